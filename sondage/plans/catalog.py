"""Imports every query module so the registry is complete."""

from __future__ import annotations

import functools

from ..session import ensure_checkpoint_dir, ship_package

from . import cleaning, discovery, drivers, io, pivots, sensory, summaries, tests, text  # noqa: F401
from .registry import REGISTRY, oracle_text


def _prepared(build):
    @functools.wraps(build)
    def run(spark, sf_dir):
        ship_package(spark)
        ensure_checkpoint_dir(spark)
        return build(spark, sf_dir)
    return run


def queries():
    return {k: _prepared(q.build) for k, q in REGISTRY.items()}


def oracle_sql():
    return {k: oracle_text(q) for k, q in REGISTRY.items() if q.oracle is not None}
