"""Operators of a training-data pipeline, one module per method.

Nothing outside this folder imports it.  ``queries.py`` registers one query per
operator (``op1_`` to ``op13_``) and the whole pipeline.
"""
