"""Keyed store with committed versions: all keys of a save in one job, readers on one version.

Rows are written to a new folder, partitioned by key, and take effect with the next
manifest, a small table (key, folder, schema) of all keys.  A save that fails before its
manifest is committed leaves the version before it in place; a reader stays on the version
it opened, whatever is saved or deleted meanwhile.  Two saves at once: the second to commit
fails, and can be repeated.  Everything lies under one root that all executors share.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

KEY = "store_key"
MANIFEST = f"{KEY} string, folder string, schema string"


class Snapshot:
    """The keys and rows of one version."""

    def __init__(self, spark: SparkSession, root: str, version: int):
        self.spark, self.root, self.version = spark, root, version

    def manifest(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{self.version:012d}")

    def list(self) -> list[str]:
        return sorted(r[0] for r in self.manifest().select(KEY).collect())

    def load(self, key: str) -> DataFrame | None:
        """The rows of ``key``, or None; only its partition is read."""
        found = self.load_many([key])
        return found.drop(KEY) if found is not None else None

    def load_many(self, keys: Iterable[str]) -> DataFrame | None:
        """The rows of all present ``keys`` with their key in ``store_key``; columns that a key lacks are null.

        Keys that were saved together are read together: a scan per save, not per key.
        """
        rows = self.manifest().where(F.col(KEY).isin(list(keys))).collect()
        scans = []
        for folder, schema in sorted({(r["folder"], r["schema"]) for r in rows}):
            kind = T.StructType.fromJson(json.loads(schema)).add(KEY, "string")
            wanted = [r[KEY] for r in rows if r["folder"] == folder]
            scans.append(self.spark.read.schema(kind).parquet(f"{self.root}/data/{folder}").where(F.col(KEY).isin(wanted)))
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans) if scans else None


class VersionedStore:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or scratch_path(spark, "versions")).rstrip("/")

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getParent().getName()) for f in found or [])

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version to read, by default the last."""
        known = self.versions()
        if version is not None and version not in known:
            raise KeyError(f"no version {version}")
        return Snapshot(self.spark, self.root, version if version is not None else known[-1] if known else 0)

    def save_all(self, df: DataFrame, key_col: str, keep_key: bool = False) -> int:
        """Replace every key in ``key_col`` by its rows, in one job; other keys stay.  Returns the new version.

        Rows without a key are an error, as is the empty key, which a folder can't tell from none.
        """
        base = self.snapshot()
        rows = df.withColumn(KEY, F.col(key_col).cast("string"))
        rows = rows.withColumn(KEY, F.when(F.length(KEY) > 0, F.col(KEY)).otherwise(F.raise_error(F.lit("a row without a key"))))
        rows = rows if keep_key else rows.drop(key_col)
        folder = uuid.uuid4().hex
        rows.write.partitionBy(KEY).parquet(f"{self.root}/data/{folder}")
        schema = T.StructType([f for f in rows.schema.fields if f.name != KEY])
        written = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(KEY, T.StringType())])).parquet(f"{self.root}/data/{folder}")
        return self._commit(base, written.select(KEY).distinct(), folder, schema)

    def save(self, df: DataFrame, key: str) -> int:
        """Replace the rows of ``key``; no rows are kept as such."""
        if not key:
            raise ValueError("a key has at least one character")
        base, folder = self.snapshot(), uuid.uuid4().hex
        df.withColumn(KEY, F.lit(key)).write.partitionBy(KEY).parquet(f"{self.root}/data/{folder}")
        return self._commit(base, self.spark.range(1).select(F.lit(key).alias(KEY)), folder, df.schema)

    def delete(self, key: str) -> int:
        """A version without ``key``; earlier versions keep it."""
        base = self.snapshot()
        return self._write(base, base.manifest().where(F.col(KEY) != key))

    def _commit(self, base: Snapshot, keys: DataFrame, folder: str, schema: T.StructType) -> int:
        new = keys.select(KEY, F.lit(folder).alias("folder"), F.lit(schema.json()).alias("schema"))
        return self._write(base, base.manifest().join(new, KEY, "left_anti").unionByName(new))

    def _write(self, base: Snapshot, manifest: DataFrame) -> int:
        version = base.version + 1
        # fails if another save has committed this version meanwhile
        manifest.coalesce(1).write.mode("error").parquet(f"{self.root}/manifests/{version:012d}")
        return version

    def load(self, key: str) -> DataFrame | None:
        return self.snapshot().load(key)

    def load_many(self, keys: Iterable[str]) -> DataFrame | None:
        return self.snapshot().load_many(keys)

    def list(self) -> list[str]:
        return self.snapshot().list()
