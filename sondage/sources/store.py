"""Named intermediate store: parquet tables in the session catalog under a shared root.

``save`` writes a key's rows to a new path and then points its table there, so rows
read from the old version can be saved under the same key; ``load`` returns the table
or None, ``list`` and ``delete`` manage the keys.  The catalog lower-cases table names,
so the key itself is kept as a table property.  The root defaults to a folder under
the cluster's shared checkpoint location, never a machine-local one.
"""

from __future__ import annotations

import functools
import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

KEY = "store.key"


class TableStore:
    def __init__(self, spark: SparkSession, root: str | None = None, prefix: str = "store_"):
        self.spark = spark
        self.root = (root or scratch_path(spark, "store")).rstrip("/")
        self.prefix = prefix

    def _name(self, key: str) -> str:
        # the digest keeps apart keys that differ in case or in replaced characters only
        return f"{self.prefix}{re.sub(r'[^0-9A-Za-z_]', '_', key)}_{hashlib.sha256(key.encode()).hexdigest()[:8]}".lower()

    def save(self, df: DataFrame, key: str) -> str:
        name = self._name(key)
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        quoted = key.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}' TBLPROPERTIES ('{KEY}' = '{quoted}')")
        return name

    def load(self, key: str) -> DataFrame | None:
        name = self._name(key)
        return self.spark.table(name) if self.spark.catalog.tableExists(name) else None

    def load_many(self, keys) -> DataFrame | None:
        """The rows of all present ``keys`` (by name, missing columns null) with their key in ``store_key``."""
        found = [(k, self.load(k)) for k in keys]
        frames = [df.withColumn("store_key", F.lit(k)) for k, df in found if df is not None]
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None

    def list(self) -> list[str]:
        tables = [t.name for t in self.spark.catalog.listTables() if t.name.startswith(self.prefix.lower()) and not t.isTemporary]
        found = [self.spark.sql(f"SHOW TBLPROPERTIES {t}").where(f"key = '{KEY}'").select("value").first() for t in tables]
        return sorted(r[0] for r in found if r)

    def delete(self, key: str) -> None:
        """Drop the table and delete the files of all its versions under this store's root."""
        name = self._name(key)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(conf).delete(path, True)
