"""A Parquet table that is upserted by key, version by version.

Rows are in hash buckets of their key. ``upsert`` reads the buckets that the new rows touch, writes
them anew in a folder of its version, and then puts a manifest (bucket -> version) in place by a rename.
Readers take the highest manifest, so a version is seen whole or not at all, and an old one stays readable. Whether the table
exists is decided by its manifests alone; every other read error is raised.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._hadoop.Path(path)

    def versions(self) -> list[int]:
        """Versions with a manifest, in order."""
        folder = self._at(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def _manifest(self, version: int) -> dict[int, int]:
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/v{version}").collect())
        return {int(k): v for k, v in json.loads(text).items()}

    def _rows(self, places: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(places.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], self.schema)
        return self._rows(self._manifest(have[-1] if version is None else version))

    def bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], version: int) -> None:
        """Merge ``new`` into the version before ``version`` and put ``version`` in place."""
        before = [v for v in self.versions() if v < version]
        places = self._manifest(before[-1]) if before else {}
        # At most ``buckets`` rows.
        touched = [r["bucket"] for r in self.bucket(new).select("bucket").distinct().collect()]
        merged = merge(self._rows({b: places[b] for b in touched if b in places}), new)
        cols = self.schema.fieldNames()
        (self.bucket(merged.select(*cols)).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.path}/data/v{version}"))
        self._put(version, places | dict.fromkeys(touched, version))

    def _put(self, version: int, places: dict[int, int]) -> None:
        draft, final = self._at(f"{self.path}/draft/v{version}"), self._at(f"{self.path}/manifest/v{version}")
        out = self._fs.create(draft, True)
        out.write(json.dumps(places).encode())
        out.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final):  # a replay: the same version, written again
            self._fs.delete(final, False)
        if not self._fs.rename(draft, final):
            raise OSError(f"could not put version {version} of {self.path} in place")
