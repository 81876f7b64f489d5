"""Skew-safe building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounded_collect(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[Column], value: Column,
                    out: str, salt_buckets: int = 32) -> DataFrame:
    """First ``n`` values per key by ``order``, as an array — without ever holding a whole group.

    Stage 1 ranks within (key, salt) so a hot key is spread over ``salt_buckets`` tasks and
    keeps at most ``n`` rows per salt; stage 2 ranks the <= n * salt_buckets survivors.
    """
    keys = list(keys)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    stage2 = stage1.withColumn("_r2", F.row_number().over(w2)).where(F.col("_r2") <= n)
    return (stage2.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct(F.col("_r2").alias("r"), value.alias("v")))).alias("_l"))
            .select(*keys, F.transform("_l", lambda x: x["v"]).alias(out)))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key (row_number = 1) with a total order given by the caller."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
