"""Sharding by jump consistent hashing, in DataFrame functions alone.

A key's shard comes from a pseudo-random sequence seeded by the key: starting at shard 0, it jumps
ahead while the next jump stays below the number of shards. No ring table is kept, and with one
more shard a key either stays or moves into the new one, so ``doc_id`` and the shard count decide (law ``key``).

The sequence is the 64-bit generator of the published algorithm, ``x <- x * MULTIPLIER + 1 (mod 2^64)``,
of which the upper 31 bits are used. Its i-th value is ``key * MULTIPLIER^i + c_i``, so each value is computed
directly from the key's four 16-bit parts with products below 2^50: exact in long arithmetic in ANSI mode as
well, without overflow. No Python runs on the executors.

``slot`` numbers a shard's rows from 0 without gaps. A shard may hold a large part of all rows, so it is
numbered in ``BUCKETS`` hash buckets: a row's slot is the rows of the buckets before plus its rank in its own
bucket by (doc_id, crc, size). The table of bucket counts has shards x BUCKETS rows at most, by construction, and is
broadcast.

Cases: null text has size 1 and crc 0; a null id is treated as key 0; repeated rows share a shard and
get slots of their own; equal texts (groups) go where their own ids lead; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MULTIPLIER = 2862933555777941757
BUCKETS = 256
MASK = 0xFFFFFFFF


def _draws(key: Column, n: int) -> list[Column]:
    """The upper 31 bits of the first ``n`` values of the generator seeded with ``key``."""
    parts = [F.shiftrightunsigned(key, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    out, a, c = [], 1, 0
    for _ in range(n):
        a, c = a * MULTIPLIER % 2**64, (c * MULTIPLIER + 1) % 2**64
        low = high = None
        for k, p in enumerate(parts):
            w = (a << 16 * k) % 2**64
            lo, hi = p * F.lit(w & MASK), p * F.lit(w >> 32)
            low, high = (lo, hi) if low is None else (low + lo, high + hi)
        low, high = low + F.lit(c & MASK), high + F.lit(c >> 32)
        word = (high + F.shiftright(low, 32)).bitwiseAND(F.lit(MASK))
        out.append(F.shiftright(word, 1))
    return out


def jump(draws: Column, shards: int) -> Column:
    """The shard for an array of draws (as many as there are shards, at least)."""
    def step(at, draw):
        ahead = F.floor((at["next"] + 1) * (F.lit(float(2**31)) / (draw + 1))).cast("long")
        return F.when(at["next"] < shards, F.struct(at["next"].alias("shard"), ahead.alias("next"))).otherwise(at)

    start = F.struct(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.slice(draws, 1, shards), start, step)["shard"]


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    bytes_ = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    placed = (docs.select("doc_id", (F.octet_length(bytes_).cast("long") + 1).alias("size"), F.crc32(bytes_).alias("text_crc32"),
                          F.array(*_draws(key, shards + 1)).alias("draws"))
              .select("doc_id", "size", "text_crc32", jump(F.col("draws"), shards).alias("shard"),
                      jump(F.col("draws"), shards + 1).alias("grown"),
                      (F.col("draws")[0] % BUCKETS).alias("bucket")))
    ids = (docs.select(F.array(*_draws(key, shards)).alias("draws"))
           .select(jump(F.col("draws"), shards).alias("shard"), (F.col("draws")[0] % BUCKETS).alias("bucket")))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # shards x BUCKETS rows at most.
    starts = (ids.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
              .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    rank = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (placed.withColumn("rank", F.row_number().over(rank))
            .join(F.broadcast(starts), ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.col("base") + F.col("rank") - 1).alias("slot"), F.col("grown").cast("int").alias("grown_shard")))
