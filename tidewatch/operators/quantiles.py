"""Exact order statistics per key for keys of any size (A-04, A-05, A-39, D-02, E-02).

A percentile is found by refining a histogram, not by gathering a key's values: values are counted in ``BINS`` equal cells with
map-side sums, the cell that holds the wanted rank is known from the running counts of a key's cells, and only cells of more than
``LIMIT`` values are cut again, between their own least and greatest value. A cell of one value is that value; a cell of up to
``LIMIT`` values is ranked. So a task sees at most ``LIMIT`` values or ``BINS`` counts of one key, whatever the key holds. The least and
the greatest value of a cell never share a finer one, so refining ends. The first cells are equal on a scale of logarithms, so one
huge value does not leave all others in one cell; a cell there spans a factor of 17 at most, and 53 bits are refined in six
passes beyond it, whatever the values. Two passes do for 10 million values spread evenly.

``gaps`` gives the time since the row before of the same key, over ranges of time: within a range by its own rows, from one
range to the next by a carry of each range's last time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import checkpoint_dir

BINS, LIMIT = 1024, 10_000


def _key(keys: Sequence[str]) -> Column:
    """One column that equals where all keys do, nulls included."""
    return F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("")


def _magnitude(v: Column) -> Column:
    """Grows with a value, by the logarithm of its size."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.abs(v)) + 746))


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """The cell of a value between ``lo`` and ``hi``; halves, so that the width of any two doubles is finite."""
    at = F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS)
    return F.when(hi > lo, F.greatest(F.lit(0), F.least(F.lit(BINS - 1), at))).otherwise(0).cast("string")


def _placed(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(_k, _parent, _pos, _base) -> the child cell that holds each rank, with the count below it."""
    cells = rows.groupBy("_k", "_parent", "_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    before = Window.partitionBy("_k", "_parent").orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # BINS cells of a parent at most
    at = F.col("_base") + F.col("_before")
    return (wanted.join(cells, ["_k", "_parent"]).where((F.col("_pos") >= at) & (F.col("_pos") < at + F.col("_n")))
            .select("_k", "_pos", at.alias("_base"), "_cell", "_n", "_lo", "_hi"))


def _ranked(small: DataFrame, rows: DataFrame) -> DataFrame:
    """The values at the ranks of cells with up to ``LIMIT`` values."""
    mine = rows.join(small.select("_k", "_cell").distinct(), ["_k", "_cell"], "left_semi")
    mine = mine.withColumn("_r", F.row_number().over(Window.partitionBy("_k", "_cell").orderBy("_v")) - 1)
    return small.join(mine, ["_k", "_cell"]).where(F.col("_base") + F.col("_r") == F.col("_pos")).select("_k", "_pos", F.col("_v").alias("value"))


def add_percentiles(groups: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float]) -> DataFrame:
    """``groups`` (one row per ``keys``) with a column per fraction: the exact percentile of ``value`` over the key's ``rows``, interpolated
    as PERCENTILE_CONT does; null where a key has no finite value. Values that are null, NaN or infinite do not count."""
    checkpoint_dir(rows.sparkSession)
    v = rows.select(_key(keys).alias("_k"), F.col(value).cast("double").alias("_v")).where(F.abs("_v") < float("inf"))
    whole = v.agg(F.min("_v"), F.max("_v")).first()
    if whole[0] is None:
        return groups.withColumns({c: F.lit(None).cast("double") for c in fractions})
    v = v.withColumn("_parent", F.lit("")).withColumn("_cell", _bin(_magnitude(F.col("_v")), *[_magnitude(F.lit(x)) for x in whole]))
    n = v.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    at = {c: F.lit(float(p)) * (F.col("_n") - 1) for c, p in fractions.items()}
    ranks = F.array_distinct(F.array(*[f(a).cast("long") for a in at.values() for f in (F.floor, F.ceil)]))
    wanted = n.select("_k", F.lit("").alias("_parent"), F.explode(ranks).alias("_pos"), F.lit(0).cast("long").alias("_base"))
    found = []
    while True:
        placed = _placed(wanted, v).checkpoint()
        one, big = F.col("_lo") == F.col("_hi"), F.col("_n") > LIMIT
        found.append(placed.where(one).select("_k", "_pos", F.col("_lo").alias("value")))
        found.append(_ranked(placed.where(~one & ~big), v))
        large = placed.where(~one & big)
        if large.isEmpty():
            break
        wanted = large.select("_k", F.col("_cell").alias("_parent"), "_pos", "_base")
        spans = large.select("_k", "_cell", "_lo", "_hi").distinct()
        v = (v.join(spans, ["_k", "_cell"]).withColumn("_parent", F.col("_cell"))
             .withColumn("_cell", F.concat_ws(".", "_cell", _bin(F.col("_v"), F.col("_lo"), F.col("_hi")))).select("_k", "_v", "_parent", "_cell"))
    values = reduce(DataFrame.unionByName, found).join(n, "_k")
    cols = []
    for c, a in at.items():
        low, high = (F.max(F.when(F.col("_pos") == f(a).cast("long"), F.col("value"))) for f in (F.floor, F.ceil))
        share = F.max(a - F.floor(a))
        cols.append((low + (high - low) * share).alias(c))
    return groups.withColumn("_k", _key(keys)).join(values.groupBy("_k").agg(*cols), "_k", "left").drop("_k")


def gaps(rows: DataFrame, keys: Sequence[str], micros: Column, range_seconds: int = 60) -> DataFrame:
    """``rows`` with ``gap_us``: microseconds since the key's row before, null for its first."""
    e = rows.withColumn("_k", _key(keys)).withColumn("_us", micros).withColumn("_range", F.floor(F.col("_us") / (range_seconds * 1_000_000)))
    last = e.groupBy("_k", "_range").agg(F.max("_us").alias("_last"))
    # One row per key and range with rows.
    carry = last.select("_k", "_range", F.lag("_last").over(Window.partitionBy("_k").orderBy("_range")).alias("_carry"))
    own = F.lag("_us").over(Window.partitionBy("_k", "_range").orderBy("_us"))
    return (e.withColumn("_own", own).join(carry, ["_k", "_range"])
            .withColumn("gap_us", F.col("_us") - F.coalesce("_own", "_carry")).drop("_k", "_us", "_range", "_own", "_carry"))
