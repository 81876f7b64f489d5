"""S-21: the technique taxonomy as a versioned dimension, and joins with it as of a row's own time (J-06, T-14).

Releases are tables of (framework, version, released_at, technique_id): each lists all ids of its framework. ``dimension`` turns them
into validity intervals, one row per stretch of releases that hold an id, so a dimension of many releases is little longer than
its list of ids. ``versions`` names the release in force at any time over all frameworks ('atlas-4.5+attack-16.1').
An alert of last year thus meets the taxonomy of last year, also when it is read again today.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import ZONE_CONSEQUENCE

#: Releases of all frameworks that may be sent to every task as one array.
MAX_RELEASES = 10_000


def _releases(releases: DataFrame) -> DataFrame:
    """(framework, version, valid_from, valid_to, nth): one row a release."""
    w = Window.partitionBy("framework").orderBy("valid_from", "version")
    r = releases.groupBy("framework", "version").agg(F.min("released_at").alias("valid_from"))
    return r.withColumn("valid_to", F.lead("valid_from").over(w)).withColumn("nth", F.row_number().over(w))


def dimension(releases: DataFrame) -> DataFrame:
    """(framework, technique_id, valid_from, valid_to, since, until): the intervals in which an id is part of its framework;
    ``since`` and ``until`` are the first and last version of it, ``valid_to`` is null while it lasts."""
    r = _releases(releases)
    held = (releases.where(F.col("technique_id").isNotNull()).select("framework", "version", "technique_id").distinct().join(r, ["framework", "version"]))
    # Consecutive releases keep the difference of both numberings; an id has a row per release at most.
    own = Window.partitionBy("framework", "technique_id").orderBy("nth")
    held = held.withColumn("run", F.col("nth") - F.row_number().over(own))
    first, last = F.min_by("version", "nth"), F.max_by(F.struct("version", "valid_to"), "nth")
    g = held.groupBy("framework", "technique_id", "run").agg(F.min("valid_from").alias("valid_from"), first.alias("since"), last.alias("l"))
    return g.select("framework", "technique_id", "valid_from", F.col("l.valid_to").alias("valid_to"), "since", F.col("l.version").alias("until"))


def known_at(dim: DataFrame, at) -> DataFrame:
    """The ids in force at one time: the reference list of ``text.quarantine_techniques``."""
    at = at if isinstance(at, Column) else F.lit(at).cast(dim.schema["valid_from"].dataType)
    return dim.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).select("technique_id").distinct()


def versions(releases: DataFrame) -> DataFrame:
    """(valid_from, valid_to, taxonomy): the version string of all frameworks from one release to the next of any."""
    r = _releases(releases).select("framework", "version", "valid_from", "valid_to")
    at = r.select("valid_from").distinct().withColumn("upto", F.lead("valid_from").over(Window.orderBy("valid_from")))
    inside = at.alias("a").join(r.alias("r"), (F.col("r.valid_from") <= F.col("a.valid_from")) & (F.col("r.valid_to").isNull() | (F.col("r.valid_to") > F.col("a.valid_from"))))
    # One row a framework.
    named = F.array_join(F.array_sort(F.collect_list(F.concat_ws("-", "r.framework", "r.version"))), "+")
    return inside.groupBy(F.col("a.valid_from").alias("valid_from"), F.col("a.upto").alias("valid_to")).agg(named.alias("taxonomy"))


def with_version(rows: DataFrame, ts: str, releases: DataFrame) -> DataFrame:
    """``taxonomy``: the version string at each row's time, '' before the first release or without a time. The releases go to each task as
    one array; more than ``MAX_RELEASES`` are refused."""
    v = versions(releases)
    n = v.count()
    if n > MAX_RELEASES:
        raise ValueError(f"{n} releases, {MAX_RELEASES} at most")
    one = v.agg(F.array_sort(F.collect_list(F.struct("valid_from", "taxonomy"))).alias("_v"))
    hit = F.element_at(F.filter("_v", lambda x: x["valid_from"] <= F.col(ts)), -1)
    out = rows.crossJoin(F.broadcast(one))
    return out.withColumn("taxonomy", F.when(F.exists("_v", lambda x: x["valid_from"] <= F.col(ts)), hit["taxonomy"]).otherwise("")).drop("_v")


def as_of(rows: DataFrame, ts: str, technique: str, dim: DataFrame) -> DataFrame:
    """J-06 in time: ``rows`` with the ``framework``, ``since`` and ``known`` of their technique at their own time; an id not in force then is
    not known. Equi-joined on the id, of which the dimension has a row per interval; an id of two frameworks takes the first by name."""
    d = dim.select(F.col("technique_id").alias("_id"), "framework", "since", F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"))
    here = (F.col(technique) == F.col("_id")) & (F.col(ts) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(ts) < F.col("_to")))
    one = rows.select(technique, ts).distinct().join(d, here).groupBy(technique, ts).agg(F.min(F.struct("framework", "since")).alias("_d"))
    return (rows.join(one, [technique, ts], "left")
            .withColumn("framework", F.col("_d.framework")).withColumn("since", F.col("_d.since")).withColumn("known", F.col("_d").isNotNull()).drop("_d"))


def zone_table(spark: SparkSession) -> DataFrame:
    """The default zone data as a table (zone, consequence)."""
    return spark.createDataFrame(sorted(ZONE_CONSEQUENCE.items()), "zone string, consequence string")


def zone_consequences(assets: DataFrame, zones: DataFrame, zone: str = "zone", default: str = "data_loss") -> DataFrame:
    """J-14 over a table of zones: ``consequence`` of each asset's zone, ``default`` for an unknown one. A repeated zone takes its first
    consequence by name."""
    z = zones.groupBy(F.col("zone").alias("_zone")).agg(F.min("consequence").alias("_consequence"))
    return (assets.join(z, F.col(zone) == F.col("_zone"), "left")
            .withColumn("consequence", F.coalesce("_consequence", F.lit(default))).drop("_zone", "_consequence"))
