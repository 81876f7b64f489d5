"""ST-03: rules on a schedule over a live baseline.

A rule that compares a lookback with a baseline of the same table needs only counts per key and hour. These are kept in a
versioned table that every micro-batch adds to, so the baseline moves on with the stream and nothing older than the rule's span
is held. At each full hour (tick) that the stream's clock, the latest event, has passed since the batch before, the rule is evaluated
over the hours before the tick: the result equals the batch rule at ``now`` = tick over the events that have arrived.

Ticks of a micro-batch are evaluated together: the lookback's rows count for the ticks they are in sight of, and the baseline is a
range window over the hours of a key (as many rows as the span has hours), read off at those ticks.
A replayed micro-batch starts from the version before it and overwrites its own alerts, so it raises the same ones.
An event that comes in after its tick counts from the next tick on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.exprs import epoch_seconds
from tidewatch.operators import rules as R
from tidewatch.sources.versioned import VersionedTable


@dataclass(frozen=True)
class LiveRule:
    """``keys`` are compared with themselves; ``member`` is what is counted distinct in the lookback; hours before a tick:
    ``lookback`` of them are current, the rest up to ``span`` are baseline, of ``slots`` units."""

    keys: tuple[str, ...]
    member: str
    lookback: int
    span: int
    slots: float
    names: tuple[str, str]
    fired: Callable[[DataFrame], DataFrame]
    where: Column | None = None

    def hourly(self, events: DataFrame, ts: str) -> DataFrame:
        """Counts by (keys, member, hour since the epoch)."""
        rows = events if self.where is None else events.where(self.where)
        return (rows.groupBy(*self.keys, F.col(self.member).cast("string").alias("member"), F.floor(epoch_seconds(F.col(ts)) / 3600).alias("hour"))
                .agg(F.count(F.lit(1)).alias("n")))

    def evaluate(self, counts: DataFrame, first: int, last: int) -> DataFrame:
        """The rule's detections at the ticks ``first`` to ``last`` (hours since the epoch)."""
        keys = list(self.keys)
        lo, hi = F.greatest(F.col("hour") + 1, F.lit(first)), F.least(F.col("hour") + self.lookback, F.lit(last))
        current = (counts.where((lo <= hi)).withColumn("tick", F.explode(F.sequence(lo, hi)))
                   .groupBy(*keys, "tick").agg(F.sum("n").alias(self.names[0]), F.count_distinct("member").alias(self.names[1])))
        sums = counts.where((F.col("hour") >= first - self.span) & (F.col("hour") < last)).groupBy(*keys, "hour").agg(F.sum("n").alias("n"))
        probes = current.select(*keys, F.col("tick").alias("hour"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("probe"))
        before = Window.partitionBy(*keys).orderBy("hour").rangeBetween(-self.span, -self.lookback - 1)
        base = (sums.withColumn("probe", F.lit(False)).unionByName(probes).withColumn("past", F.coalesce(F.sum("n").over(before), F.lit(0)))
                .where("probe").select(*keys, F.col("hour").alias("tick"), (F.col("past") / F.lit(float(self.slots))).alias("baseline_avg")))
        return self.fired(current.join(base, [*keys, "tick"]))


def poisoning_rule(actions=R.SUSPICIOUS_ACTIONS, **thresholds) -> LiveRule:
    """D-01 with its daily baseline of 30 days."""
    return LiveRule(("tenant_id", "user_id"), "target_resource", 24, 30 * 24, 30.0, ("count", "distinct_tables"),
                    lambda g: R.poisoning_fired(g, **thresholds), F.col("action").isin(*actions))


def flood_rule(baseline_days: int = 7, lookback_hours: int = 6, **thresholds) -> LiveRule:
    """D-08 for all alerts together (``tenants`` counts those of the lookback)."""
    return LiveRule(("scope",), "tenant_id", lookback_hours, baseline_days * 24, baseline_days * 24.0 / lookback_hours, ("current_count", "tenants"),
                    lambda g: R.flood_fired(g, **thresholds))


def all_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("scope", F.lit("all"))


def history(events: DataFrame, ts: str, rule: LiveRule, first: int, last: int) -> DataFrame:
    """Batch twin: the rule at every full hour from ``first`` to ``last``."""
    seen = events.where((epoch_seconds(F.col(ts)) >= (first - rule.span) * 3600) & (epoch_seconds(F.col(ts)) < last * 3600))
    return rule.evaluate(rule.hourly(seen, ts), first, last)


def start_live_rule(events: DataFrame, ts: str, rule: LiveRule, table_path: str, alerts_path: str, checkpoint: str, trigger: dict | None = None):
    """Run a rule over a stream; alerts of a micro-batch are at ``alerts_path/batch_id=N``, each with its ``tick``."""
    fields = [T.StructField(k, T.StringType()) for k in (*rule.keys, "member")] + [T.StructField("hour", T.LongType()), T.StructField("n", T.LongType())]
    schema = T.StructType([T.StructField("key", T.StringType()), *fields])
    names = [f.name for f in fields[:-1]]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = VersionedTable(spark, table_path, "key", schema)
        earlier = [v for v in table.versions() if v < batch_id]
        before = table.read(earlier[-1]).agg(F.max("hour")).first()[0] if earlier else None
        new = rule.hourly(batch, ts).select(F.concat_ws("\u0001", *rule.keys).alias("key"), *[F.col(c).cast("string").alias(c) for c in names[:-1]], "hour", "n")
        newest = new.agg(F.max("hour")).first()[0]
        oldest = max(x for x in (before, newest, 0) if x is not None) - rule.span

        def add(old: DataFrame, more: DataFrame) -> DataFrame:
            return old.unionByName(more).where(F.col("hour") >= oldest).groupBy("key", *names).agg(F.sum("n").alias("n"))

        table.upsert(new, add, batch_id)
        counts = table.read(batch_id).drop("key")
        first, last = (before if before is not None else counts.agg(F.min("hour")).first()[0]), newest
        if first is None or last is None:
            first, last = 0, -1
        rule.evaluate(counts, first + 1, last).write.mode("overwrite").parquet(f"{alerts_path}/batch_id={batch_id}")

    q = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return q.trigger(**(trigger or {"availableNow": True})).start()
