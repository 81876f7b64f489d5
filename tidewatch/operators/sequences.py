"""Sequence operators over event logs: trailing-window quotas (W-11, W-12), consecutive
failure runs (W-14), silent-source gaps (ST-11 batch twin), sequential escalation budget
(ST-05 batch twin) and dual-trigger batching (ST-06 batch twin).

Trailing windows are partitioned by (key, bucket), a bucket being eight window lengths, with a
*halo*: rows of the last window length of each bucket are copied into the next bucket and used only as
context. A key holding a third of all rows is thereby split finely instead of being sorted in one task; the result
equals the unpartitioned window exactly.

The two sequential policies (a grant depends on earlier grants) stream rows in time order through
``mapInPandas`` carrying O(1) state (at most ``limit`` timestamps, or one open batch), never a whole
group. The budget streams only the rows that could be granted, and a key is cut wherever a whole window has none of
them: grants before such a gap have expired after it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.exprs import epoch_seconds
from tidewatch.session import ship_package

# Fixed values (must equal the reference)
TENANT_HOURLY_QUOTA = {"premium": 500, "standard": 100, "trial": 20}
PRIORITY_MINUTE_LIMIT = {"critical": 200, "high": 100, "normal": 50, "low": 20}
FAILURE_THRESHOLD, RECOVERY_SECONDS = 5, 30
MAX_ESCALATIONS_PER_HOUR, ESCALATION_CONFIDENCE, ESCALATION_SEVERITIES = 10, 0.6, ("critical", "high")
BATCH_COUNT_THRESHOLD, BATCH_TIME_THRESHOLD_HOURS = 50, 6


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int, out: str = "trailing_count") -> DataFrame:
    """Rows of the same key within ``[ts - seconds, ts]`` (inclusive, like rangeBetween(-s, 0))."""
    span = 8 * seconds
    e = df.withColumn("_t", epoch_seconds(F.col(ts))).withColumn("_bucket", F.floor(F.col("_t") / span))
    halo = (e.where(F.col("_t") - F.col("_bucket") * span >= span - seconds)
            .withColumn("_bucket", F.col("_bucket") + 1).withColumn("_halo", F.lit(True)))
    u = e.withColumn("_halo", F.lit(False)).unionByName(halo)
    w = Window.partitionBy(key, "_bucket").orderBy("_t").rangeBetween(-seconds, 0)
    return u.withColumn(out, F.count(F.lit(1)).over(w)).where(~F.col("_halo")).drop("_t", "_bucket", "_halo")


def quota_check(df: DataFrame, key: str, ts: str, seconds: int, limit_col, out: str = "over_quota") -> DataFrame:
    """W-11/W-12: trailing count vs a per-row limit."""
    t = trailing_count(df, key, ts, seconds)
    return t.withColumn(out, F.col("trailing_count") > limit_col)


def failure_runs(df: DataFrame, key: str, ts: str, ok_col: str, tie: str,
                 threshold: int = FAILURE_THRESHOLD) -> DataFrame:
    """W-14: length of the current run of consecutive failures per key and whether the breaker
    is open (run >= threshold).

    A row's place less that of the last success before it, inside (key, day) partitions, by one sort; a run that crosses midnight gets a carry-in
    computed on the per-day summary (one row per key-day), so no task sees a key's whole history.
    """
    e = df.withColumn("_day", F.floor(epoch_seconds(F.col(ts)) / 86400))
    w = Window.partitionBy(key, "_day").orderBy(ts, tie)
    cum = w.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("_at", F.row_number().over(w))
    e = e.withColumn("_succeeded", F.max(F.when(F.col(ok_col), F.col("_at"))).over(cum))
    e = e.withColumn("_run", F.col("_at").cast("bigint") - F.coalesce("_succeeded", F.lit(0)))
    day = e.groupBy(key, "_day").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_succeeded").alias("_succ"),
        F.max_by("_run", F.struct(ts, tie)).alias("_trail"))
    wd = Window.partitionBy(key).orderBy("_day")
    prev = wd.rowsBetween(Window.unboundedPreceding, -1)
    day = (day.withColumn("_ncum", F.sum("_n").over(wd.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("_last_succ", F.max(F.when(F.col("_succ") > 0, F.col("_day"))).over(prev)))
    anchor = day.select(key, F.col("_day").alias("_last_succ"), F.col("_trail").alias("_a_trail"),
                        F.col("_ncum").alias("_a_ncum"))
    before = day.select(key, "_day", (F.col("_ncum") - F.col("_n")).alias("_before"), "_last_succ")
    carry = (before.join(anchor, [key, "_last_succ"], "left")
             .select(key, "_day", F.when(F.col("_last_succ").isNull(), F.col("_before"))
                     .otherwise(F.col("_a_trail") + F.col("_before") - F.col("_a_ncum")).alias("_carry")))
    out = e.join(carry, [key, "_day"], "left").withColumn(
        "failure_run", F.col("_run") + F.when(F.col("_succeeded").isNull(), F.coalesce("_carry", F.lit(0))).otherwise(0))
    return out.withColumn("breaker_open", F.col("failure_run") >= threshold) \
        .drop("_day", "_at", "_succeeded", "_run", "_carry")


def silent_gaps(df: DataFrame, key: str, ts: str, bucket_seconds: int = 3600) -> DataFrame:
    """ST-11 batch twin: per source, stretches of empty buckets between active ones (lag over the
    distinct active buckets; no grid of sources x hours is built)."""
    b = df.select(key, F.floor(epoch_seconds(F.col(ts)) / bucket_seconds).alias("_b")).distinct()
    w = Window.partitionBy(key).orderBy("_b")
    g = b.withColumn("_prev", F.lag("_b").over(w)).where(F.col("_b") - F.col("_prev") > 1)
    return g.select(key, ((F.col("_prev") + 1) * bucket_seconds).cast("timestamp").alias("silent_from"),
                    (F.col("_b") * bucket_seconds).cast("timestamp").alias("silent_until"),
                    (F.col("_b") - F.col("_prev") - 1).alias("silent_buckets"))


def bucket_counts(df: DataFrame, key: str, ts: str, width: str = "1 hour") -> DataFrame:
    """ST-11 rate: tumbling-window counts per key (the streaming form adds a watermark)."""
    return df.groupBy(key, F.window(ts, width)).agg(F.count(F.lit(1)).alias("count")) \
        .select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "count")


# ---------------------------------------------------------------------------
# Sequential policies, streamed per key
# ---------------------------------------------------------------------------

def _budget_stream(limit: int, window_s: float):
    """Rows sorted by (key, segment, time), all of which ask for a grant."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, grants = None, deque()
        for pdf in it:
            granted = []
            for key, segment, t in zip(pdf["_key"], pdf["_segment"], pdf["_t"]):
                if (key, segment) != now:
                    now, grants = (key, segment), deque()
                while grants and t - grants[0] >= window_s:
                    grants.popleft()
                granted.append(len(grants) < limit)
                if granted[-1]:
                    grants.append(t)
            out = pdf.drop(columns=["_key", "_segment", "_t"])
            out["escalated"] = granted
            yield out
    return run


def escalation_budget(df: DataFrame, key: str, ts: str, confidence: str, severity: str, *,
                      limit: int = MAX_ESCALATIONS_PER_HOUR, window_seconds: int = 3600,
                      confidence_threshold: float = ESCALATION_CONFIDENCE, order_cols: tuple[str, ...] = (),
                      partitions: int | None = None) -> DataFrame:
    """ST-05 batch twin: escalate low-confidence critical/high rows while fewer than ``limit``
    escalations were GRANTED for the key in the trailing hour (denied ones do not count)."""
    spark = df.sparkSession
    ship_package(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    asks = F.coalesce((F.col(confidence).cast("double") < confidence_threshold) & F.col(severity).isin(*ESCALATION_SEVERITIES), F.lit(False))
    e = df.where(asks).select("*", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), epoch_seconds(F.col(ts)).alias("_t"))
    e = e.withColumn("_bucket", F.floor(F.col("_t") / window_seconds))
    # One row per key and window length with a request: where the one before is empty, a segment begins.
    w = Window.partitionBy("_key").orderBy("_bucket")
    b = e.select("_key", "_bucket").distinct().withColumn("_new", F.when(F.col("_bucket") - F.lag("_bucket").over(w) == 1, 0).otherwise(1))
    b = b.withColumn("_segment", F.sum("_new").over(w)).drop("_new")
    e = (e.join(b, ["_key", "_bucket"]).drop("_bucket").repartition(n, "_key", "_segment")
         .sortWithinPartitions("_key", "_segment", "_t", *order_cols).select(*df.columns, "_key", "_segment", "_t"))
    schema = T.StructType(df.schema.fields + [T.StructField("escalated", T.BooleanType())])
    granted = e.mapInPandas(_budget_stream(limit, float(window_seconds)), schema)
    return granted.unionByName(df.where(~asks).withColumn("escalated", F.lit(False)))


def _batch_stream(count_threshold: int, time_s: float):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[str, list] = {}   # key -> [batch_no, size, last_flush_t]
        for pdf in it:
            ids, reasons = [], []
            for key, t in zip(pdf["_key"], pdf["_t"]):
                st = state.get(key)
                if st is None:
                    st = state[key] = [0, 0, t]
                elif st[1] > 0 and t - st[2] >= time_s:
                    # time trigger fired before this item: the open batch closed at a tick
                    st[0], st[1], st[2] = st[0] + 1, 0, t
                st[1] += 1
                ids.append(st[0])
                if st[1] >= count_threshold:
                    reasons.append("count")
                    st[0], st[1], st[2] = st[0] + 1, 0, t
                else:
                    reasons.append(None)
            out = pdf.drop(columns=["_key", "_t"])
            out["batch_no"] = ids
            out["closed_by_count"] = [r == "count" for r in reasons]
            yield out
    return run


def dual_trigger_batches(df: DataFrame, key: str, ts: str, *, count_threshold: int = BATCH_COUNT_THRESHOLD,
                         time_threshold_hours: float = BATCH_TIME_THRESHOLD_HOURS, order_cols: tuple[str, ...] = (),
                         partitions: int | None = None) -> DataFrame:
    """ST-06 batch twin: consecutive items per key form a batch that closes at ``count_threshold``
    items, or when an item arrives ``time_threshold_hours`` after the last flush."""
    ship_package(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = df.select("*", F.col(key).cast("string").alias("_key"), epoch_seconds(F.col(ts)).alias("_t"))
    e = e.repartition(n, "_key").sortWithinPartitions("_key", "_t", *order_cols)
    schema = T.StructType(df.schema.fields + [T.StructField("batch_no", T.LongType()),
                                              T.StructField("closed_by_count", T.BooleanType())])
    return e.mapInPandas(_batch_stream(count_threshold, time_threshold_hours * 3600.0), schema)


class Batcher:
    """ST-06 for one key: items in time order, and a clock. The open batch closes with its ``count``-th item, or when
    ``limit`` seconds have passed since the flush before it (its first item, where there is none); a batch that is begun
    after that closes at once. ``state`` is (started, batch_no, size, opened, flushed), all that goes on."""

    def __init__(self, count: int, limit: float, state: tuple | None = None):
        self.count, self.limit = count, limit
        self.started, self.no, self.size, self.opened, self.flushed = state or (None, 0, 0, None, None)

    @property
    def state(self) -> tuple:
        return self.started, self.no, self.size, self.opened, self.flushed

    @property
    def due(self) -> float | None:
        """When the clock closes the open batch."""
        return max(self.flushed + self.limit, self.opened) if self.size else None

    def _close(self, at: float, by: str, flushed: float | None) -> tuple:
        closed = (self.started, self.no, self.size, self.opened, at, by)
        self.no, self.size, self.opened, self.flushed = self.no + 1, 0, None, flushed
        return closed

    def tick(self, now: float) -> list[tuple]:
        """The batch that the clock has closed by ``now``: (started, batch_no, size, opened, closed, closed_by)."""
        # The next flush is counted from the next item.
        return [self._close(self.due, "time", None)] if self.size and self.due <= now else []

    def add(self, t: float) -> list[tuple]:
        """One more item; the batches that close before it or with it."""
        closed = self.tick(t)
        self.started = t if self.started is None else self.started
        self.flushed = t if self.flushed is None else self.flushed
        self.opened = t if not self.size else self.opened
        self.size += 1
        if self.size >= self.count:
            closed.append(self._close(t, "count", t))
        return closed


CLOSURE_COLS = "started_at timestamp, batch_no long, size long, opened_at timestamp, closed_at timestamp, closed_by string"


def closure_frame(keys: list, closed: list[tuple], key_col: str) -> pd.DataFrame:
    """Closed batches as rows of (key, CLOSURE_COLS)."""
    started, no, size, opened, at, by = (list(x) for x in zip(*closed)) if closed else ([],) * 6
    when = {n: pd.to_datetime(pd.Series(v, dtype="float64").mul(1e6).round().astype("int64"), unit="us")
            for n, v in (("started_at", started), ("opened_at", opened), ("closed_at", at))}
    return pd.DataFrame({key_col: pd.Series(keys, dtype="object"), "started_at": when["started_at"], "batch_no": pd.Series(no, dtype="int64"),
                         "size": pd.Series(size, dtype="int64"), "opened_at": when["opened_at"], "closed_at": when["closed_at"],
                         "closed_by": pd.Series(by, dtype="object")})


def batch_closures(df: DataFrame, key: str, ts: str, now, *, count_threshold: int = BATCH_COUNT_THRESHOLD,
                   time_threshold_hours: float = BATCH_TIME_THRESHOLD_HOURS, partitions: int | None = None) -> DataFrame:
    """ST-06 as seen by a clock that stands at ``now``: one row per batch that is closed by then, by count or by time; an idle
    batch closes without a further item. Rows of a key are streamed in time order with the state of one batch."""
    spark = df.sparkSession
    ship_package(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).cast("string").alias("_key"), epoch_seconds(F.col(ts)).alias("_t")).where("_key is not null and _t is not null")
    clock = epoch_seconds(F.lit(now).cast("timestamp_ntz"))
    rows = rows.where(F.col("_t") <= clock).withColumn("_now", clock).repartition(n, "_key").sortWithinPartitions("_key", "_t")
    limit = time_threshold_hours * 3600.0

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, batcher, clock = None, None, None
        for pdf in it:
            keys, closed = [], []

            def report(found):
                keys.extend([at] * len(found))
                closed.extend(found)

            for k, t, clock in zip(pdf["_key"], pdf["_t"], pdf["_now"]):
                if k != at:
                    if batcher:
                        report(batcher.tick(clock))
                    at, batcher = k, Batcher(count_threshold, limit)
                report(batcher.add(t))
            yield closure_frame(keys, closed, key)
        if batcher:
            last = batcher.tick(clock)
            yield closure_frame([at] * len(last), last, key)

    return rows.mapInPandas(run, f"`{key}` string, {CLOSURE_COLS}")


def zip_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """J-17: batch results matched to tasks by position within the job (full outer join on
    (job_id, pos)); a result that is not a valid success, or has no task at its position, is an
    error; otherwise the task type decides the outcome."""
    j = results.join(tasks, ["job_id", "pos"], "left")
    ok = (F.col("status") == "success") & F.coalesce(F.col("valid"), F.lit(False))
    outcome = (F.when(~ok, "error").when(F.col("task_type").isNull(), "error")
               .when(F.col("task_type") == "fp_pattern_generation", "fp_pattern_stored")
               .when(F.col("task_type") == "playbook_generation", "playbook_published").otherwise("error"))
    return j.withColumn("outcome", outcome)


def result_summary(zipped: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A-36: stored / published / error counts."""
    return zipped.groupBy(*keys).agg(F.count_if(F.col("outcome") == "fp_pattern_stored").alias("fp_patterns_stored"),
                                     F.count_if(F.col("outcome") == "playbook_published").alias("playbooks_published"),
                                     F.count_if(F.col("outcome") == "error").alias("errors"))
