"""Structured Streaming twins of the batch operators (ST-01 .. ST-11).

Each function takes a streaming DataFrame and returns a streaming DataFrame (or starts a
``foreachBatch`` query for the sinks that need two outputs / idempotent upserts). The
transformations are the same column expressions and operators as the batch path, so a
stream and its batch twin agree on the same rows (see tests/test_streaming.py).

State is bounded by construction: chain heads are two values per tenant (or rows of a stored table), the
escalation budget keeps at most ``limit`` grant times per key, batching keeps one open batch per key,
windows and de-duplication are bounded by watermarks. Budgets and batches set event-time timers: a
batch nobody adds to closes by the clock, and a key that has been idle longer than its rows can matter leaves no state.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tidewatch.functions.exprs import epoch_seconds
from tidewatch.operators import audit as AU
from tidewatch.operators import exposure as EX
from tidewatch.operators import sequences as SQ
from tidewatch.session import ship_package
from tidewatch.sources.versioned import VersionedTable

# ---------------------------------------------------------------------------
# ST-01 / ST-02 / S-09 sinks with dead letters
# ---------------------------------------------------------------------------


def split_write(good_path: str, reject_path: str, splitter: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
                fmt: str = "parquet"):
    """``foreachBatch`` writer: split each micro-batch into good rows and rejects and write both.

    Writes go to ``.../batch_id=N`` with overwrite, so a replayed batch (at-least-once
    delivery after a failure) replaces its own output instead of duplicating it.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = splitter(batch)
        good.write.mode("overwrite").format(fmt).save(f"{good_path}/batch_id={batch_id}")
        bad.write.mode("overwrite").format(fmt).save(f"{reject_path}/batch_id={batch_id}")
    return write


def parse_alerts(raw: DataFrame, schema: T.StructType, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """ST-01/S-08/P-01: JSON alert text -> typed rows; malformed or invalid rows -> rejects with a reason."""
    parsed = raw.select(F.col(value_col).alias("raw"), F.from_json(F.col(value_col), schema).alias("a"))
    sev_ok = F.lower(F.col("a.severity")).isin("critical", "high", "medium", "low", "informational")
    ts_ok = F.try_to_timestamp(F.regexp_replace(F.col("a.timestamp"), "Z$", "")).isNotNull()
    ok = F.col("a").isNotNull() & F.col("a.alert_id").isNotNull() & sev_ok & ts_ok
    good = parsed.where(ok).select("a.*")
    bad = parsed.where(~F.coalesce(ok, F.lit(False))).select(
        "raw", F.when(F.col("a").isNull() | F.col("a.alert_id").isNull(), "parse_error")
        .when(~sev_ok, "invalid_severity").otherwise("invalid_timestamp").alias("error"))
    return good, bad


def start_alert_stream(raw_stream: DataFrame, schema: T.StructType, good_path: str, reject_path: str,
                       checkpoint: str, trigger: dict | None = None):
    """ST-01: raw alert JSON stream -> normalised table + dead-letter table, checkpointed."""
    w = split_write(good_path, reject_path, lambda b: parse_alerts(b, schema))
    q = raw_stream.writeStream.foreachBatch(w).option("checkpointLocation", checkpoint)
    return q.trigger(**(trigger or {"availableNow": True})).start()


def start_finding_stream(findings_stream: DataFrame, table_path: str, reject_path: str, checkpoint: str,
                         trigger: dict | None = None):
    """ST-02: findings -> normalise -> upsert into the exposure table (idempotent by key) + rejects.

    The table is versioned (``sources.versioned``): a micro-batch rewrites the key buckets it
    touches beside the old ones, and the new version counts once its manifest is in place. A failed read or
    write fails the batch and leaves the table as it was; a replayed batch starts from the version before it.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = EX.dispatch(batch)
        bad.write.mode("overwrite").parquet(f"{reject_path}/batch_id={batch_id}")
        table = VersionedTable(batch.sparkSession, table_path, "exposure_key", good.drop("finding_id").schema)
        table.upsert(good, lambda old, new: EX.upsert_exposures(old, new).drop("change"), batch_id)
    q = findings_stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return q.trigger(**(trigger or {"availableNow": True})).start()


# ---------------------------------------------------------------------------
# ST-03 / ST-07 / ST-08 / ST-09 / ST-11 stateless-or-windowed transforms
# ---------------------------------------------------------------------------

def sliding_counts(events: DataFrame, key: str, ts: str, lookback: str, frequency: str,
                   watermark: str = "1 hour") -> DataFrame:
    """ST-03: rule evaluated every ``frequency`` over the last ``lookback`` (sliding window)."""
    return (events.withWatermark(ts, watermark)
            .groupBy(key, F.window(ts, lookback, frequency)).agg(F.count(F.lit(1)).alias("count"))
            .select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "count"))


def dedupe_alerts(alerts: DataFrame, key: str = "alert_id", ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """ST-07: drop repeated alert ids within the watermark (late duplicates are dropped)."""
    return alerts.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def pair_decisions(shadow: DataFrame, analyst: DataFrame, within: str = "14 days",
                   watermark: str = "1 day") -> DataFrame:
    """ST-08: stream-stream inner join of shadow and analyst decisions on the investigation,
    bounded in time so both sides' state can be dropped."""
    s = shadow.withWatermark("shadow_ts", watermark).alias("s")
    a = analyst.withWatermark("analyst_ts", watermark).alias("a")
    cond = (F.col("s.investigation_id") == F.col("a.investigation_id")) & \
        (F.col("a.analyst_ts") >= F.col("s.shadow_ts") - F.expr(f"INTERVAL {within}")) & \
        (F.col("a.analyst_ts") <= F.col("s.shadow_ts") + F.expr(f"INTERVAL {within}"))
    return s.join(a, cond, "inner")


# Fixed values (must equal the reference): severity -> work queue.
SEVERITY_TOPIC = {"critical": "jobs.llm.priority.critical", "high": "jobs.llm.priority.high",
                  "medium": "jobs.llm.priority.normal", "low": "jobs.llm.priority.low",
                  "informational": "jobs.llm.priority.low"}


def route_by_severity(alerts: DataFrame, severity: str = "severity") -> DataFrame:
    """ST-09/P-21: a ``topic`` column per row; a Kafka sink writes each row to its topic."""
    from tidewatch.functions.exprs import lookup
    return alerts.withColumn("topic", lookup(SEVERITY_TOPIC, F.lower(F.col(severity)), "jobs.llm.priority.normal"))


def alert_rate(alerts: DataFrame, key: str, ts: str, width: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """ST-11: tumbling-window alert counts per source."""
    return SQ.bucket_counts(alerts.withWatermark(ts, watermark), key, ts, width)


# ---------------------------------------------------------------------------
# ST-04 chain heads, ST-05 escalation budget, ST-06 dual-trigger batching (keyed state)
# ---------------------------------------------------------------------------

CHAIN_STATE = T.StructType([T.StructField("last_seq", T.LongType()), T.StructField("last_hash", T.StringType()),
                            T.StructField("segment", T.StringType())])


def chain_stream(events: DataFrame) -> DataFrame:
    """ST-04: per-tenant chain head kept in state (sequence, hash, segment); genesis on first event.

    Events carry the stored audit columns; a micro-batch's rows of a tenant are chained in (timestamp,
    audit_id) order in the stored format of the batch build, an event earlier than the head in
    the head's segment. Output rows have the AUDIT_SCHEMA.
    """
    ship_package(events.sparkSession)
    ev = AU.canonical_pieces(events.select(*AU._EVENT_FIELDS))
    g = AU.canonical_pieces(AU.genesis_rows(events.sparkSession.createDataFrame([("{tenant}",)], "tenant_id string"))).first()
    genesis = {c: g[c] for c in [*AU._EVENT_FIELDS, "_head", "_mid", "_tail"]}
    out_schema = AU.AUDIT_SCHEMA

    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        seq, last, segment = state.get if state.exists else (-1, AU.GENESIS_HASH, "")
        # The rows must be in order across the whole micro-batch, so they are gathered; a trigger bounds them.
        pdf = pd.concat(pdfs, ignore_index=True).sort_values(["timestamp", "audit_id"])
        if seq < 0:
            # The JVM's JSON of the tenant, so that the genesis record verifies for any name.
            named = json.dumps(key[0], ensure_ascii=False)[1:-1]
            first = {c: v.replace("{tenant}", named if c[0] == "_" else key[0]) if isinstance(v, str) else v for c, v in genesis.items()}
            pdf = pd.concat([pd.DataFrame([first]), pdf], ignore_index=True)
        seqs, prevs, hashes = [], [], []
        for ts, head, mid, tail in zip(pdf["timestamp"], pdf["_head"], pdf["_mid"], pdf["_tail"]):
            seq += 1
            hour = max(ts[:13], segment)
            if seq and hour != segment:
                last = hashlib.sha256(f"segment|{key[0]}|{seq}".encode()).hexdigest()
            segment = hour
            prevs.append(last)
            last = AU.link_hash(last, seq, head, mid, tail)
            seqs.append(seq)
            hashes.append(last)
        state.update((seq, last, segment))
        pdf["sequence_number"], pdf["previous_hash"], pdf["record_hash"] = seqs, prevs, hashes
        yield pdf[out_schema.fieldNames()]

    return ev.groupBy("tenant_id").applyInPandasWithState(fn, out_schema, CHAIN_STATE, "append",
                                                         GroupStateTimeout.NoTimeout)


def start_chain_table(events: DataFrame, records_path: str, heads_path: str, segments_path: str, checkpoint: str, trigger: dict | None = None):
    """ST-04 without state in the stream: the heads are a versioned table by tenant, so a tenant that has been idle for years
    costs a row on disk and goes on from its stored head.

    A micro-batch is chained by the batch build (segments of an hour in parallel, whatever the tenant), its records and its segments'
    heads replace those of an earlier try of the same batch, and the heads of its tenants are put in place last.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ship_package(spark)
        table = VersionedTable(spark, heads_path, "tenant_id", HEAD_SCHEMA)
        before = [v for v in table.versions() if v < batch_id]
        stored = table.read(before[-1]) if before else spark.createDataFrame([], HEAD_SCHEMA)
        heads = stored.join(batch.select("tenant_id").distinct(), "tenant_id", "left_semi")
        out = f"{records_path}/batch_id={batch_id}"
        AU.build_chain(batch, heads).write.mode("overwrite").parquet(out)
        records = spark.read.schema(AU.AUDIT_SCHEMA).parquet(out)
        AU.chain_segments(records).write.mode("overwrite").parquet(f"{segments_path}/batch_id={batch_id}")
        table.upsert(AU.chain_heads(records), lambda old, new: old.join(new, "tenant_id", "left_anti").unionByName(new), batch_id)
    q = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return q.trigger(**(trigger or {"availableNow": True})).start()


HEAD_SCHEMA = T.StructType([T.StructField("tenant_id", T.StringType()), T.StructField("sequence_number", T.LongType()),
                            T.StructField("timestamp", T.StringType()), T.StructField("record_hash", T.StringType())])


def _timer(state, at: float) -> None:
    """Wake the group once the watermark has passed ``at`` (epoch seconds)."""
    state.setTimeoutTimestamp(max(int(at * 1000) + 1, state.getCurrentWatermarkMs() + 1))


def _timed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Rows with their epoch seconds, late by at most ``delay``."""
    return df.withColumn("_t", epoch_seconds(F.col(ts))).withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", delay)


BUDGET_STATE = T.StructType([T.StructField("grants", T.ArrayType(T.DoubleType()))])


def escalation_stream(calls: DataFrame, key: str, ts: str, confidence: str, severity: str, *,
                      limit: int = SQ.MAX_ESCALATIONS_PER_HOUR, window_seconds: int = 3600,
                      order_col: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """ST-05: the escalation budget with at most ``limit`` grant times per key in state, dropped by a timer once the
    last of them is out of the window. Rows later than ``delay`` are dropped."""
    ship_package(calls.sparkSession)
    cols = calls.columns
    schema = T.StructType(calls.schema.fields + [T.StructField("escalated", T.BooleanType())])

    def fn(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        grants = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(pdfs), ignore_index=True)
        pdf = pdf.sort_values(["_t"] + ([order_col] if order_col else []))
        out = []
        for t, c, s in zip(pdf["_t"], pdf[confidence], pdf[severity]):
            grants = [g for g in grants if t - g < window_seconds]
            ok = c is not None and c < SQ.ESCALATION_CONFIDENCE and s in SQ.ESCALATION_SEVERITIES and len(grants) < limit
            if ok:
                grants.append(t)
            out.append(bool(ok))
        if grants:
            state.update((grants[-limit:],))
            _timer(state, grants[-1] + window_seconds)
        elif state.exists:
            state.remove()
        pdf = pdf[cols].copy()
        pdf["escalated"] = out
        yield pdf

    return _timed(calls, ts, delay).groupBy(key).applyInPandasWithState(fn, schema, BUDGET_STATE, "append", GroupStateTimeout.EventTimeTimeout)


BATCH_STATE = T.StructType([T.StructField("started", T.DoubleType()), T.StructField("batch_no", T.LongType()), T.StructField("size", T.LongType()),
                            T.StructField("opened", T.DoubleType()), T.StructField("flushed", T.DoubleType())])


def batching_stream(tasks: DataFrame, key: str, ts: str, *, count_threshold: int = SQ.BATCH_COUNT_THRESHOLD,
                    time_threshold_hours: float = SQ.BATCH_TIME_THRESHOLD_HOURS,
                    order_col: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """ST-06 by task: the batch each row goes to, with the state of one open batch per key. A batch that is due closes by a
    timer, so that the next row begins another. Batch numbers of a key go on, so its five numbers stay."""
    ship_package(tasks.sparkSession)
    cols = tasks.columns
    schema = T.StructType(tasks.schema.fields + [T.StructField("batch_no", T.LongType()),
                                                 T.StructField("closed_by_count", T.BooleanType())])
    limit = time_threshold_hours * 3600.0

    def fn(k, pdfs, state):
        batcher = SQ.Batcher(count_threshold, limit, state.get if state.exists else None)
        if state.hasTimedOut:
            batcher.tick(state.getCurrentWatermarkMs() / 1000)
        else:
            pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["_t"] + ([order_col] if order_col else []))
            ids, by_count = [], []
            for t in pdf["_t"]:
                closed = batcher.add(t)
                counted = bool(closed) and closed[-1][5] == "count"
                ids.append(closed[-1][1] if counted else batcher.no)
                by_count.append(counted)
            out = pdf[cols].copy()
            out["batch_no"], out["closed_by_count"] = ids, by_count
            yield out
        state.update(batcher.state)
        if batcher.due is not None:
            _timer(state, batcher.due)

    return _timed(tasks, ts, delay).groupBy(key).applyInPandasWithState(fn, schema, BATCH_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def batch_closure_stream(tasks: DataFrame, key: str, ts: str, *, count_threshold: int = SQ.BATCH_COUNT_THRESHOLD,
                         time_threshold_hours: float = SQ.BATCH_TIME_THRESHOLD_HOURS, keep_hours: float | None = None,
                         delay: str = "10 minutes") -> DataFrame:
    """ST-06 by batch: one row when a batch closes, by count or, without any further task, by the clock (the watermark).
    The batch twin is ``sequences.batch_closures``.

    With ``keep_hours`` a key that has had no open batch for so long leaves no state; its next batch has a new
    ``started_at`` and number 0, so (key, started_at, batch_no) stays unique.
    """
    ship_package(tasks.sparkSession)
    schema = T._parse_datatype_string(f"`{key}` string, {SQ.CLOSURE_COLS}")
    limit = time_threshold_hours * 3600.0

    def fn(k, pdfs, state):
        batcher = SQ.Batcher(count_threshold, limit, state.get if state.exists else None)
        closed = []
        if state.hasTimedOut:
            if not batcher.size:
                state.remove()
                return
            now = state.getCurrentWatermarkMs() / 1000
            closed += batcher.tick(now)
        else:
            times = sorted(t for pdf in pdfs for t in pdf["_t"])
            now = times[-1]
            for t in times:
                closed += batcher.add(t)
        state.update(batcher.state)
        if batcher.due is not None:
            _timer(state, batcher.due)
        elif keep_hours is not None:
            _timer(state, now + keep_hours * 3600.0)
        yield SQ.closure_frame([k[0]] * len(closed), closed, key)

    rows = _timed(tasks.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn(key, F.col(key).cast("string")), ts, delay)
    return rows.groupBy(key).applyInPandasWithState(fn, schema, BATCH_STATE, "append", GroupStateTimeout.EventTimeTimeout)
