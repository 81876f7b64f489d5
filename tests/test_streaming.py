"""Streaming twins equal their batch twins on the same rows (file source, availableNow)."""

import datetime as dt
import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import audit as AU
from tidewatch.operators import sequences as SQ
from tidewatch.sources import tables as TB
from tidewatch.streaming import streams as STR

SF = "/root/testdata/sf0.001"


def _run_to_memory(sdf, name):
    q = sdf.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True) \
        .option("checkpointLocation", tempfile.mkdtemp(prefix="tw-ckpt-")).start()
    q.awaitTermination()
    return sdf.sparkSession.table(name)


def _as_stream(spark, df, parts=2, order_col=None):
    """Write ``df`` as ``parts`` files split by ``order_col`` ranges and read them back as a stream."""
    path = tempfile.mkdtemp(prefix="tw-src-")
    if order_col:
        df = df.withColumn("_part", F.ntile(parts).over(__import__("pyspark.sql").sql.Window.orderBy(order_col)))
        for p in range(1, parts + 1):
            df.where(F.col("_part") == p).drop("_part").coalesce(1).write.mode("append").parquet(path)
        schema = df.drop("_part").schema
    else:
        df.coalesce(1).write.mode("append").parquet(path)
        schema = df.schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_chain_stream_equals_batch(spark):
    ev = TB.audit_events(spark, SF)
    batch = {(r.tenant_id, r.sequence_number): r.record_hash for r in AU.build_chain(ev).collect()}
    stream = _run_to_memory(STR.chain_stream(_as_stream(spark, ev, 3, "timestamp")), "chain_out")
    got = {(r.tenant_id, r.sequence_number): r.record_hash for r in stream.collect()}
    assert got == batch
    assert AU.verify_chain(stream).count() == 0


def _calls(spark, n=2000, seed=3):
    random.seed(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(random.choice("ab"), t0 + dt.timedelta(seconds=random.randint(0, 6 * 3600)), i,
             random.random(), random.choice(["critical", "high", "low"])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, i int, conf double, sev string")


def test_escalation_stream_equals_batch(spark):
    df = _calls(spark)
    batch = {r.i: r.escalated for r in SQ.escalation_budget(df, "k", "ts", "conf", "sev", order_cols=("i",)).collect()}
    s = _run_to_memory(STR.escalation_stream(_as_stream(spark, df, 3, "ts"), "k", "ts", "conf", "sev", order_col="i"),
                       "esc_out")
    assert {r.i: r.escalated for r in s.collect()} == batch
    assert 0 < sum(batch.values()) < len(batch)


def test_batching_stream_equals_batch(spark):
    df = _calls(spark, 500, seed=5)
    b = {r.i: (r.batch_no, r.closed_by_count) for r in
         SQ.dual_trigger_batches(df, "k", "ts", count_threshold=50, time_threshold_hours=1, order_cols=("i",)).collect()}
    s = _run_to_memory(STR.batching_stream(_as_stream(spark, df, 4, "ts"), "k", "ts", count_threshold=50,
                                           time_threshold_hours=1, order_col="i"), "batch_out")
    assert {r.i: (r.batch_no, r.closed_by_count) for r in s.collect()} == b


def test_sliding_and_tumbling_windows_equal_batch(spark):
    e = TB.read(spark, SF, "events").select(F.col("user_id").cast("string").alias("user"),
                                            F.col("ts").cast("timestamp").alias("ts"))
    batch = e.groupBy("user", F.window("ts", "24 hours", "6 hours")).count() \
        .select("user", F.col("window.start").alias("window_start"), "count")
    s = _run_to_memory(STR.sliding_counts(_as_stream(spark, e, 2, "ts"), "user", "ts", "24 hours", "6 hours",
                                          watermark="0 seconds"), "slide_out")
    got = s.select("user", "window_start", "count")
    # with a zero watermark, append mode emits every window once it closes; the last open
    # windows are emitted when the stream ends -> compare the closed ones
    closed = batch.join(got.select("window_start").distinct(), "window_start", "left_semi") \
        .select("user", "window_start", "count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.collect()))
    r = _run_to_memory(STR.alert_rate(_as_stream(spark, e, 2, "ts"), "user", "ts", watermark="0 seconds"), "rate_out")
    assert r.count() > 0


def test_dedupe_route_and_alert_dlq(spark):
    rows = [("a1", dt.datetime(2024, 1, 1, 0, 0), "High"), ("a1", dt.datetime(2024, 1, 1, 0, 5), "High"),
            ("a2", dt.datetime(2024, 1, 1, 0, 6), "low")]
    df = spark.createDataFrame(rows, "alert_id string, ts timestamp, severity string")
    d = _run_to_memory(STR.route_by_severity(STR.dedupe_alerts(_as_stream(spark, df))), "dedupe_out")
    got = sorted((r.alert_id, r.topic) for r in d.collect())
    assert got == [("a1", "jobs.llm.priority.high"), ("a2", "jobs.llm.priority.low")]

    schema = "alert_id string, source string, timestamp string, title string, severity string"
    raw = spark.createDataFrame([(json.dumps({"alert_id": "x", "source": "s", "timestamp": "2024-01-01T00:00:00Z",
                                              "title": "t", "severity": "high"}),),
                                 ("not json",),
                                 (json.dumps({"alert_id": "y", "timestamp": "2024-01-01T00:00:00Z",
                                              "severity": "urgent"}),)], "value string")
    good, bad = tempfile.mkdtemp(), tempfile.mkdtemp()
    from pyspark.sql import types as T
    st = T._parse_datatype_string(schema)
    q = STR.start_alert_stream(_as_stream(spark, raw), st, good, bad, tempfile.mkdtemp())
    q.awaitTermination()
    assert spark.read.parquet(good).count() == 1
    assert sorted(r.error for r in spark.read.parquet(bad).collect()) == ["invalid_severity", "parse_error"]


def _plain_batches(times, now, count, limit):
    """The reference's loop, ticked at every moment that matters."""
    queue, last, no, out = [], None, 0, []
    for t, is_item in sorted([(t, 1) for t in times] + [(now, 2)]):
        due = None if last is None or not queue else max(last + limit, queue[0])
        if due is not None and due <= t:
            out.append((no, len(queue), queue[0], due, "time"))
            queue, last, no = [], None, no + 1
        if is_item == 1:
            last = t if last is None else last
            queue.append(t)
            if len(queue) == count:
                out.append((no, count, queue[0], t, "count"))
                queue, last, no = [], t, no + 1
    return out


def _closed(df):
    return sorted((r.k, r.batch_no, r.size, r.opened_at, r.closed_at, r.closed_by) for r in df.collect())


def test_batch_closures_by_count_and_clock(spark):
    df, now = _calls(spark, 300, seed=8), dt.datetime(2024, 1, 1, 7)
    kinds = set()
    for count, hours in ((10, 0.2), (3, 1.0), (500, 0.05)):
        got = _closed(SQ.batch_closures(df, "k", "ts", now, count_threshold=count, time_threshold_hours=hours))
        want = []
        for k in "ab":
            times = sorted((r.ts - dt.datetime(2024, 1, 1)).total_seconds() for r in df.collect() if r.k == k)
            want += [(k, no, n, *(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=x) for x in (o, c)), by)
                     for no, n, o, c, by in _plain_batches(times, 7 * 3600.0, count, hours * 3600)]
        assert got == sorted(want) and got
        kinds |= {x[5] for x in got}
    assert kinds == {"time", "count"}


def test_idle_batches_close_by_a_timer_and_leave_no_state(spark):
    df = _calls(spark, 200, seed=9)
    # A row of another key moves the clock far beyond the last task of a and b.
    later = spark.createDataFrame([("z", dt.datetime(2024, 1, 3), 9999, 0.5, "low")], df.schema)
    stream = STR.batch_closure_stream(_as_stream(spark, df.unionByName(later), 3, "ts"), "k", "ts", count_threshold=7,
                                      time_threshold_hours=0.5, keep_hours=2)
    ckpt = tempfile.mkdtemp(prefix="tw-ckpt-")
    q = stream.writeStream.format("memory").queryName("closures").outputMode("append").trigger(availableNow=True).option("checkpointLocation", ckpt).start()
    q.awaitTermination()
    want = _closed(SQ.batch_closures(df, "k", "ts", dt.datetime(2024, 1, 2), count_threshold=7, time_threshold_hours=0.5))
    assert [x for x in _closed(spark.table("closures")) if x[0] != "z"] == want and {x[5] for x in want} == {"time", "count"}
    keys = {r.k for r in spark.read.format("statestore").load(ckpt).select("key.k").collect()}
    assert keys <= {"z", "a", "b"}
    # One more batch of the watermark: the keys without an open batch are gone.
    sums = spark.read.format("statestore").load(ckpt).where("key.k <> 'z'").count()
    assert sums <= 2


def test_budget_state_expires(spark):
    df = _calls(spark, 300, seed=4)
    later = spark.createDataFrame([("z", dt.datetime(2024, 1, 3), 9999, 0.9, "low")], df.schema)
    ckpt = tempfile.mkdtemp(prefix="tw-ckpt-")
    s = STR.escalation_stream(_as_stream(spark, df.unionByName(later), 3, "ts"), "k", "ts", "conf", "sev", order_col="i")
    q = s.writeStream.format("memory").queryName("budget").outputMode("append").trigger(availableNow=True).option("checkpointLocation", ckpt).start()
    q.awaitTermination()
    batch = {r.i: r.escalated for r in SQ.escalation_budget(df, "k", "ts", "conf", "sev", order_cols=("i",)).collect()}
    assert {r.i: r.escalated for r in spark.table("budget").collect() if r.i != 9999} == batch
    assert spark.read.format("statestore").load(ckpt).count() == 0


def test_chain_table_keeps_its_heads_on_disk(spark):
    ev = TB.audit_events(spark, SF)
    root = tempfile.mkdtemp(prefix="tw-chain-")
    src = _as_stream(spark, ev, 3, "timestamp")
    STR.start_chain_table(src, f"{root}/records", f"{root}/heads", f"{root}/segments", f"{root}/ckpt").awaitTermination()
    records = spark.read.schema(AU.AUDIT_SCHEMA).parquet(*[f"{root}/records/batch_id={i}" for i in range(3)])
    batch = {(r.tenant_id, r.sequence_number): r.audit_id for r in AU.build_chain(ev).collect()}
    assert {(r.tenant_id, r.sequence_number): r.audit_id for r in records.collect()} == batch
    assert AU.verify_chain(records).count() == 0
    from tidewatch.sources.versioned import VersionedTable
    heads = VersionedTable(spark, f"{root}/heads", "tenant_id", STR.HEAD_SCHEMA).read()
    assert sorted(map(tuple, heads.collect())) == sorted(map(tuple, AU.chain_heads(records).collect()))
