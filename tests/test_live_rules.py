"""ST-03: rules over a live baseline equal the batch rules at every tick; a replayed batch raises the same alerts."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from tidewatch.operators import rules as R
from tidewatch.streaming import live_rules as L

START = dt.datetime(2024, 1, 1)
HOUR0 = int(START.replace(tzinfo=dt.timezone.utc).timestamp()) // 3600


def _audit(spark, days=4, n=900, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        at = rng.uniform(0, days * 24)
        rows.append(("t1", rng.choice(["u1", "u2", "u3"]), "modify", f"r{rng.randint(0, 9)}", at))
    rows += [("t2", "u1", "modify", f"r{i}", days * 24 - 30 + i / 2) for i in range(40)] + [("t1", "u9", "read", "r", 1.0)]
    return spark.createDataFrame([(t, u, a, r, START + dt.timedelta(seconds=int(h * 3600))) for t, u, a, r, h in rows],
                                 "tenant_id string, user_id string, action string, target_resource string, ts timestamp_ntz")


def _files(spark, df, cuts):
    """A stream of one file per span of hours, in order."""
    path = tempfile.mkdtemp(prefix="tw-live-")
    for lo, hi in zip(cuts, cuts[1:]):
        at = [F.lit(START + dt.timedelta(hours=h)).cast("timestamp_ntz") for h in (lo, hi)]
        df.where((F.col("ts") >= at[0]) & (F.col("ts") < at[1])).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _rows(df, cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


COLS = ["tick", "tenant_id", "user_id", "count", "distinct_tables", "baseline_avg", "deviation_factor", "confidence"]


def test_every_tick_equals_the_batch_rule(spark):
    audit = _audit(spark)
    rule = L.poisoning_rule(("modify",), deviation_threshold=2.0)
    got = L.history(audit, "ts", rule, HOUR0 + 60, HOUR0 + 96)
    for h in (60, 75, 96):
        batch = R.training_data_poisoning(audit, START + dt.timedelta(hours=h), actions=("modify",), deviation_threshold=2.0)
        want = _rows(batch, COLS[1:])
        assert _rows(got.where(F.col("tick") == HOUR0 + h), COLS[1:]) == want
    assert got.count() > 30


def test_stream_equals_batch_and_a_replay_raises_the_same_alerts(spark):
    audit, root = _audit(spark, seed=2), tempfile.mkdtemp(prefix="tw-live-")
    rule = L.poisoning_rule(("modify",), deviation_threshold=2.0)
    paths = (f"{root}/baseline", f"{root}/alerts")
    L.start_live_rule(_files(spark, audit, [0, 31, 62.5, 80, 97]), "ts", rule, *paths, f"{root}/ckpt").awaitTermination()
    got = _rows(spark.read.parquet(paths[1]), COLS)
    newest = audit.where("action = 'modify'").agg(F.max(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600))).first()[0]
    assert got == _rows(L.history(audit, "ts", rule, HOUR0 + 1, newest), COLS) and len(got) > 50
    # The same batches once more, with a new checkpoint: versions and alerts are written over.
    L.start_live_rule(_files(spark, audit, [0, 31, 62.5, 80, 97]), "ts", rule, *paths, f"{root}/ckpt2").awaitTermination()
    assert _rows(spark.read.parquet(paths[1]), COLS) == got


def test_alert_flood_as_a_stream(spark):
    rng = random.Random(5)
    times = [rng.uniform(0, 48) for _ in range(100)] + [rng.uniform(40, 46) for _ in range(300)]
    alerts = spark.createDataFrame([(rng.choice("ab"), START + dt.timedelta(seconds=int(h * 3600))) for h in times], "tenant_id string, ts timestamp_ntz")
    root, rule = tempfile.mkdtemp(prefix="tw-live-"), L.flood_rule()
    L.start_live_rule(_files(spark, L.all_alerts(alerts), [0, 20, 43, 49]), "ts", rule, f"{root}/b", f"{root}/a", f"{root}/c").awaitTermination()
    got = {r["tick"] - HOUR0: (r["current_count"], round(r["spike_ratio"], 9)) for r in spark.read.parquet(f"{root}/a").collect()}
    for h in range(1, 48):
        batch = R.alert_flood(alerts, START + dt.timedelta(hours=h), ts_col="ts").collect()
        assert ({h: (batch[0]["current_count"], round(batch[0]["spike_ratio"], 9))} if batch else {}) == {k: v for k, v in got.items() if k == h}
    assert got


def test_no_event_of_the_rule(spark):
    audit, root = _audit(spark, n=5), tempfile.mkdtemp(prefix="tw-live-")
    L.start_live_rule(_files(spark, audit.where("action = 'read'"), [0, 97]), "ts", L.poisoning_rule(("modify",)), f"{root}/b", f"{root}/a", f"{root}/c").awaitTermination()
    assert spark.read.parquet(f"{root}/a").count() == 0
