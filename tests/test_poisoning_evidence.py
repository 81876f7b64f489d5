"""E-01: address evidence of bounded size beside the exact members."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import rules as R


def test_addresses_are_counted_sketched_and_listed_apart(spark):
    now = dt.datetime(2024, 1, 31)
    rows = [("t", "u", "modify", f"r{i % 3}", f"10.0.{i % 700 // 256}.{i % 700 % 256}", now - dt.timedelta(minutes=i % 1000 + 1)) for i in range(2100)]
    rows += [(None, "v", "modify", "r", None, now - dt.timedelta(hours=1))] * 3 + [(None, "v", "modify", "r", "10.9.9.9", now - dt.timedelta(hours=2))]
    df = spark.createDataFrame(rows, "tenant_id string, user_id string, action string, target_resource string, source_ip string, ts timestamp_ntz")
    d = R.training_data_poisoning_detailed(df, now, actions=("modify",))
    got = {r.user_id: r for r in d.withColumn("about", F.hll_sketch_estimate("ip_sketch")).collect()}
    assert got["u"].distinct_source_ips == 700 and abs(got["u"].about - 700) < 40 and len(got["u"].ip_sketch) < 5000
    assert got["u"].source_ips == sorted({r[4] for r in rows if r[1] == "u"})[:R.EVIDENCE_IPS]
    assert got["v"].source_ips == ["10.9.9.9"] and got["v"].distinct_source_ips == 1
    members = R.poisoning_addresses(df, now, actions=("modify",)).where("user_id = 'u'")
    assert members.count() == 700 and members.agg(F.sum("action_count")).first()[0] == 2100


def test_all_addresses_are_listed_where_asked(spark, tmp_path):
    """The registered query lists every address of the day."""
    from pyspark.sql import functions as F

    from tidewatch.plans import ORACLES, QUERIES
    rows = [(i, dt.datetime(2024, 1, 30, 12, i % 60), 7, "purchase", 1.0, f'{{"k": {i}}}') for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    r = QUERIES["e01_poisoning_detailed"](spark, str(tmp_path)).where(F.col("user_id") == "7").first()
    assert r.source_ips.split(",") == sorted(f"10.0.7.{i}" for i in range(40))
    assert "[1:10]" not in ORACLES["e01_poisoning_detailed"]
