"""Table-write helpers: keyed upsert, append-only audit writes, evidence hashing, metadata."""

import tempfile

from pyspark.sql import functions as F

from tidewatch.sources import io as IO


def test_upsert_keeps_created_at_and_latest_wins(spark):
    old = spark.createDataFrame([("i1", "received", "2024-01-01"), ("i2", "closed", "2024-01-02")],
                                "investigation_id string, state string, created_at string")
    new = spark.createDataFrame([("i1", "enriching", "2024-02-01", 1), ("i1", "reasoning", "2024-02-01", 2),
                                 ("i3", "received", "2024-02-03", 1)],
                                "investigation_id string, state string, created_at string, v int")
    out = IO.upsert(old, new, ["investigation_id"], [F.desc("v")])
    got = {r.investigation_id: (r.state, r.created_at) for r in out.collect()}
    assert got == {"i1": ("reasoning", "2024-01-01"), "i2": ("closed", "2024-01-02"), "i3": ("received", "2024-02-03")}
    again = IO.upsert(out, new, ["investigation_id"], [F.desc("v")])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_append_only_and_evidence_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="tw-io-")
    rows = spark.createDataFrame([("t1", "2024-01-05T10:00:00Z", "alpha"), ("t2", "2024-01-06T11:00:00Z", "beta")],
                                 "tenant_id string, timestamp string, content string")
    ev = IO.evidence_objects(rows)
    IO.store_evidence(ev, f"{d}/evidence")
    IO.store_evidence(ev, f"{d}/evidence")          # append: stored twice, nothing replaced
    back = spark.read.parquet(f"{d}/evidence")
    assert back.count() == 4 and IO.verify_evidence(back).count() == 0
    tampered = back.withColumn("content", F.when(F.col("tenant_id") == "t1", F.lit("x")).otherwise(F.col("content")))
    assert IO.verify_evidence(tampered).count() == 2
    IO.append_only(rows, f"{d}/audit", ["tenant_id"])
    IO.append_only(rows, f"{d}/audit", ["tenant_id"])
    assert spark.read.parquet(f"{d}/audit").count() == 4


def test_embedding_metadata_enforcement(spark):
    pts = spark.createDataFrame([("p1", "m", None), ("p2", None, None)],
                                "id string, embedding_model_id string, embedding_version string")
    ok, bad = IO.enforce_embedding_metadata(pts, {"embedding_dimensions": 64, "embedding_version": "2"})
    assert [r.id for r in ok.collect()] == ["p1"] and [r.id for r in bad.collect()] == ["p2"]
