import zlib

import brute
from tidewatch.llm import sharding

SCHEMA = "doc_id long, text string, shard string, n string, rank string"


def test_against_the_published_loop(spark):
    ids = [0, 1, 2, -1, -2**63, 2**63 - 1, 10**15, *range(100, 900, 3)]
    text = {i: f"té {i % 3}" for i in ids}
    rows = [(i, text[i], "x", "y", "z") for i in ids] + [(5, None, "x", "y", "z"), (6, "", "x", "y", "z"), (7, "long " * 100_000, "x", "y", "z")]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 16).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["shard"] == brute.jump_hash(r["doc_id"], 16) and r["grown_shard"] == brute.jump_hash(r["doc_id"], 17)
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    by = {r["doc_id"]: r for r in got}
    assert (by[5]["size"], by[5]["text_crc32"], by[6]["size"], by[6]["text_crc32"]) == (1, 0, 1, 0)
    assert by[100]["size"] == len("té 1".encode()) + 1 and by[100]["text_crc32"] == zlib.crc32("té 1".encode())


def test_slots_are_gapless_with_copies_and_null_ids(spark):
    rows = [(1, "same", "x", "y", "z")] * 30 + [(None, "n", "x", "y", "z")] * 3 + [(i, "t", "x", "y", "z") for i in range(2000)]
    by = {}
    for r in sharding.shard(spark.createDataFrame(rows, SCHEMA), 4).collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, by.values())) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_empty_and_native(spark):
    df = sharding.shard(spark.createDataFrame([], SCHEMA))
    assert df.collect() == []
    assert "Python" not in df._jdf.queryExecution().toString()
