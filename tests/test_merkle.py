"""Merkle proofs over the chain's segments, against a plain tree."""

import hashlib
import random

from pyspark.sql import functions as F

from tidewatch.operators import audit as AU
from tidewatch.operators import merkle as M
from tidewatch.sources import tables as TB

SF = "/root/testdata/sf0.001"


def _sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _plain_nodes(hashes):
    out, level, k = {(0, i): h for i, h in enumerate(hashes)}, list(hashes), 0
    while len(level) > 1:
        level, k = [_sha(level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)], k + 1
        out |= {(k, i): h for i, h in enumerate(level)}
    return out


def _plain_peaks(nodes, n):
    return {(k, (n >> k) - 1): nodes[k, (n >> k) - 1] for k in range(n.bit_length()) if n >> k & 1}


def _frame(spark, trees, start):
    rows = [(t, i, h) for t, hs in trees.items() for i, h in enumerate(hs) if i >= start.get(t, 0)]
    return spark.createDataFrame(rows, "tenant_id string, idx long, hash string")


def _by_tenant(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.tenant_id, {})[r.level, r.idx] = r.hash
    return out


def test_trees_grown_at_once_and_in_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "SPAN_BITS", 3)
    trees = {"a": [_sha(f"a{i}") for i in range(77)], "b": [_sha(f"b{i}") for i in range(64)], "c": [_sha("c")], "d": [_sha(f"d{i}") for i in range(9)]}
    want = {t: _plain_nodes(h) for t, h in trees.items()}
    whole = M.grow(_frame(spark, trees, {})).checkpoint()
    assert _by_tenant(whole) == want
    assert _by_tenant(M.peaks_of(whole)) == {t: _plain_peaks(n, len(trees[t])) for t, n in want.items()}
    rng, peaks, have, nodes = random.Random(4), None, dict.fromkeys(trees, 0), None
    while any(have[t] < len(trees[t]) for t in trees):
        upto = {t: min(len(h), have[t] + rng.choice([0, 1, 2, 7, 40])) for t, h in trees.items()}
        new = _frame(spark, {t: h[:upto[t]] for t, h in trees.items()}, have)
        if new.isEmpty():
            continue
        added = M.grow(new, peaks).checkpoint()
        before, nodes = peaks, added if nodes is None else nodes.unionByName(added).checkpoint()
        peaks = M.peaks_of(added if peaks is None else peaks.unionByName(added)).checkpoint()
        assert _by_tenant(peaks) == {t: _plain_peaks(want[t], n) for t, n in upto.items() if n}
        assert before is None or M.not_extended(before, nodes).isEmpty()
        have = upto
    assert _by_tenant(nodes) == want and nodes.count() == whole.count()
    assert sorted(map(tuple, M.roots(peaks).collect())) == sorted(map(tuple, M.roots(M.peaks_of(whole)).collect()))
    other = M.grow(_frame(spark, {"a": [_sha("x"), *trees["a"][1:]]}, {}))
    assert {r.tenant_id for r in M.not_extended(M.peaks_of(whole), other.unionByName(whole.where("tenant_id <> 'a'"))).collect()} == {"a"}


def test_paths_lead_to_peaks(spark):
    trees = {"a": [_sha(f"a{i}") for i in range(45)], "b": [_sha("b0"), _sha("b1")]}
    nodes = M.grow(_frame(spark, trees, {})).checkpoint()
    peaks = M.peaks_of(nodes).checkpoint()
    leaf = _frame(spark, trees, {})
    got = leaf.join(M.proofs(leaf, nodes, peaks), ["tenant_id", "idx"]).withColumn("up", M.carried()).collect()
    assert len(got) == 47 and all(r.up == r.peak for r in got)
    assert max(len(r.path) for r in got) == 5 and {r.idx for r in got if r.tenant_id == "a" and not r.path} == {44}
    beyond = M.proofs(spark.createDataFrame([("a", 45), ("z", 0)], "tenant_id string, idx long"), nodes, peaks).collect()
    assert [r.peak for r in beyond] == [None, None]


def test_a_rewritten_hour_is_found_from_its_records_and_the_peaks(spark):
    chain = AU.build_chain(TB.audit_events(spark, SF)).checkpoint()
    segs = M.leaves(AU.chain_segments(chain)).checkpoint()
    nodes = M.grow(segs).checkpoint()
    peaks = M.peaks_of(nodes).checkpoint()
    n = segs.groupBy("tenant_id").count().collect()
    assert all(r.proven and r.steps <= max(x["count"] for x in n).bit_length() for r in M.verify_hours(chain, segs, nodes, peaks).collect())
    # A middle hour with two records or more, rewritten as a whole: every hash and link in it holds.
    hour = segs.where("tenant_id = 't1' and last_seq > first_seq and idx > 2").orderBy("idx").first()
    inside = (F.col("tenant_id") == "t1") & F.col("sequence_number").between(hour.first_seq, hour.last_seq)
    rows, last, forged = AU.canonical_pieces(chain.where(inside).withColumn("context", F.lit('{"changed":1}'))).orderBy("sequence_number").collect(), None, []
    for r in rows:
        prev = last or r.previous_hash
        last = AU.link_hash(prev, r.sequence_number, r._head, r._mid, r._tail)
        forged.append(tuple({**r.asDict(), "previous_hash": prev, "record_hash": last}[c] for c in AU.AUDIT_SCHEMA.fieldNames()))
    only = spark.createDataFrame(forged, AU.AUDIT_SCHEMA)
    got = M.verify_hours(only, segs.where((F.col("tenant_id") == "t1") & (F.col("idx") == hour.idx)), nodes, peaks).collect()
    assert [(r.records, r.errors, r.proven) for r in got] == [(len(rows), 0, False)]
    true = M.verify_hours(chain.where(inside), segs.where((F.col("tenant_id") == "t1") & (F.col("idx") == hour.idx)), nodes, peaks).first()
    assert true.proven
    short = M.verify_hours(chain.where(inside & (F.col("sequence_number") > hour.first_seq)), segs.where((F.col("tenant_id") == "t1") & (F.col("idx") == hour.idx)), nodes, peaks).first()
    assert not short.proven


def test_no_segment(spark):
    empty = spark.createDataFrame([], "tenant_id string, idx long, hash string")
    assert M.grow(empty).count() == 0 and M.peaks_of(M.grow(empty)).count() == 0
