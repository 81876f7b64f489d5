"""Chain format, append, forks, pages; versioned upserts that fail half-way."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import audit as AU
from tidewatch.sources.versioned import VersionedTable

SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in AU.AUDIT_SCHEMA.fields if f.name in AU._EVENT_FIELDS)


def _events(spark, rows):
    """rows: (tenant, audit id, ISO timestamp)."""
    base = {f: "" for f in AU._EVENT_FIELDS} | {"actor_permissions": [], "entity_ids": [], "context": "{}", "decision": "{}", "outcome": "{}"}
    data = [base | {"tenant_id": t, "audit_id": a, "timestamp": ts, "event_type": "alert.classified", "event_category": "decision"}
            for t, a, ts in rows]
    names = [f.name for f in AU.AUDIT_SCHEMA.fields if f.name in AU._EVENT_FIELDS]
    return spark.createDataFrame([tuple(d[n] for n in names) for d in data], SCHEMA)


ROWS = [(t, f"{t}-{i:03d}", f"2024-05-0{1 + i // 20}T{i % 20 // 6:02d}:{i % 6:02d}:00.000Z") for t in ("α-tenant", "b") for i in range(50)]


def test_links_recomputed_by_hand(spark):
    got = sorted(AU.build_chain(_events(spark, ROWS)).collect(), key=lambda r: (r.tenant_id, r.sequence_number))
    assert len(got) == 102
    last = {}
    for r in got:
        before = last.get(r.tenant_id)
        hour = r.timestamp[:13]
        if before is None:
            assert r.sequence_number == 0 and r.previous_hash == AU.GENESIS_HASH
        elif before[1] == hour:
            assert r.previous_hash == before[0]
        else:
            assert r.previous_hash == hashlib.sha256(f"segment|{r.tenant_id}|{r.sequence_number}".encode()).hexdigest()
        assert before is None or r.sequence_number == before[2] + 1
        last[r.tenant_id] = (r.record_hash, hour, r.sequence_number)
    for t in ("α-tenant", "b"):
        assert [r.audit_id for r in got if r.tenant_id == t][1:] == [a for x, a, _ in sorted(ROWS, key=lambda e: (e[2], e[1])) if x == t]


def test_append_equals_one_build(spark):
    whole = {(r.tenant_id, r.sequence_number): r.record_hash for r in AU.build_chain(_events(spark, ROWS)).collect()}
    order = sorted(ROWS, key=lambda e: (e[2], e[1]))
    first = AU.build_chain(_events(spark, order[:43])).cache()
    more = AU.build_chain(_events(spark, order[43:]), AU.chain_heads(first))
    both = first.unionByName(more).cache()
    assert {(r.tenant_id, r.sequence_number): r.record_hash for r in both.collect()} == whole
    assert AU.verify_chain(both).count() == 0
    late = AU.build_chain(_events(spark, [("b", "late", "2024-04-01T00:00:00.000Z")]), AU.chain_heads(both))
    assert [r.sequence_number for r in late.collect()] == [51] and AU.verify_chain(both.unionByName(late)).count() == 0


def test_forked_and_shortened_chains(spark):
    c = AU.build_chain(_events(spark, ROWS)).cache()
    tail = c.where("tenant_id = 'b' and sequence_number = 50")
    for copy in (tail, tail.withColumn("audit_id", F.lit("other")).withColumn("record_hash", AU.record_digest())):
        errors = [e for r in AU.verify_chain(c.unionByName(copy)).collect() for e in r.errors]
        assert errors == ["Sequence repeated: 50"] * 2
    gone = c.where("not (tenant_id = 'b' and sequence_number = 7)")
    assert [r.errors for r in AU.verify_chain(gone).collect()] == [["Sequence gap: expected predecessor of 8"]]


def test_segments_cover_the_chain(spark):
    c = AU.build_chain(_events(spark, ROWS)).cache()
    segs = sorted(AU.chain_segments(c).collect(), key=lambda r: (r.tenant_id, r.first_seq))
    for t in ("α-tenant", "b"):
        mine, acc, at = [s for s in segs if s.tenant_id == t], AU.GENESIS_HASH, 0
        for s in mine:
            assert s.first_seq == at
            at, acc = s.last_seq + 1, hashlib.sha256((acc + s.head_hash).encode()).hexdigest()
            assert s.digest == acc
        assert at == 51


def test_a_rewritten_hour_is_found(spark):
    ev = _events(spark, ROWS).withColumn("investigation_id", F.lit("inv-1"))
    c = AU.build_chain(ev).checkpoint()
    segs = AU.chain_segments(c).checkpoint()
    assert AU.verify_chain(c, segs).count() == 0 and AU.verify_range(c, "b", 3, 40, segs).count() == 0
    s = [r for r in segs.collect() if r.tenant_id == "b"]
    mid = sorted(s, key=lambda r: r.first_seq)[3]
    # From the second record of a middle hour to its end, and the whole hour: rewritten with hashes recomputed.
    for start in (mid.first_seq + 1, mid.first_seq):
        inside = (F.col("tenant_id") == "b") & F.col("sequence_number").between(start, mid.last_seq)
        rows = AU.canonical_pieces(c.where(inside).withColumn("context", F.lit('{"changed":1}'))).orderBy("sequence_number").collect()
        last = c.where((F.col("tenant_id") == "b") & (F.col("sequence_number") == start - 1)).first().record_hash
        forged = []
        for r in rows:
            prev = hashlib.sha256(f"segment|b|{r.sequence_number}".encode()).hexdigest() if r.sequence_number in (start, mid.first_seq) else last
            last = AU.link_hash(prev, r.sequence_number, r._head, r._mid, r._tail)
            forged.append(tuple({**r.asDict(), "previous_hash": prev, "record_hash": last}[n] for n in AU.AUDIT_SCHEMA.fieldNames()))
        bad = c.where(~inside).unionByName(spark.createDataFrame(forged, AU.AUDIT_SCHEMA)).checkpoint()
        seqs = {r.sequence_number for r in AU.verify_chain(bad, segs).collect() if r.tenant_id == "b"}
        assert seqs == set(range(mid.first_seq, mid.last_seq + 1))
        assert AU.verify_chain(bad).count() == (start > mid.first_seq)  # a seed within an hour is no link
    assert AU.verify_range(bad, "b", 3, 40, segs).count() == len(seqs)
    assert {r.tenant_id: r.valid for r in AU.chain_summary(bad, segs).collect()} == {"α-tenant": True, "b": False}
    assert {r.tenant_id: r.chain_errors for r in AU.evidence_package(bad, segments=segs).collect()} == {"α-tenant": 0, "b": len(seqs)}
    cut = [r for r in AU.verify_chain(c.where("not (tenant_id = 'b' and sequence_number >= 50)"), segs).collect() if r.audit_id is None]
    assert [r.sequence_number for r in cut] == [50]


def test_pages(spark):
    c = AU.number_events(_events(spark, ROWS))
    with pytest.raises(ValueError):
        AU.list_events(c, "b", limit=5000)
    page = AU.list_events(c, "b", limit=30).collect()
    rest = AU.list_events(c, "b", limit=1000, before=(page[-1].timestamp, page[-1].sequence_number)).collect()
    assert [r.sequence_number for r in page + rest] == list(range(50, -1, -1))


def test_evidence_packages_per_tenant(spark):
    ev = _events(spark, ROWS).withColumn("investigation_id", F.lit("inv-1"))
    p = {r.tenant_id: r for r in AU.evidence_package(AU.build_chain(ev)).collect()}
    assert set(p) == {"α-tenant", "b"} and all(r.events == 50 and r.chain_verified and r.chain_errors == 0 for r in p.values())
    assert p["b"].package_hash != p["α-tenant"].package_hash


def test_export_is_read_back(spark, tmp_path):
    c = AU.build_chain(_events(spark, ROWS)).cache()
    r = AU.export_month(c, "2024-05", str(tmp_path / "m")).collect()
    assert [(x.month, x.rows, x.verified) for x in r] == [("2024-05", 100, True)]
    one = c.where("sequence_number = 1 and tenant_id = 'b'")
    assert AU.content_fingerprint(one).first().fingerprint != AU.content_fingerprint(one.unionByName(one).unionByName(one)).first().fingerprint
    assert AU.forward_months("2024-11", 3) == ["2024-11", "2024-12", "2025-01", "2025-02"]


def _table(spark, path):
    df = spark.createDataFrame([], "k string, v int")
    return VersionedTable(spark, str(path), "k", df.schema, buckets=4)


def _newer(old, new):
    return old.join(new.select("k"), "k", "left_anti").unionByName(new)


def test_versioned_upserts(spark, tmp_path):
    t = _table(spark, tmp_path / "t")
    rows = lambda v: spark.createDataFrame(v, "k string, v int")
    assert t.read().count() == 0
    t.upsert(rows([(f"k{i}", 0) for i in range(20)]), _newer, 0)
    t.upsert(rows([("k3", 1), ("new", 1)]), _newer, 1)
    want = {**{f"k{i}": 0 for i in range(20)}, "k3": 1, "new": 1}
    assert dict(map(tuple, t.read().collect())) == want
    t.upsert(rows([("k3", 1), ("new", 1)]), _newer, 1)  # replayed
    assert dict(map(tuple, t.read().collect())) == want and len(dict(map(tuple, t.read(0).collect()))) == 20


def test_a_failed_batch_leaves_the_table(spark, tmp_path):
    t = _table(spark, tmp_path / "t")
    rows = lambda v: spark.createDataFrame(v, "k string, v int")
    t.upsert(rows([(f"k{i}", 0) for i in range(20)]), _newer, 0)

    def breaks(old, new):
        return _newer(old, new).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception):
        t.upsert(rows([("k3", 1)]), breaks, 1)
    assert t.versions() == [0] and t.read().count() == 20
    manifest = tmp_path / "t" / "manifest" / "v0"
    manifest.write_text("{not json")
    (tmp_path / "t" / "manifest" / ".v0.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):  # a read error is not taken for an empty table
        t.upsert(rows([("k3", 1)]), _newer, 1)
    assert t.versions() == [0]
