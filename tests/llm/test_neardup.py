import numpy as np

import brute
from conftest import SF01
from tidewatch.llm import neardup

SCHEMA = "doc_id long, text string, node string, key string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], SCHEMA)


def edited(rng, ws, share):
    ws = list(ws)
    for i in rng.choice(len(ws), max(1, int(share * len(ws))), replace=False):
        ws[i] = f"e{rng.randint(10**6)}"
    return " ".join(ws)


def copies(seed=1):
    rng = np.random.RandomState(seed)
    rows, d = [], 0
    for _ in range(12):
        base = [f"w{rng.randint(10**5)}" for _ in range(int(rng.randint(80, 300)))]
        for _ in range(int(rng.randint(1, 12))):
            rows.append((d, edited(rng, base, float(rng.choice([0.0, 0.005, 0.01, 0.02, 0.04])))))
            d += 1
    return rows


def classes(got):
    by = {}
    for r in got:
        by.setdefault(r["class_id"], set()).add(r["doc_id"])
    return {frozenset(v) for v in by.values()}


def expected(rows):
    by = {}
    for d, c in brute.near_classes(rows).items():
        by.setdefault(c, set()).add(d)
    return {frozenset(v) for v in by.values()}


def test_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    got = neardup.near_duplicates(docs).collect()
    assert classes(got) == expected([tuple(r) for r in docs.collect()])
    assert sum(r["kept"] for r in got) == len(classes(got))


def test_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 3)
    monkeypatch.setattr(neardup, "BROADCAST_NODES", 0)
    rows = copies(2)
    rng = np.random.RandomState(6)
    shared = [f"s{i}" for i in range(120)]  # a passage of many documents, half of each
    rows += [(1000 + i, " ".join(shared + [f"o{rng.randint(10**6)}" for _ in range(90)])) for i in range(60)]
    rows += [(2000 + i, edited(rng, rows[-1 - i][1].split(), 0.02)) for i in range(10)]
    assert classes(neardup.near_duplicates(frame(spark, rows)).collect()) == expected(rows)


def test_no_pair_is_lost_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 1)  # every bucket is large; few bands, so that splitting by others would lose pairs
    rows, pairs = [], []
    for f in range(120):
        base = [f"f{f}x{i}" for i in range(200)]
        x = base + [f"x{f}y{i}" for i in range(20)]
        y = base + [f"z{f}y{i}" for i in range(20)]
        others = [base[:150 + 5 * j] + [f"o{f}j{j}n{i}" for i in range(40)] for j in range(5)]
        d = 10 * f
        rows += [(d, " ".join(x)), (d + 1, " ".join(y))] + [(d + 2 + j, " ".join(o)) for j, o in enumerate(others)]
        pairs.append((d, d + 1))
    docs = frame(spark, rows)
    keys = {r["doc_id"]: set(r["keys"]) for r in neardup.signatures(docs, bands=8).collect()}
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs, bands=8).collect()}
    shared = [(a, b) for a, b in pairs if keys[a] & keys[b]]
    assert len(shared) > 100 and [(a, b) for a, b in shared if found[a] != found[b]] == []


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "two  words"), (6, long), (7, long + " more"), (8, "clean text of its own, not like others"),
            (9, "two words"), (9, "another one entirely, with words"), (None, "two words"), (6, long)]
    got = sorted(((r["doc_id"] or 0, r["class_id"], r["kept"]) for r in neardup.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (6, 6, True), (7, 6, False),
                          (8, 8, True), (9, 4, False), (9, 9, True), (0, 4, False)], key=repr)
    kept = neardup.representatives(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "node", "key", "n"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 8, 9]
    assert neardup.near_duplicates(frame(spark, [])).collect() == []


def test_components_against_union_find(spark):
    rng = np.random.RandomState(0)
    edges = [(bytes([a]), bytes([b])) for a, b in rng.randint(0, 120, size=(90, 2))] + [(bytes([i]), bytes([i + 1])) for i in range(130, 170)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {bytes(r["node"]): bytes(r["root"]) for r in neardup.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_signature_estimates_weighted_similarity():
    rng = np.random.RandomState(3)
    e = neardup.mix(np.arange(1, 400, dtype=np.uint64))
    wa, wb = rng.randint(0, 4, 399).astype(float), rng.randint(0, 4, 399) + 0.5
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    k = 2048
    a = neardup.signature(e[wa > 0], wa[wa > 0], k)
    b = neardup.signature(e[wb > 0], wb[wb > 0], k)
    assert abs((a == b).mean() - want) < 4 * np.sqrt(want * (1 - want) / k)
    for n in (1, 3, 5000):
        one = neardup.mix(np.arange(7, 7 + n, dtype=np.uint64))
        assert neardup.signature(one, np.ones(n), 96).all()
