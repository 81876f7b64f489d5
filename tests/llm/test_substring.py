import hashlib

import numpy as np
import pytest

import brute
from tidewatch.llm import substring

SCHEMA = "doc_id long, text string, key string, n string, start string"


def rows_with_repeats(seed=7, n=60):
    rng = np.random.RandomState(seed)
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(4)]
    rows = []
    for d in range(n):
        parts = []
        for _ in range(int(rng.randint(1, 5))):
            parts.append(" ".join(f"u{rng.randint(10**6)}" for _ in range(int(rng.randint(0, 40)))))
            parts.append(passages[int(rng.randint(4))])
        rows.append((d, "\n".join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (501, rows[3][1]), (502, None), (503, ""), (504, "short one"), (505, "short one"),
             (506, "a b " * 50), (507, "\x1c ".join(f"z{i}" for i in range(30))), (508, "é ".join(f"z{i}" for i in range(30))),
             (None, rows[5][1]), (9, "other text " + passages[0]), (510, "x" * 100_000 + " " + passages[1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "k", "n", "s") for d, t in rows], SCHEMA)


def check(spark, rows):
    want = brute.substring(rows)
    text = {}
    for d, t in rows:
        text.setdefault(d, set()).add(t)
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.substring_dedup(frame(spark, rows)).collect())
    expect = sorted((d or -1, len(brute.word_list(t)), len(brute.word_list(t)) - len(want[d, t]), hashlib.sha256(" ".join(want[d, t]).encode()).hexdigest())
                    for d, t in rows)
    assert got == expect


def test_against_brute_force(spark):
    check(spark, rows_with_repeats())


def test_hot_anchors_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 3)
    check(spark, rows_with_repeats(8))


def test_deduplicated_documents(spark):
    rows = rows_with_repeats(9)
    want = brute.substring(rows)
    got = substring.deduplicated(frame(spark, rows))
    assert got.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    expect = []
    for d, t in rows:
        k = want[d, t]
        n = len(brute.word_list(t))
        if not n or k:
            expect.append((d or -1, t if len(k) == n else " ".join(k)))
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got.collect()) == sorted((d, t or "") for d, t in expect)


def test_empty(spark):
    assert substring.substring_dedup(frame(spark, [])).collect() == [] and substring.deduplicated(frame(spark, [])).collect() == []


@pytest.mark.parametrize("sigma", [1, 2, 5, 300])
def test_wavelet_rank(sigma):
    rng = np.random.RandomState(sigma)
    seq = rng.randint(sigma, size=517)
    w = substring.WaveletMatrix(seq.astype(np.int64), sigma)
    c = rng.randint(sigma, size=400)
    lo = rng.randint(0, 518, size=400)
    hi = np.maximum(lo, rng.randint(0, 518, size=400))
    a, b = w.rank(c, lo, hi)
    assert a.tolist() == [int((seq[:i] == x).sum()) for i, x in zip(lo, c)]
    assert b.tolist() == [int((seq[:i] == x).sum()) for i, x in zip(hi, c)]


def test_index_finds_the_earliest_place():
    rng = np.random.RandomState(2)
    runs = [rng.randint(2, size=int(rng.randint(20, 60))).astype(np.uint64) for _ in range(80)]
    index = substring.FMIndex(runs)
    at = np.flatnonzero(index.left >= 20)
    seen, want = {}, []
    for p in at.tolist():
        r = index.run_of[p]
        w = tuple(runs[r][p - index.begin[r]:p - index.begin[r] + 20].tolist())
        want.append(seen.setdefault(w, p))
    assert index.earliest(at).tolist() == want


def test_equal_windows_have_equal_anchors():
    rng = np.random.RandomState(4)
    h = rng.randint(3, size=400).astype(np.uint64)
    key, at, first = substring.anchors(h)
    run = np.searchsorted(first, np.arange(len(h) - 19), side="right") - 1
    by = {}
    for p in range(len(h) - 19):
        got = (key[run[p]], at[run[p]] - p)
        assert by.setdefault(h[p:p + 20].tobytes(), got) == got


def test_many_rows_without_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, f"own {i} {' '.join(f'w{i}x{j}' for j in range(30))} {passage} end {i}") for i in range(400)] + [(None, passage)] * 3 + [(7, passage)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string")
    got = sorted((r["doc_id"] is not None, r["kept_sha256"], r["n_removed"]) for r in substring.substring_dedup(df).collect())
    kept = brute.substring(rows)
    want = sorted((i is not None, hashlib.sha256(" ".join(kept[i, t]).encode()).hexdigest(), len(brute.word_list(t)) - len(kept[i, t])) for i, t in rows)
    assert got == want
