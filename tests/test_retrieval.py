"""Exact cosine top-k with pivots against every pair."""

import numpy as np
import pytest

from tidewatch.operators import retrieval as RT

SCHEMA = "id string, vec array<double>, label string, doc string, version string"


def _vectors(spark, kind, n=400, seed=1):
    rng = np.random.RandomState(seed)
    if kind == "clusters":
        centres = rng.randn(12, 8)
        vecs = centres[rng.randint(12, size=n)] + rng.randn(n, 8) * 0.02
    else:
        vecs = rng.randn(n, 8)
    vecs[5] = vecs[6] = vecs[7]  # ties
    vecs[10] = vecs[11] = 0.0
    vecs[20:40] = np.abs(vecs[20:40]) * 1e3
    rows = [(f"v{i:03}", v.tolist(), "ab"[i % 2], f"d{i // 3}", f"v{i % 3}") for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, SCHEMA).cache(), rows


def _plain(rows, k, threshold=None, filtered=False, dedup=False, preferred=None):
    m = np.array([r[1] for r in rows])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(norm == 0, 1, norm)
    s, out = m @ m.T, {}
    for i, q in enumerate(rows):
        hits = [(j, c) for j, c in enumerate(rows) if i != j and (threshold is None or s[i, j] >= threshold) and (not filtered or q[2] == c[2])]
        if dedup:
            best = {}
            for j, c in sorted(hits, key=lambda x: (x[1][4] == preferred, x[1][4])):
                best[c[3]] = (j, c)
            hits = list(best.values())
        out[q[0]] = [(round(s[i, j], 9)) for j, c in sorted(hits, key=lambda x: (-s[i, x[0]], x[1][0]))[:k]]
    return out


def _got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(round(r.score, 9))
    return out


@pytest.mark.parametrize("kind", ["clusters", "random"])
def test_pivots_lose_no_row(spark, kind):
    v, rows = _vectors(spark, kind)
    for size in (7, 40, 1000):
        want = {q: x for q, x in _plain(rows, 5).items() if x}
        assert _got(RT.cosine_topk(v, v, 5, exclude_self=True, rows_per_block=size)) == want
    want = {q: x for q, x in _plain(rows, 4, threshold=0.5, filtered=True).items() if x}
    assert _got(RT.cosine_topk(v, v, 4, exclude_self=True, filter_cols=("label", "label"), threshold=0.5, rows_per_block=20)) == want
    want = {q: x for q, x in _plain(rows, 3, dedup=True, preferred="v1").items() if x}
    assert _got(RT.cosine_topk(v, v, 3, exclude_self=True, doc_col="doc", version_col="version", preferred_version="v1", rows_per_block=20)) == want


def test_equal_scores_go_to_the_smaller_ids(spark):
    v = spark.createDataFrame([(f"x{i}", [1.0, float(i % 2)], "a", "d", "v") for i in range(60)], SCHEMA)
    got = RT.cosine_topk(v.where("id = 'x1'"), v, 4, exclude_self=True, rows_per_block=5).orderBy("rank").collect()
    assert [r.corpus_id for r in got] == ["x11", "x13", "x15", "x17"]


def test_clusters_are_skipped(spark):
    v, _ = _vectors(spark, "clusters")
    r = RT.cells_scored(v, v, 5, rows_per_block=20, exclude_self=True).first()
    assert r.queries == 400 and r.visits < r.all_visits / 2


def test_empty_sides(spark):
    v, _ = _vectors(spark, "random", 50)
    none = v.where("id = 'none'")
    assert RT.cosine_topk(none, v, 3).count() == 0 and RT.cosine_topk(v, none, 3).count() == 0


def test_packed_cut_and_dealt_blocks_lose_no_row(spark, monkeypatch):
    """Cells packed into blocks, cells larger than a block, several tasks a block, and slices of a few queries."""
    v, rows = _vectors(spark, "random", 200)
    want = {q: x for q, x in _plain(rows, 5).items() if x}
    deduped = {q: x for q, x in _plain(rows, 3, dedup=True, preferred="v1").items() if x}
    for size, cap in (("BLOCK_ROWS", 30), ("LANE_QUERIES", 40), ("SCORES", 500)):
        monkeypatch.setattr(RT, size, cap)
    for per_cell in (5, 1000):
        assert _got(RT.cosine_topk(v, v, 5, exclude_self=True, rows_per_block=per_cell)) == want
    assert _got(RT.cosine_topk(v, v, 3, exclude_self=True, doc_col="doc", version_col="version", preferred_version="v1", rows_per_block=5)) == deduped


def test_a_task_holds_a_slice_of_scores():
    """Memory of a batch of queries in a block does not grow with the batch."""
    import tracemalloc

    import pandas as pd
    n, rng = 20_000, np.random.RandomState(3)
    block = RT._Block(pd.DataFrame({"id": [str(i) for i in range(n)], "cell": 0, "doc": "", "ver": ""}), rng.randn(n, 4), 5, None, True, False, None)
    queries = pd.DataFrame({"id": [str(i) for i in range(4000)], "cell": 0, "floor": np.nan, "vec": list(rng.randn(4000, 4))})
    tracemalloc.start()
    got = sum(len(x) for x in block.best(queries, (np.ones((1, 4)) / 2, np.array([np.pi])), True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == 5 * 4000 and peak < 12 * 8 * RT.SCORES  # a score of every pair would be 640 MB
