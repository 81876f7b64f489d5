"""Top-k that grows with the tables: what a block scores, holds and hands to tasks, and that its rows stay exact."""

import math
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from test_retrieval import SCHEMA, _got, _plain, _vectors

from tidewatch.operators import retrieval as RT
from tidewatch.plans import retrieval_q as RQ

INDEX = (np.ones((1, 4)) / 2, np.array([np.pi]))


def _block(vecs, k=3, threshold=None, dedup=False, ids=None):
    n = len(vecs)
    rows = pd.DataFrame({"id": ids or [f"{i:05}" for i in range(n)], "cell": 0, "doc": [f"d{i // 2}" for i in range(n)], "ver": [f"v{i % 2 + 1}" for i in range(n)]})
    return RT._Block(rows, vecs, k, threshold, True, dedup, "v2")


def _asked(block, vecs, ids, first=True, floor=np.nan, cell=0):
    q = pd.DataFrame({"id": ids, "cell": cell, "floor": floor, "vec": list(vecs)})
    out = pd.concat(list(block.best(q, INDEX, first)))
    return {x: list(g["corpus_id"]) for x, g in out.groupby("query_id")}


def test_versions_of_a_block_hold_a_tile_of_scores():
    """W-08: no score, and no score of a document, of every query and row is held."""
    n, rng = 20_000, np.random.RandomState(3)
    vecs = rng.randn(n, 4)
    block = _block(vecs, dedup=True)
    tracemalloc.start()
    got = _asked(block, vecs[:4000], [f"{i:05}" for i in range(4000)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 4000 and peak < 8 * RT.SCORES  # 80 M scores, 40 M of documents
    # The preferred version stands for its document; its own query sees the other one.
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for i in (0, 1, 2, 3999):
        rep = [j for j in range(1, n, 2) if j != i] + ([i - 1] if i % 2 else [])
        want = sorted(rep, key=lambda j: (-(u[i] * u[j]).sum(), j))[:3]
        assert got[f"{i:05}"] == [f"{j:05}" for j in want]


def test_copies_of_a_vector_are_scored_for_their_first_ids():
    vecs = np.r_[np.ones((3000, 4)), np.random.RandomState(1).randn(50, 4)].astype(np.float32)
    block = _block(vecs)
    assert len(block.rows) == 3 + 1 + 50
    got = _asked(block, vecs[[0, 2, 2999]], ["00000", "00002", "02999"])
    assert got == {"00000": ["00001", "00002", "00003"], "00002": ["00000", "00001", "00003"], "02999": ["00000", "00001", "00002"]}
    twice = _block(vecs, ids=[f"{i // 2:05}" for i in range(len(vecs))])  # an id may come twice
    assert _asked(twice, vecs[:1], ["00000"]) == {"00000": ["00001", "00001", "00002"]}


def test_scores_closer_than_single_precision_keep_their_order():
    a = 0.5 + np.arange(40) * 1e-9
    vecs = np.c_[np.cos(a), np.sin(a), np.zeros((40, 2))][np.random.RandomState(2).permutation(40)]
    ids = [f"{i:05}" for i in range(40)]
    q = np.array([[1.0, 0, 0, 0]])
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    want = [ids[j] for j in sorted(range(40), key=lambda j: (-u[j, 0], j))[:3]]
    assert _asked(_block(vecs), q, ["q"]) == {"q": want}
    # The second round, with a floor that three rows reach.
    floor = sorted(u[:, 0])[-3]
    assert _asked(_block(vecs), q, ["q"], first=False, floor=floor, cell=7) == {"q": want}


@pytest.mark.parametrize("threshold", [None, 0.2, 0.6])
def test_versions_with_a_threshold_and_broken_vectors(spark, threshold, monkeypatch):
    _, rows = _vectors(spark, "random", 160)
    rows[30] = (*rows[30][:1], [math.nan] * 8, *rows[30][2:])
    rows[31] = (*rows[31][:1], [1.0] * 7 + [None], *rows[31][2:])
    v = spark.createDataFrame(rows, SCHEMA).cache()
    whole = [r for i, r in enumerate(rows) if i not in (30, 31)]
    want = {q: x for q, x in _plain(whole, 3, threshold=threshold, dedup=True, preferred="v1").items() if x}
    for tile, scores in (((128, 4096), RT.SCORES), ((7, 20), 400)):
        monkeypatch.setattr(RT, "TILE", tile)
        monkeypatch.setattr(RT, "SCORES", scores)
        monkeypatch.setattr(RT, "BLOCK_ROWS", 60)
        got = _got(RT.cosine_topk(v, v, 3, exclude_self=True, doc_col="doc", version_col="version", preferred_version="v1", threshold=threshold, rows_per_block=20))
        assert got == want


def test_blocks_and_lanes_get_tasks_of_their_own(spark, monkeypatch):
    """A few heavy keys must not share the few partitions that the session has."""
    monkeypatch.setattr(RT, "BLOCK_ROWS", 100)
    monkeypatch.setattr(RT, "LANE_QUERIES", 50)
    v, _ = _vectors(spark, "random", 400)
    plan = RT.cosine_topk(v, v, 5, exclude_self=True, rows_per_block=100)._jdf.queryExecution().optimizedPlan().toString()
    dealt = [int(x) for x in re.findall(r"RepartitionByExpression \[flt.*\], (\d+)", plan)]
    assert dealt and min(dealt) >= 4 * 4 * 8


def test_context_finds_neighbours_once_and_leaves_texts_where_they_are(spark, tmp_path):
    """E-26: both stores read the same top-k, and no text goes through a join or a window."""
    rng, n = np.random.RandomState(5), 60
    vecs = rng.randn(n, 8).astype(np.float32)
    spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(vecs)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    texts = [(i, None if i == 4 else "é" * int(rng.randint(1, 8000))) for i in range(n - 5)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = RQ._e26(spark, str(tmp_path))
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert "MapIn" not in plan
    joined = [x for x in plan.splitlines() if re.search(r"Window|Join|Sort", x)]
    assert joined and not any("text#" in x for x in joined)
    assert all("length" in x for x in plan.splitlines() if "text#" in x and "Project" in x)
    u = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {x.query_id: x for x in r.collect()}
    length = dict(texts)
    for i in range(n):
        found = [j for j in np.argsort(-s[i])[:5] if j in length]
        if all((len(length[j] or "") // 4) * 1 for j in found) and sum(len(length[j]) // 4 for j in found) <= 4096 and found:
            x = got[str(i)]
            assert (x["items"], x.tokens) == (len(found), sum(len(length[j]) // 4 for j in found))
