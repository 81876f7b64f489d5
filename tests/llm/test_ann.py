import numpy as np
import pandas as pd

from tidewatch.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, ids string, shard string, dim string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], SCHEMA)


def exact(rows, q, k=10):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in rows:
        if i % q == 0:
            near = sorted((float(np.sqrt(np.square(np.array(v) - np.array(w)).sum())), j) for j, w in rows if j != i and len(w) == len(v))
            out[i] = near[:k]
    return out


def check(got, want, least):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert by.keys() == {k for k, v in want.items() if v}
    hit = 0
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(want[q]) + 1))
        assert [f[1:] for f in found] == sorted(f[1:] for f in found)
        hit += len({f[2] for f in found} & {w[1] for w in want[q]})
        true = {w[1]: w[0] for w in want[q]}
        assert all(abs(true[f[2]] - f[1]) < 1e-12 for f in found if f[2] in true)
    assert hit >= least * sum(map(len, want.values()))


def test_recall_over_shards(spark):
    rng = np.random.RandomState(5)
    rows = [(i, [float(x) for x in rng.randn(16).astype(np.float32)]) for i in range(1500)]
    check(ann.nearest(frame(spark, rows), every=50, shard=400).collect(), exact(rows, 50), 0.95)


def test_copies_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(60)]
    rows += [(100 + i, [0.0, float(i % 7 + 1), 0.0, 0.0]) for i in range(40)]
    rows += [(200, None), (300, []), (400, [0.0] * 4), (500, [1.0, None, 0.0, 0.0]), (600, [float("nan")] * 4), (700, [float("inf"), 0.0, 0.0, 0.0]),
             (None, [1.0, 1.0, 1.0, 1.0]), (0, [1.0, 0.0, 0.0, 0.0]), (800, [3.0, 4.0]), (801, [3.0, 5.0])]
    check(ann.nearest(frame(spark, rows), every=10, shard=30).collect(), exact(rows, 10), 1.0)


def test_huge_components(spark):
    rows = [(i, [1e30 * (i + 1), float(i)]) for i in range(12)]
    got = ann.nearest(frame(spark, rows), every=5).collect()
    assert len(got) == 30 and all(np.isfinite(r["score"]) for r in got)


def _recall(v, asked, k=10):
    index = ann._build_shard(pd.DataFrame({"dim": v.shape[1], "shard": 0, "ids": [[i] for i in range(len(v))], "vector": v.tolist()}))
    q = pd.DataFrame({"query_id": asked, "vector": v[asked].tolist()})
    got = ann._search_cell(k, ann.BEAM)(index, q)
    hits = 0
    for i, found in got.groupby("query_id")["vec_id"]:
        d = np.square(v - v[i]).sum(axis=1)
        d[i] = np.inf
        hits += len(set(found) & set(np.argsort(d, kind="stable")[:k].tolist()))
    return hits / (k * len(asked))


def test_one_huge_vector_in_a_shard():
    v = np.random.RandomState(4).randn(1500, 16)
    v /= np.linalg.norm(v, axis=1)[:, None]
    asked = list(range(0, 1500, 25))
    for huge in (1.0, 1e8, 1e30):
        w = v.copy()
        w[7] = huge
        assert _recall(w, asked) >= 0.95, huge
    far = v.copy()
    far[1200:] += 1e6  # a second group far away
    assert _recall(far, asked) >= 0.9
    assert _recall(np.concatenate([v, [[1e8] * 16]]), [3, 1500]) >= 0.9  # the huge one is itself a query


def test_empty(spark):
    assert ann.nearest(frame(spark, [])).collect() == []
    assert ann.nearest(frame(spark, [(100, [1.0, 2.0])])).collect() == []


def test_robust_prune_keeps_the_nearest_and_skips_its_shadow():
    x = np.array([[0, 0], [1, 0], [1.05, 0], [0, 2]], dtype=np.float32)
    assert ann.robust_prune(x, np.array([0]), np.array([[1, 2, 3]]), 3, 1.2)[0].tolist() == [1, 3, -1]
