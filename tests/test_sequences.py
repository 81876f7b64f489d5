"""Skew-safe sequence operators vs plain-Python restatements (random events over four days)."""

import datetime as dt
import random
from collections import deque

from tidewatch.operators import sequences as SQ


def _rows(n=1500, seed=1):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    return [(rnd.choice("ab"), t0 + dt.timedelta(seconds=rnd.randint(0, 4 * 86400)), rnd.random() < 0.3, i,
             rnd.random(), rnd.choice(["critical", "high", "low"])) for i in range(n)]


def test_sequences_match_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, ok boolean, i int, conf double, sev string")
    srt = sorted(rows, key=lambda r: (r[0], r[1], r[3]))
    run, runs = {}, {}
    for k, t, ok, i, *_ in srt:
        run[k] = 0 if ok else run.get(k, 0) + 1
        runs[i] = run[k]
    assert {r.i: r.failure_run for r in SQ.failure_runs(df, "k", "ts", "ok", "i").collect()} == runs

    trail = {i: sum(1 for k2, t2, *_ in rows if k2 == k and t - dt.timedelta(seconds=3600) <= t2 <= t)
             for k, t, _, i, *_ in rows}
    assert {r.i: r.trailing_count for r in SQ.trailing_count(df, "k", "ts", 3600).collect()} == trail

    grants, want = {}, {}
    for k, t, ok, i, c, s in srt:
        d = grants.setdefault(k, deque())
        while d and t.timestamp() - d[0] >= 3600:
            d.popleft()
        g = c < 0.6 and s in ("critical", "high") and len(d) < 10
        if g:
            d.append(t.timestamp())
        want[i] = g
    got = {r.i: r.escalated for r in SQ.escalation_budget(df, "k", "ts", "conf", "sev", order_cols=("i",)).collect()}
    assert got == want


def test_cosine_ties_go_to_the_smallest_ids(spark):
    from tidewatch.operators import retrieval as RT
    rows = [(str(1000 + i), [1.0, 0.0]) for i in range(2000)]
    corpus = spark.createDataFrame(rows, "id string, vec array<double>")
    q = spark.createDataFrame([("q", [2.0, 0.0])], "id string, vec array<double>")
    for block in (100, 5000):
        got = RT.cosine_topk(q, corpus, 3, rows_per_block=block).orderBy("rank").collect()
        assert [r.corpus_id for r in got] == ["1000", "1001", "1002"]
