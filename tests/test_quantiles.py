"""Exact percentiles by refined counts, and gaps over ranges of time, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import quantiles as Q

SCHEMA = "k string, g int, v double"


def _rows(seed):
    rng = random.Random(seed)
    rows = [("hot", 1, rng.choice([rng.gauss(0, 1), rng.lognormvariate(0, 6), 3.0, -1e300, 1e300, 5e-324])) for _ in range(3000)]
    rows += [(f"k{i % 40}", i % 2, float(rng.randint(0, 5))) for i in range(400)] + [(None, None, float(i)) for i in range(7)] + [("one", 0, 2.5)]
    return rows + [("hot", 1, None), ("none", 0, None), ("none", 0, float("nan")), ("one", 0, float("inf")), ("tie", 0, 1.5), ("tie", 0, 1.5)]


@pytest.mark.parametrize("bins, limit", [(64, 5), (1024, 100), (1024, 10_000)])
def test_equal_to_sorting(spark, monkeypatch, bins, limit):
    monkeypatch.setattr(Q, "BINS", bins)
    monkeypatch.setattr(Q, "LIMIT", limit)
    rows = _rows(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = Q.add_percentiles(df.groupBy("k", "g").agg(F.count(F.lit(1)).alias("n")), df, ["k", "g"], "v", {"lo": 0.0, "mid": 0.5, "p95": 0.95, "hi": 1.0}).collect()
    by = {}
    for k, g, v in rows:
        by.setdefault((k, g), []).extend([v] if v is not None and np.isfinite(v) else [])
    assert len(got) == len(by)
    for r in got:
        v = by[r.k, r.g]
        want = [None] * 4 if not v else [float(np.percentile(v, p)) for p in (0, 50, 95, 100)]
        assert [r.lo, r.mid, r.p95, r.hi] == (want if not v else pytest.approx(want, rel=1e-12))


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert Q.add_percentiles(df.groupBy("k").count(), df, ["k"], "v", {"m": 0.5}).collect() == []


def test_gaps(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 40) * 7_000_000 + rng.randint(0, 3)) for _ in range(300)]
    got = Q.gaps(spark.createDataFrame(rows, "k string, us long"), ["k"], F.col("us"), 10).collect()
    for k in ("a", "b", None):
        t = sorted(us for x, us in rows if x == k)
        want = sorted([(t[0], None)] + [(b, b - a) for a, b in zip(t, t[1:])], key=repr)
        assert sorted([(r.us, r.gap_us) for r in got if r.k == k], key=repr) == want
