import hashlib
import random
import re
from collections import defaultdict

from tidewatch.llm import exactdup

SCHEMA = "doc_id long, text string, digest string, chars string, delivery string"


def plain_version(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((-len(t or ""), i is None, i))
    out = []
    for sha, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        out += [(m[2], members[0][2], len(members), k == 0, sha) for k, m in enumerate(members)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_the_plain_version(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["ab c", "a b c", "abc", "x", "é 😀", "é😀 ", "\v\f"]) for _ in range(rng.randint(0, 3)))) for i in range(900)]
    rows += [(None, "ab c"), (None, "ab c"), (5, "ab  c"), (5, "ab  c"), (-2, None), (-1, ""), (3, " \t\r\n "), (2000, "long text\n" * 50_000), (2001, "long text" * 50_000)]
    rows += [(i, "hot passage") for i in range(3000, 3600)] + [(2999, "hot passag e "), (2998, "hot passag e ")]
    got = collected(exactdup.exact_duplicates(frame(spark, rows)))
    assert got == plain_version(rows)
    assert collected(exactdup.exact_duplicates(frame(spark, rows), deliveries=1)) == got


def test_hot_and_other_digests_take_the_same_decision(spark, monkeypatch):
    rows = [(i, f"text {i % 7}") for i in range(100)]
    monkeypatch.setattr(exactdup, "HOT", 1)
    assert collected(exactdup.exact_duplicates(frame(spark, rows))) == plain_version(rows)


def test_an_index_outlives_its_session_and_takes_deliveries(spark, tmp_path):
    path = str(tmp_path / "index")
    index = exactdup.DigestIndex.open(spark, path, 3)
    first = {r["doc_id"]: r for r in exactdup.deliver(index, frame(spark, [(4, "a b"), (3, "a b"), (2, "c")]), "monday").collect()}
    assert [first[i]["kept"] for i in (2, 3, 4)] == [True, True, False] and first[4]["keep_id"] == 3
    before = index.entries().count()
    again = {r["doc_id"]: r["kept"] for r in exactdup.deliver(index, frame(spark, [(4, "a b"), (3, "a b"), (2, "c")]), "monday").collect()}
    assert index.entries().count() == before and again == {2: True, 3: True, 4: False}
    spark.sql(f"DROP TABLE {index.table}")  # as in another session; the files stay
    index = exactdup.DigestIndex.open(spark, path, 99)
    assert index.buckets == 3 and index.entries().count() == before
    second = {r["doc_id"]: r for r in exactdup.deliver(index, frame(spark, [(1, "a    b"), (3, "a b"), (9, "new")]), "tuesday").collect()}
    assert {i: r["kept"] for i, r in second.items()} == {1: False, 3: False, 9: True}
    assert second[1]["keep_id"] == 3 and index.entries().count() == before + 1


def test_the_index_is_read_by_buckets_without_python(spark):
    index = exactdup.DigestIndex.open(spark, exactdup.scratch(spark, "plan"), 8)
    rows = exactdup.written(frame(spark, [(i, f"t {i}") for i in range(50)]))
    index.append(rows, "all")
    plan = (rows.groupBy("digest").count().join(index.entries().select("digest").hint("merge"), "digest", "left_anti")
            ._jdf.queryExecution().executedPlan().toString())
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1
    assert "Python" not in plan + index.decide(rows)._jdf.queryExecution().toString()


def test_empty_table(spark):
    assert exactdup.exact_duplicates(frame(spark, [])).collect() == []
