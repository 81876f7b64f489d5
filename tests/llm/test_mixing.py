import duckdb
import numpy as np

from tidewatch.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, tokens string, weight string"


def frame(spark):
    rng = np.random.RandomState(3)
    rows = [(i, " ".join(["w"] * int(rng.randint(1, 60))) + ("!" if i % 7 == 0 else ""), ["en", "de", None][int(rng.randint(3))],
             "hot" if i % 3 else f"s{i % 5}", "x", "y") for i in range(600)]
    rows += [(1000, None, "en", None, "x", "y"), (1001, "", "fr", "s1", "x", "y"), (None, "null id", "en", "hot", "x", "y"), (3, rows[3][1], "en", "s3", "x", "y")]
    return spark.createDataFrame(rows, SCHEMA)


def test_marginals_and_share(spark):
    got = mixing.mix(frame(spark)).toPandas()
    assert len(got) == 604
    raked = got.tokens * got.weight
    for d in mixing.DIMS:
        have = raked.groupby(got[d]).sum()
        n = got.tokens.groupby(got[d]).sum().astype(float)
        n = n[n > 0]
        want = n**mixing.ALPHA[d] / (n**mixing.ALPHA[d]).sum() * got.tokens.sum()
        assert np.allclose(have[want.index], want, rtol=1e-3)
    assert abs((got.tokens * got.probability).sum() / got.tokens.sum() - mixing.SHARE) < 1e-6
    assert abs(got.tokens[got.drawn].sum() / got.tokens.sum() - mixing.SHARE) < 0.08


def test_spark_rounds_equal_driver_rounds(spark):
    a = {tuple(r)[:4]: r for r in mixing.mix(frame(spark)).collect()}
    cells = mixing.keyed(frame(spark)).groupBy(*mixing.DIMS).agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "tokens")
    one = {tuple(r)[:3]: r for r in mixing.rake(cells, rounds=3).collect()}
    two = {tuple(r)[:3]: r for r in mixing.rake(cells, rounds=3, max_cells=0).collect()}
    assert one.keys() == two.keys() and a
    for k in one:
        assert abs(one[k]["weight"] - two[k]["weight"]) < 1e-9 and abs(one[k]["probability"] - two[k]["probability"]) < 1e-5


def test_tiny_weights_give_the_same_factor(spark):
    # Language z is held by the small source b only, so raking drives the cell (b, x) towards 0.
    cells = spark.createDataFrame([("a", "x", "p", 10**9), ("a", "y", "p", 1000), ("b", "x", "p", 10**6), ("b", "z", "p", 10)],
                                  "source string, lang string, topic string, tokens long")
    one, two = ({tuple(r)[:3]: r for r in mixing.rake(cells, {"source": 1.0, "lang": 0.05, "topic": 1.0}, 4, max_cells=n).collect()}
                for n in (mixing.MAX_CELLS, 0))
    assert min(r["weight"] for r in one.values()) < 1e-6
    for k in one:
        assert np.isclose(one[k]["weight"], two[k]["weight"], rtol=1e-9, atol=1e-9) and abs(one[k]["probability"] - two[k]["probability"]) < 1e-9
    tokens = {tuple(r)[:3]: r["tokens"] for r in cells.collect()}
    assert abs(sum(tokens[k] * r["probability"] for k, r in two.items()) / sum(tokens.values()) - mixing.SHARE) < 1e-9


def test_sql_gives_the_same_rows(spark, tmp_path):
    df = frame(spark)
    pdf = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("pdf", pdf)
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, source FROM pdf")
    from pyspark.sql import functions as F
    m = mixing.mix(df).withColumn("weight", F.round("weight", 6)).withColumn("probability", F.round("probability", 6))
    assert sorted(map(tuple, m.collect()), key=repr) == sorted(map(tuple, con.sql(mixing.mix_sql()).fetchall()), key=repr)


def test_drawn_documents_are_the_drawn(spark):
    df = frame(spark).where("doc_id is not null and doc_id <> 3")
    want = {r["doc_id"] for r in mixing.mix(df).where("drawn").collect()}
    got = mixing.drawn_documents(df, df.columns)
    assert got.columns == df.columns and {r["doc_id"] for r in got.collect()} == want


def test_empty(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(e).collect() == [] and mixing.drawn_documents(e, ["doc_id"]).collect() == []
