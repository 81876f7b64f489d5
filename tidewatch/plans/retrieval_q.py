"""Registered retrieval queries (J-15, W-08, R-01..R-03, W-07, E-25).

Oracles are brute force over the whole table in DuckDB (cosine of every pair), the
independent check of the blocked exact top-k.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.operators import retrieval as RT
from tidewatch.plans.registry import register, tidy
from tidewatch.sources import tables as TB

VEC_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS vec, label,
         't' || CAST(vec_id % 4 AS VARCHAR) AS tenant_id, CAST(vec_id % 400 AS DOUBLE) AS age_days,
         'AML.T00' || CAST(label + 10 AS VARCHAR) AS technique, vec_id % 13 = 0 AS rare_important,
         'doc-' || CAST(vec_id // 2 AS VARCHAR) AS doc_id, 'v' || CAST(vec_id % 2 + 1 AS VARCHAR) AS version
  FROM embeddings)
, pairs AS (SELECT q.id AS query_id, c.id AS corpus_id, list_cosine_similarity(q.vec, c.vec) AS score,
                   q.label AS q_label, c.label AS c_label, c.doc_id, c.version
            FROM v q, v c WHERE q.id <> c.id)
"""


def _vec(spark, sf):
    return TB.vectors(spark, sf)


def _top5(spark, sf):
    v = _vec(spark, sf)
    return RT.cosine_topk(v, v, 5, exclude_self=True)


def _j15(spark, sf):
    return tidy(_top5(spark, sf).select("query_id", "corpus_id", "score", F.col("rank").cast("bigint").alias("rank")))


register("j15_cosine_top5", VEC_SQL + """
, r AS (SELECT query_id, corpus_id, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank
        FROM pairs)
SELECT query_id, corpus_id, ROUND(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5
""", headline=True)(_j15)


def _j15_cells(spark, sf):
    """The same top 5 with cells of about 50 rows, so that the pivots decide which blocks a query visits."""
    v = _vec(spark, sf)
    t = RT.cosine_topk(v, v, 5, exclude_self=True, rows_per_block=50)
    return tidy(t.select("query_id", "corpus_id", "score", F.col("rank").cast("bigint").alias("rank")))


register("j15_cosine_top5_cells", VEC_SQL + """
, r AS (SELECT query_id, corpus_id, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank
        FROM pairs)
SELECT query_id, corpus_id, ROUND(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5
""")(_j15_cells)


def _j15f(spark, sf):
    v = _vec(spark, sf)
    t = RT.cosine_topk(v, v, 5, exclude_self=True, filter_cols=("label", "label"), threshold=0.1)
    return tidy(t.select("query_id", "corpus_id", "score", F.col("rank").cast("bigint").alias("rank")))


register("j15_filtered_threshold_top5", VEC_SQL + """
, r AS (SELECT query_id, corpus_id, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank
        FROM pairs WHERE q_label = c_label AND score >= 0.1)
SELECT query_id, corpus_id, ROUND(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5
""")(_j15f)


def _w08(spark, sf):
    v = _vec(spark, sf)
    t = RT.cosine_topk(v, v, 3, exclude_self=True, doc_col="doc_id", version_col="version", preferred_version="v2")
    return tidy(t.select("query_id", "corpus_id", "score", F.col("rank").cast("bigint").alias("rank")))


register("w08_version_dedup_top3", VEC_SQL + """
, rep AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id, doc_id ORDER BY (version = 'v2') DESC, version DESC) AS vr
          FROM pairs)
, r AS (SELECT query_id, corpus_id, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank
        FROM rep WHERE vr = 1)
SELECT query_id, corpus_id, ROUND(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 3
""")(_w08)


def _r02(spark, sf):
    v = _vec(spark, sf)
    hits = RT.cosine_topk(v, v, 5, exclude_self=True)
    q = v.select(F.col("id").alias("query_id"), "tenant_id", "techniques")
    c = v.select(F.col("id").alias("corpus_id"), "tenant_id", "techniques", "age_days", "rare_important")
    r = RT.relevance_rerank(hits, q, c, 5)
    return tidy(r.select("query_id", "corpus_id", "composite", F.col("rerank").cast("bigint").alias("rerank")))


register("r02_similar_incidents", VEC_SQL + f"""
, top AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rk
                         FROM pairs) WHERE rk <= 5)
, s AS (
  SELECT t.query_id, t.corpus_id,
         {X.SCORE_ALPHA} * t.score
         + {X.SCORE_BETA} * CASE WHEN c.rare_important THEN GREATEST(rec, {X.RARE_IMPORTANT_FLOOR}) ELSE rec END
         + {X.SCORE_GAMMA} * CASE WHEN q.tenant_id = c.tenant_id THEN 1.0 ELSE 0.0 END
         + {X.SCORE_DELTA} * CASE WHEN q.technique = c.technique THEN 1.0 ELSE 0.0 END AS composite
  FROM top t JOIN v q ON q.id = t.query_id JOIN v c ON c.id = t.corpus_id,
       LATERAL (SELECT {X.SHORT_TERM_WEIGHT} * exp(-{X.DECAY_LAMBDA} * c.age_days)
                       + {X.LONG_TERM_WEIGHT} / (1 + ln(1 + c.age_days / 365.0)) AS rec))
SELECT query_id, corpus_id, ROUND(composite, 6) AS composite,
       CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY composite DESC, corpus_id) AS BIGINT) AS rerank
FROM s
""")(_r02)


def _r03(spark, sf):
    v = _vec(spark, sf)
    hits = RT.cosine_topk(v, v, 5, exclude_self=True)
    sem = (hits.join(v.select(F.col("id").alias("corpus_id"), F.explode("techniques").alias("technique")), "corpus_id")
           .select("query_id", "technique", F.col("score").alias("confidence"), F.lit("semantic").alias("source")))
    exact = v.select(F.col("id").alias("query_id"), F.explode("techniques").alias("technique"),
                     F.lit(1.0).alias("confidence"), F.lit("crosswalk").alias("source"))
    best = RT.best_per_key(exact.unionByName(sem), ["query_id", "technique"])
    return tidy(best)


register("r03_technique_mapping", VEC_SQL + """
, top AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rk
                         FROM pairs) WHERE rk <= 5)
, cand AS (SELECT id AS query_id, technique, 1.0::DOUBLE AS confidence, 'crosswalk' AS source FROM v
           UNION ALL SELECT t.query_id, c.technique, t.score, 'semantic' FROM top t JOIN v c ON c.id = t.corpus_id)
, b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id, technique ORDER BY confidence DESC, source) AS rn FROM cand)
SELECT query_id, technique, ROUND(confidence, 6) AS confidence, source FROM b WHERE rn = 1
""")(_r03)


def _e25(spark, sf):
    v = _vec(spark, sf)
    hits = RT.cosine_topk(v, v, 5, exclude_self=True)
    lab = v.select("id", "label")
    h = (hits.join(lab.select(F.col("id").alias("query_id"), F.col("label").alias("q_label")), "query_id")
         .join(lab.select(F.col("id").alias("corpus_id"), F.col("label").alias("c_label")), "corpus_id"))
    counts = lab.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    rel = lab.join(counts, "label").select(F.col("id").alias("query_id"), "n_relevant")
    return tidy(RT.retrieval_quality(h, rel, F.col("q_label") == F.col("c_label")))


register("e25_retrieval_quality", VEC_SQL + """
, top AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rk
                         FROM pairs) WHERE rk <= 5)
, pq AS (SELECT query_id, MAX(CASE WHEN rk = 1 AND q_label = c_label THEN 1 ELSE 0 END) AS hit1,
                MAX(CASE WHEN rk <= 3 AND q_label = c_label THEN 1 ELSE 0 END) AS hit3,
                SUM(CASE WHEN q_label = c_label THEN 1.0 / log2(rk + 1) ELSE 0 END) AS dcg, MIN(q_label) AS label
         FROM top GROUP BY query_id)
, nr AS (SELECT label, COUNT(*) - 1 AS n FROM v GROUP BY label)
, idc AS (SELECT label, n, (SELECT SUM(1.0 / log2(i + 1)) FROM range(1, LEAST(5, GREATEST(n, 1)) + 1) t(i)) AS idcg FROM nr)
SELECT CAST(COUNT(*) AS BIGINT) AS queries, ROUND(AVG(hit1), 6) AS hit_at_1, ROUND(AVG(hit3), 6) AS hit_at_3,
       ROUND(AVG(CASE WHEN n > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg_at_5
FROM pq JOIN idc USING (label)
""")(_e25)


def _x04(spark, sf):
    docs = TB.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    new, progress = RT.migrate_embeddings(docs, RT.hashing_embedder(64))
    stats = new.agg(F.count(F.lit(1)).alias("written"),
                    F.count_if(F.abs(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)) - 1) < 1e-4)
                    .alias("unit_vectors"),
                    F.min(F.size("vector")).cast("bigint").alias("min_dims"))
    return progress.crossJoin(stats)


register("x04_embedding_migration", """
SELECT CAST(COUNT(*) AS BIGINT) AS pending,
       CAST(COUNT(*) FILTER (WHERE text IS NOT NULL AND trim(text) <> '') AS BIGINT) AS migrated,
       CAST(COUNT(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS BIGINT) AS skipped_no_text,
       CAST(COUNT(*) FILTER (WHERE text IS NOT NULL AND trim(text) <> '') AS BIGINT) AS written,
       CAST(COUNT(*) FILTER (WHERE text IS NOT NULL AND trim(text) <> '') AS BIGINT) AS unit_vectors,
       CAST(64 AS BIGINT) AS min_dims
FROM documents
""")(_x04)


def _e26(spark, sf):
    v = _vec(spark, sf)
    hits = RT.cosine_topk(v, v, 5, exclude_self=True).checkpoint()  # read by both stores
    q = v.select(F.col("id").alias("query_id"), "tenant_id", "techniques")
    c = v.select(F.col("id").alias("corpus_id"), "tenant_id", "techniques", "age_days", "rare_important")
    hist = RT.relevance_rerank(hits, q, c, 5)
    docs = TB.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), RT.token_count("text").alias("tokens"))
    cand = (hits.select("query_id", F.col("corpus_id").alias("doc_id"), F.lit("semantic").alias("store"), "score")
            .unionByName(hist.select("query_id", F.col("corpus_id").alias("doc_id"), F.lit("history").alias("store"),
                                     F.col("composite").alias("score")))
            .join(docs, "doc_id"))
    ctx = RT.assemble_context(cand)
    return ctx.groupBy("query_id").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").cast("bigint").alias("tokens"),
                                       F.count_if(F.col("store") == "history").alias("from_history"))


def _e26_sql() -> str:
    from tidewatch.plans.registry import ORACLES
    return f"""
WITH sem AS ({ORACLES['j15_cosine_top5']}), hist AS ({ORACLES['r02_similar_incidents']})
, cand AS (SELECT query_id, corpus_id AS doc_id, 'semantic' AS store, score FROM sem
           UNION ALL SELECT query_id, corpus_id, 'history', composite FROM hist)
, d AS (SELECT c.*, CAST(floor(length(t.text) / 4) AS BIGINT) AS tokens,
               ROW_NUMBER() OVER (PARTITION BY c.query_id, c.doc_id ORDER BY c.score DESC, c.store) AS r
        FROM cand c JOIN documents t ON CAST(t.doc_id AS VARCHAR) = c.doc_id)
, k AS (SELECT *, SUM(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM d WHERE r = 1)
SELECT query_id, CAST(COUNT(*) AS BIGINT) AS items, CAST(SUM(tokens) AS BIGINT) AS tokens,
       CAST(COUNT(*) FILTER (WHERE store = 'history') AS BIGINT) AS from_history
FROM k WHERE so_far <= 4096 GROUP BY query_id
"""


register("e26_context_assembly", _e26_sql())(_e26)


def _e23(spark, sf):
    d = TB.read(spark, sf, "documents").select(
        F.lit("threat_intel_report").alias("doc_type"), F.col("source").alias("title"), F.col("text").alias("summary"),
        F.array(F.col("lang")).alias("threat_actors"), F.array().cast("array<string>").alias("mitre_techniques"))
    inv = TB.investigations(spark, sf).select(F.lit("incident_memory").alias("doc_type"),
                                              F.col("alert_title").alias("alert_name"), "classification")
    a = d.select(RT.embedding_text(d).alias("t"))
    b = inv.select(RT.embedding_text(inv).alias("t"))
    u = a.unionByName(b)
    return u.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("t")).cast("bigint").alias("chars"),
                 F.count_if(F.col("t").contains("Threat actors: ")).alias("reports"))


from tidewatch.plans.oracle_roles import with_roles  # noqa: E402

register("e23_embedding_text", with_roles("""
, a AS (SELECT concat_ws(chr(10), NULLIF(source, ''), NULLIF(text, ''), 'Threat actors: ' || lang, 'MITRE techniques: ') AS t
        FROM documents)
, b AS (SELECT concat_ws(chr(10), 'Alert: ' || alert_title, 'Classification: ' || classification) AS t FROM investigations)
, u AS (SELECT t FROM a UNION ALL SELECT t FROM b)
SELECT CAST(COUNT(*) AS BIGINT) AS docs, CAST(SUM(length(t)) AS BIGINT) AS chars,
       CAST(COUNT(*) FILTER (WHERE contains(t, 'Threat actors: ')) AS BIGINT) AS reports FROM u
""", "investigations"))(_e23)
