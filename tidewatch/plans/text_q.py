"""Registered text queries over ``documents``, ``pages`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import text as TX
from tidewatch.plans.registry import register, tidy
from tidewatch.sources import tables as TB


def sq(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _docs(spark, sf):
    return TB.read(spark, sf, "documents").select("doc_id", "text")


# ---------------------------------------------------------------- T-02
def _t02(spark, sf):
    r = _docs(spark, sf).select("doc_id", TX.regex_iocs("text").alias("r"))
    return (r.where(F.size("r.raw_iocs") > 0)
            .select("doc_id", F.size("r.ips").cast("bigint").alias("n_ips"),
                    F.size("r.sha256").cast("bigint").alias("n_sha256"),
                    F.size("r.sha1").cast("bigint").alias("n_sha1"),
                    F.size("r.domains").cast("bigint").alias("n_domains"),
                    F.array_join("r.raw_iocs", ",").alias("raw_iocs")))


T02_SQL = f"""
WITH x AS (
  SELECT doc_id,
    list_filter(list_distinct(regexp_extract_all(text, {sq(TX.RE_IPV4)})),
                lambda ip: list_bool_and(list_transform(string_split(ip, '.'), lambda p: CAST(p AS INTEGER) <= 255))) AS ips,
    list_distinct(list_transform(regexp_extract_all(text, {sq(TX.RE_SHA256)}), lambda h: lower(h))) AS sha256,
    list_distinct(list_transform(regexp_extract_all(text, {sq(TX.RE_SHA1)}), lambda h: lower(h))) AS sha1_all,
    list_distinct(regexp_extract_all(text, {sq(TX.RE_IOC_DOMAIN)})) AS dom_all
  FROM documents)
, y AS (SELECT doc_id, ips, sha256,
          list_filter(sha1_all, lambda h: NOT list_bool_or(list_transform(sha256, lambda s: contains(s, h)) || [false])) AS sha1,
          dom_all FROM x)
, z AS (SELECT doc_id, ips, sha256, sha1,
          list_filter(dom_all, lambda d: NOT list_contains(ips || sha256 || sha1, d)) AS domains FROM y)
SELECT doc_id, CAST(len(ips) AS BIGINT) AS n_ips, CAST(len(sha256) AS BIGINT) AS n_sha256,
       CAST(len(sha1) AS BIGINT) AS n_sha1, CAST(len(domains) AS BIGINT) AS n_domains,
       array_to_string(list_sort(list_distinct(ips || sha256 || sha1 || domains)), ',') AS raw_iocs
FROM z WHERE len(ips) + len(sha256) + len(sha1) + len(domains) > 0
"""
register("t02_regex_iocs", T02_SQL)(_t02)


# ---------------------------------------------------------------- T-06 / T-07 / W-13
def _t06(spark, sf):
    r = TX.redact_pii(_docs(spark, sf), "text")
    c = TX.placeholder_counts("redaction_map")
    return (r.where(F.size("redaction_map") > 0)
            .select("doc_id", c["ip_src"].cast("bigint").alias("ip_placeholders"),
                    c["user"].cast("bigint").alias("user_placeholders"),
                    c["host"].cast("bigint").alias("host_placeholders"),
                    F.sha2("redacted_text", 256).alias("redacted_sha256")))


register("t06_pii_redaction", None, headline=True)(_t06)


def _t07(spark, sf):
    r = TX.redact_pii(_docs(spark, sf), "text")
    back = TX.reidentify("redacted_text", "redaction_map")
    return r.agg(F.count(F.lit(1)).alias("docs"), F.count_if(back == F.col("text")).alias("roundtrip_ok"))


register("t07_reidentify_roundtrip",
         "SELECT CAST(COUNT(*) AS BIGINT) AS docs, CAST(COUNT(*) AS BIGINT) AS roundtrip_ok FROM documents")(_t07)


# ---------------------------------------------------------------- T-08 / T-09
def _t08(spark, sf):
    c = _docs(spark, sf).select(TX.classify_injection(F.lit(""), "text", F.lit("")).alias("c"))
    return tidy(c.groupBy(F.col("c.risk").alias("risk"), F.col("c.action").alias("action"))
                .agg(F.count(F.lit(1)).alias("docs"), F.sum("c.match_count").cast("bigint").alias("matches"),
                     F.avg("c.confidence").alias("avg_confidence")))


_N = " + ".join(f"CAST(regexp_matches(' ' || text || ' ', {sq(p)}) AS INTEGER)" for p in TX.INJECTION_PATTERNS)
register("t08_injection_risk", f"""
WITH c AS (SELECT {_N} AS n FROM documents)
, r AS (SELECT n, CASE WHEN n = 0 THEN 'benign' WHEN n <= 2 THEN 'suspicious' ELSE 'malicious' END AS risk,
               CASE WHEN n = 0 THEN 1.0 WHEN n <= 2 THEN LEAST(0.5 + n * 0.15, 0.9)
                    ELSE LEAST(0.7 + n * 0.05, 0.99) END AS conf FROM c)
SELECT risk, CASE risk WHEN 'benign' THEN 'pass' WHEN 'suspicious' THEN 'summarize' ELSE 'quarantine' END AS action,
       CAST(COUNT(*) AS BIGINT) AS docs, CAST(SUM(n) AS BIGINT) AS matches, ROUND(AVG(conf), 6) AS avg_confidence
FROM r GROUP BY risk
""")(_t08)


def _t09(spark, sf):
    s = _docs(spark, sf).select("doc_id", "text", TX.sanitise_input("text").alias("s"))
    return s.agg(F.count_if(F.size("s.detections") > 0).alias("docs_flagged"),
                 F.sum(F.size("s.detections")).cast("bigint").alias("detections"),
                 F.count_if(F.col("s.text") != F.col("text")).alias("docs_changed"))


register("t09_sanitise_input", None)(_t09)


# ---------------------------------------------------------------- T-11 / T-12
def _t11(spark, sf):
    e = _docs(spark, sf).select("doc_id", TX.summary_entities("text").alias("e")).where(F.size("e") > 0)
    return e.select("doc_id", F.size("e").cast("bigint").alias("n_entities"),
                    F.array_join(F.array_sort("e"), "|").alias("entities"))


register("t11_summary_entities", f"""
WITH x AS (SELECT doc_id, regexp_extract_all(text, {sq(TX.RE_SHA256)}) AS sha,
                  regexp_extract_all(text, {sq(TX.RE_MD5)}) AS md5, text FROM documents)
, y AS (SELECT doc_id, list_distinct(sha
          || list_filter(md5, lambda m: NOT list_bool_or(list_transform(sha, lambda s: contains(s, m)) || [false]))
          || regexp_extract_all(text, {sq(TX.RE_IPV4)}) || regexp_extract_all(text, {sq(TX.RE_IPV6)})
          || regexp_extract_all(text, {sq(TX.RE_SUMMARY_DOMAIN)}) || regexp_extract_all(text, {sq(TX.RE_EMAIL)})) AS e
        FROM x)
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_entities, array_to_string(list_sort(e), '|') AS entities FROM y WHERE len(e) > 0
""")(_t11)


def _t12(spark, sf):
    d = _docs(spark, sf).withColumn("ents", TX.summary_entities("text"))
    return d.select("doc_id", F.size(TX.sentences("text")).cast("bigint").alias("n_sentences"),
                    F.size(TX.facts("text", "ents")).cast("bigint").alias("n_facts"))


register("t12_fact_sentences", None)(_t12)


def _t13(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text", TX.classify_injection(F.lit(""), "text", F.lit(""))["action"]
                                .alias("action"))
    out = TX.summarize_df(d, "text", "summary")
    return out.select("doc_id", F.length("summary").cast("bigint").alias("summary_chars"),
                      F.sha2("summary", 256).alias("summary_sha256"))


register("t13_summarize", None)(_t13)


# ---------------------------------------------------------------- T-16 / T-17
def _t16(spark, sf):
    p = TB.read(spark, sf, "pages").select("page_id", TX.evidence_block("html").alias("b"))
    return p.select("page_id", F.length("b").cast("bigint").alias("block_chars"), F.md5("b").alias("block_md5"))


register("t16_evidence_block", """
WITH s AS (SELECT page_id, regexp_replace(html, '(?i)</?\\s*evidence[^>]*>', '', 'g') AS t FROM pages)
, e AS (SELECT page_id, '<evidence>' || replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'),
          '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '</evidence>' AS b FROM s)
SELECT page_id, CAST(length(b) AS BIGINT) AS block_chars, md5(b) AS block_md5 FROM e
""")(_t16)

ROLE_TIER = {"user": "tier_0", "assistant": "tier_1", "system": "tier_2"}


def _t17(spark, sf):
    c = TB.read(spark, sf, "conversations")
    tier = F.coalesce(F.create_map(*[x for k, v in ROLE_TIER.items() for x in (F.lit(k), F.lit(v))])[F.col("role")],
                      F.lit("tier_1"))
    t = TX.truncate_to_budget("text", TX.context_budget(tier))
    return c.select("conv_id", "turn", F.length("text").cast("bigint").alias("chars"),
                    F.length(t).cast("bigint").alias("kept_chars"), F.md5(t).alias("kept_md5"))


register("t17_budget_truncation", """
WITH c AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 4096 WHEN 'assistant' THEN 8192
                  WHEN 'system' THEN 16384 ELSE 8192 END AS budget FROM conversations)
SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS chars, CAST(length(substr(text, 1, budget * 4)) AS BIGINT) AS kept_chars,
       md5(substr(text, 1, budget * 4)) AS kept_md5
FROM c
""")(_t17)


def _e22(spark, sf):
    c = TX.chunk_documents(_docs(spark, sf))
    per_doc = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size("iocs_in_chunk")).alias("iocs"))
    return per_doc.groupBy("chunks").agg(F.count(F.lit(1)).alias("documents"),
                                         F.sum("iocs").cast("bigint").alias("iocs"))


register("e22_document_chunking", None)(_e22)


# ---------------------------------------------------------------- T-10 / T-14 / T-15 / T-19
def _techniques(spark):
    from tidewatch.operators.exposure import KNOWN_TECHNIQUES
    return spark.createDataFrame([(t,) for t, _, _ in KNOWN_TECHNIQUES], "technique_id string")


def _reports(spark, sf):
    """Documents as reports that cite techniques: one of the taxonomy, one numbered by the row; every fifth
    row has no language (a null beside the text)."""
    d = TB.read(spark, sf, "documents")
    cited = F.format_string("%s uses AML.T%04d and T%04d.%03d.", F.substring("text", 1, 80), 10 + F.col("doc_id") % 60,
                            1000 + F.col("doc_id") % 700, F.col("doc_id") % 5)
    return d.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"), cited.alias("report"))


def _t14(spark, sf):
    q = TX.quarantine_techniques(_reports(spark, sf), "report", _techniques(spark))
    return q.select("doc_id", "lang", F.array_join("quarantined", ",").alias("quarantined"), F.md5("validated_text").alias("validated_md5"))


def _t14_sql() -> str:
    from tidewatch.operators.exposure import KNOWN_TECHNIQUES
    known = "[" + ", ".join(f"'{t}'" for t, _, _ in KNOWN_TECHNIQUES) + "]"
    return rf"""
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang, substr(text, 1, 80) || ' uses ' AS head,
                  'AML.T' || lpad(CAST(10 + doc_id % 60 AS VARCHAR), 4, '0') AS a,
                  'T' || lpad(CAST(1000 + doc_id % 700 AS VARCHAR), 4, '0') || '.' || lpad(CAST(doc_id % 5 AS VARCHAR), 3, '0') AS t
           FROM documents)
, q AS (SELECT *, head || a || ' and ' || t || '.' AS report, list_contains({known}, a) AS ka, list_contains({known}, t) AS kt FROM r)
SELECT doc_id, lang, array_to_string(list_sort(list_filter([a, t], lambda x: NOT list_contains({known}, x))), ',') AS quarantined,
       md5(head || CASE WHEN ka THEN a ELSE '' END || ' and ' || CASE WHEN kt THEN t ELSE '' END || '.') AS validated_md5
FROM q
"""


register("t14_quarantine_techniques", _t14_sql())(_t14)


def _t10(spark, sf):
    d = TB.read(spark, sf, "documents").select("doc_id")
    risk = F.element_at(F.array(*[F.lit(x) for x in ("benign", "suspicious", "malicious")]), (F.col("doc_id") % 3 + 1).cast("int"))
    other = F.when(F.col("doc_id") % 7 != 0, F.element_at(F.array(*[F.lit(x) for x in ("benign", "suspicious", "malicious")]),
                                                          (F.col("doc_id") % 4 % 3 + 1).cast("int")))
    v = TX.stricter_verdict(risk, other, F.lit(0.65), (F.col("doc_id") % 10) / 10)
    return tidy(d.select("doc_id", v.alias("v")).select("doc_id", "v.risk", "v.confidence"))


register("t10_stricter_verdict", """
WITH x AS (SELECT doc_id, ['benign', 'suspicious', 'malicious'][doc_id % 3 + 1] AS r, doc_id % 3 AS rr,
                  CASE WHEN doc_id % 7 <> 0 THEN doc_id % 4 % 3 END AS o, (doc_id % 10) / 10.0 AS oc FROM documents)
SELECT doc_id, CASE WHEN rr = 1 AND o > 1 THEN 'malicious' ELSE r END AS risk,
       ROUND(CASE WHEN rr = 1 AND o > 1 THEN oc WHEN rr = 1 AND o IS NOT NULL THEN GREATEST(0.65, oc) ELSE 0.65 END, 6) AS confidence
FROM x
""")(_t10)


def _answers(spark, sf):
    """Model answers: JSON with a verdict and score; some rows malformed, without a key, or with a wrong type."""
    d = TB.read(spark, sf, "documents").select("doc_id", "lang")
    k = F.col("doc_id") % 5
    body = (F.when(k == 0, F.lit("not json")).when(k == 1, F.format_string('{"verdict":"%s"}', "lang"))
            .when(k == 2, F.format_string('{"verdict":%d,"score":0.5}', F.col("doc_id")))
            .otherwise(F.format_string('{"verdict":"%s","score":0.%d}', "lang", k)))
    return d.select("doc_id", body.alias("answer"))


def _t15(spark, sf):
    e = TX.json_shape_errors("answer", ["verdict", "score"], {"verdict": "string", "score": "number"})
    return _answers(spark, sf).select("doc_id", F.array_join(e, "; ").alias("errors"))


register("t15_json_shape", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Response is not valid JSON' WHEN 1 THEN 'Missing required field: score'
                               WHEN 2 THEN 'Field ''verdict'' expected string' ELSE '' END AS errors FROM documents
""")(_t15)


def _t19(spark, sf):
    p = TX.parse_json_or_default("answer", "verdict string, score double", '{"verdict":"unknown","score":0.0}')
    return tidy(_answers(spark, sf).select("doc_id", p.alias("p")).select("doc_id", "p.verdict", "p.score"))


register("t19_json_or_default", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'unknown' WHEN 2 THEN CAST(doc_id AS VARCHAR) ELSE lang END AS verdict,
       CAST(CASE doc_id % 5 WHEN 0 THEN 0.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.3 WHEN 4 THEN 0.4 END AS DOUBLE) AS score FROM documents
""")(_t19)
