"""Registered FP-lifecycle queries (A-24..A-31, J-08..J-11, W-05, P-34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import fp as FP
from tidewatch.plans.oracle_roles import with_roles
from tidewatch.plans.registry import register, tidy
from tidewatch.plans.rules_q import ts
from tidewatch.sources import tables as TB

INV = TB.INVESTIGATIONS_NOW
EVN = TB.EVENTS_NOW
CALLS = TB.CALLS_NOW


# ---------------------------------------------------------------- A-30 / A-31
def _a30(spark, sf):
    return FP.fp_candidates(TB.investigations(spark, sf), INV).select("tenant_id", "group_key", "investigation_count",
                                                                      "investigation_id")


register("a30_fp_candidates", with_roles(f"""
, b AS (SELECT tenant_id, COALESCE(alert_title, 'unknown') AS group_key, investigation_id FROM investigations
        WHERE state = 'closed' AND updated_at >= {ts(INV, days=30)} AND updated_at < {ts(INV)}
          AND classification = 'false_positive')
, r AS (SELECT *, COUNT(*) OVER (PARTITION BY tenant_id, group_key) AS n FROM b)
SELECT tenant_id, group_key, CAST(n AS BIGINT) AS investigation_count, investigation_id FROM r WHERE n >= 3
""", "investigations"))(_a30)


def _a31(spark, sf):
    return FP.playbook_candidates(TB.investigations(spark, sf), INV)


register("a31_playbook_candidates", with_roles(f"""
SELECT tenant_id, COALESCE(atlas_techniques[1], 'unknown') AS technique, CAST(COUNT(*) AS BIGINT) AS investigation_count
FROM investigations WHERE state = 'closed' AND updated_at >= {ts(INV, days=30)} AND updated_at < {ts(INV)}
  AND classification <> 'false_positive'
GROUP BY 1, 2 HAVING COUNT(*) >= 2
""", "investigations"))(_a31)


# ---------------------------------------------------------------- J-08 / J-09
KILLS = [("tenant", "t3", True), ("technique", "AML.T0007", True), ("rule_family", "family-6", False)]
HOST_RE = "asset-[0-9]*[02468]$"
IP_CIDR = "10.0.0.0/9"


def fp_patterns(spark, sf):
    """Patterns mined from every closed false positive up to the clock, one per (tenant, title group)."""
    inv = TB.investigations(spark, sf)
    dt = inv.schema["updated_at"].dataType
    from tidewatch.functions.exprs import time_lit
    g = (inv.where((F.col("state") == "closed") & (F.col("classification") == "false_positive")
                   & (F.col("updated_at") < time_lit(INV, dt)))
         .groupBy("tenant_id", F.col("alert_title").alias("group_key")).count()
         .where(F.col("count") >= FP.MIN_INVESTIGATIONS_FOR_FP))
    pid = F.concat(F.lit("fp-"), F.substring(F.md5(F.concat_ws("|", "tenant_id", "group_key")), 1, 10))
    g = g.withColumn("pattern_id", pid).withColumn("h", F.substring(F.md5(F.col("pattern_id")), 1, 1))
    h = F.col("h")
    ep_type = "array<struct<type:string,value_regex:string,value_cidr:string>>"
    ents = (F.when(h.isin("0", "3", "6", "9", "c", "f"), F.array().cast(ep_type))
            .when(h.isin("1", "4", "7", "a", "d"), F.array(F.struct(F.lit("host").alias("type"),
                                                                     F.lit(HOST_RE).alias("value_regex"),
                                                                     F.lit(None).cast("string").alias("value_cidr"))))
            .otherwise(F.array(F.struct(F.lit("ip").alias("type"), F.lit(None).cast("string").alias("value_regex"),
                                        F.lit(IP_CIDR).alias("value_cidr")))))
    status = (F.when(h.isin("0", "1", "2", "3", "4", "5"), "approved").when(h.isin("6", "7", "8", "9"), "active")
              .when(h.isin("a", "b"), "shadow").when(h == "c", "pending_review").otherwise("expired"))
    return g.select("tenant_id", "pattern_id", F.col("group_key").alias("alert_name_regex"), ents.alias("entity_patterns"),
                    status.alias("status"), F.lit("").alias("scope_rule_family"),
                    F.when(h.isin("2", "5"), F.col("tenant_id")).otherwise(F.lit("")).alias("scope_tenant_id"),
                    F.when(h.isin("3", "4"), F.lit("server")).otherwise(F.lit("")).alias("scope_asset_class"))


def _j08(spark, sf):
    inv = TB.investigations(spark, sf).where(F.col("state") != "closed")
    alerts = inv.select("alert_id", "tenant_id", "alert_title", "rule_family", "asset_class",
                        F.element_at("atlas_techniques", 1).alias("technique"),
                        F.create_map(F.lit("hosts"), F.array("asset_id"), F.lit("ips"), F.array("src_ip")).alias("entities"))
    kills = spark.createDataFrame(KILLS, "dimension string, value string, active boolean")
    live = FP.kill_switch_filter(alerts, kills, {"tenant": "tenant_id", "technique": "technique",
                                                 "rule_family": "rule_family"})
    return tidy(FP.match_fp_patterns(live, fp_patterns(spark, sf)))


def _ip_int(c: str) -> str:
    return (f"(CAST(split_part({c}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({c}, '.', 2) AS BIGINT) * 65536"
            f" + CAST(split_part({c}, '.', 3) AS BIGINT) * 256 + CAST(split_part({c}, '.', 4) AS BIGINT))")


register("j08_fp_pattern_match", with_roles(f"""
, g AS (SELECT tenant_id, alert_title AS group_key FROM investigations
        WHERE state = 'closed' AND classification = 'false_positive' AND updated_at < {ts(INV)}
        GROUP BY 1, 2 HAVING COUNT(*) >= 3)
, p0 AS (SELECT *, 'fp-' || substr(md5(tenant_id || '|' || group_key), 1, 10) AS pattern_id FROM g)
, p AS (SELECT *, substr(md5(pattern_id), 1, 1) AS h FROM p0)
, pats AS (
  SELECT tenant_id, pattern_id, group_key, h,
         CASE WHEN h IN ('0','1','2','3','4','5') THEN 'approved' WHEN h IN ('6','7','8','9') THEN 'active'
              WHEN h IN ('a','b') THEN 'shadow' WHEN h = 'c' THEN 'pending_review' ELSE 'expired' END AS status,
         CASE WHEN h IN ('2','5') THEN tenant_id ELSE '' END AS scope_tenant,
         CASE WHEN h IN ('3','4') THEN 'server' ELSE '' END AS scope_asset
  FROM p)
, a AS (SELECT alert_id, tenant_id, alert_title, rule_family, asset_class, asset_id, src_ip,
               atlas_techniques[1] AS technique FROM investigations WHERE state <> 'closed')
, live AS (SELECT * FROM a WHERE tenant_id <> 't3' AND COALESCE(technique, '') <> 'AML.T0007')
, j AS (
  SELECT l.alert_id, l.tenant_id, q.pattern_id,
         CASE WHEN regexp_matches(l.alert_title, '(?i)^(?:' || q.group_key || ')') THEN 1.0 ELSE 0.0 END AS tscore,
         CASE WHEN q.h IN ('0','3','6','9','c','f') THEN NULL
              WHEN q.h IN ('1','4','7','a','d') THEN
                   CASE WHEN regexp_matches(l.asset_id, '(?i)^(?:{HOST_RE})') THEN 1.0 ELSE 0.0 END
              ELSE CASE WHEN {_ip_int('l.src_ip')} >= 167772160 AND {_ip_int('l.src_ip')} < 167772160 + 8388608
                        THEN 1.0 ELSE 0.0 END END AS escore
  FROM live l JOIN pats q ON l.tenant_id = q.tenant_id
  WHERE q.status IN ('approved', 'active') AND (q.scope_tenant = '' OR q.scope_tenant = l.tenant_id)
    AND (q.scope_asset = '' OR q.scope_asset = l.asset_class))
, s AS (SELECT alert_id, tenant_id, pattern_id,
               CASE WHEN escore IS NULL THEN tscore ELSE (tscore + escore) / 2 END AS confidence FROM j)
, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY alert_id ORDER BY confidence DESC, pattern_id) AS rn
        FROM s WHERE confidence >= 0.9)
SELECT alert_id, tenant_id, pattern_id, ROUND(confidence, 6) AS confidence FROM r WHERE rn = 1
""", "investigations"), headline=True)(_j08)


def _j08_report(spark, sf):
    """How many (title, pattern) pairs the index leaves of all pairs of a tenant. The patterns are titles, regexes without a
    metacharacter, so a pattern's literal is all of it, and a pair is left where the title holds it."""
    inv = TB.investigations(spark, sf).where(F.col("state") != "closed")
    r = FP.candidate_report(inv.select("tenant_id", "alert_title"), fp_patterns(spark, sf))
    return r.select("tenant_id", "titles", "patterns", "all_pairs", F.col("indexed_pairs").alias("pairs_tested"), "unindexed_pairs", "matches")


register("j08_pairs_tested", with_roles(f"""
, g AS (SELECT tenant_id, alert_title AS group_key FROM investigations
        WHERE state = 'closed' AND classification = 'false_positive' AND updated_at < {ts(INV)}
        GROUP BY 1, 2 HAVING COUNT(*) >= 3)
, p AS (SELECT tenant_id, group_key, substr(md5('fp-' || substr(md5(tenant_id || '|' || group_key), 1, 10)), 1, 1) AS h FROM g)
, pats AS (SELECT * FROM p WHERE h IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9'))
, t AS (SELECT DISTINCT tenant_id, alert_title AS title FROM investigations WHERE state <> 'closed')
, n AS (SELECT tenant_id, COUNT(*) AS titles FROM t GROUP BY tenant_id)
, m AS (SELECT tenant_id, COUNT(*) AS patterns FROM pats GROUP BY tenant_id)
, c AS (SELECT t.tenant_id, COUNT(*) FILTER (WHERE contains(lower(title), lower(group_key))) AS tested,
               COUNT(*) FILTER (WHERE starts_with(lower(title), lower(group_key))) AS matches
        FROM t JOIN pats ON pats.tenant_id = t.tenant_id GROUP BY t.tenant_id)
SELECT n.tenant_id, CAST(titles AS BIGINT) AS titles, CAST(patterns AS BIGINT) AS patterns, CAST(titles * patterns AS BIGINT) AS all_pairs,
       CAST(tested AS BIGINT) AS pairs_tested, CAST(0 AS BIGINT) AS unindexed_pairs, CAST(matches AS BIGINT) AS matches
FROM n JOIN m USING (tenant_id) JOIN c USING (tenant_id)
""", "investigations"))(_j08_report)


# ---------------------------------------------------------------- A-24 / A-29
def _a24(spark, sf):
    return tidy(FP.evaluate_closures(TB.closures(spark, sf)))


A24_SQL = """
, g AS (SELECT rule_family, COUNT(*) AS total, COUNT(*) FILTER (WHERE auto_closed AND truly_fp) AS tp,
               COUNT(*) FILTER (WHERE auto_closed AND NOT truly_fp) AS fp,
               COUNT(*) FILTER (WHERE NOT auto_closed AND truly_fp) AS fn FROM closures GROUP BY rule_family)
, e AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS precision,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS recall,
               CASE WHEN tp + fn > 0 THEN fn / (fn + tp) ELSE 0.0 END AS fnr FROM g)
"""
register("a24_precision_recall", with_roles(A24_SQL + """
SELECT rule_family, CAST(total AS BIGINT) AS total, CAST(tp AS BIGINT) AS true_positives,
       CAST(fp AS BIGINT) AS false_positives, CAST(fn AS BIGINT) AS false_negatives,
       ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(fnr, 6) AS fnr FROM e
""", "closures"))(_a24)


def _a29(spark, sf):
    e = FP.autonomy_threshold(FP.evaluate_closures(TB.closures(spark, sf)))
    return tidy(e.select("rule_family", "reduce_autonomy", "threshold"))


register("a29_autonomy_threshold", with_roles(A24_SQL + """
SELECT rule_family, (precision < 0.98 OR fnr > 0.005) AS reduce_autonomy,
       ROUND(CAST(LEAST(0.99, 0.9 + CASE WHEN precision < 0.98 THEN 0.02 ELSE 0 END
                              + CASE WHEN fnr > 0.005 THEN 0.02 ELSE 0 END) AS DOUBLE), 6) AS threshold FROM e
""", "closures"))(_a29)


# ---------------------------------------------------------------- W-05
def _w05(spark, sf):
    s = FP.stratified_sample(TB.closures(spark, sf), EVN, min_per_stratum=3)
    return s.select("alert_id", "rule_family", "severity", "asset_criticality", "is_novel")


register("w05_stratified_sample", with_roles(f"""
, c AS (SELECT *, COALESCE(pattern_created_at > {ts(EVN, days=30)}, false) AS is_novel FROM closures)
, r AS (SELECT *, COUNT(*) FILTER (WHERE is_novel) OVER (PARTITION BY rule_family, severity, asset_criticality) AS n_novel,
               ROW_NUMBER() OVER (PARTITION BY rule_family, severity, asset_criticality, is_novel
                                  ORDER BY md5('42:' || alert_id), alert_id) AS rn FROM c)
SELECT alert_id, rule_family, severity, asset_criticality, is_novel FROM r
WHERE is_novel OR rn <= GREATEST(0, 3 - n_novel)
""", "closures"))(_w05)


# ---------------------------------------------------------------- W-06
def _w06(spark, sf):
    c = TB.closures(spark, sf)
    dt = c.schema["pattern_created_at"].dataType
    from tidewatch.functions.exprs import shift, time_lit
    cur = F.col("pattern_created_at") >= time_lit(shift(EVN, days=7), dt)
    counts = (c.where((F.col("pattern_created_at") >= time_lit(shift(EVN, days=37), dt))
                      & (F.col("pattern_created_at") < time_lit(EVN, dt)))
              .groupBy("rule_family", F.col("severity").alias("key"))
              .agg(F.count_if(cur).alias("current"), F.count_if(~cur).alias("baseline")))
    affected = FP.family_drift(counts, "rule_family").where("drifted")
    quota = FP.drift_quota(c.select("rule_family").distinct(), affected, base=3)
    s = FP.stratified_sample(c.join(quota, "rule_family"), EVN, quota_col="quota", max_quota=6)
    return s.select("alert_id", "rule_family", "severity", "asset_criticality", "is_novel", "quota")


register("w06_drift_sample_quota", with_roles(f"""
, cnt AS (SELECT rule_family, severity AS key, COUNT(*) FILTER (WHERE pattern_created_at >= {ts(EVN, days=7)}) AS a,
                 COUNT(*) FILTER (WHERE pattern_created_at < {ts(EVN, days=7)}) AS b FROM closures
          WHERE pattern_created_at >= {ts(EVN, days=37)} AND pattern_created_at < {ts(EVN)} GROUP BY ALL)
, tot AS (SELECT rule_family, CASE WHEN SUM(a) > 0 THEN SUM(a) ELSE 1 END AS ta,
                 CASE WHEN SUM(b) > 0 THEN SUM(b) ELSE 1 END AS tb FROM cnt GROUP BY 1)
, pq AS (SELECT rule_family, a / ta AS p, b / tb AS q, (a / ta + b / tb) / 2 AS m FROM cnt JOIN tot USING (rule_family))
, fd AS (SELECT rule_family, LEAST(GREATEST(COALESCE(SUM(
        0.5 * CASE WHEN p > 0 AND m > 0 THEN p * log2(p / m) ELSE 0 END
      + 0.5 * CASE WHEN q > 0 AND m > 0 THEN q * log2(q / m) ELSE 0 END), 0), 0), 1) AS jsd FROM pq GROUP BY 1)
, qt AS (SELECT DISTINCT rule_family, CASE WHEN jsd > 0.3 THEN 6 ELSE 3 END AS quota FROM closures LEFT JOIN fd USING (rule_family))
, c AS (SELECT closures.*, quota, COALESCE(pattern_created_at > {ts(EVN, days=30)}, false) AS is_novel
        FROM closures JOIN qt USING (rule_family))
, r AS (SELECT *, COUNT(*) FILTER (WHERE is_novel) OVER (PARTITION BY rule_family, severity, asset_criticality) AS n_novel,
               ROW_NUMBER() OVER (PARTITION BY rule_family, severity, asset_criticality, is_novel
                                  ORDER BY md5('42:' || alert_id), alert_id) AS rn FROM c)
SELECT alert_id, rule_family, severity, asset_criticality, is_novel, CAST(quota AS BIGINT) AS quota FROM r
WHERE is_novel OR rn <= GREATEST(0, quota - n_novel)
""", "closures"))(_w06)


# ---------------------------------------------------------------- J-10
def _j10(spark, sf):
    closed = TB.closures(spark, sf).where("auto_closed")
    conv = TB.read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("alert_id"))
    return FP.escalated_closures(closed, conv).select("alert_id", "rule_family", "fn_flagged", "review_status")


register("j10_escalated_closures", with_roles("""
SELECT alert_id, rule_family, true AS fn_flagged, 'pending_review' AS review_status FROM closures
WHERE auto_closed AND alert_id IN (SELECT CAST(conv_id AS VARCHAR) FROM conversations)
""", "closures"))(_j10)


# ---------------------------------------------------------------- A-27 / A-28
def _drift_parts(spark, sf):
    e = TB.read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    src = FP.js_divergence(FP.window_counts(e, F.col("event_type"), "ts", EVN), "key")
    tech = FP.js_divergence(FP.window_counts(e, (k % 10).cast("string"), "ts", EVN), "key")
    ent = FP.js_divergence(FP.window_counts(e, (F.col("user_id") % 7).cast("string"), "ts", EVN), "key")
    return src, tech, ent


def _a27(spark, sf):
    return tidy(_drift_parts(spark, sf)[0])


def _jsd_sql(key: str, name: str) -> str:
    return f"""
, {name}_c AS (SELECT {key} AS key, COUNT(*) FILTER (WHERE ts >= {ts(EVN, days=7)}) AS a,
               COUNT(*) FILTER (WHERE ts < {ts(EVN, days=7)}) AS b FROM events
               WHERE ts >= {ts(EVN, days=37)} AND ts < {ts(EVN)} GROUP BY 1)
, {name}_t AS (SELECT CASE WHEN SUM(a) > 0 THEN SUM(a) ELSE 1 END AS ta,
                      CASE WHEN SUM(b) > 0 THEN SUM(b) ELSE 1 END AS tb FROM {name}_c)
, {name}_p AS (SELECT a / ta AS p, b / tb AS q, (a / ta + b / tb) / 2 AS m FROM {name}_c, {name}_t)
, {name} AS (SELECT LEAST(GREATEST(COALESCE(SUM(
        0.5 * CASE WHEN p > 0 AND m > 0 THEN p * log2(p / m) ELSE 0 END
      + 0.5 * CASE WHEN q > 0 AND m > 0 THEN q * log2(q / m) ELSE 0 END), 0), 0), 1) AS jsd FROM {name}_p)
"""


KEY_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
register("a27_js_divergence", "WITH x AS (SELECT 1)" + _jsd_sql("event_type", "src") + """
SELECT ROUND(jsd, 6) AS jsd FROM src
""")(_a27)


def _a28(spark, sf):
    s, t, e = _drift_parts(spark, sf)
    return tidy(FP.overall_drift(s, t, e))


register("a28_overall_drift", "WITH x AS (SELECT 1)" + _jsd_sql("event_type", "src")
         + _jsd_sql(f"CAST({KEY_K} % 10 AS VARCHAR)", "tech") + _jsd_sql("CAST(user_id % 7 AS VARCHAR)", "ent") + """
, o AS (SELECT src.jsd AS s, tech.jsd AS t, ent.jsd AS e, 0.4 * src.jsd + 0.35 * tech.jsd + 0.25 * ent.jsd AS ov
        FROM src, tech, ent)
SELECT ROUND(s, 6) AS source_drift, ROUND(t, 6) AS technique_drift, ROUND(e, 6) AS entity_drift,
       ROUND(ov, 6) AS overall_drift, ov > 0.3 AS threshold_exceeded,
       ROUND(CAST(CASE WHEN ov > 0.3 THEN 0.95 ELSE 0.9 END AS DOUBLE), 6) AS fp_threshold FROM o
""")(_a28)


# ---------------------------------------------------------------- J-11 / A-25 / A-26 / P-34
PAIRS_SQL = """
, last AS (SELECT tenant_id, rule_family, investigation_id, pattern_id, type,
                  arg_max(decision, (ts, decision)) AS decision, MAX(ts) AS ts
           FROM decision_log GROUP BY ALL)
, pairs AS (SELECT s.tenant_id, s.rule_family, s.investigation_id, s.pattern_id, s.decision AS shadow_decision,
                   s.ts AS shadow_ts, a.decision AS analyst_decision, a.ts AS analyst_ts
            FROM last s JOIN last a ON s.tenant_id = a.tenant_id AND s.rule_family = a.rule_family
             AND s.investigation_id = a.investigation_id AND s.type = 'shadow' AND a.type = 'analyst')
"""


def _pairs(spark, sf):
    d = TB.decision_log(spark, sf)
    p = FP.shadow_pairs(d.drop("pattern_id"))
    pat = d.select("investigation_id", "pattern_id").distinct()
    return p.join(pat, "investigation_id")


def _j11(spark, sf):
    p = _pairs(spark, sf)
    return p.groupBy("tenant_id", "shadow_decision", "analyst_decision").agg(F.count(F.lit(1)).alias("pairs"))


register("j11_shadow_analyst_pairs", with_roles(PAIRS_SQL + """
SELECT tenant_id, shadow_decision, analyst_decision, CAST(COUNT(*) AS BIGINT) AS pairs FROM pairs GROUP BY ALL
""", "decision_log"), headline=True)(_j11)


def _a26(spark, sf):
    return tidy(FP.agreement_rate(_pairs(spark, sf), CALLS))


register("a26_agreement_rate", with_roles(PAIRS_SQL + f"""
SELECT tenant_id, rule_family, CAST(COUNT(*) AS BIGINT) AS pairs,
       ROUND(AVG(CASE WHEN shadow_decision = analyst_decision THEN 1.0 ELSE 0.0 END), 6) AS agreement_rate
FROM pairs WHERE shadow_ts >= {ts(CALLS, days=14)} AND shadow_ts < {ts(CALLS)} GROUP BY ALL
""", "decision_log"))(_a26)


def _a25(spark, sf):
    return tidy(FP.canary_agreement(_pairs(spark, sf)))


A25_SQL = PAIRS_SQL + """
, c AS (SELECT pattern_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE shadow_decision = analyst_decision) AS agree
        FROM pairs GROUP BY pattern_id)
, c2 AS (SELECT *, total - agree AS disagree, CASE WHEN total > 0 THEN (total - agree) / total ELSE 0 END AS dr FROM c)
"""
register("a25_canary_agreement", with_roles(A25_SQL + """
SELECT pattern_id, CAST(total AS BIGINT) AS total, CAST(agree AS BIGINT) AS agree, CAST(disagree AS BIGINT) AS disagree,
       ROUND(dr, 6) AS disagreement_rate, total >= 50 AND dr <= 0.05 AS promote FROM c2
""", "decision_log"))(_a25)


def _p34(spark, sf):
    c = FP.canary_agreement(_pairs(spark, sf))
    ev = c.select(F.col("pattern_id").alias("slice_id"), (F.col("agree") / F.col("total")).alias("precision"),
                  F.lit(0).alias("missed"))
    inv_dt = TB.investigations(spark, sf).schema["created_at"].dataType
    from tidewatch.functions.exprs import time_lit
    n = F.regexp_extract("slice_id", r"(\d+)$", 1).cast("int")
    slices = c.select(F.col("pattern_id").alias("slice_id")).union(
        spark.range(3).select(F.concat(F.lit("new-"), F.col("id").cast("string")).alias("slice_id"))) \
        .withColumn("created_at", time_lit(CALLS, inv_dt) - F.make_interval(F.lit(0), F.lit(0), F.lit(0),
                                                                              F.coalesce(n, F.lit(1))))
    return tidy(FP.canary_decision(slices, ev, CALLS).select("slice_id", "precision", "decision"))


register("p34_canary_decision", with_roles(A25_SQL + f"""
, s AS (SELECT pattern_id AS slice_id FROM c2 UNION ALL SELECT 'new-' || CAST(i AS VARCHAR) FROM range(3) t(i))
, s2 AS (SELECT slice_id, {ts(CALLS)} - to_days(CAST(COALESCE(TRY_CAST(regexp_extract(slice_id, '(\\d+)$', 1) AS INTEGER), 1) AS BIGINT)) AS created_at
         FROM s)
, j AS (SELECT s2.slice_id, s2.created_at, COALESCE(c2.agree / c2.total, 1.0) AS precision, 0 AS missed
        FROM s2 LEFT JOIN c2 ON s2.slice_id = c2.pattern_id)
SELECT slice_id, ROUND(precision, 6) AS precision,
       CASE WHEN missed > 0 OR precision < 0.95 THEN 'rollback'
            WHEN created_at <= {ts(CALLS, days=7)} AND precision >= 0.98 THEN 'promote' ELSE 'continue' END AS decision
FROM j
""", "decision_log"))(_p34)


# ---------------------------------------------------------------- A-33 / A-37
def _patterns_with_expiry(spark, sf):
    p = fp_patterns(spark, sf)
    from tidewatch.functions.exprs import time_lit
    off = F.conv(F.substring(F.md5(F.col("pattern_id")), 2, 1), 16, 10).cast("int") * 3 - 10
    return p.withColumn("expiry_date", time_lit(INV) + F.make_interval(F.lit(0), F.lit(0), F.lit(0), off))


def _a33(spark, sf):
    return FP.pattern_summary(_patterns_with_expiry(spark, sf), INV)


register("a33_fp_pattern_summary", with_roles(f"""
, g AS (SELECT tenant_id, alert_title AS group_key FROM investigations
        WHERE state = 'closed' AND classification = 'false_positive' AND updated_at < {ts(INV)}
        GROUP BY 1, 2 HAVING COUNT(*) >= 3)
, p AS (SELECT *, 'fp-' || substr(md5(tenant_id || '|' || group_key), 1, 10) AS pattern_id FROM g)
, q AS (SELECT *, substr(md5(pattern_id), 1, 1) AS h,
               {ts(INV)} + to_days(CAST(('0x' || substr(md5(pattern_id), 2, 1))::INTEGER * 3 - 10 AS BIGINT)) AS expiry FROM p)
, s AS (SELECT CASE WHEN h IN ('0','1','2','3','4','5') THEN 'approved' WHEN h IN ('6','7','8','9') THEN 'active'
                    WHEN h IN ('a','b') THEN 'shadow' WHEN h = 'c' THEN 'pending_review' ELSE 'expired' END AS status,
               GREATEST(0, date_diff('day', CAST({ts(INV)} AS DATE), CAST(expiry AS DATE))) AS days FROM q)
SELECT CAST(COUNT(*) AS BIGINT) AS total, CAST(COUNT(*) FILTER (WHERE status = 'active') AS BIGINT) AS active,
       CAST(COUNT(*) FILTER (WHERE status = 'pending_approval') AS BIGINT) AS pending,
       CAST(COUNT(*) FILTER (WHERE status = 'active' AND days <= 14) AS BIGINT) AS expiring_soon FROM s
""", "investigations"))(_a33)


def _a37(spark, sf):
    return FP.canary_cycle_summary(_p34(spark, sf))


def _a37_sql():
    from tidewatch.plans.registry import ORACLES
    return ("SELECT CAST(COUNT(*) AS BIGINT) AS slices_evaluated, "
            "CAST(COUNT(*) FILTER (WHERE decision = 'promote') AS BIGINT) AS promotions, "
            "CAST(COUNT(*) FILTER (WHERE decision = 'rollback') AS BIGINT) AS rollbacks FROM ("
            + ORACLES["p34_canary_decision"] + ")")


register("a37_canary_cycle_summary", _a37_sql())(_a37)


A33_BASE = f"""
, g AS (SELECT tenant_id, alert_title AS group_key FROM investigations
        WHERE state = 'closed' AND classification = 'false_positive' AND updated_at < {ts(INV)}
        GROUP BY 1, 2 HAVING COUNT(*) >= 3)
, p AS (SELECT *, 'fp-' || substr(md5(tenant_id || '|' || group_key), 1, 10) AS pattern_id FROM g)
, q AS (SELECT *, substr(md5(pattern_id), 1, 1) AS h,
               {ts(INV)} + to_days(CAST(('0x' || substr(md5(pattern_id), 2, 1))::INTEGER * 3 - 10 AS BIGINT)) AS expiry FROM p)
, s AS (SELECT pattern_id, tenant_id, group_key, expiry,
               CASE WHEN h IN ('0','1','2','3','4','5') THEN 'approved' WHEN h IN ('6','7','8','9') THEN 'active'
                    WHEN h IN ('a','b') THEN 'shadow' WHEN h = 'c' THEN 'pending_review' ELSE 'expired' END AS status,
               GREATEST(0, date_diff('day', CAST({ts(INV)} AS DATE), CAST(expiry AS DATE))) AS days FROM q)
"""


def _p17(spark, sf):
    p = _patterns_with_expiry(spark, sf)
    hit = p.where((F.col("status") == "approved") & F.lower("alert_name_regex").contains("pattern 1"))
    return hit.select("pattern_id", F.col("alert_name_regex").alias("group_key"),
                      FP.days_until_expiry(F.col("expiry_date"), INV).cast("bigint").alias("days_until_expiry"))


register("p17_fp_pattern_search", with_roles(A33_BASE + """
SELECT pattern_id, group_key, CAST(days AS BIGINT) AS days_until_expiry FROM s
WHERE status = 'approved' AND contains(lower(group_key), 'pattern 1')
""", "investigations"))(_p17)


def _p32(spark, sf):
    e = FP.expired_patterns(_patterns_with_expiry(spark, sf), INV)
    return e.groupBy("status").agg(F.count(F.lit(1)).alias("patterns"))


register("p32_expired_patterns", with_roles(A33_BASE + f"""
SELECT status, CAST(COUNT(*) AS BIGINT) AS patterns FROM s
WHERE expiry < {ts(INV)} AND status NOT IN ('expired', 'revoked', 'deprecated') GROUP BY status
""", "investigations"))(_p32)


def _a32(spark, sf):
    return tidy(FP.shadow_summary(_pairs(spark, sf)))


register("a32_shadow_summary", with_roles(PAIRS_SQL + """
SELECT CAST(COUNT(*) AS BIGINT) AS pairs,
       CAST(COUNT(*) FILTER (WHERE shadow_decision = analyst_decision) AS BIGINT) AS agreements,
       CAST(COUNT(DISTINCT tenant_id) AS BIGINT) AS tenants,
       ROUND(CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (WHERE shadow_decision = analyst_decision) / COUNT(*) END, 6)
         AS agreement_rate
FROM pairs
""", "decision_log"))(_a32)


def _p35(spark, sf):
    m = FP.agreement_rate(_pairs(spark, sf), CALLS).withColumn("window_days", F.lit(14)).withColumn("fnr", F.lit(0.0))
    g = FP.go_live_unmet(m)
    return g.select("tenant_id", "rule_family", F.array_join("unmet", "; ").alias("unmet"), "ready")


register("p35_go_live_criteria", with_roles(PAIRS_SQL + f"""
, m AS (SELECT tenant_id, rule_family, COUNT(*) AS pairs,
               AVG(CASE WHEN shadow_decision = analyst_decision THEN 1.0 ELSE 0.0 END) AS rate
        FROM pairs WHERE shadow_ts >= {ts(CALLS, days=14)} AND shadow_ts < {ts(CALLS)} GROUP BY ALL)
, u AS (SELECT tenant_id, rule_family,
               concat_ws('; ', CASE WHEN rate < 0.95 THEN 'agreement_rate < 0.95' END,
                         CASE WHEN pairs < 100 THEN 'decisions < 100' END) AS unmet FROM m)
SELECT tenant_id, rule_family, unmet, unmet = '' AS ready FROM u
""", "decision_log"))(_p35)

SHADOW_CONFIG = [("t0", True, []), ("t1", True, ["family-1", "family-2"]), ("t2", False, [])]


def _p36(spark, sf):
    inv = TB.investigations(spark, sf).select("tenant_id", "rule_family")
    cfg = spark.createDataFrame(SHADOW_CONFIG, "tenant_id string, shadow_enabled boolean, shadow_families array<string>")
    return FP.shadow_active(inv, cfg).groupBy("tenant_id", "shadow_active").agg(F.count(F.lit(1)).alias("investigations"))


register("p36_shadow_mode_active", with_roles("""
SELECT tenant_id, (tenant_id = 't0') OR (tenant_id = 't1' AND rule_family IN ('family-1', 'family-2')) AS shadow_active,
       CAST(COUNT(*) AS BIGINT) AS investigations
FROM investigations GROUP BY ALL
""", "investigations"))(_p36)


def _p18_p20(spark, sf):
    inv = TB.investigations(spark, sf)
    sev = F.get_json_object("graph_state", "$.severity")
    f = inv.where(F.array_contains("atlas_techniques", "AML.T0010") | F.arrays_overlap("atlas_techniques",
                                                                                         F.array(F.lit("AML.T0015"))))
    f = f.where(~F.col("state").isin("closed", "failed") & (sev.isin("critical", "high")))
    return f.groupBy("state").agg(F.count(F.lit(1)).alias("investigations"))


register("p18_p20_array_and_json_filters", with_roles("""
SELECT state, CAST(COUNT(*) AS BIGINT) AS investigations FROM investigations
WHERE (list_contains(atlas_techniques, 'AML.T0010') OR list_has_any(atlas_techniques, ['AML.T0015']))
  AND state NOT IN ('closed', 'failed') AND graph_state->>'severity' IN ('critical', 'high')
GROUP BY state
""", "investigations"))(_p18_p20)
