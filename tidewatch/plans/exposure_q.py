"""Registered exposure queries (P-02..P-13, S-11, J-05, A-19, E-10).

The DuckDB oracle restates the per-tool mappings as CASE expressions generated
from the same fixed tables the Spark side folds into map literals.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.operators import exposure as EX
from tidewatch.operators import reports as RP
from tidewatch.plans.oracle_roles import with_roles
from tidewatch.plans.registry import register, tidy
from tidewatch.plans.rules_q import ts
from tidewatch.sources import tables as TB

NOW = TB.EXPOSURES_NOW
CUTOFF = "1999-01-01 00:00:00"
FMT = "yyyy-MM-dd HH:mm:ss"


def q(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def case(expr: str, mapping: dict, default) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    d = q(default) if isinstance(default, str) else default
    return f"(CASE {expr} {whens} ELSE {d} END)"


MATRIX = {f"{e}|{c}": s for (e, c), s in X.SEVERITY_MATRIX.items()}
ML_ANY = " OR ".join(f"contains(pkg, {q(p)})" for p in EX.ML_PACKAGES)

NORMALISE_SQL = f"""
, n0 AS (
  SELECT finding_id, lower(source_tool) AS tool, COALESCE(title, '') AS title, COALESCE(asset_id, '') AS asset_id,
         detected_at AS ts, upper(COALESCE(severity, '')) AS sev_raw, lower(COALESCE(resource_type, '')) AS rtype,
         lower(COALESCE(package_name, '')) AS pkg, COALESCE(package_manager, '') AS pkg_mgr,
         COALESCE(exploitability_score, 0.0) AS cvss, COALESCE(success_rate, 0.0) AS rate,
         lower(COALESCE(probe_type, '')) AS probe, lower(COALESCE(attack_type, '')) AS attack,
         deployment_zone, COALESCE(tenant_id, '') AS tenant_id
  FROM findings WHERE lower(source_tool) IN ('wiz', 'snyk', 'garak', 'art'))
, n1 AS (
  SELECT *, {case("CASE WHEN sev_raw = '' THEN 'MEDIUM' ELSE sev_raw END", EX.CLOUD_EXPLOITABILITY, 'medium')} AS cloud_expl,
         CASE tool WHEN 'wiz' THEN {case('rtype', EX.CLOUD_ZONES, EX.CLOUD_ZONE_DEFAULT)}
                   WHEN 'garak' THEN COALESCE(deployment_zone, 'Zone3_Enterprise') ELSE 'Zone3_Enterprise' END AS asset_zone
  FROM n0)
, n2 AS (
  SELECT *,
    CASE tool WHEN 'wiz' THEN {case('asset_zone', X.ZONE_CONSEQUENCE, X.ZONE_CONSEQUENCE_DEFAULT)}
              WHEN 'snyk' THEN CASE WHEN {ML_ANY} THEN 'safety_life' ELSE 'data_loss' END
              WHEN 'garak' THEN {case('probe', {k: v[0] for k, v in EX.PROBE_MAP.items()}, EX.PROBE_DEFAULT[0])}
              ELSE {case('attack', {k: v[0] for k, v in EX.ATTACK_MAP.items()}, EX.ATTACK_DEFAULT[0])} END AS consequence,
    CASE tool WHEN 'wiz' THEN cloud_expl
              WHEN 'snyk' THEN CASE WHEN cvss >= 7.0 THEN 'high' WHEN cvss >= 3.0 THEN 'medium' ELSE 'low' END
              ELSE CASE WHEN rate >= 0.7 THEN 'high' WHEN rate >= 0.3 THEN 'medium' ELSE 'low' END END AS band,
    CASE tool WHEN 'wiz' THEN {case('cloud_expl', EX.CLOUD_EXPLOITABILITY_SCORE, 0.5)}
              WHEN 'snyk' THEN LEAST(GREATEST(cvss / 10.0, 0.0), 1.0)
              ELSE LEAST(GREATEST(rate, 0.0), 1.0) END AS expl_score,
    CASE tool WHEN 'wiz' THEN rtype WHEN 'snyk' THEN pkg_mgr WHEN 'garak' THEN 'llm_model' ELSE 'ml_model' END AS asset_type,
    CASE tool WHEN 'garak' THEN {case('probe', {k: v[1] for k, v in EX.PROBE_MAP.items()}, EX.PROBE_DEFAULT[1])}
              WHEN 'art' THEN {case('attack', {k: v[1] for k, v in EX.ATTACK_MAP.items()}, EX.ATTACK_DEFAULT[1])}
              ELSE '' END AS atlas_technique,
    CASE WHEN tool IN ('wiz', 'snyk') AND sev_raw = '' THEN 'MEDIUM' ELSE sev_raw END AS original_severity
  FROM n1)
, n3 AS (
  SELECT *, {case("band || '|' || consequence", MATRIX, X.SEVERITY_DEFAULT)} AS severity_,
         ROUND(expl_score * {case('consequence', X.CONSEQUENCE_WEIGHTS, X.CONSEQUENCE_WEIGHT_DEFAULT)} * 10, 2) AS ctem_score,
         substr(sha256(tool || ':' || title || ':' || asset_id), 1, 16) AS exposure_key
  FROM n2)
, normalised AS (
  SELECT *, ts + to_hours(CAST({case('upper(severity_)', X.SLA_HOURS, X.SLA_HOURS_DEFAULT)} AS BIGINT)) AS sla_deadline
  FROM n3)
"""


def _normalised(spark, sf):
    return EX.normalise(TB.findings(spark, sf).where(F.lower("source_tool").isin(*EX.KNOWN_TOOLS)))


def _p02(spark, sf):
    n = _normalised(spark, sf)
    # wiz resource types are lower-cased in the oracle; asset_type keeps the raw value here
    return tidy(n.select("finding_id", "exposure_key", "source_tool", "severity", "original_severity", "asset_zone",
                         F.lower("asset_type").alias("asset_type"), "physical_consequence", "exploitability_score",
                         "ctem_score", "atlas_technique", F.date_format("sla_deadline", FMT).alias("sla_deadline")))


register("p02_p11_normalise_findings", with_roles(NORMALISE_SQL + """
SELECT finding_id, exposure_key, tool AS source_tool, severity_ AS severity, original_severity, asset_zone,
       lower(asset_type) AS asset_type, consequence AS physical_consequence, ROUND(expl_score, 6) AS exploitability_score,
       ROUND(ctem_score, 6) AS ctem_score, atlas_technique, strftime(sla_deadline, '%Y-%m-%d %H:%M:%S') AS sla_deadline
FROM normalised
""", "findings"), headline=True)(_p02)


def _p06(spark, sf):
    _, rej = EX.dispatch(TB.findings(spark, sf))
    return rej.groupBy("source_tool", "error").agg(F.count(F.lit(1)).alias("rejected"))


register("p06_dispatch_rejects", with_roles("""
SELECT source_tool, 'unsupported source: ' || COALESCE(source_tool, 'null') AS error, CAST(COUNT(*) AS BIGINT) AS rejected
FROM findings WHERE lower(source_tool) NOT IN ('wiz', 'snyk', 'garak', 'art') OR source_tool IS NULL
GROUP BY source_tool
""", "findings"))(_p06)


def exposure_table(spark, sf):
    """Existing state (findings before the cutoff, latest per key, some Verified/Closed) upserted
    with the later findings: the exposure table the other queries read."""
    n = _normalised(spark, sf)
    dt = n.schema["ts"].dataType
    cut = X.time_lit(CUTOFF, dt)
    old = EX.latest_per_key(n.where(F.col("ts") < cut), "exposure_key", [F.desc("ts"), F.desc("finding_id")])
    first = F.substring("exposure_key", 1, 1)
    old = old.withColumn("status", F.when(first.isin("0", "1", "2"), "Verified").when(first == "3", "Closed")
                         .otherwise("Open")).drop("finding_id")
    return EX.upsert_exposures(old, n.where(F.col("ts") >= cut))


EXPOSURE_TABLE_SQL = NORMALISE_SQL + f"""
, old AS (
  SELECT * EXCLUDE (rn), CASE WHEN substr(exposure_key, 1, 1) IN ('0', '1', '2') THEN 'Verified'
                              WHEN substr(exposure_key, 1, 1) = '3' THEN 'Closed' ELSE 'Open' END AS status
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY exposure_key ORDER BY ts DESC, finding_id DESC) AS rn
        FROM normalised WHERE ts < TIMESTAMP '{CUTOFF}') WHERE rn = 1)
, inc AS (
  SELECT * EXCLUDE (rn), 'Open' AS status
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY exposure_key ORDER BY ts DESC, finding_id DESC) AS rn
        FROM normalised WHERE ts >= TIMESTAMP '{CUTOFF}') WHERE rn = 1)
, exposures AS (
  SELECT COALESCE(o.exposure_key, n.exposure_key) AS exposure_key,
         CASE WHEN n.exposure_key IS NOT NULL THEN n.ts ELSE o.ts END AS ts,
         CASE WHEN n.exposure_key IS NOT NULL THEN n.severity_ ELSE o.severity_ END AS severity,
         CASE WHEN n.exposure_key IS NOT NULL THEN n.ctem_score ELSE o.ctem_score END AS ctem_score,
         CASE WHEN o.exposure_key IS NOT NULL AND o.status IN ('Verified', 'Closed') THEN o.status
              WHEN n.exposure_key IS NOT NULL THEN n.status ELSE o.status END AS status,
         COALESCE(o.tool, n.tool) AS source_tool, COALESCE(o.asset_id, n.asset_id) AS asset_id,
         COALESCE(o.tenant_id, n.tenant_id) AS tenant_id,
         CASE WHEN o.exposure_key IS NOT NULL THEN o.sla_deadline ELSE n.sla_deadline END AS sla_deadline,
         CASE WHEN o.exposure_key IS NOT NULL THEN o.atlas_technique ELSE n.atlas_technique END AS atlas_technique,
         CASE WHEN n.exposure_key IS NOT NULL AND o.exposure_key IS NOT NULL THEN 'updated'
              WHEN n.exposure_key IS NOT NULL THEN 'inserted' ELSE 'unchanged' END AS change
  FROM old o FULL OUTER JOIN inc n ON o.exposure_key = n.exposure_key)
"""


def _s11(spark, sf):
    e = exposure_table(spark, sf)
    return tidy(e.select("exposure_key", F.date_format("ts", FMT).alias("ts"), "severity", "ctem_score", "status",
                         "change"))


register("s11_upsert_exposures", with_roles(EXPOSURE_TABLE_SQL + """
SELECT exposure_key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, severity, ROUND(ctem_score, 6) AS ctem_score, status, change
FROM exposures
""", "findings"), headline=True)(_s11)


def _j05(spark, sf):
    # Alerts of one asset share its exposures, so each asset is joined once.
    assets = (TB.investigations(spark, sf).where(F.col("state") != "closed")
              .groupBy("tenant_id", F.col("asset_id").alias("alert_asset")).agg(F.count(F.lit(1)).alias("alerts")))
    j = EX.open_exposures_for_assets(assets, exposure_table(spark, sf), NOW, asset_col="alert_asset")
    return tidy(j.select("tenant_id", "alert_asset", "alerts", "exposure_key", "ctem_score", "stale", "sla_hours_left"))


register("j05_open_exposures_for_alerts", with_roles(EXPOSURE_TABLE_SQL + f"""
, assets AS (SELECT tenant_id, asset_id AS alert_asset, COUNT(*) AS alerts FROM investigations
             WHERE state <> 'closed' GROUP BY ALL)
SELECT a.tenant_id, alert_asset, CAST(alerts AS BIGINT) AS alerts, e.exposure_key, ROUND(e.ctem_score, 6) AS ctem_score,
       COALESCE(e.ts < {ts(NOW, hours=24)}, true) AS stale,
       ROUND(EXTRACT(EPOCH FROM (e.sla_deadline - {ts(NOW)})) / 3600.0, 6) AS sla_hours_left
FROM assets a JOIN exposures e ON a.alert_asset = e.asset_id AND a.tenant_id = e.tenant_id
WHERE e.status NOT IN ('Verified', 'Closed')
""", "findings", "investigations"))(_j05)


def _a19(spark, sf):
    return tidy(EX.exposure_stats(exposure_table(spark, sf)))


register("a19_exposure_stats", with_roles(EXPOSURE_TABLE_SQL + """
, e AS (SELECT *, lower(status) AS status_lc FROM exposures)
, g AS (
  SELECT severity, status_lc, source_tool, GROUPING(severity, status_lc, source_tool) AS gid,
         COUNT(*) AS n, COUNT(*) FILTER (WHERE status_lc = 'open') AS open_n, AVG(ctem_score) AS avg_score
  FROM e GROUP BY GROUPING SETS ((severity), (status_lc), (source_tool), ()))
SELECT CASE gid WHEN 3 THEN 'severity' WHEN 5 THEN 'status' WHEN 6 THEN 'source_tool' ELSE 'total' END AS dimension,
       CASE WHEN gid = 7 THEN '' ELSE COALESCE(severity, status_lc, source_tool, '') END AS key,
       CAST(n AS BIGINT) AS count, CAST(open_n AS BIGINT) AS open_count, ROUND(avg_score, 6) AS avg_score
FROM g
""", "findings"))(_a19)


def _p13(spark, sf):
    e = EX.list_exposures(exposure_table(spark, sf), severity="CRITICAL", status="open", limit=20, offset=10)
    return tidy(e.select("exposure_key", "ctem_score", "source_tool"))


register("p13_list_exposures", with_roles(EXPOSURE_TABLE_SQL + """
SELECT exposure_key, ROUND(ctem_score, 6) AS ctem_score, source_tool FROM exposures
WHERE severity = 'CRITICAL' AND lower(status) = 'open' ORDER BY ctem_score DESC, exposure_key LIMIT 20 OFFSET 10
""", "findings"))(_p13)


def _e10(spark, sf):
    b = EX.sla_breaches(exposure_table(spark, sf), NOW)
    return (b.groupBy("sla_state", "escalation_level").agg(F.count(F.lit(1)).alias("count"))
            .withColumn("escalation_level", F.col("escalation_level").cast("bigint")))


register("e10_sla_breaches", with_roles(EXPOSURE_TABLE_SQL + f"""
, b AS (SELECT EXTRACT(EPOCH FROM ({ts(NOW)} - sla_deadline)) / 3600.0 AS over FROM exposures
        WHERE status NOT IN ('Verified', 'Closed'))
, c AS (SELECT CASE WHEN over > 0 THEN 'breached' WHEN over > -24 THEN 'at_risk' ELSE 'on_track' END AS sla_state,
               CASE WHEN over > 168 THEN 3 WHEN over > 72 THEN 2 WHEN over > 0 THEN 1 ELSE 0 END AS escalation_level
        FROM b)
SELECT sla_state, CAST(escalation_level AS BIGINT) AS escalation_level, CAST(COUNT(*) AS BIGINT) AS count
FROM c WHERE sla_state <> 'on_track' GROUP BY sla_state, escalation_level
""", "findings"))(_e10)


def _e08(spark, sf):
    f = TB.findings(spark, sf)
    n = EX.normalise(f.where(F.lower("source_tool").isin(*EX.KNOWN_TOOLS)))
    v = n.select(F.concat(F.lit("camp-"), (F.col("finding_id") % 20).cast("string")).alias("campaign_id"),
                 F.col("finding_id").alias("validation_id"), F.col("title").alias("exposure_id"), "ts",
                 (F.col("exploitability_score") >= 0.3).alias("exploitable"),
                 (F.col("severity") == "LOW").alias("detection_evaded"),
                 (F.col("physical_consequence") == "safety_life").alias("physical_consequence_demonstrated"))
    alerts = f.where(F.col("source_tool") == "qualys").select(F.col("title").alias("alert_title"),
                                                              F.col("detected_at").alias("ts"))
    g = EX.campaign_gaps(v, alerts)
    return tidy(g.select("campaign_id", *[F.col(c).cast("bigint").alias(c) for c in (
        "total_tests", "exploitable_count", "detected_count", "detection_gaps", "critical_gaps", "timing_gaps")],
        "detection_rate"))


register("e08_campaign_gap_analysis", with_roles(NORMALISE_SQL + """
, cr AS (SELECT 'camp-' || CAST(finding_id % 20 AS VARCHAR) AS campaign_id, finding_id, title AS exposure_id, ts,
                severity_ = 'LOW' AS evaded, consequence = 'safety_life' AS phys
         FROM normalised WHERE expl_score >= 0.3)
, win AS (SELECT campaign_id, MIN(ts) AS s, MAX(ts) AS e FROM cr GROUP BY campaign_id)
, alerts AS (SELECT title AS alert_title, detected_at AS ts FROM findings WHERE source_tool = 'qualys')
, ga AS (
  SELECT cr.campaign_id, a.alert_title IS NOT NULL AS detected,
         CASE WHEN cr.evaded AND cr.phys THEN 'CRITICAL_GAP' WHEN cr.evaded THEN 'DETECTION_GAP'
              WHEN NOT cr.evaded AND a.alert_title IS NULL THEN 'TIMING_GAP' ELSE 'DETECTED' END AS gap_type
  FROM cr JOIN win ON cr.campaign_id = win.campaign_id
  LEFT JOIN alerts a ON cr.exposure_id = a.alert_title AND a.ts BETWEEN win.s AND win.e)
SELECT campaign_id, CAST(COUNT(*) AS BIGINT) AS total_tests, CAST(COUNT(*) AS BIGINT) AS exploitable_count,
       CAST(COUNT(*) FILTER (WHERE detected) AS BIGINT) AS detected_count,
       CAST(COUNT(*) FILTER (WHERE gap_type = 'DETECTION_GAP') AS BIGINT) AS detection_gaps,
       CAST(COUNT(*) FILTER (WHERE gap_type = 'CRITICAL_GAP') AS BIGINT) AS critical_gaps,
       CAST(COUNT(*) FILTER (WHERE gap_type = 'TIMING_GAP') AS BIGINT) AS timing_gaps,
       ROUND(ROUND(COUNT(*) FILTER (WHERE detected) * 100.0 / GREATEST(COUNT(*), 1), 1), 6) AS detection_rate
FROM ga GROUP BY campaign_id
""", "findings"))(_e08)


def validations(spark, sf):
    """Red-team validations derived from the normalised findings (campaign = finding id % 20)."""
    n = EX.normalise(TB.findings(spark, sf).where(F.lower("source_tool").isin(*EX.KNOWN_TOOLS)))
    vt = F.when(F.col("source_tool").isin("garak", "art"), "adversarial_ml").when(F.col("source_tool") == "wiz", "full_campaign") \
        .otherwise("manual_red_team")
    return n.select(F.concat(F.lit("camp-"), (F.col("finding_id") % 20).cast("string")).alias("campaign_id"),
                    F.col("finding_id").alias("validation_id"), F.col("title").alias("exposure_id"), "ts",
                    (F.col("exploitability_score") >= 0.3).alias("exploitable"),
                    (F.col("severity") == "LOW").alias("detection_evaded"),
                    (F.col("physical_consequence") == "safety_life").alias("physical_consequence_demonstrated"),
                    vt.alias("validation_type"),
                    F.when(F.col("exploitability_score") >= 0.7, "low").otherwise("high").alias("exploit_complexity"))


VALIDATIONS_SQL = NORMALISE_SQL + """
, val AS (SELECT 'camp-' || CAST(finding_id % 20 AS VARCHAR) AS campaign_id, finding_id AS validation_id, ts,
                 expl_score >= 0.3 AS exploitable, severity_ = 'LOW' AS evaded, consequence = 'safety_life' AS phys,
                 CASE WHEN tool IN ('garak', 'art') THEN 'adversarial_ml' WHEN tool = 'wiz' THEN 'full_campaign'
                      ELSE 'manual_red_team' END AS vtype,
                 CASE WHEN expl_score >= 0.7 THEN 'low' ELSE 'high' END AS complexity
          FROM normalised)
"""


def _e13(spark, sf):
    c = EX.campaign_effectiveness(validations(spark, sf), NOW)
    return tidy(c.select("campaign_id", *[F.col(x).cast("bigint").alias(x) for x in (
        "total_tests", "exploitable_findings", "detection_evaded_count", "physical_consequence_count", "unique_types")],
        "exploit_rate", "evasion_rate", "detection_rate"))


register("e13_campaign_effectiveness", with_roles(VALIDATIONS_SQL + f"""
, g AS (SELECT campaign_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE exploitable) AS ex, COUNT(*) FILTER (WHERE evaded) AS ev,
               COUNT(*) FILTER (WHERE phys) AS ph, COUNT(DISTINCT vtype) AS ut
        FROM val WHERE ts > {ts(NOW, days=365)} AND ts < {ts(NOW)}
          AND vtype IN ('manual_red_team', 'adversarial_ml', 'full_campaign') GROUP BY campaign_id)
SELECT campaign_id, CAST(n AS BIGINT) AS total_tests, CAST(ex AS BIGINT) AS exploitable_findings,
       CAST(ev AS BIGINT) AS detection_evaded_count, CAST(ph AS BIGINT) AS physical_consequence_count,
       CAST(ut AS BIGINT) AS unique_types, ROUND(ROUND(ex * 100.0 / GREATEST(n, 1), 1), 6) AS exploit_rate,
       ROUND(ROUND(ev * 100.0 / GREATEST(ex, 1), 1), 6) AS evasion_rate,
       ROUND(ROUND((ex - ev) * 100.0 / GREATEST(ex, 1), 1), 6) AS detection_rate FROM g
""", "findings"))(_e13)


def _e15(spark, sf):
    g = EX.new_detection_gaps(validations(spark, sf), NOW)
    return g.groupBy("gap_severity").agg(F.count(F.lit(1)).alias("gaps"))


register("e15_new_detection_gaps", with_roles(VALIDATIONS_SQL + f"""
SELECT CASE WHEN phys THEN 'CRITICAL' WHEN complexity = 'low' THEN 'HIGH' ELSE 'MEDIUM' END AS gap_severity,
       CAST(COUNT(*) AS BIGINT) AS gaps
FROM val WHERE ts > {ts(NOW, hours=1)} AND ts <= {ts(NOW)} AND evaded GROUP BY 1
""", "findings"))(_e15)
