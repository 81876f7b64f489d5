"""Registered queries for documented designs (E-01, E-04, E-12, E-17) and audit/detection
reports (A-13, A-22, P-15, P-16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import audit as AU
from tidewatch.operators import exposure as EX
from tidewatch.operators import rules as R
from tidewatch.plans.audit_q import AUDIT_EVENTS_SQL, numbered
from tidewatch.plans.exposure_q import EXPOSURE_TABLE_SQL, _normalised, exposure_table
from tidewatch.plans.oracle_roles import with_roles
from tidewatch.plans.registry import register, tidy
from tidewatch.plans.rules_q import EVENT_ACTIONS, NOW, all_detections, ts
from tidewatch.sources import tables as TB

XNOW = TB.EXPOSURES_NOW


def _e01(spark, sf):
    d = R.training_data_poisoning_detailed(TB.audit_log(spark, sf), NOW, actions=EVENT_ACTIONS, evidence_ips=None)
    return tidy(d.select("user_id", "today_count", "distinct_tables", "distinct_actions",
                         "distinct_source_ips", F.hll_sketch_estimate("ip_sketch").alias("sketched_ips"), F.array_join("source_ips", ",").alias("source_ips"),
                         F.date_format("earliest_action", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("earliest_action"),
                         "deviation_factor", "severity", "confidence"))


register("e01_poisoning_detailed", with_roles(f"""
, b AS (SELECT user_id, COUNT(*) / 30.0 AS avg_daily FROM audit_log
        WHERE ts >= {ts(days=30)} AND ts <= {ts(days=1)} AND action IN ('purchase', 'error') GROUP BY user_id)
, c AS (SELECT user_id, COUNT(*) AS n, COUNT(DISTINCT target_resource) AS dt, COUNT(DISTINCT action) AS da,
               array_to_string(list_sort(list_distinct(list(source_ip))), ',') AS ips, COUNT(DISTINCT source_ip) AS n_ips, MIN(ts) AS first_ts
        FROM audit_log WHERE ts > {ts(hours=24)} AND ts < {ts()} AND action IN ('purchase', 'error') GROUP BY user_id)
, j AS (SELECT c.*, CASE WHEN COALESCE(b.avg_daily, 0) > 0 THEN c.n / b.avg_daily ELSE 999.0 END AS dev
        FROM c LEFT JOIN b ON c.user_id = b.user_id)
SELECT user_id, CAST(n AS BIGINT) AS today_count, CAST(dt AS BIGINT) AS distinct_tables, CAST(da AS BIGINT) AS distinct_actions,
       CAST(n_ips AS BIGINT) AS distinct_source_ips, CAST(n_ips AS BIGINT) AS sketched_ips, ips AS source_ips, strftime(first_ts, '%Y-%m-%d %H:%M:%S.%f') AS earliest_action,
       ROUND(CAST(dev AS DOUBLE), 6) AS deviation_factor, CASE WHEN dev > 10 THEN 'High' ELSE 'Medium' END AS severity,
       ROUND(LEAST(0.95, 0.5 + dev / 20.0), 6) AS confidence
FROM j WHERE dev > 3.0 OR dt > 5 OR n > 50
""", "audit_log"))(_e01)


def _e01_ips(spark, sf):
    a = R.poisoning_addresses(TB.audit_log(spark, sf), NOW, actions=EVENT_ACTIONS)
    return tidy(a.select("tenant_id", "user_id", "source_ip", "action_count", F.date_format("last_action", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_action")))


register("e01_poisoning_addresses", with_roles(f"""
SELECT tenant_id, user_id, source_ip, CAST(COUNT(*) AS BIGINT) AS action_count, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_action
FROM audit_log WHERE ts > {ts(hours=24)} AND ts < {ts()} AND action IN ('purchase', 'error') AND source_ip IS NOT NULL GROUP BY ALL
""", "audit_log"))(_e01_ips)


def _e04(spark, sf):
    h = R.oracle_health_bins(TB.oracle_log(spark, sf), NOW)
    return tidy(h.select("tenant_id", "edge_node_id", F.date_format("bin_start", "yyyy-MM-dd HH:mm:ss").alias("bin_start"),
                         "checks", "failures", "errors", "avg_latency_ms", "max_latency_ms"))


register("e04_oracle_health_bins", with_roles(f"""
SELECT tenant_id, edge_node_id, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS bin_start,
       CAST(COUNT(*) AS BIGINT) AS checks, CAST(COUNT(*) FILTER (WHERE check_result = 'fail') AS BIGINT) AS failures,
       CAST(COUNT(*) FILTER (WHERE error_state IS NOT NULL) AS BIGINT) AS errors,
       ROUND(AVG(latency_ms), 6) AS avg_latency_ms, ROUND(MAX(latency_ms), 6) AS max_latency_ms
FROM oracle_log WHERE ts >= {ts(hours=24)} AND ts < {ts()} GROUP BY 1, 2, 3
""", "oracle_log"))(_e04)


def _e12(spark, sf):
    t = EX.weekly_risk_trend(exposure_table(spark, sf), XNOW)
    return tidy(t.withColumn("week", F.date_format("week", "yyyy-MM-dd")))


register("e12_weekly_risk_trend", with_roles(EXPOSURE_TABLE_SQL + f"""
, w AS (SELECT date_trunc('week', ts) AS week, COUNT(*) AS n,
               COUNT(*) FILTER (WHERE severity = 'CRITICAL') AS c, COUNT(*) FILTER (WHERE severity = 'HIGH') AS h,
               COUNT(*) FILTER (WHERE severity = 'MEDIUM') AS m, COUNT(*) FILTER (WHERE severity = 'LOW') AS l,
               ROUND(AVG(ctem_score), 1) AS avg_s, MAX(ctem_score) AS max_s,
               ROUND(SUM(ctem_score * CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)
                     / GREATEST(COUNT(*), 1), 1) AS risk
        FROM exposures WHERE ts > {ts(XNOW, days=180)} AND ts < {ts(XNOW)} AND status IN ('Open', 'InProgress')
        GROUP BY 1)
, l AS (SELECT *, LAG(risk) OVER (ORDER BY week) AS prev FROM w)
SELECT strftime(week, '%Y-%m-%d') AS week, CAST(n AS BIGINT) AS total_exposures, CAST(c AS BIGINT) AS critical_count,
       CAST(h AS BIGINT) AS high_count, CAST(m AS BIGINT) AS medium_count, CAST(l AS BIGINT) AS low_count,
       ROUND(avg_s, 6) AS avg_ctem_score, ROUND(max_s, 6) AS max_ctem_score, ROUND(risk, 6) AS risk_posture_score,
       ROUND(CASE WHEN prev IS NOT NULL AND prev <> 0 THEN ROUND(risk - prev, 1) END, 6) AS week_over_week_change,
       CASE WHEN prev IS NOT NULL AND prev <> 0 AND risk < prev THEN 'IMPROVING' ELSE 'DEGRADING' END AS trend
FROM l
""", "findings"))(_e12)


def _e17(spark, sf):
    f = TB.findings(spark, sf).select("asset_id", F.col("detected_at").alias("ts"))
    return EX.new_assets(f, XNOW).select("asset_id", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"))


register("e17_new_assets", with_roles(f"""
, r AS (SELECT asset_id, MIN(detected_at) AS first_seen FROM findings
        WHERE detected_at >= {ts(XNOW, days=7)} AND detected_at < {ts(XNOW)} GROUP BY asset_id)
SELECT asset_id, strftime(first_seen, '%Y-%m-%d') AS first_seen FROM r
WHERE asset_id NOT IN (SELECT asset_id FROM findings WHERE detected_at >= {ts(XNOW, days=37)}
                       AND detected_at < {ts(XNOW, days=7)} AND asset_id IS NOT NULL)
""", "findings"))(_e17)


def _a13(spark, sf):
    return all_detections(spark, sf).groupBy("telemetry_trust_level").agg(F.count(F.lit(1)).alias("detections"))


def _a13_sql() -> str:
    from tidewatch.plans.registry import ORACLES
    trusted = [q for q in ("d01_training_data_poisoning", "d02_model_extraction", "d03_prompt_injection",
                           "d04_adversarial_evasion", "d05_oracle_dos", "d06_supply_chain", "d07_insider_exfiltration",
                           "d08_alert_flood", "d10_partner_compromise")]
    untrusted = ["d09_sensor_spoofing", "d11_edge_compromise"]
    parts = [f"SELECT 'trusted' AS t FROM ({ORACLES[q]})" for q in trusted]
    parts += [f"SELECT 'untrusted' FROM ({ORACLES[q]})" for q in untrusted]
    return ("SELECT t AS telemetry_trust_level, CAST(COUNT(*) AS BIGINT) AS detections FROM ("
            + " UNION ALL ".join(parts) + ") GROUP BY t")


register("a13_detections_by_trust", _a13_sql())(_a13)


def _p15(spark, sf):
    e = AU.list_events(numbered(spark, sf), "t1", event_type="alert.classified", date_from="2024-01-10",
                       date_to="2024-01-20", limit=AU.MAX_PAGE)
    return e.select("audit_id", "sequence_number", "timestamp")


register("p15_audit_event_listing", AUDIT_EVENTS_SQL + """
SELECT audit_id, CAST(sequence_number AS BIGINT) AS sequence_number, timestamp FROM seq
WHERE tenant_id = 't1' AND et = 'view' AND timestamp >= '2024-01-10' AND timestamp <= '2024-01-20'
ORDER BY timestamp DESC, sequence_number DESC LIMIT 1000
""".replace("et = 'view'", "event_category = 'decision' AND et = 'view'"))(_p15)


def _p16(spark, sf):
    s = AU.search_events(numbered(spark, sf), actor="USER-1", tenant="t2")
    return s.groupBy("actor_id").agg(F.count(F.lit(1)).alias("events"))


register("p16_audit_search", AUDIT_EVENTS_SQL + """
SELECT actor_id, CAST(COUNT(*) AS BIGINT) AS events FROM (
  SELECT 'user-' || CAST(user_id AS VARCHAR) AS actor_id, 't' || CAST(user_id % 5 AS VARCHAR) AS tenant_id FROM events)
WHERE lower(actor_id) LIKE '%user-1%' AND tenant_id = 't2' GROUP BY actor_id
""")(_p16)


def _a22(spark, sf):
    return AU.audit_stats(numbered(spark, sf), "2024-01-30")


register("a22_audit_stats", """
WITH r AS (
  SELECT CASE event_type WHEN 'click' THEN 'investigation.state_changed' WHEN 'view' THEN 'alert.classified'
              WHEN 'purchase' THEN 'response.executed' WHEN 'signup' THEN 'approval.requested'
              ELSE 'injection.detected' END AS event_type,
         'user-' || CAST(user_id AS VARCHAR) AS actor_id, strftime(ts, '%Y-%m-%d') AS d FROM events
  UNION ALL SELECT 'system.genesis', 'audit-service', '1970-01-01' FROM (SELECT DISTINCT user_id % 5 FROM events))
, g AS (SELECT event_type, actor_id, GROUPING(event_type, actor_id) AS gid, COUNT(*) AS n,
               COUNT(*) FILTER (WHERE d = '2024-01-30') AS today FROM r GROUP BY GROUPING SETS ((event_type), (actor_id), ()))
SELECT CASE gid WHEN 1 THEN 'event_type' WHEN 2 THEN 'actor_id' ELSE 'total' END AS dimension,
       CASE WHEN gid = 3 THEN '' ELSE COALESCE(event_type, actor_id) END AS key,
       CAST(n AS BIGINT) AS count, CAST(today AS BIGINT) AS today FROM g
""")(_a22)


def _e03(spark, sf):
    c = TB.read(spark, sf, "conversations")
    q = c.select(F.col("conv_id").cast("string").alias("user_id"), "turn", F.col("text").alias("query_text"),
                 (F.col("role") == "system").alias("safety_filter_triggered"),
                 F.floor(F.length("text") / 4).cast("bigint").alias("token_count"))
    t = R.nl_query_threats(q)
    return t.groupBy("threat_type", "severity", "atlas_technique").agg(F.count(F.lit(1)).alias("queries"))


def _e03_sql() -> str:
    inj = " + ".join(f"contains(lower(text), '{p}')::INT" for p in R.NL_INJECTION_PHRASES)
    esc = " + ".join(f"contains(lower(text), '{p}')::INT" for p in R.NL_ESCALATION_PHRASES)
    return f"""
WITH q AS (SELECT {inj} AS i, {esc} AS e, role = 'system' AS s, CAST(floor(length(text) / 4) AS BIGINT) AS tok FROM conversations)
, f AS (SELECT * FROM q WHERE i > 0 OR e > 0 OR s OR tok > 4000)
SELECT CASE WHEN e > 0 AND i > 0 THEN 'Injection+Escalation' WHEN e > 0 THEN 'Prescriptive_Escalation'
            WHEN i > 0 THEN 'Prompt_Injection' WHEN tok > 4000 THEN 'Suspicious_Length' ELSE 'Safety_Filter_Triggered' END
         AS threat_type,
       CASE WHEN e > 0 THEN 'High' WHEN i > 0 AND s THEN 'High' WHEN i > 0 THEN 'Medium' ELSE 'Low' END AS severity,
       CASE WHEN i > 0 THEN 'AML.T0051' ELSE 'AML.T0054' END AS atlas_technique, CAST(COUNT(*) AS BIGINT) AS queries
FROM f GROUP BY ALL
"""


register("e03_nl_query_threats", _e03_sql())(_e03)


def _s07(spark, sf):
    from tidewatch.sources import adapters as AD
    new, mark = AD.incremental_read(TB.read(spark, sf, "events").select("event_id", "ts"), "ts", "2024-01-29 12:00:00")
    return mark.select("rows_read", F.date_format("next_high_water_mark", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("next_high_water_mark"))


register("s07_incremental_read", """
SELECT CAST(COUNT(*) AS BIGINT) AS rows_read,
       strftime(COALESCE(MAX(ts), TIMESTAMP '2024-01-29 12:00:00'), '%Y-%m-%d %H:%M:%S.%f') AS next_high_water_mark
FROM events WHERE ts > TIMESTAMP '2024-01-29 12:00:00'
""")(_s07)


def _j18(spark, sf):
    e = TB.read(spark, sf, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
                                            "ts")
    from pyspark.sql import Window
    # produced offsets: every event; stored: the chain up to the ingestion cut-off (sequence = rank in tenant)
    offsets = e.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("offset"))
    stored = e.where(F.col("ts") < F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")).groupBy("tenant_id") \
        .agg(F.count(F.lit(1)).alias("sequence_number"))
    return AU.stream_lag(offsets, stored, threshold=300).select(
        "tenant_id", F.col("stream_offset").cast("bigint").alias("stream_offset"),
        F.col("table_max_seq").cast("bigint").alias("table_max_seq"), F.col("lag").cast("bigint").alias("lag"), "lagging")


register("j18_stream_lag", """
WITH e AS (SELECT 't' || CAST(user_id % 5 AS VARCHAR) AS tenant_id, ts FROM events)
, o AS (SELECT tenant_id, COUNT(*) AS off FROM e GROUP BY tenant_id)
, s AS (SELECT tenant_id, COUNT(*) AS seq FROM e WHERE ts < TIMESTAMP '2024-01-25 00:00:00' GROUP BY tenant_id)
SELECT o.tenant_id, CAST(off AS BIGINT) AS stream_offset, CAST(COALESCE(seq, 0) AS BIGINT) AS table_max_seq,
       CAST(off - COALESCE(seq, 0) AS BIGINT) AS lag, off - COALESCE(seq, 0) > 300 AS lagging
FROM o LEFT JOIN s ON o.tenant_id = s.tenant_id
""")(_j18)


def _e05(spark, sf):
    e = TB.read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    running = e.select(F.concat(F.lit("node-"), (F.col("user_id") % 20).cast("string")).alias("edge_node_id"),
                       F.when(F.col("event_type") != "signup", F.md5(F.concat(F.lit("model-"), (k % 12).cast("string"))))
                       .alias("model_weight_hash")).distinct()
    reg = TB.model_registry(spark, sf).withColumn("model_hash", F.when(
        F.col("model_version").cast("bigint") % 9 != 0, F.md5(F.col("model_name"))))
    u = R.unregistered_models(running, reg)
    return u.groupBy("model_weight_hash").agg(F.count_distinct("edge_node_id").alias("nodes"))


register("e05_unregistered_model_hash", with_roles("""
, running AS (SELECT DISTINCT 'node-' || CAST(user_id % 20 AS VARCHAR) AS edge_node_id,
                     CASE WHEN event_type <> 'signup' THEN md5('model-' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 12 AS VARCHAR)) END
                       AS model_weight_hash FROM events)
, prod AS (SELECT CASE WHEN CAST(model_version AS BIGINT) % 9 <> 0 THEN md5(model_name) END AS h
           FROM model_registry WHERE stage = 'Production')
SELECT model_weight_hash, CAST(COUNT(DISTINCT edge_node_id) AS BIGINT) AS nodes FROM running
WHERE model_weight_hash IS NOT NULL AND model_weight_hash NOT IN (SELECT h FROM prod WHERE h IS NOT NULL)
GROUP BY model_weight_hash
""", "model_registry"))(_e05)


def _e02(spark, sf):
    d = R.extraction_by_gap(TB.api_log(spark, sf), NOW)
    return tidy(d.select("tenant_id", "caller_identity", "query_count", "distinct_endpoints", "median_gap_ms", "confidence"))


register("e02_extraction_by_call_gap", with_roles(f"""
, w AS (SELECT tenant_id, caller_identity, endpoint, ts FROM api_log
        WHERE ts > {ts(hours=6)} AND ts < {ts()} AND (endpoint LIKE '%predict%' OR endpoint LIKE '%forecast%'
          OR endpoint LIKE '%inference%' OR endpoint LIKE '%query%' OR endpoint LIKE '%nl-query%'))
, g AS (SELECT *, EXTRACT(EPOCH FROM (ts - LAG(ts) OVER (PARTITION BY tenant_id, caller_identity ORDER BY ts))) * 1000 AS gap FROM w)
, s AS (SELECT tenant_id, caller_identity, COUNT(*) AS n, COUNT(DISTINCT endpoint) AS de, quantile_cont(gap, 0.5) AS med
        FROM g GROUP BY tenant_id, caller_identity HAVING COUNT(*) > 100)
, f AS (SELECT *, COALESCE(med, 9999.0) AS m2 FROM s WHERE COALESCE(med, 9999.0) < 500 OR de > 2)
, c AS (SELECT *, CASE WHEN n > 500 AND m2 < 200 THEN 0.95 WHEN n > 200 AND de > 3 THEN 0.85 WHEN n > 100 THEN 0.70
                        ELSE 0.50 END AS conf FROM f)
SELECT tenant_id, caller_identity, CAST(n AS BIGINT) AS query_count, CAST(de AS BIGINT) AS distinct_endpoints,
       ROUND(med, 6) AS median_gap_ms, ROUND(CAST(conf AS DOUBLE), 6) AS confidence FROM c WHERE conf > 0.65
""", "api_log"))(_e02)


def _e14(spark, sf):
    from tidewatch.functions.exprs import time_lit
    ex = exposure_table(spark, sf)
    dt = ex.schema["ts"].dataType
    ctem = ex.where((F.col("ts") > time_lit(R.shift(XNOW, days=90), dt)) & (F.col("ts") < time_lit(XNOW, dt))) \
        .select("atlas_technique")
    runtime = all_detections(spark, sf).select("atlas_technique")
    known = spark.createDataFrame(list(EX.KNOWN_TECHNIQUES), "atlas_technique string, threat_model_ref string, technique_name string")
    val = spark.createDataFrame([], "atlas_technique string")
    m = EX.coverage_matrix(known, ctem, runtime, val)
    return m.select("atlas_technique", F.col("ctem_findings").cast("bigint").alias("ctem_findings"),
                    F.col("runtime_alerts").cast("bigint").alias("runtime_alerts"),
                    F.col("coverage_score").cast("bigint").alias("coverage_score"), "coverage_status")


def _e14_sql() -> str:
    from tidewatch.operators.rules import RULES
    from tidewatch.plans.registry import ORACLES
    tech = {f"d{m.rule_id[-2:]}": m.atlas_technique for m in RULES.values()}
    parts = []
    for q in ("d01_training_data_poisoning", "d02_model_extraction", "d03_prompt_injection", "d04_adversarial_evasion",
              "d05_oracle_dos", "d07_insider_exfiltration", "d08_alert_flood", "d09_sensor_spoofing",
              "d10_partner_compromise", "d11_edge_compromise"):
        parts.append(f"SELECT '{tech[q[:3]]}' AS t FROM ({ORACLES[q]})")
    parts.append(f"SELECT CASE finding WHEN 'promotion' THEN 'AML.T0010' ELSE 'AML.T0018' END FROM ({ORACLES['d06_supply_chain']})")
    values = ", ".join(f"('{a}')" for a, _, _ in EX.KNOWN_TECHNIQUES)
    return with_roles(EXPOSURE_TABLE_SQL + f"""
, ctem AS (SELECT atlas_technique AS t, COUNT(*) AS n FROM exposures
           WHERE ts > {ts(XNOW, days=90)} AND ts < {ts(XNOW)} AND atlas_technique <> '' GROUP BY 1)
, rt AS (SELECT t, COUNT(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY t)
, k AS (SELECT * FROM (VALUES {values}) v(t))
SELECT k.t AS atlas_technique, CAST(COALESCE(ctem.n, 0) AS BIGINT) AS ctem_findings,
       CAST(COALESCE(rt.n, 0) AS BIGINT) AS runtime_alerts,
       CAST((ctem.n IS NOT NULL)::INT + (rt.n IS NOT NULL)::INT AS BIGINT) AS coverage_score,
       CASE WHEN rt.n IS NOT NULL THEN 'DETECTION_ONLY' WHEN ctem.n IS NOT NULL THEN 'DISCOVERY_ONLY'
            ELSE 'NO_COVERAGE' END AS coverage_status
FROM k LEFT JOIN ctem ON k.t = ctem.t LEFT JOIN rt ON k.t = rt.t
""", "findings")


register("e14_coverage_matrix", _e14_sql())(_e14)


def _runtime_alerts(spark, sf):
    """Detections as runtime alerts of the exposures' tenants: the tenant follows from the entity."""
    t = F.conv(F.substring(F.md5(F.coalesce("entity_id", F.lit(""))), 1, 4), 16, 10).cast("int") % 4
    return all_detections(spark, sf).withColumn("tenant_id", F.concat(F.lit("t"), t.cast("string")))


def _runtime_counts(spark, sf):
    return _runtime_alerts(spark, sf).where(F.col("atlas_technique") != "").groupBy("tenant_id", "atlas_technique").agg(
        F.count(F.lit(1)).alias("runtime_alerts"))


def _e07(spark, sf):
    t = EX.weekly_triage(exposure_table(spark, sf), _runtime_counts(spark, sf), XNOW)
    return tidy(t.groupBy("triage_priority", "sla_status").agg(F.count(F.lit(1)).alias("exposures"),
                                                                F.sum("adjusted_score").alias("adjusted_score"),
                                                                F.sum("days_open").cast("bigint").alias("days_open")))


def _rt_sql() -> str:
    from tidewatch.operators.rules import RULES
    from tidewatch.plans.registry import ORACLES
    from tidewatch.plans.rules_q import DETECTION_ENTITY
    tech = {f"d{m.rule_id[-2:]}": f"'{m.atlas_technique}'" for m in RULES.values()}
    tech["d06"] = "CASE finding WHEN 'promotion' THEN 'AML.T0010' ELSE 'AML.T0018' END"
    parts = [f"SELECT {tech[q[:3]]} AS t, COALESCE(CAST({e} AS VARCHAR), '') AS entity FROM ({ORACLES[q]})" for q, e in DETECTION_ENTITY.items()]
    return (", rt AS (SELECT t AS atlas_technique, 't' || CAST(CAST('0x' || substr(md5(entity), 1, 4) AS INTEGER) % 4 AS VARCHAR) AS tenant_id, "
            f"COUNT(*) AS runtime_alerts FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)")


def _e07_sql() -> str:
    return with_roles(EXPOSURE_TABLE_SQL + _rt_sql() + f"""
, e AS (SELECT x.*, rt.runtime_alerts FROM exposures x LEFT JOIN rt ON x.atlas_technique = rt.atlas_technique AND x.tenant_id = rt.tenant_id
        WHERE x.status IN ('Open', 'InProgress') AND x.ts > {ts(XNOW, days=90)} AND x.ts < {ts(XNOW)})
, f AS (SELECT *, CASE WHEN runtime_alerts IS NOT NULL THEN ctem_score * 1.5 ELSE ctem_score END AS adj,
               CASE WHEN {ts(XNOW)} > sla_deadline THEN 'BREACHED'
                    WHEN EXTRACT(EPOCH FROM (sla_deadline - {ts(XNOW)})) / 3600.0 < 24 THEN 'AT_RISK' ELSE 'ON_TRACK' END AS sla,
               CAST(floor(EXTRACT(EPOCH FROM ({ts(XNOW)} - ts)) / 3600.0 / 24) AS BIGINT) AS days_open FROM e)
, g AS (SELECT *, CASE WHEN severity = 'CRITICAL' AND sla = 'BREACHED' THEN 1 WHEN severity = 'CRITICAL' THEN 2
                       WHEN severity = 'HIGH' AND sla = 'BREACHED' THEN 3 WHEN severity = 'HIGH' AND runtime_alerts IS NOT NULL THEN 4
                       WHEN severity = 'HIGH' THEN 5 WHEN severity = 'MEDIUM' THEN 6 ELSE 7 END AS pr FROM f)
SELECT CAST(pr AS BIGINT) AS triage_priority, sla AS sla_status, CAST(COUNT(*) AS BIGINT) AS exposures,
       ROUND(SUM(adj), 6) AS adjusted_score, CAST(SUM(days_open) AS BIGINT) AS days_open FROM g GROUP BY ALL
""", "findings")


register("e07_weekly_triage", _e07_sql())(_e07)


def _e09(spark, sf):
    alerts = _runtime_alerts(spark, sf).select("tenant_id", "atlas_technique", F.col("alert_title"), F.col("detected_at").alias("ts"))
    c = EX.runtime_correlation(exposure_table(spark, sf), alerts)
    return c.groupBy("tenant_id", "atlas_technique").agg(F.count(F.lit(1)).alias("exposures"),
                                            F.max("runtime_alerts").cast("bigint").alias("runtime_alerts"))


register("e09_exposure_runtime_correlation", with_roles(EXPOSURE_TABLE_SQL + _rt_sql() + """
SELECT x.tenant_id, x.atlas_technique, CAST(COUNT(*) AS BIGINT) AS exposures, CAST(MAX(rt.runtime_alerts) AS BIGINT) AS runtime_alerts
FROM exposures x JOIN rt ON x.atlas_technique = rt.atlas_technique AND x.tenant_id = rt.tenant_id GROUP BY ALL
""", "findings"))(_e09)


def _e06(spark, sf):
    inv = TB.investigations(spark, sf)
    d = R.title_hourly_flood(inv, TB.INVESTIGATIONS_NOW)
    return tidy(d.select("tenant_id", "alert_title", F.date_format("hour_bin", "yyyy-MM-dd HH:mm").alias("hour_bin"),
                         "current_count", "hourly_avg", "spike_ratio"))


_INV = TB.INVESTIGATIONS_NOW
register("e06_title_hourly_flood", with_roles(f"""
, b AS (SELECT tenant_id, alert_title, COUNT(*) / (7 * 24.0) AS hourly_avg FROM investigations
        WHERE created_at >= {ts(_INV, days=7)} AND created_at <= {ts(_INV, hours=6)} GROUP BY ALL)
, c AS (SELECT tenant_id, alert_title, date_trunc('hour', created_at) AS hour_bin, COUNT(*) AS n FROM investigations
        WHERE created_at > {ts(_INV, hours=6)} AND created_at < {ts(_INV)} GROUP BY 1, 2, 3)
SELECT c.tenant_id, c.alert_title, strftime(c.hour_bin, '%Y-%m-%d %H:%M') AS hour_bin, CAST(c.n AS BIGINT) AS current_count,
       ROUND(b.hourly_avg, 6) AS hourly_avg, ROUND(c.n / GREATEST(b.hourly_avg, 0.1), 6) AS spike_ratio
FROM c JOIN b ON c.alert_title = b.alert_title AND c.tenant_id = b.tenant_id WHERE c.n / GREATEST(b.hourly_avg, 0.1) > 5.0
""", "investigations"))(_e06)


# ---------------------------------------------------------------- E-06 insider / partner forms
def _e06_insider(spark, sf):
    d = R.insider_resource_access(TB.resource_access_log(spark, sf), NOW)
    return tidy(d)


_SUSP = " OR ".join(f"target_resource ILIKE '%{r}%'" for r in R.SUSPICIOUS_RESOURCES)
register("e06_insider_resource_access", with_roles(f"""
, g AS (SELECT tenant_id, user_id,
               COUNT(*) FILTER (WHERE ts >= {ts(NOW, days=30)} AND ts <= {ts(NOW, days=1)}) / 30.0 AS daily_avg,
               COUNT(*) FILTER (WHERE ts > {ts(NOW, hours=24)}) AS access_count,
               COUNT(DISTINCT CASE WHEN ts > {ts(NOW, hours=24)} THEN target_resource END) AS distinct_resources,
               COUNT(DISTINCT CASE WHEN ts > {ts(NOW, hours=24)} THEN source_ip END) AS distinct_source_ips,
               COUNT(*) FILTER (WHERE ts > {ts(NOW, hours=24)} AND (hour(ts) < 6 OR hour(ts) > 20)) AS after_hours_count
        FROM resource_access_log WHERE ts >= {ts(NOW, days=30)} AND ts < {ts(NOW)} AND ({_SUSP})
        GROUP BY tenant_id, user_id)
, d AS (SELECT *, CASE WHEN daily_avg > 0 THEN access_count / daily_avg ELSE 999.0 END AS dev FROM g
        WHERE access_count > 0)
SELECT tenant_id, user_id, ROUND(daily_avg, 6) AS daily_avg, CAST(access_count AS BIGINT) AS access_count,
       CAST(distinct_resources AS BIGINT) AS distinct_resources, CAST(distinct_source_ips AS BIGINT) AS distinct_source_ips,
       CAST(after_hours_count AS BIGINT) AS after_hours_count, ROUND(dev, 6) AS deviation_factor,
       ROUND(LEAST(0.95, 0.6 + dev / 30.0), 6) AS confidence
FROM d WHERE dev > 5.0 OR distinct_resources > 3 OR after_hours_count > 5 OR access_count > 50
""", "resource_access_log"))(_e06_insider)


def _e06_partner(spark, sf):
    return tidy(R.partner_direction_anomaly(TB.partner_traffic(spark, sf), NOW))


register("e06_partner_direction_anomaly", with_roles(f"""
, b AS (SELECT tenant_id, partner_id, direction, COUNT(*) / 7.0 AS avg_daily_requests, AVG(payload_size) AS avg_payload_size,
               STDDEV_SAMP(payload_size) AS std_payload_size,
               COUNT(*) FILTER (WHERE mtls_verified) / GREATEST(COUNT(*), 1) AS normal_mtls_rate
        FROM partner_traffic WHERE ts >= {ts(NOW, days=7)} AND ts <= {ts(NOW, hours=6)} GROUP BY ALL)
, c AS (SELECT tenant_id, partner_id, partner_name, direction, COUNT(*) AS request_count, AVG(payload_size) AS avg_payload,
               MAX(payload_size) AS max_payload, COUNT(*) FILTER (WHERE response_code >= 400) AS error_count,
               COUNT(*) FILTER (WHERE NOT mtls_verified) AS mtls_fail_count,
               COUNT(DISTINCT data_type) AS distinct_data_types
        FROM partner_traffic WHERE ts > {ts(NOW, hours=6)} AND ts < {ts(NOW)} GROUP BY ALL)
, j AS (SELECT c.*, b.avg_daily_requests, b.avg_payload_size, b.std_payload_size, b.normal_mtls_rate,
               CASE WHEN b.avg_daily_requests > 0 THEN c.request_count / (b.avg_daily_requests / 4.0) ELSE 999.0 END AS vol,
               CASE WHEN b.std_payload_size > 0 THEN (c.avg_payload - b.avg_payload_size) / b.std_payload_size
                    ELSE 0.0 END AS z,
               c.mtls_fail_count > 0 AND b.normal_mtls_rate > 0.99 AS mtls_anomalous
        FROM c JOIN b ON c.partner_id = b.partner_id AND c.direction = b.direction AND c.tenant_id = b.tenant_id)
SELECT tenant_id, partner_id, partner_name, direction, CAST(request_count AS BIGINT) AS request_count,
       ROUND(avg_payload, 6) AS avg_payload, ROUND(max_payload, 6) AS max_payload,
       CAST(error_count AS BIGINT) AS error_count, CAST(mtls_fail_count AS BIGINT) AS mtls_fail_count,
       CAST(distinct_data_types AS BIGINT) AS distinct_data_types, ROUND(avg_daily_requests, 6) AS avg_daily_requests,
       ROUND(avg_payload_size, 6) AS avg_payload_size, ROUND(std_payload_size, 6) AS std_payload_size,
       ROUND(normal_mtls_rate, 6) AS normal_mtls_rate, ROUND(vol, 6) AS volume_deviation,
       ROUND(z, 6) AS payload_z_score, mtls_anomalous
FROM j WHERE vol > 3.0 OR z > 3.0 OR mtls_anomalous OR error_count > 10
""", "partner_traffic"))(_e06_partner)


# ---------------------------------------------------------------- E-11 weekly KPIs
REMEDIATIONS_SQL = """
, span AS (SELECT exposure_key, MIN(ts) AS assigned_date, MAX(ts) AS verified_date FROM normalised GROUP BY 1)
, remediations AS (SELECT e.exposure_key AS exposure_id, s.assigned_date, s.verified_date, e.sla_deadline,
                          'Verified' AS status, s.verified_date AS ts
                   FROM exposures e JOIN span s ON e.exposure_key = s.exposure_key WHERE e.status = 'Verified')
"""


def _e11(spark, sf):
    ex = exposure_table(spark, sf)
    rem = EX.remediations(_normalised(spark, sf), ex)
    return tidy(EX.weekly_kpis(rem, ex, XNOW))


register("e11_weekly_kpis", with_roles(EXPOSURE_TABLE_SQL + REMEDIATIONS_SQL + f"""
, r AS (SELECT *, epoch_us(verified_date) / 3.6e9 - epoch_us(assigned_date) / 3.6e9 AS hrs,
               exposure_id IN (SELECT exposure_key FROM exposures WHERE severity = 'CRITICAL') AS crit
        FROM remediations WHERE status = 'Verified' AND ts > {ts(XNOW, days=30)} AND ts < {ts(XNOW)})
, m AS (SELECT ROUND(COALESCE(AVG(hrs), 0.0), 1) AS mttr_all_hours,
               ROUND(COALESCE(AVG(hrs) FILTER (WHERE crit), 0.0), 1) AS mttr_critical_hours,
               COUNT(*) AS verified_total, COUNT(*) FILTER (WHERE verified_date <= sla_deadline) AS on_time FROM r)
, red AS (SELECT COUNT(DISTINCT exposure_key) FILTER (WHERE ts > {ts(XNOW, days=30)}) AS cur,
                 COUNT(DISTINCT exposure_key) FILTER (WHERE ts <= {ts(XNOW, days=30)}) AS prior
          FROM exposures WHERE severity IN ('CRITICAL', 'HIGH') AND ts >= {ts(XNOW, days=60)} AND ts < {ts(XNOW)})
SELECT ROUND(mttr_all_hours, 6) AS mttr_all_hours, ROUND(mttr_critical_hours, 6) AS mttr_critical_hours,
       CAST(verified_total AS BIGINT) AS verified_total, CAST(on_time AS BIGINT) AS on_time,
       ROUND(ROUND(on_time * 100.0 / GREATEST(verified_total, 1), 1), 6) AS sla_compliance_rate,
       CAST(cur AS BIGINT) AS attack_path_current_month, CAST(prior AS BIGINT) AS attack_path_prior_month
FROM m, red
""", "findings"))(_e11)


def _e11_breakdowns(spark, sf):
    return tidy(EX.kpi_breakdowns(exposure_table(spark, sf), XNOW))


register("e11_kpi_breakdowns", with_roles(EXPOSURE_TABLE_SQL + f"""
SELECT 'open_exposures' AS metric, severity AS key, CAST(COUNT(*) AS BIGINT) AS count FROM exposures
WHERE status IN ('Open', 'InProgress') GROUP BY severity
UNION ALL
SELECT 'tool_coverage' AS metric, source_tool AS key, CAST(COUNT(*) AS BIGINT) AS count FROM exposures
WHERE ts > {ts(XNOW, days=30)} AND ts < {ts(XNOW)} GROUP BY source_tool
""", "findings"))(_e11_breakdowns)


# ---------------------------------------------------------------- rules whose default windows are empty in small tables
# The same operators over wider windows or lower thresholds, so that rows fire; SQL is the default's with those values.
def _again(name: str, base: str, *changes: tuple[str, str]) -> str:
    from tidewatch.plans.registry import ORACLES
    sql = ORACLES[base]
    for old, new in changes:
        if old not in sql:
            raise ValueError(f"{name}: {old!r} is not in the SQL of {base}")
        sql = sql.replace(old, new)
    return sql


def _d02_week(spark, sf):
    d = R.model_extraction(TB.query_log(spark, sf), NOW, count_threshold=5, lookback_hours=24 * 7)
    return tidy(d.select("rule_id", "tenant_id", "user_id", "query_count", "median_tokens", "confidence"))


register("d02_model_extraction_week", _again("d02", "d02_model_extraction", (ts(hours=6), ts(hours=168)), ("> 100", "> 5")))(_d02_week)


def _d05_day(spark, sf):
    d = R.oracle_dos(TB.oracle_log(spark, sf), NOW, lookback_minutes=24 * 60)
    return tidy(d.select("rule_id", "tenant_id", "edge_node_id", "total_checks", "error_count", "timeout_count", "fail_rate",
                         "max_latency_ms", "confidence"))


register("d05_oracle_dos_day", _again("d05", "d05_oracle_dos", (ts(minutes=15), ts(minutes=1440))))(_d05_day)


def _d09_hours(spark, sf):
    d = R.sensor_spoofing(TB.sensor_log(spark, sf), NOW, lookback_minutes=360, zscore_threshold=1.5)
    return tidy(d.select("rule_id", "tenant_id", "edge_node_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                         "protocol_violations", "z_score", "sensor_delta", "confidence", "telemetry_trust_level"))


register("d09_sensor_spoofing_hours", _again("d09", "d09_sensor_spoofing", (ts(minutes=15), ts(minutes=360)), ("z > 3.0", "z > 1.5")))(_d09_hours)


def _d11_day(spark, sf):
    d = R.edge_compromise(TB.edge_telemetry(spark, sf), NOW, lookback_minutes=24 * 60)
    return tidy(d.select("rule_id", "tenant_id", "edge_node_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                         "attestation_finding", "disk_failed", "cpu_high", "memory_high", "confidence", "attestation_status"))


register("d11_edge_compromise_day", _again("d11", "d11_edge_compromise", (ts(minutes=15), ts(minutes=1440))))(_d11_day)


def _e02_week(spark, sf):
    d = R.extraction_by_gap(TB.api_log(spark, sf), NOW, threshold=5, lookback_hours=24 * 7)
    return tidy(d.select("tenant_id", "caller_identity", "query_count", "distinct_endpoints", "median_gap_ms", "confidence"))


register("e02_extraction_by_call_gap_week", _again("e02", "e02_extraction_by_call_gap", (ts(hours=6), ts(hours=168)), ("> 100", "> 5")))(_e02_week)


def _e06_title_days(spark, sf):
    d = R.title_hourly_flood(TB.investigations(spark, sf), TB.INVESTIGATIONS_NOW, ratio_threshold=0.5, baseline_days=60, lookback_hours=48)
    return tidy(d.select("tenant_id", "alert_title", F.date_format("hour_bin", "yyyy-MM-dd HH:mm").alias("hour_bin"),
                         "current_count", "hourly_avg", "spike_ratio"))


register("e06_title_hourly_flood_days", _again("e06", "e06_title_hourly_flood", (ts(_INV, hours=6), ts(_INV, hours=48)),
                                               (ts(_INV, days=7), ts(_INV, days=60)), ("(7 * 24.0)", "(60 * 24.0)"), ("> 5.0", "> 0.5")))(_e06_title_days)


def _e06_partner_low(spark, sf):
    return tidy(R.partner_direction_anomaly(TB.partner_traffic(spark, sf), NOW, volume_threshold=1.1, payload_z_threshold=0.5, error_threshold=2))


register("e06_partner_direction_anomaly_low", _again("e06p", "e06_partner_direction_anomaly", ("vol > 3.0", "vol > 1.1"), ("z > 3.0", "z > 0.5"),
                                                     ("error_count > 10", "error_count > 2")))(_e06_partner_low)
