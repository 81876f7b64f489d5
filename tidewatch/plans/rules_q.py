"""Registered rule queries (D-01 .. D-12, P-39) on the role views.

The oracle SQL restates each rule the way the reference writes it (separate
current and baseline queries joined on the key); the Spark side uses the
one-scan conditional aggregate, so the check also validates that rewrite.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.exprs import shift
from tidewatch.operators import rules as R
from tidewatch.plans.oracle_roles import with_roles
from tidewatch.plans.registry import register, tidy
from tidewatch.sources import tables as TB
from tidewatch.streaming import live_rules as LR

NOW = TB.EVENTS_NOW
INV_NOW = TB.INVESTIGATIONS_NOW
# On the driver's ``events`` the suspicious workspace actions are these event types.
EVENT_ACTIONS = ("purchase", "error")


def ts(now=NOW, **delta) -> str:
    return "TIMESTAMP '" + shift(now, **delta).strftime("%Y-%m-%d %H:%M:%S") + "'"


# ---------------------------------------------------------------- D-01
def _d01(spark, sf):
    d = R.training_data_poisoning(TB.audit_log(spark, sf), NOW, actions=EVENT_ACTIONS)
    return tidy(d.select("rule_id", "tenant_id", "user_id", "count", "distinct_tables", "baseline_avg",
                         "deviation_factor", "confidence"))


D01_SQL = with_roles(f"""
, cur AS (
  SELECT tenant_id, user_id, COUNT(*) AS cnt, COUNT(DISTINCT target_resource) AS distinct_tables
  FROM audit_log WHERE ts >= {ts(hours=24)} AND ts < {ts()} AND action IN ('purchase', 'error')
  GROUP BY tenant_id, user_id)
, base AS (
  SELECT tenant_id, user_id, COUNT(*) / 30.0 AS avg_daily
  FROM audit_log WHERE ts >= {ts(days=30)} AND ts < {ts(hours=24)} AND action IN ('purchase', 'error')
  GROUP BY tenant_id, user_id)
, j AS (
  SELECT c.tenant_id, c.user_id, c.cnt, c.distinct_tables, COALESCE(b.avg_daily, 0) AS avg_daily,
         CASE WHEN COALESCE(b.avg_daily, 0) > 0 THEN c.cnt / b.avg_daily ELSE c.cnt END AS deviation
  FROM cur c LEFT JOIN base b ON c.tenant_id = b.tenant_id AND c.user_id = b.user_id)
SELECT 'ATLAS-DETECT-001' AS rule_id, tenant_id, user_id, CAST(cnt AS BIGINT) AS count,
       CAST(distinct_tables AS BIGINT) AS distinct_tables, ROUND(CAST(avg_daily AS DOUBLE), 6) AS baseline_avg,
       ROUND(CAST(deviation AS DOUBLE), 6) AS deviation_factor,
       ROUND(LEAST(0.95, 0.5 + deviation / 20.0), 6) AS confidence
FROM j WHERE deviation > 3.0 OR distinct_tables > 5 OR cnt > 50
""", "audit_log")
register("d01_training_data_poisoning", D01_SQL, headline=True)(_d01)


# ---------------------------------------------------------------- D-02
def _d02(spark, sf):
    return tidy(R.model_extraction(TB.query_log(spark, sf), NOW)
                .select("rule_id", "tenant_id", "user_id", "query_count", "median_tokens", "confidence"))


D02_SQL = with_roles(f"""
SELECT 'ATLAS-DETECT-002' AS rule_id, tenant_id, user_id, CAST(COUNT(*) AS BIGINT) AS query_count,
       ROUND(quantile_cont(token_count, 0.5), 6) AS median_tokens,
       ROUND(LEAST(0.9, 0.6 + COUNT(*) / 1000.0), 6) AS confidence
FROM query_log WHERE ts >= {ts(hours=6)} AND ts < {ts()}
GROUP BY tenant_id, user_id HAVING COUNT(*) > 100
""", "query_log")
register("d02_model_extraction", D02_SQL)(_d02)


def _d02_median(spark, sf):
    """A-04 on its own: exact median per caller over the 6 h window, with HAVING count > 1."""
    d = R.model_extraction(TB.query_log(spark, sf), NOW, count_threshold=1)
    return tidy(d.select("user_id", "query_count", "median_tokens"))


register("a04_exact_median_having", with_roles(f"""
SELECT user_id, CAST(COUNT(*) AS BIGINT) AS query_count, ROUND(quantile_cont(token_count, 0.5), 6) AS median_tokens
FROM query_log WHERE ts >= {ts(hours=6)} AND ts < {ts()} GROUP BY user_id HAVING COUNT(*) > 1
""", "query_log"))(_d02_median)


# ---------------------------------------------------------------- D-03
def _d03(spark, sf):
    return tidy(R.prompt_injection(TB.query_log(spark, sf), NOW)
                .select("rule_id", "tenant_id", "user_id", "session_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                        "confidence"))


register("d03_prompt_injection", with_roles(f"""
SELECT 'ATLAS-DETECT-003' AS rule_id, tenant_id, user_id, session_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,
       0.85::DOUBLE AS confidence
FROM query_log WHERE ts >= {ts(hours=1)} AND ts < {ts()} AND safety_filter_triggered = true
""", "query_log"))(_d03)


# ---------------------------------------------------------------- D-04
def _d04(spark, sf):
    return tidy(R.adversarial_evasion(TB.inference_log(spark, sf), NOW)
                .select("rule_id", "tenant_id", "edge_node_id", "count", "z_score", "fail_rate",
                        "latency_increase_ms", "confidence"))


register("d04_adversarial_evasion", with_roles(f"""
, cur AS (
  SELECT tenant_id, edge_node_id, AVG(confidence_score) AS avg_confidence, AVG(inference_latency_ms) AS avg_latency,
         SUM(CASE WHEN physics_check_result = 'fail' THEN 1 ELSE 0 END)::DOUBLE / NULLIF(COUNT(*), 0) AS fail_rate,
         COUNT(*) AS cnt
  FROM inference_log WHERE ts >= {ts(hours=1)} AND ts < {ts()} GROUP BY tenant_id, edge_node_id)
, base AS (
  SELECT tenant_id, edge_node_id, AVG(confidence_score) AS avg_confidence,
         STDDEV_SAMP(confidence_score) AS sd, AVG(inference_latency_ms) AS avg_latency
  FROM inference_log WHERE ts >= {ts(days=7)} AND ts < {ts(hours=1)} GROUP BY tenant_id, edge_node_id)
, j AS (
  SELECT c.tenant_id, c.edge_node_id, c.cnt, (c.avg_confidence - b.avg_confidence) / b.sd AS z,
         COALESCE(c.fail_rate, 0) AS fail_rate, c.avg_latency - COALESCE(b.avg_latency, 0) AS lat
  FROM cur c JOIN base b ON c.tenant_id = b.tenant_id AND c.edge_node_id = b.edge_node_id
  WHERE b.sd IS NOT NULL AND b.sd <> 0)
SELECT 'ATLAS-DETECT-004' AS rule_id, tenant_id, edge_node_id, CAST(cnt AS BIGINT) AS count, ROUND(z, 6) AS z_score,
       ROUND(fail_rate, 6) AS fail_rate, ROUND(lat, 6) AS latency_increase_ms,
       ROUND(LEAST(0.95, 0.6 + ABS(z) / 10.0), 6) AS confidence
FROM j WHERE z < -2.0 OR fail_rate > 0.1 OR lat > 500
""", "inference_log"))(_d04)


# ---------------------------------------------------------------- D-05
def _d05(spark, sf):
    return tidy(R.oracle_dos(TB.oracle_log(spark, sf), NOW)
                .select("rule_id", "tenant_id", "edge_node_id", "total_checks", "error_count", "timeout_count",
                        "fail_rate", "max_latency_ms", "confidence"))


register("d05_oracle_dos", with_roles(f"""
, g AS (
  SELECT tenant_id, edge_node_id, COUNT(*) AS total_checks,
         SUM(CASE WHEN error_state IS NOT NULL THEN 1 ELSE 0 END) AS error_count,
         SUM(CASE WHEN latency_ms > 10000 THEN 1 ELSE 0 END) AS timeout_count,
         SUM(CASE WHEN check_result = 'fail' THEN 1 ELSE 0 END)::DOUBLE / NULLIF(COUNT(*), 0) AS fail_rate,
         MAX(latency_ms) AS max_latency
  FROM oracle_log WHERE ts >= {ts(minutes=15)} AND ts < {ts()} GROUP BY tenant_id, edge_node_id)
SELECT 'ATLAS-DETECT-005' AS rule_id, tenant_id, edge_node_id, CAST(total_checks AS BIGINT) AS total_checks,
       CAST(error_count AS BIGINT) AS error_count, CAST(timeout_count AS BIGINT) AS timeout_count,
       ROUND(fail_rate, 6) AS fail_rate, ROUND(max_latency, 6) AS max_latency_ms, 0.9::DOUBLE AS confidence
FROM g WHERE error_count > 3 OR timeout_count > 2 OR (fail_rate > 0.5 AND total_checks > 10) OR max_latency > 10000
""", "oracle_log"))(_d05)


def _d05b(spark, sf):
    return tidy(R.silent_nodes(TB.oracle_log(spark, sf), NOW).select("rule_id", "tenant_id", "edge_node_id",
                                                                      "total_checks", "confidence"))


register("d05b_silent_nodes", with_roles(f"""
SELECT DISTINCT 'ATLAS-DETECT-005' AS rule_id, k.tenant_id, k.edge_node_id, CAST(0 AS BIGINT) AS total_checks,
       0.9::DOUBLE AS confidence
FROM oracle_log k
WHERE k.ts >= {ts(hours=24)} AND k.ts < {ts(minutes=15)}
  AND NOT EXISTS (SELECT 1 FROM oracle_log a WHERE a.ts >= {ts(minutes=15)} AND a.ts < {ts()}
                  AND a.tenant_id = k.tenant_id AND a.edge_node_id = k.edge_node_id)
""", "oracle_log"))(_d05b)


# ---------------------------------------------------------------- D-06
def _d06(spark, sf):
    return tidy(R.supply_chain(TB.model_registry(spark, sf), TB.cicd_audit(spark, sf), NOW)
                .select("rule_id", "tenant_id", "finding", "entity_id", "alert_title", "subject", "detail",
                        "confidence"))


register("d06_supply_chain", with_roles(f"""
SELECT 'ATLAS-DETECT-006' AS rule_id, tenant_id, 'promotion' AS finding, user_id AS entity_id,
       'Unapproved model promotion: ' || model_name || ' v' || model_version AS alert_title,
       model_name AS subject, model_version AS detail, 0.85::DOUBLE AS confidence
FROM model_registry WHERE ts >= {ts(hours=24)} AND ts < {ts()} AND action = 'stage_transition'
  AND stage = 'Production' AND (approved_by IS NULL OR approved_by = '')
UNION ALL
SELECT 'ATLAS-DETECT-006', tenant_id, 'dependency', COALESCE(deployer, ''),
       'Dependency change without tests: pipeline ' || pipeline_id, pipeline_id, commit_hash, 0.8::DOUBLE
FROM cicd_audit WHERE ts >= {ts(hours=24)} AND ts < {ts()} AND dependency_changes IS NOT NULL
  AND dependency_changes <> '' AND tests_passed = 0
""", "model_registry", "cicd_audit"))(_d06)


# ---------------------------------------------------------------- D-07
def _d07(spark, sf):
    return tidy(R.insider_exfiltration(TB.api_log(spark, sf), NOW)
                .select("rule_id", "tenant_id", "caller_identity", "count", "distinct_endpoints", "after_hours",
                        "deviation_factor", "confidence"))


register("d07_insider_exfiltration", with_roles(f"""
, cur AS (
  SELECT tenant_id, caller_identity, COUNT(*) AS cnt, COUNT(DISTINCT endpoint) AS distinct_endpoints,
         SUM(CASE WHEN EXTRACT(HOUR FROM ts) < 6 OR EXTRACT(HOUR FROM ts) > 22 THEN 1 ELSE 0 END) AS after_hours
  FROM api_log WHERE ts >= {ts(hours=24)} AND ts < {ts()} GROUP BY tenant_id, caller_identity)
, base AS (
  SELECT tenant_id, caller_identity, COUNT(*) / 30.0 AS avg_daily
  FROM api_log WHERE ts >= {ts(days=30)} AND ts < {ts(hours=24)} GROUP BY tenant_id, caller_identity)
, j AS (
  SELECT c.*, CASE WHEN COALESCE(b.avg_daily, 0) > 0 THEN c.cnt / b.avg_daily ELSE c.cnt END AS deviation
  FROM cur c LEFT JOIN base b ON c.tenant_id = b.tenant_id AND c.caller_identity = b.caller_identity)
SELECT 'ATLAS-DETECT-007' AS rule_id, tenant_id, caller_identity, CAST(cnt AS BIGINT) AS count,
       CAST(distinct_endpoints AS BIGINT) AS distinct_endpoints, CAST(after_hours AS BIGINT) AS after_hours,
       ROUND(CAST(deviation AS DOUBLE), 6) AS deviation_factor,
       ROUND(LEAST(0.95, 0.5 + deviation / 20.0), 6) AS confidence
FROM j WHERE deviation > 5.0 OR distinct_endpoints > 3 OR after_hours > 5
""", "api_log"))(_d07)


# ---------------------------------------------------------------- D-08
def _d08_with(threshold):
    def build(spark, sf):
        return tidy(R.alert_flood(TB.investigations(spark, sf), INV_NOW, spike_ratio_threshold=threshold)
                    .select("rule_id", "current_count", "baseline_avg", "spike_ratio", "confidence"))
    return build


def _d08_sql(threshold):
    return with_roles(f"""
, c AS (SELECT COUNT(*) AS n FROM investigations WHERE created_at >= {ts(INV_NOW, hours=6)} AND created_at < {ts(INV_NOW)})
, b AS (SELECT COUNT(*) / (7 * 24.0 / 6.0) AS avg6 FROM investigations
        WHERE created_at >= {ts(INV_NOW, days=7)} AND created_at < {ts(INV_NOW, hours=6)})
, r AS (SELECT c.n, b.avg6, CASE WHEN b.avg6 > 0 THEN c.n / b.avg6 ELSE c.n END AS ratio FROM c, b)
SELECT 'ATLAS-DETECT-008' AS rule_id, CAST(n AS BIGINT) AS current_count, ROUND(avg6, 6) AS baseline_avg,
       ROUND(CAST(ratio AS DOUBLE), 6) AS spike_ratio, ROUND(LEAST(0.9, 0.5 + ratio / 20.0), 6) AS confidence
FROM r WHERE ratio > {threshold}
""", "investigations")


register("d08_alert_flood", _d08_sql(5.0))(_d08_with(5.0))
# A-03 on its own: the same flood statistic with a firing threshold of 0 (always one row).
register("a03_slot_baseline_ratio", _d08_sql(0.0))(_d08_with(0.0))


# ---------------------------------------------------------------- D-09
def _d09(spark, sf):
    return tidy(R.sensor_spoofing(TB.sensor_log(spark, sf), NOW)
                .select("rule_id", "tenant_id", "edge_node_id",
                        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "protocol_violations",
                        "z_score", "sensor_delta", "confidence", "telemetry_trust_level"))


register("d09_sensor_spoofing", with_roles(f"""
, cur AS (SELECT * FROM sensor_log WHERE ts >= {ts(minutes=15)} AND ts < {ts()})
, base AS (
  SELECT tenant_id, edge_node_id, AVG(data_points_received) AS avg_points, STDDEV_SAMP(data_points_received) AS sd,
         AVG(sensor_count) AS avg_sensors
  FROM sensor_log WHERE ts >= {ts(hours=24)} AND ts < {ts(minutes=15)} GROUP BY tenant_id, edge_node_id)
, j AS (
  SELECT c.tenant_id, c.edge_node_id, c.ts, COALESCE(c.protocol_violations, 0) AS v,
         CASE WHEN b.sd > 0 THEN ABS((c.data_points_received - b.avg_points) / b.sd) ELSE 0.0 END AS z,
         CASE WHEN b.sd > 0 THEN ABS(c.sensor_count - COALESCE(b.avg_sensors, 0)) ELSE 0.0 END AS d
  FROM cur c LEFT JOIN base b ON c.tenant_id = b.tenant_id AND c.edge_node_id = b.edge_node_id)
SELECT 'ATLAS-DETECT-009' AS rule_id, tenant_id, edge_node_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,
       CAST(v AS BIGINT) AS protocol_violations, ROUND(z, 6) AS z_score, ROUND(CAST(d AS DOUBLE), 6) AS sensor_delta,
       0.7::DOUBLE AS confidence, 'untrusted' AS telemetry_trust_level
FROM j WHERE z > 3.0 OR v > 0 OR d > 5
""", "sensor_log"))(_d09)


# ---------------------------------------------------------------- D-10
def _d10(spark, sf):
    return tidy(R.partner_compromise(TB.partner_log(spark, sf), NOW)
                .select("rule_id", "tenant_id", "partner_id", "partner_name", "call_count", "mtls_failures",
                        "volume_deviation", "payload_z_score", "confidence"))


register("d10_partner_compromise", with_roles(f"""
, cur AS (
  SELECT tenant_id, partner_id, partner_name, COUNT(*) AS call_count, AVG(payload_size) AS avg_payload,
         SUM(CASE WHEN mtls_verified = false THEN 1 ELSE 0 END) AS mtls_failures
  FROM partner_log WHERE ts >= {ts(hours=6)} AND ts < {ts()} GROUP BY tenant_id, partner_id, partner_name)
, base AS (
  SELECT tenant_id, partner_id, COUNT(*) / (7 * 24.0 / 6.0) AS avg_6h_calls, AVG(payload_size) AS avg_payload,
         STDDEV_SAMP(payload_size) AS sd
  FROM partner_log WHERE ts >= {ts(days=7)} AND ts < {ts(hours=6)} GROUP BY tenant_id, partner_id)
, j AS (
  SELECT c.tenant_id, c.partner_id, c.partner_name, c.call_count, c.mtls_failures,
         CASE WHEN b.partner_id IS NULL THEN 0.0
              WHEN COALESCE(b.avg_6h_calls, 0) > 0 THEN c.call_count / b.avg_6h_calls ELSE c.call_count END AS vol,
         CASE WHEN b.partner_id IS NOT NULL AND COALESCE(b.sd, 0) > 0
              THEN ABS((c.avg_payload - b.avg_payload) / b.sd) ELSE 0.0 END AS pz
  FROM cur c LEFT JOIN base b ON c.tenant_id = b.tenant_id AND c.partner_id = b.partner_id)
SELECT 'ATLAS-DETECT-010' AS rule_id, tenant_id, partner_id, partner_name, CAST(call_count AS BIGINT) AS call_count,
       CAST(mtls_failures AS BIGINT) AS mtls_failures, ROUND(CAST(vol AS DOUBLE), 6) AS volume_deviation,
       ROUND(pz, 6) AS payload_z_score, ROUND(LEAST(0.9, 0.6 + vol / 10.0), 6) AS confidence
FROM j WHERE vol > 3.0 OR pz > 3.0 OR mtls_failures > 0
""", "partner_log"))(_d10)


# ---------------------------------------------------------------- D-11
def _d11(spark, sf):
    return tidy(R.edge_compromise(TB.edge_telemetry(spark, sf), NOW)
                .select("rule_id", "tenant_id", "edge_node_id",
                        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "attestation_finding",
                        "disk_failed", "cpu_high", "memory_high", "confidence", "attestation_status"))


register("d11_edge_compromise", with_roles(f"""
SELECT 'ATLAS-DETECT-011' AS rule_id, tenant_id, edge_node_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,
       CASE WHEN boot_attestation = 'fail' THEN 'fail'
            WHEN boot_attestation IS NULL OR boot_attestation = '' THEN 'unavailable' END AS attestation_finding,
       COALESCE(disk_integrity = 'fail', false) AS disk_failed,
       COALESCE(cpu_utilisation > 0.95, false) AS cpu_high, COALESCE(memory_utilisation > 0.95, false) AS memory_high,
       0.595::DOUBLE AS confidence,
       CASE WHEN boot_attestation IS NULL OR boot_attestation = '' THEN 'unavailable' ELSE boot_attestation END
         AS attestation_status
FROM edge_telemetry
WHERE ts >= {ts(minutes=15)} AND ts < {ts()}
  AND (boot_attestation = 'fail' OR boot_attestation IS NULL OR boot_attestation = ''
       OR disk_integrity = 'fail' OR cpu_utilisation > 0.95 OR memory_utilisation > 0.95)
""", "edge_telemetry"))(_d11)


# ---------------------------------------------------------------- D-12 / U-01 / P-39
def evaluations(spark, sf):
    return {
        "D-01": lambda: R.training_data_poisoning(TB.audit_log(spark, sf), NOW, actions=EVENT_ACTIONS),
        "D-02": lambda: R.model_extraction(TB.query_log(spark, sf), NOW),
        "D-03": lambda: R.prompt_injection(TB.query_log(spark, sf), NOW),
        "D-04": lambda: R.adversarial_evasion(TB.inference_log(spark, sf), NOW),
        "D-05": lambda: R.oracle_dos(TB.oracle_log(spark, sf), NOW),
        "D-06": lambda: R.supply_chain(TB.model_registry(spark, sf), TB.cicd_audit(spark, sf), NOW),
        "D-07": lambda: R.insider_exfiltration(TB.api_log(spark, sf), NOW),
        "D-08": lambda: R.alert_flood(TB.investigations(spark, sf), INV_NOW),
        "D-09": lambda: R.sensor_spoofing(TB.sensor_log(spark, sf), NOW),
        "D-10": lambda: R.partner_compromise(TB.partner_log(spark, sf), NOW),
        "D-11": lambda: R.edge_compromise(TB.edge_telemetry(spark, sf), NOW),
    }


def all_detections(spark, sf):
    return R.run_all(evaluations(spark, sf), NOW)


def _d12(spark, sf):
    d = all_detections(spark, sf)
    return tidy(d.groupBy("rule_id").agg(F.count(F.lit(1)).alias("detections"),
                                         F.count_distinct("entity_id").alias("entities"),
                                         F.sum("confidence").alias("confidence_sum")), places=4)


#: The entity column of each rule's oracle.
DETECTION_ENTITY = {"d01_training_data_poisoning": "user_id", "d02_model_extraction": "user_id",
                    "d03_prompt_injection": "user_id", "d04_adversarial_evasion": "edge_node_id",
                    "d05_oracle_dos": "edge_node_id", "d06_supply_chain": "entity_id",
                    "d07_insider_exfiltration": "caller_identity", "d08_alert_flood": "''",
                    "d09_sensor_spoofing": "edge_node_id", "d10_partner_compromise": "partner_id",
                    "d11_edge_compromise": "edge_node_id"}


def _d12_sql() -> str:
    from tidewatch.plans.registry import ORACLES
    ent = DETECTION_ENTITY
    parts = [f"SELECT rule_id, CAST({e} AS VARCHAR) AS entity_id, confidence FROM ({ORACLES[q]})"
             for q, e in ent.items()]
    return ("SELECT rule_id, CAST(COUNT(*) AS BIGINT) AS detections, CAST(COUNT(DISTINCT entity_id) AS BIGINT) AS entities, "
            "ROUND(SUM(confidence), 4) AS confidence_sum FROM (" + " UNION ALL ".join(parts) + ") GROUP BY rule_id")


register("d12_run_all_rules", _d12_sql(), headline=True)(_d12)


def _d12_status(spark, sf):
    rules = evaluations(spark, sf)
    broken = TB.audit_log(spark, sf).drop("target_resource")
    return R.rule_status(spark, rules | {"D-01": lambda: R.training_data_poisoning(broken, NOW)}, NOW)


register("d12_rule_status", "SELECT r AS rule_id, r <> '" + R.RULES["D-01"].rule_id + "' AS ok, "
         "CASE WHEN r = '" + R.RULES["D-01"].rule_id + "' THEN 'UNRESOLVED_COLUMN.WITH_SUGGESTION' END AS error, "
         "CASE WHEN r <> '" + R.RULES["D-01"].rule_id + "' THEN COALESCE(detections, 0) END AS detections FROM (VALUES "
         + ", ".join(f"('{R.RULES[k].rule_id}')" for k in ("D-01", "D-02", "D-03", "D-04", "D-05", "D-06", "D-07", "D-08", "D-09", "D-10", "D-11"))
         + f") t(r) LEFT JOIN ({_d12_sql()}) d ON d.rule_id = r")(_d12_status)


def _d12_audit(spark, sf):
    a = R.detection_audit(all_detections(spark, sf))
    return a.groupBy("rule_id", "event_type", "severity").agg(F.count(F.lit(1)).alias("events"))


register("d12_detection_audit", "SELECT rule_id, 'atlas.detection_fired' AS event_type, CASE rule_id "
         + " ".join(f"WHEN '{m.rule_id}' THEN '{m.severity.lower()}'" for m in R.RULES.values())
         + f" END AS severity, detections AS events FROM ({_d12_sql()})")(_d12_audit)


def _p39(spark, sf):
    a = R.detections_to_alerts(all_detections(spark, sf))
    return a.select("source", "title", "severity", F.size("techniques").cast("bigint").alias("n_techniques"))


register("p39_detection_alerts", None)(_p39)


# ---------------------------------------------------------------- ST-03 rules on a schedule
LAST_TICK = 474072  # the hour that begins at EVENTS_NOW


def _st03(spark, sf):
    """D-01 at every full hour of the last two days, as the stream over the live baseline raises it."""
    h = LR.history(TB.audit_log(spark, sf), "ts", LR.poisoning_rule(EVENT_ACTIONS), LAST_TICK - 47, LAST_TICK)
    return tidy(h.select("tick", "tenant_id", "user_id", "count", "distinct_tables", "baseline_avg", "deviation_factor", "confidence"))


register("st03_hourly_poisoning", with_roles(f"""
, e AS (SELECT tenant_id, user_id, target_resource, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM audit_log WHERE action IN ('purchase', 'error'))
, ticks AS (SELECT unnest(generate_series({LAST_TICK} - 47, {LAST_TICK})) AS tick)
, cur AS (SELECT tick, tenant_id, user_id, COUNT(*) AS cnt, COUNT(DISTINCT target_resource) AS tables
          FROM ticks JOIN e ON hour >= tick - 24 AND hour < tick GROUP BY ALL)
, base AS (SELECT tick, tenant_id, user_id, COUNT(*) / 30.0 AS daily FROM ticks JOIN e ON hour >= tick - 720 AND hour < tick - 24 GROUP BY ALL)
, j AS (SELECT c.tick, c.tenant_id, c.user_id, cnt, tables, COALESCE(daily, 0) AS daily,
               CASE WHEN COALESCE(daily, 0) > 0 THEN cnt / daily ELSE cnt END AS deviation
        FROM cur c LEFT JOIN base b ON b.tick = c.tick AND b.tenant_id = c.tenant_id AND b.user_id = c.user_id)
SELECT CAST(tick AS BIGINT) AS tick, tenant_id, user_id, CAST(cnt AS BIGINT) AS count, CAST(tables AS BIGINT) AS distinct_tables,
       ROUND(CAST(daily AS DOUBLE), 6) AS baseline_avg, ROUND(CAST(deviation AS DOUBLE), 6) AS deviation_factor,
       ROUND(LEAST(0.95, 0.5 + deviation / 20.0), 6) AS confidence
FROM j WHERE deviation > 3.0 OR tables > 5 OR cnt > 50
""", "audit_log"))(_st03)
