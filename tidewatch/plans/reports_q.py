"""Registered report queries (A-05 .. A-39 subset, P-12, P-19, K-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import reports as RP
from tidewatch.operators.quantiles import add_percentiles
from tidewatch.plans.oracle_roles import with_roles
from tidewatch.plans.registry import register, tidy
from tidewatch.plans.rules_q import ts
from tidewatch.sources import tables as TB

INV = TB.INVESTIGATIONS_NOW
CALLS = TB.CALLS_NOW


def _inv(spark, sf):
    return TB.investigations(spark, sf)


register("a09_investigations_by_state", with_roles("""
SELECT state, CAST(COUNT(*) AS BIGINT) AS count FROM investigations GROUP BY state
""", "investigations"))(lambda s, sf: RP.by_state(_inv(s, sf)))

register("a09_open_summary", with_roles("""
SELECT CAST(COUNT(*) FILTER (WHERE state NOT IN ('closed', 'failed')) AS BIGINT) AS total_open,
       CAST(COUNT(*) FILTER (WHERE state = 'awaiting_human') AS BIGINT) AS awaiting_human,
       CAST(COUNT(*) AS BIGINT) AS total
FROM investigations
""", "investigations"))(lambda s, sf: RP.open_summary(_inv(s, sf)))

register("a10_severity_last_24h", with_roles(f"""
SELECT graph_state->>'severity' AS severity, CAST(COUNT(*) AS BIGINT) AS count
FROM investigations WHERE updated_at >= {ts(INV, hours=24)} AND updated_at < {ts(INV)}
GROUP BY graph_state->>'severity'
""", "investigations"))(lambda s, sf: RP.severity_recent(_inv(s, sf), INV))

register("a10_severity_open", with_roles("""
SELECT graph_state->>'severity' AS severity, CAST(COUNT(*) AS BIGINT) AS count
FROM investigations WHERE state NOT IN ('closed', 'failed')
GROUP BY graph_state->>'severity' HAVING graph_state->>'severity' IS NOT NULL AND graph_state->>'severity' <> ''
""", "investigations"))(lambda s, sf: RP.severity_open(_inv(s, sf)))

register("a11_mean_time_to_close", with_roles(f"""
, m AS (SELECT AVG(EXTRACT(EPOCH FROM (updated_at - created_at))) AS s FROM investigations
        WHERE state = 'closed' AND updated_at >= {ts(INV, days=7)} AND updated_at < {ts(INV)})
SELECT ROUND(s, 6) AS avg_seconds, ROUND(s / 3600, 6) AS avg_hours, ROUND(s / 60, 6) AS avg_minutes FROM m
""", "investigations"))(lambda s, sf: tidy(RP.mean_time_to_close(_inv(s, sf), INV)))

register("a12_fp_rate", with_roles("""
, c AS (SELECT COUNT(*) FILTER (WHERE graph_state->>'classification' = 'false_positive') AS fp, COUNT(*) AS n
        FROM investigations WHERE state = 'closed')
SELECT CAST(fp AS BIGINT) AS fp_count, CAST(n AS BIGINT) AS total,
       ROUND(CASE WHEN n > 0 THEN fp * 100.0 / n END, 6) AS fp_rate_pct FROM c
""", "investigations"))(lambda s, sf: tidy(RP.fp_rate(_inv(s, sf))))

register("a14_period_totals", with_roles(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS investigations, ROUND(COALESCE(SUM(total_cost_usd), 0), 6) AS total_cost_usd
FROM investigations WHERE created_at >= {ts(INV, days=30)} AND created_at < {ts(INV)}
""", "investigations"))(lambda s, sf: tidy(RP.period_totals(_inv(s, sf), INV)))

register("a09_a14_overview_kpis", with_roles(f"""
SELECT
  (SELECT CAST(COUNT(*) AS BIGINT) FROM investigations WHERE state NOT IN ('closed', 'failed')) AS total_open,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM investigations WHERE state = 'awaiting_human') AS awaiting_human,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM investigations WHERE updated_at >= {ts(INV, hours=24)}
      AND updated_at < {ts(INV)} AND graph_state->>'severity' = 'critical') AS critical_24h,
  (SELECT ROUND(AVG(EXTRACT(EPOCH FROM (updated_at - created_at))), 6) FROM investigations
      WHERE state = 'closed' AND updated_at >= {ts(INV, days=7)} AND updated_at < {ts(INV)}) AS mttc_seconds,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM investigations WHERE state = 'closed'
      AND graph_state->>'classification' = 'false_positive') AS fp_count,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM investigations WHERE state = 'closed') AS closed_total,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM investigations WHERE created_at >= {ts(INV, days=30)}
      AND created_at < {ts(INV)}) AS investigations_30d,
  (SELECT ROUND(COALESCE(SUM(total_cost_usd), 0), 6) FROM investigations WHERE created_at >= {ts(INV, days=30)}
      AND created_at < {ts(INV)}) AS cost_30d
""", "investigations"), headline=True)(lambda s, sf: tidy(RP.investigation_kpis(_inv(s, sf), INV)))


def _calls(spark, sf):
    return TB.call_log(spark, sf)


register("a05_model_latency", with_roles(f"""
SELECT model_id, CAST(COUNT(*) AS BIGINT) AS total_calls,
       CAST(SUM(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS success_calls,
       ROUND(AVG(latency_ms), 6) AS avg_latency, ROUND(quantile_cont(latency_ms, 0.5), 6) AS p50_latency,
       ROUND(quantile_cont(latency_ms, 0.95), 6) AS p95_latency
FROM call_log WHERE created_at > {ts(CALLS, hours=1)} AND created_at < {ts(CALLS)} GROUP BY model_id
""", "call_log"))(lambda s, sf: tidy(RP.model_latency(_calls(s, sf), CALLS)))

register("a15_spend_summary", with_roles(f"""
, s AS (SELECT
   COALESCE(SUM(CASE WHEN created_at > {ts(CALLS, days=1)} AND created_at < {ts(CALLS)} THEN cost_usd END), 0) AS today,
   COALESCE(SUM(CASE WHEN created_at > {ts(CALLS, days=7)} AND created_at < {ts(CALLS)} THEN cost_usd END), 0) AS week,
   COALESCE(SUM(CASE WHEN created_at > DATE_TRUNC('month', {ts(CALLS)}) AND created_at < {ts(CALLS)}
                THEN cost_usd END), 0) AS month
   FROM call_log)
SELECT ROUND(today, 6) AS today_usd, ROUND(week, 6) AS week_usd, ROUND(month, 6) AS month_usd,
       ROUND(1000.0 - month, 6) AS budget_remaining_usd, ROUND(month / 1000.0 * 100, 6) AS budget_pct,
       ROUND(month * 1.3, 6) AS projected_month_usd FROM s
""", "call_log"))(lambda s, sf: tidy(RP.spend_summary(_calls(s, sf), CALLS)))

register("a16_spend_by_model", with_roles("""
SELECT model_id, CAST(COUNT(*) AS BIGINT) AS calls, ROUND(COALESCE(SUM(cost_usd), 0), 6) AS spend
FROM call_log GROUP BY model_id ORDER BY spend DESC
""", "call_log"))(lambda s, sf: tidy(RP.spend_by_model(_calls(s, sf))))

register("a17_spend_guard", with_roles(f"""
, g AS (
  SELECT model_id, task_type, tenant_id, GROUPING(model_id, task_type, tenant_id) AS gid,
         SUM(cost_usd) AS spend, COUNT(*) AS calls,
         COALESCE(SUM(CASE WHEN created_at >= DATE_TRUNC('month', {ts(CALLS)})
                            AND created_at < DATE_TRUNC('month', {ts(CALLS)}) + INTERVAL 1 MONTH
                           THEN cost_usd END), 0) AS month_spend
  FROM call_log GROUP BY GROUPING SETS ((model_id), (task_type), (tenant_id), ()))
SELECT CASE gid WHEN 3 THEN 'model' WHEN 5 THEN 'task_type' WHEN 6 THEN 'tenant' ELSE 'total' END AS dimension,
       CASE WHEN gid = 7 THEN '' ELSE COALESCE(model_id, task_type, tenant_id, '') END AS key,
       ROUND(spend, 6) AS spend, CAST(calls AS BIGINT) AS calls, ROUND(month_spend, 6) AS month_spend,
       month_spend >= 500.0 AS soft_alert, month_spend >= 1000.0 AS hard_cap_hit
FROM g
""", "call_log"), headline=True)(lambda s, sf: tidy(RP.spend_guard(_calls(s, sf), CALLS)))

register("a18_routing_outcomes", with_roles("""
SELECT task_type, model_tier, CAST(COUNT(*) AS BIGINT) AS total,
       ROUND(SUM(CASE WHEN status = 'success' THEN 1 ELSE 0 END)::DOUBLE / COUNT(*), 6) AS success_rate,
       ROUND(AVG(cost_usd), 6) AS avg_cost, ROUND(AVG(latency_ms), 6) AS avg_latency_ms,
       ROUND(AVG(confidence), 6) AS avg_confidence, task_type || ':' || model_tier AS route
FROM call_log GROUP BY task_type, model_tier
""", "call_log"))(lambda s, sf: tidy(RP.routing_outcomes(_calls(s, sf))))


def _a23(spark, sf):
    return RP.table_row_counts({t: TB.read(spark, sf, t) for t in TB.TABLES})


register("a23_table_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(COUNT(*) AS BIGINT) AS rows FROM {t}" for t in TB.TABLES))(_a23)

BUCKETS = (185.0, 555.0, 925.0, 1480.0)


def _a38(spark, sf):
    return tidy(RP.histogram(_calls(spark, sf), "latency_ms", BUCKETS, ["model_id"]))


register("a38_latency_histogram", with_roles("""
, g AS (SELECT model_id, """ + ", ".join(
    f"COUNT(*) FILTER (WHERE latency_ms <= {b}) AS le_{i}" for i, b in enumerate(BUCKETS)) + """,
        COUNT(*) AS n, SUM(latency_ms) AS s FROM call_log GROUP BY model_id)
""" + " UNION ALL ".join(
    f"SELECT model_id, '{b}' AS le, CAST(le_{i} AS BIGINT) AS bucket_count, CAST(n AS BIGINT) AS count, "
    f"ROUND(s, 6) AS sum FROM g" for i, b in enumerate(BUCKETS)) + """
UNION ALL SELECT model_id, '+Inf', CAST(n AS BIGINT), CAST(n AS BIGINT), ROUND(s, 6) FROM g
""", "call_log"))(_a38)

THRESHOLDS = {"p95_latency_ms": 1700.0, "error_rate": 0.25}


def _a39(spark, sf):
    c = _calls(spark, sf)
    m = c.groupBy("model_id").agg((F.count_if(F.col("status") == "error") / F.count(F.lit(1))).alias("err"))
    m = add_percentiles(m, c, ["model_id"], "latency_ms", {"p95": 0.95})
    metrics = m.selectExpr("model_id", "stack(2, 'p95_latency_ms', p95, 'error_rate', err) AS (name, value)")
    return tidy(RP.operational_alerts(metrics, THRESHOLDS))


register("a39_operational_alerts", with_roles("""
, m AS (SELECT model_id, quantile_cont(latency_ms, 0.95) AS p95,
               SUM(CASE WHEN status = 'error' THEN 1 ELSE 0 END)::DOUBLE / COUNT(*) AS err
        FROM call_log GROUP BY model_id)
, u AS (SELECT model_id, 'p95_latency_ms' AS name, p95 AS value, 1700.0 AS threshold FROM m
        UNION ALL SELECT model_id, 'error_rate', err, 0.25 FROM m)
SELECT model_id, name, ROUND(value, 6) AS value, ROUND(threshold::DOUBLE, 6) AS threshold FROM u WHERE value > threshold
""", "call_log"))(_a39)


def _p12(spark, sf):
    return tidy(RP.list_investigations(_inv(spark, sf), severity="critical", tenant_id="t1", limit=20, offset=5)
                .select("investigation_id", "state", "tenant_id", "total_cost_usd"))


register("p12_list_investigations", with_roles("""
SELECT investigation_id, state, tenant_id, ROUND(total_cost_usd, 6) AS total_cost_usd FROM investigations
WHERE graph_state->>'severity' = 'critical' AND tenant_id = 't1'
ORDER BY created_at DESC, investigation_id DESC LIMIT 20 OFFSET 5
""", "investigations"))(_p12)


def _p19(spark, sf):
    return RP.approval_queue(_inv(spark, sf)).select("investigation_id", "severity_rank")


register("p19_approval_queue", with_roles("""
SELECT investigation_id, CASE lower(graph_state->>'severity') WHEN 'critical' THEN 1 WHEN 'high' THEN 2
       WHEN 'medium' THEN 3 WHEN 'low' THEN 4 WHEN 'informational' THEN 5 ELSE 6 END AS severity_rank
FROM investigations WHERE state = 'awaiting_human'
""", "investigations"))(_p19)


def _k02(spark, sf):
    return tidy(RP.top_k(_calls(spark, sf), 25, [F.desc("cost_usd"), "investigation_id", "task_type"])
                .select("investigation_id", "task_type", "cost_usd"))


register("k02_top_cost_calls", with_roles("""
SELECT investigation_id, task_type, ROUND(cost_usd, 6) AS cost_usd FROM call_log
ORDER BY cost_usd DESC, investigation_id, task_type LIMIT 25
""", "call_log"))(_k02)


def _k03(spark, sf):
    return tidy(RP.top_k_per_key(_inv(spark, sf), ["tenant_id"], 3,
                                 [F.desc("total_cost_usd"), "investigation_id"])
                .select("tenant_id", "investigation_id", "total_cost_usd", "rank"))


register("k03_top3_cost_per_tenant", with_roles("""
SELECT tenant_id, investigation_id, ROUND(total_cost_usd, 6) AS total_cost_usd, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant_id ORDER BY total_cost_usd DESC, investigation_id) AS rank
  FROM investigations) WHERE rank <= 3
""", "investigations"))(_k03)


def _k05(spark, sf):
    return (RP.top_k_per_key(_inv(spark, sf), ["state"], 5, [F.desc("updated_at"), "investigation_id"])
            .select("state", "investigation_id", F.col("rank").cast("bigint").alias("rank")))


register("k05_recent_per_state", with_roles("""
SELECT state, investigation_id, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY state ORDER BY updated_at DESC, investigation_id) AS rank
  FROM investigations) WHERE rank <= 5
""", "investigations"))(_k05)
