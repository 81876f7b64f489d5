"""Registered gate queries (P-26, P-27, P-28, P-40, U-05, U-07) on the role views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import gates as GT
from tidewatch.plans.oracle_roles import with_roles
from tidewatch.plans.registry import register, tidy
from tidewatch.plans.rules_q import ts
from tidewatch.sources import tables as TB

INV = TB.INVESTIGATIONS_NOW
OVERRIDES = [("t1", "critical", 2), ("t2", "low", 0)]


def _p28(spark, sf):
    inv = TB.investigations(spark, sf).where(F.col("state") == "awaiting_human")
    ov = spark.createDataFrame(OVERRIDES, "tenant_id string, severity string, timeout_hours int")
    g = GT.approval_gates(inv, INV, ov)
    return g.select("investigation_id", F.col("timeout_hours").cast("bigint").alias("timeout_hours"), "gate_status")


register("p28_approval_gates", with_roles(f"""
, o AS (SELECT * FROM (VALUES ('t1', 'critical', 2), ('t2', 'low', 0)) t(tenant_id, severity, h))
, g AS (SELECT i.investigation_id, i.severity, i.updated_at,
               GREATEST(1, COALESCE(o.h, CASE i.severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 4
                                                      WHEN 'low' THEN 8 ELSE 4 END)) AS hrs
        FROM investigations i LEFT JOIN o ON i.tenant_id = o.tenant_id AND i.severity = o.severity
        WHERE i.state = 'awaiting_human')
SELECT investigation_id, CAST(hrs AS BIGINT) AS timeout_hours,
       CASE WHEN {ts(INV)} >= updated_at + to_hours(CAST(hrs AS BIGINT))
            THEN CASE WHEN severity IN ('critical', 'high') THEN 'escalate' ELSE 'close' END
            WHEN {ts(INV)} >= updated_at + to_minutes(CAST(hrs * 30 AS BIGINT)) THEN 'notify' ELSE 'waiting' END AS gate_status
FROM g
""", "investigations"))(_p28)


def _actions(key_col="investigation_id"):
    k = F.col(key_col).cast("bigint")
    return F.array(F.struct(F.lit("isolate_host").alias("action"), (k % 4).cast("int").alias("tier")),
                   F.struct(F.lit("notify").alias("action"), F.lit(0).alias("tier")))


def _p27(spark, sf):
    inv = TB.investigations(spark, sf).where(F.col("state") != "closed")
    d = inv.select("severity", GT.needs_human_approval(_actions(), F.col("confidence"), F.col("severity")).alias("needs"),
                   GT.auto_close_allowed(F.col("confidence"), F.col("classification") == "").alias("auto_close"))
    return d.groupBy("severity").agg(F.count_if("needs").alias("needs_approval"),
                                     F.count_if("auto_close").alias("auto_close_allowed"), F.count(F.lit(1)).alias("open"))


register("p27_human_approval", with_roles("""
SELECT severity,
       CAST(COUNT(*) FILTER (WHERE CAST(investigation_id AS BIGINT) % 4 >= 2
                             OR (confidence < 0.6 AND severity IN ('critical', 'high'))) AS BIGINT) AS needs_approval,
       CAST(COUNT(*) FILTER (WHERE classification = '' AND confidence >= 0.85) AS BIGINT) AS auto_close_allowed,
       CAST(COUNT(*) AS BIGINT) AS open
FROM investigations WHERE state <> 'closed' GROUP BY severity
""", "investigations"))(_p27)

PRICING = {"model-0": GT.PRICE_STANDARD, "model-1": GT.PRICE_SMALL}


def _p40(spark, sf):
    c = TB.call_log(spark, sf)
    cost = GT.call_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("model_id"), PRICING)
    return tidy(c.groupBy("model_id").agg(F.sum(cost).alias("cost_usd"), F.max(cost).alias("max_call_cost")))


register("p40_llm_call_cost", with_roles(f"""
, c AS (SELECT model_id, ROUND(input_tokens * CASE model_id WHEN 'model-0' THEN {GT.PRICE_STANDARD[0]!r} WHEN 'model-1' THEN {GT.PRICE_SMALL[0]!r} ELSE 0 END
                              + output_tokens * CASE model_id WHEN 'model-0' THEN {GT.PRICE_STANDARD[1]!r} WHEN 'model-1' THEN {GT.PRICE_SMALL[1]!r} ELSE 0 END, 6) AS cost
        FROM call_log)
SELECT model_id, ROUND(SUM(cost), 6) AS cost_usd, ROUND(MAX(cost), 6) AS max_call_cost FROM c GROUP BY model_id
""", "call_log"))(_p40)


def _u05(spark, sf):
    d = TB.decision_log(spark, sf)
    s = d.where(F.col("type") == "shadow").select("investigation_id")
    a = d.where(F.col("type") == "analyst").select("investigation_id")
    both = s.intersect(a)
    return both.agg(F.count(F.lit(1)).alias("with_both_decisions"))


register("u05_intersect_decisions", with_roles("""
SELECT CAST(COUNT(*) AS BIGINT) AS with_both_decisions FROM (
  SELECT investigation_id FROM decision_log WHERE type = 'shadow'
  INTERSECT SELECT investigation_id FROM decision_log WHERE type = 'analyst')
""", "decision_log"))(_u05)


def _u07(spark, sf):
    from tidewatch.sources import adapters as AD
    c = AD.union_sources(TB.vendor_alerts(spark, sf))
    return c.select(F.explode("tactics").alias("tactic")).distinct().orderBy("tactic")


register("u07_sorted_distinct_tactics", """
SELECT DISTINCT t AS tactic FROM (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN ['InitialAccess', 'Execution'] ELSE ['Persistence'] END
              WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_custkey % 3 = 0 THEN ['Credential Access'] ELSE ['Initial Access'] END
              ELSE CASE WHEN o_orderkey % 2 = 0 THEN ['initial-access', 'execution'] ELSE ['persistence', 'privilege-escalation'] END
         END AS ts FROM orders WHERE o_orderkey % 97 <> 0), unnest(ts) AS u(t)
""")(_u07)


TASKS7 = ["ioc_extraction", "investigation", "fp_pattern_training", "alert_classification", "incident_report",
          "unknown_task", "agent_red_team"]


def _tasks(spark, sf, *more):
    li = TB.read(spark, sf, "lineitem")
    task = F.element_at(F.array(*[F.lit(t) for t in TASKS7]), F.col("l_linenumber"))
    sev = F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "high").otherwise("medium")
    return li.select(task.alias("task_type"), (F.col("l_quantity") / 5.0).alias("time_budget_seconds"),
                     sev.alias("alert_severity"), (F.col("l_linestatus") == "O").alias("requires_reasoning"),
                     (F.col("l_extendedprice") * 2).alias("context_tokens"),
                     F.when(F.col("l_discount") > 0.05, F.col("l_tax") * 10).alias("previous_confidence"), *more)


def _p22(spark, sf):
    r = GT.route_tasks(_tasks(spark, sf))
    return r.groupBy("tier", "reason").agg(F.count(F.lit(1)).alias("tasks"))


register("p22_task_tier_routing", f"""
WITH t AS (
  SELECT list_extract({[t for t in TASKS7]!r}::VARCHAR[], l_linenumber) AS task_type, l_quantity / 5.0 AS budget,
         CASE WHEN l_returnflag = 'R' THEN 'critical' WHEN l_returnflag = 'A' THEN 'high' ELSE 'medium' END AS sev,
         l_linestatus = 'O' AS reasoning, l_extendedprice * 2 AS ctx,
         CASE WHEN l_discount > 0.05 THEN l_tax * 10 END AS prev FROM lineitem)
, b AS (SELECT *, CASE {" ".join(f"WHEN task_type = '{k}' THEN '{v}'" for k, v in GT.TASK_TIER.items())} ELSE 'tier_1' END AS base FROM t)
, c AS (SELECT *, budget < 3 AS fast, budget >= 3 AND sev = 'critical' AND reasoning AND base = 'tier_0' AS crit FROM b)
, d AS (SELECT *, CASE WHEN fast THEN 'tier_0' WHEN crit THEN 'tier_1' ELSE base END AS t1 FROM c)
, e AS (SELECT *, ctx > 100000 AND t1 = 'tier_0' AS ctxx, prev IS NOT NULL AND prev < 0.6 AND sev IN ('critical', 'high') AS low FROM d)
, f AS (SELECT CASE WHEN low THEN 'tier_1_plus' WHEN ctxx THEN 'tier_1' ELSE t1 END AS tier,
               concat_ws('; ', 'base=' || base, CASE WHEN fast THEN 'time_budget<3s→tier_0' END,
                         CASE WHEN crit THEN 'critical+reasoning→min_tier_1' END,
                         CASE WHEN ctxx THEN 'context>100k→tier_1' END,
                         CASE WHEN low THEN 'low_confidence_escalation→tier_1+' END) AS reason FROM e)
SELECT tier, reason, CAST(COUNT(*) AS BIGINT) AS tasks FROM f GROUP BY tier, reason
""")(_p22)


#: (tier, rank, provider, context, tool use, extended thinking): the batch tier has a fallback that no task of 200,000 tokens fits.
PROVIDERS = [("tier_0", 0, "primary", 200_000, True, False), ("tier_0", 1, "secondary", 128_000, True, False),
             ("tier_1", 0, "primary", 200_000, True, False), ("tier_1", 1, "local", 128_000, False, False), ("tier_1", 2, "secondary", 128_000, True, False),
             ("tier_1_plus", 0, "primary", 200_000, True, True), ("tier_1_plus", 1, "secondary", 128_000, True, False),
             ("tier_2", 0, "primary", 200_000, True, False), ("tier_2", 1, "secondary", 128_000, True, False)]


def _daily_health(spark, sf, failures: int):
    from tidewatch.operators import sequences as SQ
    c = TB.call_log(spark, sf).select(
        F.when(F.col("model_id").isin("model-0", "model-1"), "primary").otherwise("secondary").alias("provider"),
        "created_at", F.concat_ws("|", "investigation_id", "task_type").alias("tie"), (F.col("status") == "success").alias("ok"))
    runs = SQ.failure_runs(c, "provider", "created_at", "ok", "tie")
    last = runs.groupBy("provider", F.to_date("created_at").alias("bucket")).agg(F.max_by("failure_run", F.struct("created_at", "tie")).alias("run"))
    return last.select("bucket", "provider", (F.col("run") < failures).alias("available"))


def _p22_failover(spark, sf):
    """Providers by task and day, where a provider is down on a day that ends in a failed call."""
    tasks = _tasks(spark, sf, F.to_date("l_shipdate").alias("bucket"))
    r = GT.assign_providers(GT.route_tasks(tasks), spark.createDataFrame(PROVIDERS, GT.PROVIDER_SCHEMA), GT.task_capabilities(spark), _daily_health(spark, sf, 1), "bucket")
    return r.groupBy("tier", "task_type", "provider", "is_fallback", "unserved", "primary_capable", F.array_join("fallbacks", ",").alias("fallbacks"),
                     F.contains("reason", F.lit("primary_unavailable→fallback(")).alias("said")).agg(F.count(F.lit(1)).alias("tasks"))


register("p22_provider_failover", with_roles(f"""
, t AS (
  SELECT list_extract({[t for t in TASKS7]!r}::VARCHAR[], l_linenumber) AS task_type, l_quantity / 5.0 AS budget, CAST(l_shipdate AS DATE) AS bucket,
         CASE WHEN l_returnflag = 'R' THEN 'critical' WHEN l_returnflag = 'A' THEN 'high' ELSE 'medium' END AS sev,
         l_linestatus = 'O' AS reasoning, l_extendedprice * 2 AS ctx, CASE WHEN l_discount > 0.05 THEN l_tax * 10 END AS prev FROM lineitem)
, b AS (SELECT *, CASE {" ".join(f"WHEN task_type = '{k}' THEN '{v}'" for k, v in GT.TASK_TIER.items())} ELSE 'tier_1' END AS base FROM t)
, d AS (SELECT *, CASE WHEN budget < 3 THEN 'tier_0' WHEN sev = 'critical' AND reasoning AND base = 'tier_0' THEN 'tier_1' ELSE base END AS t1 FROM b)
, tiered AS (SELECT *, CASE WHEN prev IS NOT NULL AND prev < 0.6 AND sev IN ('critical', 'high') THEN 'tier_1_plus' WHEN ctx > 100000 AND t1 = 'tier_0' THEN 'tier_1' ELSE t1 END AS tier FROM d)
, e AS (SELECT CASE WHEN model_id IN ('model-0', 'model-1') THEN 'primary' ELSE 'secondary' END AS provider, created_at, investigation_id || '|' || task_type AS tie, status = 'success' AS ok FROM call_log)
, up AS (SELECT provider, CAST(created_at AS DATE) AS bucket, arg_max(ok, (created_at, tie)) AS ok FROM e GROUP BY 1, 2)
, caps AS (SELECT * FROM (VALUES {", ".join(f"('{t}', {tools}, {ctx})" for t, (tools, ctx) in GT.TASK_CAPABILITIES.items())}) v(task_type, tools, asks))
, s AS (SELECT tier, x.task_type, COALESCE(p.ok, true) AS p_up, COALESCE(q.ok, true) AS s_up, COALESCE(asks, 0) <= 128000 AS small, COALESCE(NOT tools, true) AS plain,
               asks IS NULL AS free
        FROM tiered x LEFT JOIN caps USING (task_type) LEFT JOIN up p ON p.provider = 'primary' AND p.bucket = x.bucket LEFT JOIN up q ON q.provider = 'secondary' AND q.bucket = x.bucket)
, f AS (SELECT *, tier = 'tier_1' AND small AND plain AS l_ok FROM s)
, c AS (SELECT *, CASE WHEN p_up THEN 'primary' WHEN l_ok THEN 'local' WHEN small AND s_up THEN 'secondary' ELSE 'primary' END AS provider FROM f)
SELECT tier, task_type, provider, provider <> 'primary' AS is_fallback, NOT p_up AND provider = 'primary' AS unserved, true AS primary_capable,
       concat_ws(',', CASE WHEN l_ok AND provider <> 'local' THEN 'local' END, CASE WHEN small AND provider <> 'secondary' THEN 'secondary' END) AS fallbacks,
       provider <> 'primary' AS said, CAST(COUNT(*) AS BIGINT) AS tasks
FROM c GROUP BY ALL
""", "call_log"))(_p22_failover)


def _p23(spark, sf):
    from tidewatch.operators import sequences as SQ
    c = TB.call_log(spark, sf).select(
        F.when(F.col("model_id").isin("model-0", "model-1"), "primary").otherwise("secondary").alias("provider"),
        "created_at", F.concat_ws("|", "investigation_id", "task_type").alias("tie"),
        (F.col("status") == "success").alias("ok"))
    runs = SQ.failure_runs(c, "provider", "created_at", "ok", "tie")
    last = runs.groupBy("provider", F.to_date("created_at").alias("bucket")).agg(
        F.max_by("failure_run", F.struct("created_at", "tie")).alias("run"))
    health = last.select("bucket", "provider", (F.col("run") < 5).alias("available"))
    d = GT.degradation_levels(health)
    return d.groupBy("degradation_level", "max_tier").agg(F.count(F.lit(1)).alias("days"))


register("p23_degradation_levels", with_roles("""
, e AS (SELECT CASE WHEN model_id IN ('model-0', 'model-1') THEN 'primary' ELSE 'secondary' END AS provider,
               created_at, investigation_id || '|' || task_type AS tie, status = 'success' AS ok FROM call_log)
, g AS (SELECT *, SUM(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY provider ORDER BY created_at, tie
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM e)
, r AS (SELECT *, SUM(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY provider, grp ORDER BY created_at, tie
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)
, l AS (SELECT provider, CAST(created_at AS DATE) AS bucket, arg_max(run, (created_at, tie)) AS run FROM r GROUP BY 1, 2)
, h AS (SELECT bucket, COALESCE(MIN(CASE WHEN provider = 'primary' THEN (run < 5)::INT END), 1) AS p,
               COALESCE(MIN(CASE WHEN provider = 'secondary' THEN (run < 5)::INT END), 1) AS s FROM l GROUP BY bucket)
, v AS (SELECT CASE WHEN p = 1 THEN 'full_capability' WHEN s = 1 THEN 'secondary_active' ELSE 'deterministic_only' END AS lvl FROM h)
SELECT lvl AS degradation_level, CASE lvl WHEN 'full_capability' THEN 'tier_1_plus' WHEN 'secondary_active' THEN 'tier_1'
       ELSE 'tier_0' END AS max_tier, CAST(COUNT(*) AS BIGINT) AS days FROM v GROUP BY lvl
""", "call_log"))(_p23)


# ---------------------------------------------------------------- P-29 / P-30 / P-41 / J-13
def _p29(spark, sf):
    from tidewatch.plans.rules_q import all_detections
    d = all_detections(spark, sf).groupBy("rule_id").agg(F.collect_set(F.struct("telemetry_trust_level", "attestation_status")).alias("d"))
    return d.select("rule_id", GT.trust_constraint(F.col("d")).alias("c")).select("rule_id", "c.requires_human_review")


def _p29_sql() -> str:
    from tidewatch.plans.registry import ORACLES
    return f"SELECT rule_id, rule_id IN ('ATLAS-DETECT-009', 'ATLAS-DETECT-011') AS requires_human_review FROM ({ORACLES['d12_run_all_rules']})"


register("p29_trust_constraint", _p29_sql())(_p29)


def _p30(spark, sf):
    from tidewatch.operators import audit as AU
    e = TB.read(spark, sf, "events").select(F.when(F.col("event_type") == "click", "alert.classified")
                                            .when(F.col("event_type") == "view", "response.executed")
                                            .when(F.col("event_type") == "error", "config.changed").otherwise(F.col("event_type")).alias("event_type"))
    good, bad = AU.categorise_events(e)
    return (good.select("event_type", "event_category").unionByName(bad.select("event_type", F.col("error").alias("event_category")))
            .groupBy("event_type", "event_category").agg(F.count(F.lit(1)).alias("events")))


register("p30_event_categories", """
SELECT CASE event_type WHEN 'click' THEN 'alert.classified' WHEN 'view' THEN 'response.executed' WHEN 'error' THEN 'config.changed'
            ELSE event_type END AS event_type,
       CASE event_type WHEN 'click' THEN 'decision' WHEN 'view' THEN 'action' WHEN 'error' THEN 'system' ELSE 'unknown event type' END AS event_category,
       CAST(COUNT(*) AS BIGINT) AS events FROM events GROUP BY ALL
""")(_p30)


def _p41(spark, sf):
    jobs = TB.read(spark, sf, "events").select("event_type", F.col("ts").alias("submitted_at"))
    b = GT.batch_sla(jobs, TB.EVENTS_NOW)
    return b.groupBy("event_type").agg(F.count_if("sla_expired").alias("expired"), F.count(F.lit(1)).alias("jobs"))


register("p41_batch_sla", f"""
SELECT event_type, CAST(COUNT(*) FILTER (WHERE ts < {ts(TB.EVENTS_NOW, hours=24)}) AS BIGINT) AS expired, CAST(COUNT(*) AS BIGINT) AS jobs
FROM events GROUP BY event_type
""")(_p41)


def _j13(spark, sf):
    from tidewatch.operators import enrich as EN
    s = TB.read(spark, sf, "supplier")
    assets = s.select(F.concat(F.lit("asset-"), F.col("s_suppkey").cast("string")).alias("asset_id"))
    zone = (s.where(F.col("s_acctbal") > 0)
            .select(F.concat(F.lit("asset-"), F.col("s_suppkey").cast("string")).alias("asset_id"),
                    F.concat(F.lit("zone-"), (F.col("s_nationkey") % 5).cast("string")).alias("zone")))
    owner = (s.join(TB.read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).where(F.col("n_regionkey") < 3)
             .select(F.concat(F.lit("asset-"), F.col("s_suppkey").cast("string")).alias("asset_id"), F.col("n_name").alias("owner")))
    return EN.asset_context(assets, zone, owner)


register("j13_asset_context", """
SELECT 'asset-' || CAST(s_suppkey AS VARCHAR) AS asset_id,
       CASE WHEN s_acctbal > 0 THEN 'zone-' || CAST(s_nationkey % 5 AS VARCHAR) END AS zone,
       CASE WHEN n_regionkey < 3 THEN n_name END AS owner
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
""")(_j13)


# ---------------------------------------------------------------- P-26 actions, P-32 governance
def _p26_actions(spark, sf):
    inv = TB.investigations(spark, sf)
    k = F.col("investigation_id").cast("bigint")
    act = F.array(*[F.struct(F.lit(a).alias("action"), t.cast("int").alias("tier"), g.alias("target")) for a, t, g in (
        ("isolate_host", k % 4, F.col("asset_id")), ("execute_playbook", F.lit(1), F.concat(F.lit("pb-"), (k % 6).cast("string"))),
        ("auto_close", F.lit(0), F.col("alert_id")), ("modify_routing_policy", F.lit(0), F.lit("router")))])
    allowed = spark.range(4).select(F.concat(F.lit("pb-"), F.col("id").cast("string")).alias("playbook_id"))
    o = GT.action_outcomes(inv.select("tenant_id", "confidence", "classification", act.alias("actions")), allowed)
    return o.groupBy("tenant_id", "action", "action_class", "outcome", "blocked_reason").agg(F.count(F.lit(1)).alias("actions"))


register("p26_action_outcomes", with_roles("""
, a AS (
  SELECT tenant_id, 'isolate_host' AS action, CAST(investigation_id AS BIGINT) % 4 >= 2 AS gated, NULL AS reason FROM investigations
  UNION ALL SELECT tenant_id, 'execute_playbook', false, CASE WHEN CAST(investigation_id AS BIGINT) % 6 > 3 THEN 'unauthorized_playbook' END
  FROM investigations
  UNION ALL SELECT tenant_id, 'auto_close', false,
         CASE WHEN NOT (classification = 'false_positive' AND confidence >= 0.85) THEN 'insufficient_criteria' END FROM investigations
  UNION ALL SELECT tenant_id, 'modify_routing_policy', false, 'routing_policy_change' FROM investigations)
SELECT tenant_id, action, CASE WHEN gated THEN 'gated' ELSE 'auto' END AS action_class,
       CASE WHEN gated THEN 'executed_with_approval' WHEN reason IS NOT NULL THEN 'blocked' ELSE 'executed' END AS outcome,
       reason AS blocked_reason, CAST(COUNT(*) AS BIGINT) AS actions
FROM a GROUP BY ALL
""", "investigations"))(_p26_actions)

GOVERNANCE_NOW = "2024-04-20 00:00:00"


def _p32_governance(spark, sf):
    from tidewatch.operators import fp as FP
    e = TB.read(spark, sf, "events").where(F.col("event_type") != "view")
    kind = F.when(F.col("event_type") == "click", "approve").when((F.col("event_type") == "error") & (F.col("user_id") % 5 == 0), "revoke") \
        .otherwise("reaffirm")
    g = e.select(F.concat(F.lit("fp-"), (F.col("user_id") % 400).cast("string")).alias("pattern_id"), kind.alias("event"),
                 F.concat(F.lit("analyst-"), (F.col("event_id") % 3).cast("string")).alias("actor"), "ts")
    s = FP.pattern_status_from_events(g, GOVERNANCE_NOW)
    return s.select("pattern_id", F.col("approvers").cast("bigint").alias("approvers"), "status",
                    F.date_format("expiry_date", "yyyy-MM-dd HH:mm:ss").alias("expiry_date"))


register("p32_pattern_governance", f"""
WITH e AS (SELECT 'fp-' || CAST(user_id % 400 AS VARCHAR) AS pattern_id,
                  CASE WHEN event_type = 'click' THEN 'approve' WHEN event_type = 'error' AND user_id % 5 = 0 THEN 'revoke' ELSE 'reaffirm' END AS event,
                  event_id % 3 AS actor, ts FROM events WHERE event_type <> 'view')
, f AS (SELECT pattern_id, actor, MIN(ts) AS first_at FROM e WHERE event = 'approve' GROUP BY ALL)
, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pattern_id ORDER BY first_at, actor) AS n FROM f)
, a AS (SELECT pattern_id, COUNT(*) AS approvers, MAX(CASE WHEN n = 2 THEN first_at END) AS approved_at FROM r GROUP BY pattern_id)
, g AS (SELECT e.pattern_id, COALESCE(MAX(approvers), 0) AS approvers, MAX(approved_at) AS approved_at,
               MAX(CASE WHEN event = 'reaffirm' AND ts >= approved_at THEN ts END) AS re, MAX(CASE WHEN event = 'revoke' THEN ts END) AS rv
        FROM e LEFT JOIN a ON e.pattern_id = a.pattern_id GROUP BY e.pattern_id)
, x AS (SELECT *, CASE WHEN approved_at IS NOT NULL THEN GREATEST(approved_at, COALESCE(re, approved_at)) + INTERVAL 90 DAY END AS expiry FROM g)
SELECT pattern_id, CAST(approvers AS BIGINT) AS approvers,
       CASE WHEN rv IS NOT NULL THEN 'revoked' WHEN approvers = 0 THEN 'draft' WHEN approved_at IS NULL THEN 'pending_review'
            WHEN expiry < TIMESTAMP '{GOVERNANCE_NOW}' THEN 'expired' ELSE 'approved' END AS status,
       strftime(expiry, '%Y-%m-%d %H:%M:%S') AS expiry_date
FROM x
""")(_p32_governance)
