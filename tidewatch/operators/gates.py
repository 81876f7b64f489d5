"""Decision gates and per-row policies applied table-wide (P-26 .. P-29, P-40, P-41).

Each is a column expression over the investigation (or call) table; overrides come in as
small tables joined by key, never as per-row lookups.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import col_type, lookup, time_lit

# Fixed values (must equal the reference)
APPROVAL_TIMEOUT_BY_SEVERITY = {"critical": 1, "high": 2, "medium": 4, "low": 8}
APPROVAL_TIMEOUT_DEFAULT = 4
ESCALATE_ON_TIMEOUT = ("critical", "high")
ESCALATION_CONFIDENCE_THRESHOLD = 0.6
ESCALATION_SEVERITIES = ("critical", "high")
DESTRUCTIVE_ACTION_TIER = 2
AUTO_CLOSE_CONFIDENCE = 0.85
BATCH_SLA_HOURS = 24
# USD per token: input, output, cache read, cache write (per-million prices / 1e6)
PRICE_STANDARD = (3.0 / 1e6, 15.0 / 1e6, 0.30 / 1e6, 3.75 / 1e6)
PRICE_SMALL = (0.80 / 1e6, 4.0 / 1e6, 0.08 / 1e6, 1.0 / 1e6)


def approval_gates(inv: DataFrame, now, overrides: DataFrame | None = None, *, opened_col: str = "updated_at") -> DataFrame:
    """P-28: timeout by severity (tenant override first, minimum 1 h), deadline, expiry, half-time
    escalation notice, and what happens at timeout (escalate critical/high, else close)."""
    d = inv
    if overrides is not None:
        d = d.join(overrides.select("tenant_id", "severity", F.col("timeout_hours").alias("_ovr")),
                   ["tenant_id", "severity"], "left")
        base = F.coalesce(F.col("_ovr"), lookup(APPROVAL_TIMEOUT_BY_SEVERITY, F.col("severity"), APPROVAL_TIMEOUT_DEFAULT))
    else:
        base = lookup(APPROVAL_TIMEOUT_BY_SEVERITY, F.col("severity"), APPROVAL_TIMEOUT_DEFAULT)
    hours = F.greatest(F.lit(1), base.cast("int"))
    dt = col_type(inv, opened_col)
    nowc = time_lit(now, dt)
    deadline = F.col(opened_col) + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), hours)
    half = F.col(opened_col) + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), hours * 30)
    behaviour = F.when(F.col("severity").isin(*ESCALATE_ON_TIMEOUT), "escalate").otherwise("close")
    out = d.withColumn("timeout_hours", hours).withColumn("approval_deadline", deadline) \
        .withColumn("expired", nowc >= deadline).withColumn("half_timeout_reached", nowc >= half) \
        .withColumn("timeout_behavior", behaviour) \
        .withColumn("gate_status", F.when(F.col("expired"), behaviour)
                    .when(F.col("half_timeout_reached"), "notify").otherwise("waiting"))
    return out.drop("_ovr") if overrides is not None else out


def needs_human_approval(actions: Column, confidence: Column, severity: Column) -> Column:
    """P-27: any action at or above the destructive tier, or low confidence on critical/high."""
    destructive = F.exists(F.coalesce(actions, F.array()), lambda a: F.coalesce(a["tier"], F.lit(0)) >= DESTRUCTIVE_ACTION_TIER)
    return destructive | ((confidence < ESCALATION_CONFIDENCE_THRESHOLD) & severity.isin(*ESCALATION_SEVERITIES))


def auto_close_allowed(confidence: Column, fp_matched: Column) -> Column:
    """P-26: auto-close only with an FP match and confidence >= .85."""
    return F.coalesce(fp_matched, F.lit(False)) & (confidence >= AUTO_CLOSE_CONFIDENCE)


def action_outcomes(investigations: DataFrame, allowed_playbooks: DataFrame, *, can_modify_routing: bool = False,
                    actions: str = "actions") -> DataFrame:
    """P-26: every recommended action with its class and outcome.

    Tier 2 and above is gated (``executed_with_approval``). Of the others, a playbook outside the allow-list, an
    auto-close without its criteria and a change of the routing policy are ``blocked``, with the reason; the rest is
    ``executed``. ``actions``: ARRAY<STRUCT<action, tier, target>>; ``allowed_playbooks``: (playbook_id). The
    allow-list is joined as a semi-join flag, so it may be of any size.
    """
    a = investigations.select(*[c for c in investigations.columns if c != actions], F.explode(actions).alias("_a"))
    a = a.select("*", "_a.action", "_a.tier", "_a.target").drop("_a")
    ok = allowed_playbooks.select(F.col("playbook_id").alias("_pb")).distinct().withColumn("_listed", F.lit(True))
    a = a.join(ok, F.col("target") == F.col("_pb"), "left").drop("_pb")
    gated = F.coalesce(F.col("tier"), F.lit(0)) >= DESTRUCTIVE_ACTION_TIER
    reason = (F.when(gated, F.lit(None))
              .when((F.col("action") == "execute_playbook") & F.col("_listed").isNull(), "unauthorized_playbook")
              .when((F.col("action") == "auto_close") & ~F.coalesce(auto_close_allowed(
                  F.col("confidence"), F.col("classification") == "false_positive"), F.lit(False)), "insufficient_criteria")
              .when((F.col("action") == "modify_routing_policy") & F.lit(not can_modify_routing), "routing_policy_change"))
    return (a.withColumn("action_class", F.when(gated, "gated").otherwise("auto")).withColumn("blocked_reason", reason)
            .withColumn("outcome", F.when(gated, "executed_with_approval").when(F.col("blocked_reason").isNotNull(), "blocked")
                        .otherwise("executed")).drop("_listed"))


def trust_constraint(detections: Column) -> Column:
    """P-29: struct(requires_human_review, attestations): every detection untrusted -> human review;
    the attestation list is sorted and distinct."""
    d = F.coalesce(detections, F.array())
    all_untrusted = (F.size(d) > 0) & F.forall(d, lambda x: x["telemetry_trust_level"] == "untrusted")
    att = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(d, lambda x: x["attestation_status"]),
                                                               lambda s: s.isNotNull() & (s != "")))), ",")
    return F.struct(all_untrusted.alias("requires_human_review"), att.alias("attestations"))


def call_cost(input_tokens: Column, output_tokens: Column, model: Column, pricing: Mapping[str, tuple],
              cache_read: Column | None = None, cache_write: Column | None = None) -> Column:
    """P-40: tokens x price of the model (unknown model -> 0), rounded to 6 places."""
    def price(i):
        return F.coalesce(lookup({k: v[i] for k, v in pricing.items()}, model), F.lit(0.0))
    cr = F.coalesce(cache_read, F.lit(0)) if cache_read is not None else F.lit(0)
    cw = F.coalesce(cache_write, F.lit(0)) if cache_write is not None else F.lit(0)
    cost = input_tokens * price(0) + output_tokens * price(1) + cr * price(2) + cw * price(3)
    return F.round(cost, 6)


def batch_sla(jobs: DataFrame, now, submitted_col: str = "submitted_at", hours: int = BATCH_SLA_HOURS) -> DataFrame:
    """P-41: a batch job older than 24 h is expired."""
    dt = col_type(jobs, submitted_col)
    limit = time_lit(now, dt) - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(hours))
    return jobs.withColumn("sla_expired", F.col(submitted_col) < limit)


# ---------------------------------------------------------------------------
# P-22 task tier routing (table-wide)
# ---------------------------------------------------------------------------

# Fixed values (must equal the reference): base tier per task type.
TASK_TIER = {
    "ioc_extraction": "tier_0", "log_summarisation": "tier_0", "entity_normalisation": "tier_0",
    "fp_suggestion": "tier_0", "alert_classification": "tier_0", "severity_assessment": "tier_0",
    "investigation": "tier_1", "ctem_correlation": "tier_1", "atlas_reasoning": "tier_1",
    "attack_path_analysis": "tier_1", "incident_report": "tier_1", "playbook_selection": "tier_1",
    "fp_pattern_training": "tier_2", "playbook_generation": "tier_2", "agent_red_team": "tier_2",
    "detection_rule_generation": "tier_2", "retrospective_analysis": "tier_2", "threat_landscape_summary": "tier_2",
}
TIER_ORDER = {"tier_0": 0, "tier_1": 1, "tier_1_plus": 2, "tier_2": 3}
TIME_BUDGET_FLOOR_S, CONTEXT_ESCALATION_TOKENS, LOW_CONFIDENCE = 3, 100_000, 0.6


def route_tasks(tasks: DataFrame) -> DataFrame:
    """P-22: base tier, then the override chain (time budget < 3 s -> tier 0; else critical with
    reasoning -> at least tier 1; context > 100k on tier 0 -> tier 1; low previous confidence on
    critical/high -> tier 1+), with the reason trail joined by '; '."""
    base = lookup(TASK_TIER, F.col("task_type"), "tier_1")
    rank = lambda c: lookup(TIER_ORDER, c)
    fast = F.col("time_budget_seconds") < TIME_BUDGET_FLOOR_S
    crit = ~fast & (F.col("alert_severity") == "critical") & F.col("requires_reasoning")
    t1 = F.when(fast, F.lit("tier_0")).when(crit & (rank(base) < 1), F.lit("tier_1")).otherwise(base)
    ctx = (F.col("context_tokens") > CONTEXT_ESCALATION_TOKENS) & (t1 == "tier_0")
    t2 = F.when(ctx, F.lit("tier_1")).otherwise(t1)
    low = F.col("previous_confidence").isNotNull() & (F.col("previous_confidence") < LOW_CONFIDENCE) \
        & F.col("alert_severity").isin("critical", "high")
    tier = F.when(low, F.lit("tier_1_plus")).otherwise(t2)
    reasons = F.array_compact(F.array(
        F.concat(F.lit("base="), base),
        F.when(fast, F.lit("time_budget<3s→tier_0")),
        F.when(crit & (rank(base) < 1), F.lit("critical+reasoning→min_tier_1")),
        F.when(ctx, F.lit("context>100k→tier_1")),
        F.when(low, F.lit("low_confidence_escalation→tier_1+"))))
    return tasks.withColumn("tier", tier).withColumn("reason", F.array_join(reasons, "; ")) \
        .withColumn("use_extended_thinking", tier == "tier_1_plus")


# Fixed values (must equal the reference): what a task asks of a model, as (tool use, context tokens).
TASK_CAPABILITIES = {
    "ioc_extraction": (False, 4096), "log_summarisation": (False, 8192), "entity_normalisation": (False, 4096),
    "fp_suggestion": (False, 4096), "alert_classification": (False, 4096), "severity_assessment": (False, 4096),
    "investigation": (True, 100_000), "ctem_correlation": (True, 50_000), "atlas_reasoning": (True, 50_000),
    "attack_path_analysis": (True, 100_000), "incident_report": (False, 50_000), "playbook_selection": (True, 50_000),
    "fp_pattern_training": (False, 200_000), "playbook_generation": (True, 100_000), "agent_red_team": (True, 200_000),
    "detection_rule_generation": (True, 100_000), "retrospective_analysis": (False, 200_000), "threat_landscape_summary": (False, 200_000),
}
PROVIDER_SCHEMA = "tier string, rank int, provider string, max_context_tokens long, supports_tool_use boolean, supports_extended_thinking boolean"


def task_capabilities(spark) -> DataFrame:
    return spark.createDataFrame([(t, tools, False, ctx) for t, (tools, ctx) in TASK_CAPABILITIES.items()],
                                 "task_type string, requires_tool_use boolean, requires_extended_thinking boolean, max_context_tokens long")


def assign_providers(routed: DataFrame, providers: DataFrame, capabilities: DataFrame, health: DataFrame, bucket: str) -> DataFrame:
    """P-22 beyond the tier: the provider of each routed task (tier, task_type, reason, ``bucket``).

    ``providers`` (PROVIDER_SCHEMA) rank the models of a tier, 0 being its primary. A fallback counts only if it has all that the task's
    row of ``capabilities`` asks for (tool use, extended thinking, context); the primary is taken without that, and
    ``primary_capable`` tells. Where ``health`` (bucket, provider, available; no row is available) says that the primary is down, the first healthy
    fallback replaces it and the reason says so; with none, it stays and ``unserved`` is true. ``fallbacks`` are those left, in order.

    The choice is made once per (bucket, tier, task type) and joined back, so the tasks meet a table of a few rows a bucket.
    """
    keys = [bucket, "tier", "task_type"]
    h = health.groupBy(F.col(bucket), "provider").agg(F.min("available").alias("available"))
    c = capabilities.select("task_type", F.col("max_context_tokens").alias("_asks"), "requires_tool_use", "requires_extended_thinking")
    p = (routed.select(*keys).distinct().join(c, "task_type", "left").join(providers, "tier").join(h, [bucket, "provider"], "left"))
    capable = (F.col("_asks").isNull() | ((~F.col("requires_tool_use") | F.col("supports_tool_use"))
                                          & (~F.col("requires_extended_thinking") | F.col("supports_extended_thinking"))
                                          & (F.col("_asks") <= F.col("max_context_tokens"))))
    one = F.struct("rank", "provider", capable.alias("capable"), F.coalesce("available", F.lit(True)).alias("up"))
    g = p.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("p"))  # the models of one tier
    g = g.select(*keys, F.col("p")[0].alias("first"), F.filter(F.slice("p", 2, F.size("p")), lambda x: x["capable"]).alias("rest"))
    g = g.withColumn("next", F.get(F.filter("rest", lambda x: x["up"]), F.lit(0)))
    g = g.withColumn("is_fallback", ~F.col("first.up") & F.col("next").isNotNull())
    chosen = F.when(F.col("is_fallback"), F.col("next.provider")).otherwise(F.col("first.provider"))
    left = F.filter("rest", lambda x: ~F.col("is_fallback") | (x["rank"] != F.col("next.rank")))
    g = g.select(*keys, chosen.alias("provider"), "is_fallback", (~F.col("first.up") & F.col("next").isNull()).alias("unserved"),
                 F.col("first.capable").alias("primary_capable"), F.transform(left, lambda x: x["provider"]).alias("fallbacks"))
    out = routed.join(g, keys, "left")
    return out.withColumn("reason", F.when(F.col("is_fallback"), F.concat("reason", F.lit("; primary_unavailable→fallback("), "provider", F.lit(")")))
                          .otherwise(F.col("reason")))


# ---------------------------------------------------------------------------
# P-23 degradation level from provider health
# ---------------------------------------------------------------------------

# Fixed values (must equal the reference): level -> (confidence override, extended thinking, max tier, alert ops)
DEGRADATION_POLICIES = {
    "full_capability": (0.0, True, "tier_1_plus", False),
    "secondary_active": (0.95, False, "tier_1", True),
    "deterministic_only": (1.0, False, "tier_0", True),
}


def degradation_levels(health: DataFrame, keys: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """P-23: per bucket, full capability while the primary provider is up, secondary_active when
    only the secondary is, deterministic_only otherwise; with the level's policy columns.

    ``health``: (bucket..., provider in {primary, secondary}, available boolean); a provider
    with no row in a bucket counts as available."""
    g = health.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("provider") == "primary", F.col("available").cast("int"))), F.lit(1)).alias("_p"),
        F.coalesce(F.min(F.when(F.col("provider") == "secondary", F.col("available").cast("int"))), F.lit(1)).alias("_s"))
    level = F.when(F.col("_p") == 1, "full_capability").when(F.col("_s") == 1, "secondary_active") \
        .otherwise("deterministic_only")
    g = g.withColumn("degradation_level", level).drop("_p", "_s")
    for i, name in enumerate(("confidence_threshold_override", "extended_thinking_available", "max_tier", "alert_ops")):
        g = g.withColumn(name, lookup({k: v[i] for k, v in DEGRADATION_POLICIES.items()}, F.col("degradation_level")))
    return g
