"""Operational reports: investigation KPIs, spend, routing, listings, top-k.

Every report is one aggregate pass (partial aggregation map-side, tiny final
shuffle); several dashboard queries that the reference issues one by one are
merged into a single scan with conditional aggregates or GROUPING SETS.
Listings page with a unique tie-break so ``offset``/``limit`` are stable.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import (col_type, epoch_seconds, lookup, severity_rank, shift, time_lit,
                                       to_datetime)
from tidewatch.operators.quantiles import add_percentiles

CLOSED_STATES = ("closed", "failed")

# Fixed values (must equal the reference): spend limits and projection.
MONTHLY_HARD_CAP = 1000.0
MONTHLY_SOFT_ALERT = 500.0
SPEND_PROJECTION_FACTOR = 1.3


def _after(df: DataFrame, col: str, bound, strict: bool = False, now=None) -> Column:
    """``col >= bound`` (``>`` when strict), and ``col < now`` when a clock is given:
    rows stamped after the explicit ``now`` are not visible yet."""
    dt = col_type(df, col)
    lit = time_lit(bound, dt)
    c = F.col(col) > lit if strict else F.col(col) >= lit
    return c if now is None else c & (F.col(col) < time_lit(now, dt))


# ---------------------------------------------------------------------------
# Investigation KPIs (A-09 .. A-14)
# ---------------------------------------------------------------------------

def by_state(inv: DataFrame) -> DataFrame:
    """A-09: investigations per state."""
    return inv.groupBy("state").agg(F.count(F.lit(1)).alias("count"))


def open_summary(inv: DataFrame) -> DataFrame:
    """A-09: open total (not closed/failed) and awaiting approval, one pass."""
    return inv.agg(F.count_if(~F.col("state").isin(*CLOSED_STATES)).alias("total_open"),
                   F.count_if(F.col("state") == "awaiting_human").alias("awaiting_human"),
                   F.count(F.lit(1)).alias("total"))


def json_field(col: str, field: str) -> Column:
    """``col->>'field'`` on a JSON text column."""
    return F.get_json_object(F.col(col), f"$.{field}")


def severity_recent(inv: DataFrame, now, hours: int = 24, json_col: str = "graph_state") -> DataFrame:
    """A-10: severity (from the JSON blob) of investigations updated in the last ``hours``."""
    return (inv.where(_after(inv, "updated_at", shift(now, hours=hours), now=now))
            .groupBy(json_field(json_col, "severity").alias("severity"))
            .agg(F.count(F.lit(1)).alias("count")))


def severity_open(inv: DataFrame, json_col: str = "graph_state") -> DataFrame:
    """A-10: severity of open investigations (NOT IN closed/failed); empty severities dropped."""
    sev = json_field(json_col, "severity")
    return (inv.where(~F.col("state").isin(*CLOSED_STATES))
            .groupBy(sev.alias("severity")).agg(F.count(F.lit(1)).alias("count"))
            .where(F.col("severity").isNotNull() & (F.col("severity") != "")))


def mean_time_to_close(inv: DataFrame, now, days: int = 7) -> DataFrame:
    """A-11: mean seconds from creation to last update of investigations closed recently."""
    secs = epoch_seconds(F.col("updated_at")) - epoch_seconds(F.col("created_at"))
    return (inv.where((F.col("state") == "closed") & _after(inv, "updated_at", shift(now, days=days), now=now))
            .agg(F.avg(secs).alias("avg_seconds"))
            .select("avg_seconds", (F.col("avg_seconds") / 3600).alias("avg_hours"),
                    (F.col("avg_seconds") / 60).alias("avg_minutes")))


def fp_rate(inv: DataFrame, json_col: str = "graph_state") -> DataFrame:
    """A-12: share of closed investigations classified false positive (FILTER aggregate)."""
    cls = json_field(json_col, "classification")
    return (inv.where(F.col("state") == "closed")
            .agg(F.count_if(cls == "false_positive").alias("fp_count"), F.count(F.lit(1)).alias("total"))
            .withColumn("fp_rate_pct", F.when(F.col("total") > 0, F.col("fp_count") * 100.0 / F.col("total"))))


def period_totals(inv: DataFrame, now, days: int = 30) -> DataFrame:
    """A-14: investigations and total model cost over the last ``days``."""
    return (inv.where(_after(inv, "created_at", shift(now, days=days), now=now))
            .agg(F.count(F.lit(1)).alias("investigations"),
                 F.coalesce(F.sum("total_cost_usd"), F.lit(0.0)).alias("total_cost_usd")))


def investigation_kpis(inv: DataFrame, now) -> DataFrame:
    """A-09..A-14 merged: every scalar KPI of the overview in ONE scan of the table."""
    closed = F.col("state") == "closed"
    secs = epoch_seconds(F.col("updated_at")) - epoch_seconds(F.col("created_at"))
    recent_close = closed & _after(inv, "updated_at", shift(now, days=7), now=now)
    cls = json_field("graph_state", "classification")
    in30 = _after(inv, "created_at", shift(now, days=30), now=now)
    return inv.agg(
        F.count_if(~F.col("state").isin(*CLOSED_STATES)).alias("total_open"),
        F.count_if(F.col("state") == "awaiting_human").alias("awaiting_human"),
        F.count_if(_after(inv, "updated_at", shift(now, hours=24), now=now) & (json_field("graph_state", "severity") == "critical"))
        .alias("critical_24h"),
        F.avg(F.when(recent_close, secs)).alias("mttc_seconds"),
        F.count_if(closed & (cls == "false_positive")).alias("fp_count"),
        F.count_if(closed).alias("closed_total"),
        F.count_if(in30).alias("investigations_30d"),
        F.coalesce(F.sum(F.when(in30, F.col("total_cost_usd"))), F.lit(0.0)).alias("cost_30d"))


# ---------------------------------------------------------------------------
# Model calls: latency, spend, routing (A-05, A-15 .. A-18)
# ---------------------------------------------------------------------------

def model_latency(calls: DataFrame, now, hours: int = 1) -> DataFrame:
    """A-05: per model in the last hour: calls, successes, mean, exact p50/p95 latency."""
    seen = calls.where(_after(calls, "created_at", shift(now, hours=hours), strict=True, now=now))
    g = seen.groupBy("model_id").agg(F.count(F.lit(1)).alias("total_calls"),
                                     F.count_if(F.col("status") == "success").alias("success_calls"),
                                     F.avg("latency_ms").alias("avg_latency"))
    return add_percentiles(g, seen, ["model_id"], "latency_ms", {"p50_latency": 0.5, "p95_latency": 0.95})


def month_start(now) -> _dt.datetime:
    d = to_datetime(now)
    return _dt.datetime(d.year, d.month, 1)


def spend_summary(calls: DataFrame, now, budget: float = MONTHLY_HARD_CAP,
                  projection: float = SPEND_PROJECTION_FACTOR) -> DataFrame:
    """A-15: spend today / 7 days / month-to-date, budget left, percent used, projection."""
    earliest = min(shift(now, days=7), month_start(now))
    calls = calls.where(_after(calls, "created_at", earliest, True, now))  # pushed to the scan
    s = calls.agg(
        F.coalesce(F.sum(F.when(_after(calls, "created_at", shift(now, days=1), True, now), F.col("cost_usd"))), F.lit(0.0)).alias("today_usd"),
        F.coalesce(F.sum(F.when(_after(calls, "created_at", shift(now, days=7), True, now), F.col("cost_usd"))), F.lit(0.0)).alias("week_usd"),
        F.coalesce(F.sum(F.when(_after(calls, "created_at", month_start(now), True, now), F.col("cost_usd"))), F.lit(0.0)).alias("month_usd"))
    return s.select("*", (F.lit(budget) - F.col("month_usd")).alias("budget_remaining_usd"),
                    (F.col("month_usd") / F.lit(budget) * 100).alias("budget_pct"),
                    (F.col("month_usd") * F.lit(projection)).alias("projected_month_usd"))


def spend_by_model(calls: DataFrame) -> DataFrame:
    """A-16: calls and spend per model, highest spend first."""
    return (calls.groupBy("model_id").agg(F.count(F.lit(1)).alias("calls"),
                                           F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spend"))
            .orderBy(F.desc("spend"), "model_id"))


def spend_guard(calls: DataFrame, now, soft: float = MONTHLY_SOFT_ALERT, hard: float = MONTHLY_HARD_CAP) -> DataFrame:
    """A-17: spend by model, by task, by tenant and in total in ONE pass (GROUPING SETS),
    plus the current calendar month's total against the soft and hard limits."""
    ms = month_start(now)
    nxt = _dt.datetime(ms.year + (ms.month == 12), ms.month % 12 + 1, 1)
    in_month = (F.col("created_at") >= time_lit(ms, col_type(calls, "created_at"))) & \
        (F.col("created_at") < time_lit(nxt, col_type(calls, "created_at")))
    g = (calls.withColumn("month_cost", F.when(in_month, F.col("cost_usd")))
         .groupingSets([["model_id"], ["task_type"], ["tenant_id"], []], "model_id", "task_type", "tenant_id")
         .agg(F.sum("cost_usd").alias("spend"), F.count(F.lit(1)).alias("calls"),
              F.coalesce(F.sum("month_cost"), F.lit(0.0)).alias("month_spend"),
              F.grouping_id().alias("gid")))
    # grouping_id bits follow (model_id, task_type, tenant_id); a set bit = rolled up
    dim = (F.when(F.col("gid") == 3, "model").when(F.col("gid") == 5, "task_type")
           .when(F.col("gid") == 6, "tenant").otherwise("total"))
    key = F.coalesce(F.col("model_id"), F.col("task_type"), F.col("tenant_id"), F.lit(""))
    return g.select(dim.alias("dimension"), F.when(F.col("gid") == 7, F.lit("")).otherwise(key).alias("key"),
                    "spend", "calls", "month_spend",
                    (F.col("month_spend") >= soft).alias("soft_alert"), (F.col("month_spend") >= hard).alias("hard_cap_hit"))


def routing_outcomes(calls: DataFrame) -> DataFrame:
    """A-18: per task and tier: calls, success rate, mean cost, latency and confidence."""
    return (calls.groupBy("task_type", "model_tier")
            .agg(F.count(F.lit(1)).alias("total"),
                 (F.count_if(F.col("status") == "success") / F.count(F.lit(1))).alias("success_rate"),
                 F.avg("cost_usd").alias("avg_cost"), F.avg("latency_ms").alias("avg_latency_ms"),
                 F.avg("confidence").alias("avg_confidence"))
            .withColumn("route", F.concat_ws(":", "task_type", "model_tier")))


# ---------------------------------------------------------------------------
# Row counts, histograms, thresholds (A-23, A-38, A-39)
# ---------------------------------------------------------------------------

def table_row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """A-23: one row per table; counts run as one union job."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
             for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def histogram(df: DataFrame, value: str, buckets: Sequence[float], labels: Iterable[str] = ()) -> DataFrame:
    """A-38: cumulative bucket counts ``le`` per label set, plus +Inf, sum and count."""
    labels = list(labels)
    aggs = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(buckets)]
    aggs += [F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum")]
    g = df.groupBy(*labels).agg(*aggs)
    stack = ", ".join(f"'{b}', le_{i}" for i, b in enumerate(buckets)) + ", '+Inf', `count`"
    return g.selectExpr(*[f"`{c}`" for c in labels], f"stack({len(buckets) + 1}, {stack}) AS (le, bucket_count)",
                        "`count`", "`sum`")


def operational_alerts(metrics: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """A-39: metric rows ``(name, labels, value)`` compared with per-name thresholds (broadcast literal map)."""
    th = lookup(thresholds, F.col("name"))
    return metrics.where(th.isNotNull() & (F.col("value") > th)).withColumn("threshold", th)


# ---------------------------------------------------------------------------
# Listings and top-k (P-12 .. P-19, K-01 .. K-05)
# ---------------------------------------------------------------------------

def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """K-01: ordered page. ``order`` must end with a unique key so pages are stable."""
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def list_investigations(inv: DataFrame, *, state: str | None = None, severity: str | None = None,
                        tenant_id: str | None = None, date_from=None, date_to=None,
                        limit: int = 50, offset: int = 0) -> DataFrame:
    """P-12: optional filters (state, JSON severity, tenant, date range), newest first, paged."""
    cond = F.lit(True)
    if state:
        cond = cond & (F.col("state") == state)
    if severity:
        cond = cond & (json_field("graph_state", "severity") == severity)
    if tenant_id:
        cond = cond & (F.col("tenant_id") == tenant_id)
    if date_from is not None:
        cond = cond & _after(inv, "created_at", date_from)
    if date_to is not None:
        cond = cond & (F.col("created_at") <= time_lit(date_to, col_type(inv, "created_at")))
    return page(inv.where(cond), [F.desc("created_at"), F.desc("investigation_id")], limit, offset)


def approval_queue(inv: DataFrame) -> DataFrame:
    """P-19/K-04: awaiting approval, critical first (enumerated rank), then oldest update."""
    return (inv.where(F.col("state") == "awaiting_human")
            .withColumn("severity_rank", severity_rank(json_field("graph_state", "severity")))
            .orderBy("severity_rank", "updated_at", "investigation_id"))


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """K-02: global top-k (planned as TakeOrderedAndProject: per-partition heaps, no full sort)."""
    return df.orderBy(*order).limit(k)


def top_k_per_key(df: DataFrame, keys: Sequence[str], k: int, order: Sequence[Column],
                  rank_col: str = "rank") -> DataFrame:
    """K-03/K-05: first ``k`` rows per key by ``order`` (row_number <= k; Spark applies a
    per-partition group limit before the shuffle-sort of the window)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
