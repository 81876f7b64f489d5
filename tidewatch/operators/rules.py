"""Windowed anomaly rules (D-01 .. D-12) and detection -> alert (P-39, U-01).

Each rule is ``f(telemetry DataFrame(s), now, **thresholds) -> DataFrame``
returning one row per firing entity with typed metric columns. Where the
current window and the baseline come from the same table, both are computed
from ONE scan with conditional aggregates (``count_if(ts >= start)`` ...)
instead of two scans and a join: the scan filter ``[baseline_start, now)``
is pushed to Parquet, the aggregate is partial (map-side) so a hot key costs
one partial row per task, and no shuffle join is needed.

``as_detection`` turns any rule output into the shared 16-column result
schema; ``run_all`` unions the rules; ``detections_to_alerts`` is P-39.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import (SAFETY_RELEVANT_RULES, confidence_floor, epoch_seconds, in_window, shift,
                                       time_lit, trust_downgrade, trust_level, col_type)
from tidewatch.operators.common import bounded_collect
from tidewatch.operators.quantiles import add_percentiles, gaps

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): rule identity and defaults
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class RuleMeta:
    rule_id: str
    severity: str
    atlas_technique: str
    attack_technique: str
    threat_model_ref: str
    frequency_minutes: int
    lookback_minutes: int


RULES = {
    "D-01": RuleMeta("ATLAS-DETECT-001", "High", "AML.T0020", "T1565.001", "TM-01", 60, 1440),
    "D-02": RuleMeta("ATLAS-DETECT-002", "High", "AML.T0044.001", "T1530", "TM-12", 30, 360),
    "D-03": RuleMeta("ATLAS-DETECT-003", "High", "AML.T0051", "", "TM-10", 15, 60),
    "D-04": RuleMeta("ATLAS-DETECT-004", "Critical", "AML.T0015", "", "TM-07", 15, 60),
    "D-05": RuleMeta("ATLAS-DETECT-005", "Critical", "AML.T0029", "T1499", "TM-14", 5, 15),
    "D-06": RuleMeta("ATLAS-DETECT-006", "High", "AML.T0010", "T1195", "TM-05", 60, 1440),
    "D-07": RuleMeta("ATLAS-DETECT-007", "High", "AML.T0035.002", "T1567", "TM-11", 60, 1440),
    "D-08": RuleMeta("ATLAS-DETECT-008", "High", "AML.T0015", "", "TM-17", 60, 360),
    "D-09": RuleMeta("ATLAS-DETECT-009", "Critical", "AML.T0043", "T1565.002", "TM-06", 5, 15),
    "D-10": RuleMeta("ATLAS-DETECT-010", "High", "AML.T0043", "T1199", "TM-08", 30, 360),
    "D-11": RuleMeta("ATLAS-DETECT-011", "Critical", "AML.T0040", "T1195.002", "TM-04", 5, 15),
}
SUSPICIOUS_ACTIONS = ("deltaDMLEvent", "deltaTableWrite", "notebookRun", "clusterCreate")

DETECTION_COLUMNS = ["rule_id", "tenant_id", "entity_type", "entity_id", "alert_title", "alert_severity",
                     "atlas_technique", "attack_technique", "threat_model_ref", "confidence", "evidence",
                     "requires_immediate_action", "safety_relevant", "detected_at",
                     "telemetry_trust_level", "attestation_status"]


def _base(rule: str, df: DataFrame) -> DataFrame:
    return df.withColumn("rule_id", F.lit(RULES[rule].rule_id))


def _ratio(count: Column, avg: Column) -> Column:
    """count / avg when avg > 0, else the raw count (no-baseline quirk Q2)."""
    return F.when(avg > 0, count / avg).otherwise(count.cast("double"))


# ---------------------------------------------------------------------------
# D-01 training-data poisoning
# ---------------------------------------------------------------------------

def training_data_poisoning(audit: DataFrame, now, *, actions=SUSPICIOUS_ACTIONS,
                            deviation_threshold: float = 3.0, distinct_threshold: int = 5,
                            count_threshold: int = 50, baseline_days: int = 30,
                            baseline_divisor: float = 30.0, lookback_hours: int = 24) -> DataFrame:
    """Users whose suspicious-action count in the lookback is far above their daily baseline.

    Baseline is ``[now - baseline_days, now - lookback)`` divided by ``baseline_divisor``
    (quirk Q1 keeps 30 for a 29-day span).
    """
    start = shift(now, hours=lookback_hours)
    cur = F.col("ts") >= time_lit(start, col_type(audit, "ts"))
    g = (audit
         .where(in_window(audit, "ts", shift(now, days=baseline_days), now) & F.col("action").isin(*actions))
         .groupBy("tenant_id", "user_id")
         .agg(F.count_if(cur).alias("count"),
              F.count_distinct(F.when(cur, F.col("target_resource"))).alias("distinct_tables"),
              (F.count_if(~cur) / F.lit(float(baseline_divisor))).alias("baseline_avg"))
         .where(F.col("count") > 0))
    return poisoning_fired(g, deviation_threshold, distinct_threshold, count_threshold)


def poisoning_fired(g: DataFrame, deviation_threshold: float = 3.0, distinct_threshold: int = 5,
                    count_threshold: int = 50) -> DataFrame:
    """D-01 over (count, distinct_tables, baseline_avg) of any keys."""
    g = g.withColumn("deviation_factor", _ratio(F.col("count"), F.col("baseline_avg")))
    fired = g.where((F.col("deviation_factor") > deviation_threshold)
                    | (F.col("distinct_tables") > distinct_threshold)
                    | (F.col("count") > count_threshold))
    return _base("D-01", fired).withColumn(
        "confidence", F.least(F.lit(0.95), F.lit(0.5) + F.col("deviation_factor") / 20.0))


# ---------------------------------------------------------------------------
# D-02 model extraction
# ---------------------------------------------------------------------------

def model_extraction(queries: DataFrame, now, *, count_threshold: int = 100,
                     lookback_hours: int = 6) -> DataFrame:
    """Callers with more than ``count_threshold`` queries; exact median token count (A-04)."""
    seen, keys = queries.where(in_window(queries, "ts", shift(now, hours=lookback_hours), now)), ["tenant_id", "user_id"]
    g = (seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("query_count")).where(F.col("query_count") > count_threshold))
    g = add_percentiles(g, seen, keys, "token_count", {"median_tokens": 0.5})
    return _base("D-02", g).withColumn(
        "confidence", F.least(F.lit(0.9), F.lit(0.6) + F.col("query_count") / 1000.0))


# ---------------------------------------------------------------------------
# D-03 prompt injection
# ---------------------------------------------------------------------------

def prompt_injection(queries: DataFrame, now, *, lookback_hours: int = 1) -> DataFrame:
    """Every query in the window whose safety filter fired (one detection per row)."""
    rows = (queries.where(in_window(queries, "ts", shift(now, hours=lookback_hours), now)
                          & (F.col("safety_filter_triggered") == F.lit(True)))
            .select("tenant_id", "user_id", "session_id", "ts"))
    return _base("D-03", rows).withColumn("confidence", F.lit(0.85))


# ---------------------------------------------------------------------------
# D-04 adversarial evasion
# ---------------------------------------------------------------------------

def adversarial_evasion(inference: DataFrame, now, *, zscore_threshold: float = -2.0,
                        fail_rate_threshold: float = 0.1, latency_increase_ms: float = 500.0,
                        baseline_days: int = 7, lookback_hours: int = 1) -> DataFrame:
    """Nodes whose confidence dropped (z-score vs baseline), physics checks fail, or latency rose.

    Nodes without a baseline or with null/zero baseline stddev are skipped (quirk Q5).
    """
    start = shift(now, hours=lookback_hours)
    cur = F.col("ts") >= time_lit(start, col_type(inference, "ts"))
    g = (inference.where(in_window(inference, "ts", shift(now, days=baseline_days), now))
         .groupBy("tenant_id", "edge_node_id")
         .agg(F.count_if(cur).alias("count"),
              F.avg(F.when(cur, F.col("confidence_score"))).alias("avg_confidence"),
              F.avg(F.when(cur, F.col("inference_latency_ms"))).alias("avg_latency"),
              F.count_if(cur & (F.col("physics_check_result") == "fail")).alias("fail_count"),
              F.count_if(~cur).alias("baseline_count"),
              F.avg(F.when(~cur, F.col("confidence_score"))).alias("baseline_confidence"),
              F.stddev_samp(F.when(~cur, F.col("confidence_score"))).alias("baseline_stddev"),
              F.avg(F.when(~cur, F.col("inference_latency_ms"))).alias("baseline_latency"))
         .where((F.col("count") > 0) & (F.col("baseline_count") > 0)
                & F.col("baseline_stddev").isNotNull() & (F.col("baseline_stddev") != 0))
         .select("tenant_id", "edge_node_id", "count",
                 ((F.col("avg_confidence") - F.col("baseline_confidence")) / F.col("baseline_stddev")).alias("z_score"),
                 (F.col("fail_count") / F.col("count")).alias("fail_rate"),
                 (F.col("avg_latency") - F.coalesce(F.col("baseline_latency"), F.lit(0.0))).alias("latency_increase_ms")))
    fired = g.where((F.col("z_score") < zscore_threshold) | (F.col("fail_rate") > fail_rate_threshold)
                    | (F.col("latency_increase_ms") > latency_increase_ms))
    out = _base("D-04", fired)
    return out.withColumn("confidence", confidence_floor(
        F.col("rule_id"), F.least(F.lit(0.95), F.lit(0.6) + F.abs(F.col("z_score")) / 10.0)))


# ---------------------------------------------------------------------------
# D-05 physics-oracle denial of service, D-05b silent nodes
# ---------------------------------------------------------------------------

def oracle_dos(oracle: DataFrame, now, *, error_threshold: int = 3, timeout_threshold: int = 2,
               fail_rate_threshold: float = 0.5, min_count_for_rate: int = 10,
               max_latency_ms: float = 10_000.0, lookback_minutes: int = 15) -> DataFrame:
    g = (oracle.where(in_window(oracle, "ts", shift(now, minutes=lookback_minutes), now))
         .groupBy("tenant_id", "edge_node_id")
         .agg(F.count(F.lit(1)).alias("total_checks"),
              F.count_if(F.col("error_state").isNotNull()).alias("error_count"),
              F.count_if(F.col("latency_ms") > max_latency_ms).alias("timeout_count"),
              (F.count_if(F.col("check_result") == "fail") / F.count(F.lit(1))).alias("fail_rate"),
              F.max("latency_ms").alias("max_latency_ms")))
    fired = g.where((F.col("error_count") > error_threshold) | (F.col("timeout_count") > timeout_threshold)
                    | ((F.col("fail_rate") > fail_rate_threshold) & (F.col("total_checks") > min_count_for_rate))
                    | (F.col("max_latency_ms") > max_latency_ms))
    out = _base("D-05", fired)
    return out.withColumn("confidence", confidence_floor(F.col("rule_id"), F.lit(0.9)))


def silent_nodes(oracle: DataFrame, now, *, lookback_minutes: int = 15, known_hours: int = 24) -> DataFrame:
    """Nodes seen in the previous ``known_hours`` that sent nothing in the window (left anti)."""
    start = shift(now, minutes=lookback_minutes)
    known = (oracle.where(in_window(oracle, "ts", shift(now, hours=known_hours), start))
             .select("tenant_id", "edge_node_id").distinct())
    active = (oracle.where(in_window(oracle, "ts", start, now))
              .select("tenant_id", "edge_node_id").distinct())
    missing = known.join(active, ["tenant_id", "edge_node_id"], "left_anti")
    return _base("D-05", missing).withColumn("total_checks", F.lit(0).cast("bigint")) \
        .withColumn("confidence", F.lit(0.9))


# ---------------------------------------------------------------------------
# D-06 supply chain
# ---------------------------------------------------------------------------

def supply_chain(registry: DataFrame, cicd: DataFrame, now, *, lookback_hours: int = 24) -> DataFrame:
    """Unapproved production promotions (.85) union dependency changes without passing tests (.8)."""
    start = shift(now, hours=lookback_hours)
    promos = (registry.where(in_window(registry, "ts", start, now) & (F.col("action") == "stage_transition")
                             & (F.col("stage") == "Production")
                             & (F.col("approved_by").isNull() | (F.col("approved_by") == "")))
              .select("tenant_id", F.lit("promotion").alias("finding"),
                      F.col("user_id").alias("entity_id"),
                      F.concat(F.lit("Unapproved model promotion: "), F.col("model_name"), F.lit(" v"),
                               F.col("model_version")).alias("alert_title"),
                      F.col("model_name").alias("subject"), F.col("model_version").alias("detail"),
                      F.lit(0.85).alias("confidence"),
                      F.lit("AML.T0010").alias("atlas_technique")))
    deps = (cicd.where(in_window(cicd, "ts", start, now) & F.col("dependency_changes").isNotNull()
                       & (F.col("dependency_changes") != "") & (F.col("tests_passed") == 0))
            .select("tenant_id", F.lit("dependency").alias("finding"),
                    F.coalesce(F.col("deployer"), F.lit("")).alias("entity_id"),
                    F.concat(F.lit("Dependency change without tests: pipeline "), F.col("pipeline_id")).alias("alert_title"),
                    F.col("pipeline_id").alias("subject"), F.col("commit_hash").alias("detail"),
                    F.lit(0.8).alias("confidence"),
                    F.lit("AML.T0018").alias("atlas_technique")))
    return _base("D-06", promos.unionByName(deps))


# ---------------------------------------------------------------------------
# D-07 insider exfiltration
# ---------------------------------------------------------------------------

def insider_exfiltration(api: DataFrame, now, *, deviation_threshold: float = 5.0,
                         distinct_threshold: int = 3, after_hours_threshold: int = 5,
                         baseline_days: int = 30, baseline_divisor: float = 30.0,
                         lookback_hours: int = 24) -> DataFrame:
    """Callers far above their daily baseline, on many endpoints, or after hours (hour < 6 or > 22, Q7)."""
    start = shift(now, hours=lookback_hours)
    cur = F.col("ts") >= time_lit(start, col_type(api, "ts"))
    hr = F.hour(F.col("ts"))
    g = (api.where(in_window(api, "ts", shift(now, days=baseline_days), now))
         .groupBy("tenant_id", "caller_identity")
         .agg(F.count_if(cur).alias("count"),
              F.count_distinct(F.when(cur, F.col("endpoint"))).alias("distinct_endpoints"),
              F.count_if(cur & ((hr < 6) | (hr > 22))).alias("after_hours"),
              (F.count_if(~cur) / F.lit(float(baseline_divisor))).alias("baseline_avg"))
         .where(F.col("count") > 0)
         .withColumn("deviation_factor", _ratio(F.col("count"), F.col("baseline_avg"))))
    fired = g.where((F.col("deviation_factor") > deviation_threshold)
                    | (F.col("distinct_endpoints") > distinct_threshold)
                    | (F.col("after_hours") > after_hours_threshold))
    return _base("D-07", fired).withColumn(
        "confidence", F.least(F.lit(0.95), F.lit(0.5) + F.col("deviation_factor") / 20.0))


# ---------------------------------------------------------------------------
# D-08 alert flood (meta rule over investigations)
# ---------------------------------------------------------------------------

def alert_flood(investigations: DataFrame, now, *, spike_ratio_threshold: float = 5.0,
                baseline_days: int = 7, lookback_hours: int = 6, ts_col: str = "created_at") -> DataFrame:
    """Global volume in the last 6 h vs the 6-hour-slot average of the baseline (A-03)."""
    start = shift(now, hours=lookback_hours)
    cur = F.col(ts_col) >= time_lit(start, col_type(investigations, ts_col))
    slots = baseline_days * 24.0 / lookback_hours
    g = (investigations.where(in_window(investigations, ts_col, shift(now, days=baseline_days), now))
         .agg(F.count_if(cur).alias("current_count"),
              (F.count_if(~cur) / F.lit(slots)).alias("baseline_avg")))
    return flood_fired(g, spike_ratio_threshold)


def flood_fired(g: DataFrame, spike_ratio_threshold: float = 5.0) -> DataFrame:
    """D-08 over (current_count, baseline_avg)."""
    g = g.withColumn("spike_ratio", _ratio(F.col("current_count"), F.col("baseline_avg")))
    fired = g.where(F.col("spike_ratio") > spike_ratio_threshold)
    return _base("D-08", fired).withColumn(
        "confidence", F.least(F.lit(0.9), F.lit(0.5) + F.col("spike_ratio") / 20.0))


# ---------------------------------------------------------------------------
# D-09 sensor spoofing (per row)
# ---------------------------------------------------------------------------

def sensor_spoofing(sensors: DataFrame, now, *, zscore_threshold: float = 3.0,
                    violations_threshold: int = 0, sensor_delta_threshold: float = 5.0,
                    baseline_hours: int = 24, lookback_minutes: int = 15,
                    source: str = "opcua_telemetry") -> DataFrame:
    """Each reading in the window vs its node's 24 h baseline; trust downgrade then floor (R-04, Q6)."""
    start = shift(now, minutes=lookback_minutes)
    base = (sensors.where(in_window(sensors, "ts", shift(now, hours=baseline_hours), start))
            .groupBy("tenant_id", "edge_node_id")
            .agg(F.avg("data_points_received").alias("avg_points"),
                 F.stddev_samp("data_points_received").alias("stddev_points"),
                 F.avg("sensor_count").alias("avg_sensors")))
    cur = sensors.where(in_window(sensors, "ts", start, now)).select(
        "tenant_id", "edge_node_id", "ts", "sensor_count", "data_points_received",
        "protocol_violations", "connection_state")
    has_sd = F.col("stddev_points").isNotNull() & (F.col("stddev_points") > 0)
    j = (cur.join(base, ["tenant_id", "edge_node_id"], "left")
         .select("tenant_id", "edge_node_id", "ts", "data_points_received", "sensor_count",
                 F.coalesce(F.col("protocol_violations"), F.lit(0)).cast("bigint").alias("protocol_violations"),
                 F.when(has_sd, F.abs((F.col("data_points_received") - F.col("avg_points")) / F.col("stddev_points")))
                  .otherwise(F.lit(0.0)).alias("z_score"),
                 F.when(has_sd, F.abs(F.col("sensor_count") - F.coalesce(F.col("avg_sensors"), F.lit(0.0))))
                  .otherwise(F.lit(0.0)).alias("sensor_delta")))
    fired = j.where((F.col("z_score") > zscore_threshold) | (F.col("protocol_violations") > violations_threshold)
                    | (F.col("sensor_delta") > sensor_delta_threshold))
    out = _base("D-09", fired)
    conf = confidence_floor(F.col("rule_id"), F.lit(0.85))
    conf = confidence_floor(F.col("rule_id"), trust_downgrade(conf, F.lit(source)))
    return (out.withColumn("confidence", conf)
            .withColumn("telemetry_trust_level", trust_level(F.lit(source)))
            .withColumn("attestation_status", F.lit("unavailable")))


# ---------------------------------------------------------------------------
# D-10 partner compromise
# ---------------------------------------------------------------------------

def partner_compromise(partners: DataFrame, now, *, volume_threshold: float = 3.0,
                       payload_z_threshold: float = 3.0, baseline_days: int = 7,
                       lookback_hours: int = 6) -> DataFrame:
    """Partner volume vs 6 h-slot baseline, payload z-score, mTLS failures; no baseline => ratio 0."""
    start = shift(now, hours=lookback_hours)
    slots = baseline_days * 24.0 / lookback_hours
    cur = (partners.where(in_window(partners, "ts", start, now))
           .groupBy("tenant_id", "partner_id", "partner_name")
           .agg(F.count(F.lit(1)).alias("call_count"),
                F.avg("payload_size").alias("avg_payload"),
                F.count_if(F.col("mtls_verified") == F.lit(False)).alias("mtls_failures")))
    base = (partners.where(in_window(partners, "ts", shift(now, days=baseline_days), start))
            .groupBy("tenant_id", "partner_id")
            .agg((F.count(F.lit(1)) / F.lit(slots)).alias("avg_6h_calls"),
                 F.avg("payload_size").alias("baseline_payload"),
                 F.stddev_samp("payload_size").alias("stddev_payload")))
    has_base = F.col("avg_6h_calls").isNotNull()
    sd = F.coalesce(F.col("stddev_payload"), F.lit(0.0))
    j = (cur.join(base, ["tenant_id", "partner_id"], "left")
         .select("tenant_id", "partner_id", "partner_name", "call_count", "mtls_failures",
                 F.when(has_base, _ratio(F.col("call_count"), F.coalesce(F.col("avg_6h_calls"), F.lit(0.0))))
                  .otherwise(F.lit(0.0)).alias("volume_deviation"),
                 F.when(has_base & (sd > 0), F.abs((F.col("avg_payload") - F.col("baseline_payload")) / sd))
                  .otherwise(F.lit(0.0)).alias("payload_z_score")))
    fired = j.where((F.col("volume_deviation") > volume_threshold) | (F.col("payload_z_score") > payload_z_threshold)
                    | (F.col("mtls_failures") > 0))
    return _base("D-10", fired).withColumn(
        "confidence", F.least(F.lit(0.9), F.lit(0.6) + F.col("volume_deviation") / 10.0))


# ---------------------------------------------------------------------------
# D-11 edge node compromise (per row)
# ---------------------------------------------------------------------------

def edge_compromise(edge: DataFrame, now, *, cpu_threshold: float = 0.95, memory_threshold: float = 0.95,
                    lookback_minutes: int = 15, source: str = "edge_node_telemetry") -> DataFrame:
    """Attestation fail/missing, disk failure, CPU or memory saturation; evidence lists only what fired."""
    att = F.col("boot_attestation")
    att_fail = att == "fail"
    att_missing = att.isNull() | (att == "")
    disk_fail = F.coalesce(F.col("disk_integrity") == "fail", F.lit(False))
    cpu_hi = F.coalesce(F.col("cpu_utilisation") > cpu_threshold, F.lit(False))
    mem_hi = F.coalesce(F.col("memory_utilisation") > memory_threshold, F.lit(False))
    rows = (edge.where(in_window(edge, "ts", shift(now, minutes=lookback_minutes), now))
            .where(F.coalesce(att_fail, F.lit(False)) | att_missing | disk_fail | cpu_hi | mem_hi)
            .select("tenant_id", "edge_node_id", "ts", "cpu_utilisation", "memory_utilisation",
                    F.when(F.coalesce(att_fail, F.lit(False)), "fail").when(att_missing, "unavailable")
                     .alias("attestation_finding"),
                    disk_fail.alias("disk_failed"), cpu_hi.alias("cpu_high"), mem_hi.alias("memory_high"),
                    F.when(att_missing, F.lit("unavailable")).otherwise(att).alias("attestation_status")))
    out = _base("D-11", rows)
    conf = confidence_floor(F.col("rule_id"), F.lit(0.85))
    conf = confidence_floor(F.col("rule_id"), trust_downgrade(conf, F.lit(source)))
    return (out.withColumn("confidence", conf)
            .withColumn("telemetry_trust_level", trust_level(F.lit(source))))


# ---------------------------------------------------------------------------
# Unified result schema, run-all (U-01 / D-12) and alerts (P-39)
# ---------------------------------------------------------------------------

def _ev(**cols: Column) -> Column:
    """Evidence map: name -> value as string; null entries dropped (``map_filter``)."""
    items = []
    for k, v in cols.items():
        items += [F.lit(k), v.cast("string")]
    return F.map_filter(F.create_map(*items), lambda k, v: v.isNotNull())


def _r(c: str, n: int) -> Column:
    return F.round(F.col(c), n)


def _title(prefix: str, col: str) -> Column:
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


# rule key -> (entity type, entity column, title builder, evidence builder)
_SHAPES: dict[str, tuple[str, Callable[[], Column], Callable[[], Column], Callable[[], Column]]] = {
    "D-01": ("user", lambda: F.col("user_id"),
             lambda: _title("Training data poisoning: anomalous activity by ", "user_id"),
             lambda: _ev(user_id=F.col("user_id"), count=F.col("count"), distinct_tables=F.col("distinct_tables"),
                         deviation_factor=_r("deviation_factor", 2), baseline_avg=_r("baseline_avg", 2))),
    "D-02": ("user", lambda: F.col("user_id"),
             lambda: _title("Model extraction: high query volume by ", "user_id"),
             lambda: _ev(user_id=F.col("user_id"), query_count=F.col("query_count"),
                         median_tokens=F.col("median_tokens"))),
    "D-03": ("user", lambda: F.col("user_id"),
             lambda: _title("Prompt injection attempt by ", "user_id"),
             lambda: _ev(user_id=F.col("user_id"), session_id=F.col("session_id"),
                         safety_filter_triggered=F.lit(True))),
    "D-04": ("host", lambda: F.col("edge_node_id"),
             lambda: _title("Adversarial evasion on edge node ", "edge_node_id"),
             lambda: _ev(edge_node_id=F.col("edge_node_id"), z_score=_r("z_score", 3),
                         fail_rate=_r("fail_rate", 3), latency_increase_ms=_r("latency_increase_ms", 1))),
    "D-05": ("host", lambda: F.col("edge_node_id"),
             lambda: _title("Physics oracle DoS on edge node ", "edge_node_id"),
             lambda: _ev(edge_node_id=F.col("edge_node_id"), total_checks=F.col("total_checks"),
                         error_count=F.col("error_count"), timeout_count=F.col("timeout_count"),
                         fail_rate=F.round(F.coalesce(F.col("fail_rate"), F.lit(0.0)), 3),
                         max_latency_ms=F.col("max_latency_ms"))),
    "D-06": ("user", lambda: F.col("entity_id"), lambda: F.col("alert_title"),
             lambda: _ev(finding=F.col("finding"), subject=F.col("subject"), detail=F.col("detail"))),
    "D-07": ("user", lambda: F.col("caller_identity"),
             lambda: _title("Insider exfiltration: anomalous API access by ", "caller_identity"),
             lambda: _ev(caller_identity=F.col("caller_identity"), count=F.col("count"),
                         distinct_endpoints=F.col("distinct_endpoints"), after_hours=F.col("after_hours"),
                         deviation_factor=_r("deviation_factor", 2))),
    "D-08": ("system", lambda: F.lit(""),
             lambda: F.lit("Alert fatigue: abnormal alert volume spike detected"),
             lambda: _ev(current_count=F.col("current_count"), baseline_avg=_r("baseline_avg", 2),
                         spike_ratio=_r("spike_ratio", 2))),
    "D-09": ("host", lambda: F.col("edge_node_id"),
             lambda: _title("Sensor spoofing detected on ", "edge_node_id"),
             lambda: _ev(edge_node_id=F.col("edge_node_id"), z_score=_r("z_score", 3),
                         protocol_violations=F.col("protocol_violations"), sensor_delta=F.col("sensor_delta"))),
    "D-10": ("account", lambda: F.col("partner_id"),
             lambda: _title("Partner compromise: anomalous activity from ", "partner_name"),
             lambda: _ev(partner_id=F.col("partner_id"), partner_name=F.col("partner_name"),
                         volume_deviation=_r("volume_deviation", 2), payload_z_score=_r("payload_z_score", 2),
                         mtls_failures=F.col("mtls_failures"))),
    "D-11": ("host", lambda: F.col("edge_node_id"),
             lambda: _title("Edge node compromise detected on ", "edge_node_id"),
             lambda: _ev(edge_node_id=F.col("edge_node_id"), boot_attestation=F.col("attestation_finding"),
                         disk_integrity=F.when(F.col("disk_failed"), F.lit("fail")),
                         cpu_utilisation=F.when(F.col("cpu_high"), F.col("cpu_utilisation")),
                         memory_utilisation=F.when(F.col("memory_high"), F.col("memory_utilisation")))),
}
_IMMEDIATE = ("D-05", "D-09", "D-11")


def as_detection(rule: str, df: DataFrame, now) -> DataFrame:
    """Project a rule output onto the shared result schema (16 columns)."""
    meta = RULES[rule]
    etype, ent, title, ev = _SHAPES[rule]
    cols = set(df.columns)
    tech = F.col("atlas_technique") if "atlas_technique" in cols else F.lit(meta.atlas_technique)
    trust = F.col("telemetry_trust_level") if "telemetry_trust_level" in cols else F.lit("trusted")
    att = F.col("attestation_status") if "attestation_status" in cols else F.lit("")
    return df.select(
        F.lit(meta.rule_id).alias("rule_id"),
        F.col("tenant_id") if "tenant_id" in cols else F.lit("default").alias("tenant_id"),
        F.lit(etype).alias("entity_type"), ent().cast("string").alias("entity_id"),
        title().alias("alert_title"), F.lit(meta.severity).alias("alert_severity"),
        tech.alias("atlas_technique"), F.lit(meta.attack_technique).alias("attack_technique"),
        F.lit(meta.threat_model_ref).alias("threat_model_ref"),
        F.col("confidence").cast("double").alias("confidence"), ev().alias("evidence"),
        F.lit(rule in _IMMEDIATE).alias("requires_immediate_action"),
        F.lit(meta.rule_id in SAFETY_RELEVANT_RULES).alias("safety_relevant"),
        time_lit(now).alias("detected_at"), trust.alias("telemetry_trust_level"), att.alias("attestation_status"),
    )


#: Error conditions that fail one rule: its table or one of its columns is missing.
MISSING = ("UNRESOLVED_COLUMN", "TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND", "FIELD_NOT_FOUND", "CANNOT_RESOLVE")
RULE_STATUS_SCHEMA = "rule_id string, ok boolean, error string"


def plan_rules(evaluations: dict[str, Callable[[], DataFrame]], now) -> tuple[dict[str, DataFrame], list[tuple]]:
    """Plan every rule: its detections, and a (rule, ok, error) row for each.

    A missing table or column fails that rule and is reported; the others still run. Any other
    error is not the rule's and is raised.
    """
    frames, status = {}, []
    for rule, build in evaluations.items():
        try:
            d = as_detection(rule, build(), now)
            d.schema  # analysis happens here
        except AnalysisException as e:
            condition = e.getCondition() or ""
            if not condition.startswith(MISSING):
                raise
            status.append((RULES[rule].rule_id, False, condition))
            continue
        frames[rule] = d
        status.append((RULES[rule].rule_id, True, None))
    return frames, status


def run_all(evaluations: dict[str, Callable[[], DataFrame]], now) -> DataFrame:
    """U-01/D-12: union of every rule in the result schema; ``rule_status`` tells which rules ran."""
    frames, status = plan_rules(evaluations, now)
    if not frames:
        raise ValueError(f"no rule could be planned: {status}")
    return reduce(DataFrame.unionByName, frames.values())


def rule_status(spark, evaluations: dict[str, Callable[[], DataFrame]], now) -> DataFrame:
    """D-12: one row per rule: whether it could run, what was missing if it could not, and what it detected (null if it did not run)."""
    frames, status = plan_rules(evaluations, now)
    planned = spark.createDataFrame(status, RULE_STATUS_SCHEMA)
    if not frames:
        return planned.withColumn("detections", F.lit(None).cast("long"))
    found = reduce(DataFrame.unionByName, frames.values()).groupBy("rule_id").agg(F.count(F.lit(1)).alias("detections"))
    return planned.join(found, "rule_id", "left").withColumn("detections", F.when(F.col("ok"), F.coalesce("detections", F.lit(0))))


def detection_audit(detections: DataFrame) -> DataFrame:
    """D-12: the audit event of each detection (type, actor and decision as the runner writes them)."""
    return detections.select(
        "tenant_id", F.lit("atlas.detection_fired").alias("event_type"), F.lit("decision").alias("event_category"),
        F.lit("system").alias("actor_type"), F.lit("atlas-detection").alias("actor_id"), "rule_id", "entity_id",
        F.lower("alert_severity").alias("severity"),
        F.to_json(F.struct("rule_id", "confidence", "atlas_technique", "safety_relevant")).alias("decision"))


def detections_to_alerts(det: DataFrame) -> DataFrame:
    """P-39: canonical alert rows (lower-case severity, technique list, JSON payload)."""
    techniques = F.filter(F.array(F.col("atlas_technique"), F.col("attack_technique")),
                          lambda x: x.isNotNull() & (x != ""))
    ts = F.date_format(F.col("detected_at"), "yyyy-MM-dd'T'HH:mm:ss")
    payload = F.to_json(F.struct("rule_id", "confidence", "evidence", "threat_model_ref",
                                 "requires_immediate_action", "safety_relevant"))
    return det.select(
        F.concat_ws("-", F.col("rule_id"), ts, F.substring(F.sha2(F.concat_ws("|", "entity_type", "entity_id",
                                                                              "alert_title"), 256), 1, 12))
        .alias("alert_id"),
        F.lit("atlas").alias("source"), ts.alias("timestamp"), F.col("alert_title").alias("title"),
        F.concat(F.lit("ATLAS detection: "), F.col("alert_title")).alias("description"),
        F.lower(F.col("alert_severity")).alias("severity"),
        F.array().cast("array<string>").alias("tactics"), techniques.alias("techniques"),
        F.lit("").alias("entities_raw"), F.lit("").alias("product"), F.col("tenant_id"),
        payload.alias("raw_payload"))


# ---------------------------------------------------------------------------
# E-01 richer poisoning rule (documented form), E-04 binned oracle health
# ---------------------------------------------------------------------------

#: Addresses in a detection's own row, unless it asks for another number or for all.
EVIDENCE_IPS = 10


def training_data_poisoning_detailed(audit: DataFrame, now, *, actions=SUSPICIOUS_ACTIONS,
                                     deviation_threshold: float = 3.0, distinct_threshold: int = 5,
                                     count_threshold: int = 50, high_ratio: float = 10.0,
                                     no_baseline_ratio: float = 999.0, evidence_ips: int | None = EVIDENCE_IPS) -> DataFrame:
    """E-01: D-01 with distinct actions, source addresses and first/last action time;
    severity High when the ratio exceeds 10; no baseline => ratio 999. One scan:
    baseline ``[now-30d, now-1d]``, current ``(now-24h, now)``.

    The row has the exact number of the user's addresses, a sketch of fixed size (``ip_sketch``, HyperLogLog: sketches of users
    or days merge with ``hll_union``) and, as evidence, the first ``evidence_ips`` of them, or with None all, distinct and sorted. They are also
    the rows of ``poisoning_addresses``."""
    dt = col_type(audit, "ts")
    cur = (F.col("ts") > time_lit(shift(now, hours=24), dt)) & (F.col("ts") < time_lit(now, dt))
    base = (F.col("ts") >= time_lit(shift(now, days=30), dt)) & (F.col("ts") <= time_lit(shift(now, days=1), dt))
    g = (audit.where(F.col("action").isin(*actions) & (F.col("ts") >= time_lit(shift(now, days=30), dt))
                     & (F.col("ts") < time_lit(now, dt)))
         .groupBy("tenant_id", "user_id")
         .agg(F.count_if(cur).alias("today_count"),
              F.count_distinct(F.when(cur, F.col("target_resource"))).alias("distinct_tables"),
              F.count_distinct(F.when(cur, F.col("action"))).alias("distinct_actions"),
              F.count_distinct(F.when(cur, F.col("source_ip"))).alias("distinct_source_ips"),
              F.min(F.when(cur, F.col("ts"))).alias("earliest_action"),
              F.max(F.when(cur, F.col("ts"))).alias("latest_action"),
              (F.count_if(base) / F.lit(30.0)).alias("avg_daily"))
         .where(F.col("today_count") > 0))
    dev = F.when(F.col("avg_daily") > 0, F.col("today_count") / F.col("avg_daily")).otherwise(F.lit(no_baseline_ratio))
    g = g.withColumn("deviation_factor", dev)
    fired = g.where((F.col("deviation_factor") > deviation_threshold) | (F.col("distinct_tables") > distinct_threshold)
                    | (F.col("today_count") > count_threshold))
    fired = _base("D-01", fired).withColumn(
        "severity", F.when(F.col("deviation_factor") > high_ratio, "High").otherwise("Medium")).withColumn(
        "confidence", F.least(F.lit(0.95), F.lit(0.5) + F.col("deviation_factor") / 20.0))
    ips = poisoning_addresses(audit, now, actions=actions)
    keys = [F.col(k).alias(f"_{k}") for k in ("tenant_id", "user_id")]
    sketches = ips.groupBy(*keys).agg(F.hll_sketch_agg("source_ip").alias("ip_sketch"))
    listed = ips.select(*keys, "source_ip")
    if evidence_ips is None:
        some = listed.groupBy("_tenant_id", "_user_id").agg(F.array_sort(F.collect_list("source_ip")).alias("source_ips"))
    else:
        some = bounded_collect(listed, ["_tenant_id", "_user_id"], evidence_ips, [F.col("source_ip")], F.col("source_ip"), "source_ips")
    same = F.col("tenant_id").eqNullSafe(F.col("_tenant_id")) & F.col("user_id").eqNullSafe(F.col("_user_id"))
    for side in (sketches, some):
        fired = fired.join(side, same, "left").drop("_tenant_id", "_user_id")
    return fired.withColumn("source_ips", F.coalesce("source_ips", F.array().cast("array<string>")))


def poisoning_addresses(audit: DataFrame, now, *, actions=SUSPICIOUS_ACTIONS) -> DataFrame:
    """E-01's members: one row per tenant, user and source address of the last 24 hours, with its actions and first and last time."""
    dt = col_type(audit, "ts")
    cur = (F.col("ts") > time_lit(shift(now, hours=24), dt)) & (F.col("ts") < time_lit(now, dt))
    return (audit.where(cur & F.col("action").isin(*actions) & F.col("source_ip").isNotNull()).groupBy("tenant_id", "user_id", "source_ip")
            .agg(F.count(F.lit(1)).alias("action_count"), F.min("ts").alias("first_action"), F.max("ts").alias("last_action")))


def oracle_health_bins(oracle: DataFrame, now, *, hours: int = 24, width: str = "5 minutes") -> DataFrame:
    """E-04: per tenant, node and 5-minute bin over the last ``hours``: checks, failures, errors, latency."""
    w = oracle.where(in_window(oracle, "ts", shift(now, hours=hours), now))
    return (w.groupBy("tenant_id", "edge_node_id", F.window("ts", width).alias("bin"))
            .agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("check_result") == "fail").alias("failures"),
                 F.count_if(F.col("error_state").isNotNull()).alias("errors"),
                 F.avg("latency_ms").alias("avg_latency_ms"), F.max("latency_ms").alias("max_latency_ms"))
            .select("tenant_id", "edge_node_id", F.col("bin.start").alias("bin_start"), "checks", "failures", "errors",
                    "avg_latency_ms", "max_latency_ms"))


# ---------------------------------------------------------------------------
# E-03 phrase-based NL-interface rule (documented form)
# ---------------------------------------------------------------------------

# Fixed values (must equal the reference's documented lists; matched against lower-cased text,
# so entries with capitals can never match — kept as written).
NL_INJECTION_PHRASES = (
    "ignore previous instructions", "ignore all instructions", "disregard your instructions", "forget your rules",
    "you are now", "new persona", "override safety", "bypass filter", "system prompt", "reveal your prompt",
    "DAN mode", "developer mode", "jailbreak", "pretend you are", "act as if you have no restrictions",
    "hypothetically if you could", "for educational purposes only", "ignore the above",
)
NL_ESCALATION_PHRASES = (
    "execute command", "run script", "modify setpoint", "change parameter", "override alarm", "disable safety",
    "bypass interlock", "adjust pressure", "increase temperature", "open valve", "close valve", "shutdown",
)


def nl_query_threats(queries: DataFrame, now=None, *, lookback_hours: int | None = 1,
                     long_query_tokens: int = 4000) -> DataFrame:
    """E-03: phrase counts (injection, escalation) per query; fires on any phrase, the safety
    filter or more than 4000 tokens; threat type, severity and technique as documented."""
    q = queries
    if now is not None and lookback_hours is not None:
        dt = col_type(q, "ts")
        q = q.where((F.col("ts") > time_lit(shift(now, hours=lookback_hours), dt)) & (F.col("ts") <= time_lit(now, dt)))
    low = F.lower(F.coalesce(F.col("query_text"), F.lit("")))
    inj = sum(F.contains(low, F.lit(p)).cast("int") for p in NL_INJECTION_PHRASES)
    esc = sum(F.contains(low, F.lit(p)).cast("int") for p in NL_ESCALATION_PHRASES)
    q = q.withColumn("injection_matches", inj).withColumn("escalation_matches", esc)
    safety = F.coalesce(F.col("safety_filter_triggered"), F.lit(False))
    fired = q.where((F.col("injection_matches") > 0) | (F.col("escalation_matches") > 0) | safety
                    | (F.col("token_count") > long_query_tokens))
    i, e = F.col("injection_matches") > 0, F.col("escalation_matches") > 0
    return (fired.withColumn("threat_type", F.when(e & i, "Injection+Escalation").when(e, "Prescriptive_Escalation")
                             .when(i, "Prompt_Injection").when(F.col("token_count") > long_query_tokens, "Suspicious_Length")
                             .otherwise("Safety_Filter_Triggered"))
            .withColumn("severity", F.when(e, "High").when(i & safety, "High").when(i, "Medium").otherwise("Low"))
            .withColumn("atlas_technique", F.when(i, "AML.T0051").otherwise("AML.T0054")))


def unregistered_models(running: DataFrame, registry: DataFrame, *, hash_col: str = "model_weight_hash",
                        registry_hash_col: str = "model_hash") -> DataFrame:
    """E-05: nodes running a model hash that is not a production hash of the registry.

    NOT IN semantics are made explicit: null hashes on either side never match (left anti on
    non-null keys), so one null in the registry does not silence the rule."""
    prod = registry.where((F.col("stage") == "Production") & F.col(registry_hash_col).isNotNull()) \
        .select(F.col(registry_hash_col).alias(hash_col)).distinct()
    return running.where(F.col(hash_col).isNotNull()).join(prod, hash_col, "left_anti")


EXTRACTION_THRESHOLD, AUTOMATION_GAP_MS = 100, 500
EXTRACTION_ENDPOINTS = ("%predict%", "%forecast%", "%inference%", "%query%", "%nl-query%")


def extraction_by_gap(api: DataFrame, now, *, threshold: int = EXTRACTION_THRESHOLD,
                      gap_ms: float = AUTOMATION_GAP_MS, lookback_hours: int = 6,
                      endpoints=EXTRACTION_ENDPOINTS) -> DataFrame:
    """E-02: per tenant and caller over the last 6 h on model endpoints: count, distinct endpoints, median gap
    between consecutive calls (exact median), session span; automation = median gap < 500 ms or
    > 2 endpoints; tiered confidence, reported above 0.65. Gaps are taken by ranges of a minute and the median by
    refined counts, so a caller with a third of all rows is no task of its own."""
    dt = col_type(api, "ts")
    like = F.lit(False)
    for p in endpoints:
        like = like | F.col("endpoint").like(p)
    w = api.where((F.col("ts") > time_lit(shift(now, hours=lookback_hours), dt)) & (F.col("ts") < time_lit(now, dt)) & like)
    # In whole microseconds: seconds as doubles would lose the last digits.
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    keys = ["tenant_id", "caller_identity"]
    g = (w.groupBy(*keys)
         .agg(F.count(F.lit(1)).alias("query_count"), F.count_distinct("endpoint").alias("distinct_endpoints"),
              ((epoch_seconds(F.max("ts")) - epoch_seconds(F.min("ts"))) / 60.0).alias("session_window_min"))
         .where(F.col("query_count") > threshold))
    g = add_percentiles(g, gaps(w, keys, micros).withColumn("gap_ms", F.col("gap_us") / 1000), keys, "gap_ms", {"median_gap_ms": 0.5})
    med = F.coalesce(F.col("median_gap_ms"), F.lit(9999.0))
    g = g.where((med < gap_ms) | (F.col("distinct_endpoints") > 2))
    conf = (F.when((F.col("query_count") > 500) & (med < 200), 0.95)
            .when((F.col("query_count") > 200) & (F.col("distinct_endpoints") > 3), 0.85)
            .when(F.col("query_count") > threshold, 0.70).otherwise(0.50))
    return g.withColumn("confidence", conf).where(F.col("confidence") > 0.65)


def title_hourly_flood(alerts: DataFrame, now, *, ratio_threshold: float = 5.0, baseline_days: int = 7,
                       lookback_hours: int = 6, product_like: str | None = None, ts_col: str = "created_at") -> DataFrame:
    """E-06 (per-title flood form): per tenant, alert title and hour bin of the last 6 h, the count vs the
    title's hourly average over ``[now-7d, now-6h]`` (divided by 7*24); ratio uses max(avg, 0.1);
    titles without a baseline are not reported (inner join)."""
    dt = col_type(alerts, ts_col)
    a = alerts
    if product_like is not None:
        a = a.where(F.col("product").ilike(product_like) | F.col("source").ilike(product_like))
    base = (a.where((F.col(ts_col) >= time_lit(shift(now, days=baseline_days), dt))
                    & (F.col(ts_col) <= time_lit(shift(now, hours=lookback_hours), dt)))
            .groupBy("tenant_id", "alert_title").agg((F.count(F.lit(1)) / F.lit(baseline_days * 24.0)).alias("hourly_avg")))
    cur = (a.where((F.col(ts_col) > time_lit(shift(now, hours=lookback_hours), dt)) & (F.col(ts_col) < time_lit(now, dt)))
           .groupBy("tenant_id", "alert_title", F.date_trunc("hour", F.col(ts_col)).alias("hour_bin"))
           .agg(F.count(F.lit(1)).alias("current_count")))
    j = cur.join(base, ["tenant_id", "alert_title"]).withColumn(
        "spike_ratio", F.col("current_count") / F.greatest(F.col("hourly_avg"), F.lit(0.1)))
    return j.where(F.col("spike_ratio") > ratio_threshold)


# Fixed values (must equal the reference): resource substrings of the insider-access form
SUSPICIOUS_RESOURCES = ("model-weights", "model-registry", "training-data",
                        "architecture-docs", "hyperparameters", "model-config")


def insider_resource_access(log: DataFrame, now, *, resources=SUSPICIOUS_RESOURCES, baseline_days: int = 30,
                            deviation_threshold: float = 5.0, distinct_threshold: int = 3,
                            after_hours_threshold: int = 5, count_threshold: int = 50) -> DataFrame:
    """E-06 (exfiltration form): accesses to resources matching any suspicious substring
    (case-insensitive), per tenant and user: the last 24 h vs the daily average over [now-30d, now-1d].
    Flagged on deviation > 5, > 3 distinct resources, > 5 after-hours accesses (hour < 6 or > 20)
    or > 50 accesses; users without a baseline get deviation 999. One scan: both windows are
    conditional aggregates of the rows in [now-30d, now)."""
    dt = col_type(log, "ts")
    hit = F.lit(False)
    for r in resources:
        hit = hit | F.col("target_resource").ilike(f"%{r}%")
    base_lo, base_hi = time_lit(shift(now, days=baseline_days), dt), time_lit(shift(now, days=1), dt)
    cur_lo, hi = time_lit(shift(now, hours=24), dt), time_lit(now, dt)
    in_base = (F.col("ts") >= base_lo) & (F.col("ts") <= base_hi)
    in_cur = F.col("ts") > cur_lo
    hour = F.hour("ts")
    g = (log.where((F.col("ts") >= base_lo) & (F.col("ts") < hi) & hit)
         .groupBy("tenant_id", "user_id")
         .agg((F.count_if(in_base) / F.lit(float(baseline_days))).alias("daily_avg"),
              F.count_if(in_cur).alias("access_count"),
              F.count_distinct(F.when(in_cur, F.col("target_resource"))).alias("distinct_resources"),
              F.count_distinct(F.when(in_cur, F.col("source_ip"))).alias("distinct_source_ips"),
              F.count_if(in_cur & ((hour < 6) | (hour > 20))).alias("after_hours_count"))
         .where(F.col("access_count") > 0))
    dev = F.when(F.col("daily_avg") > 0, F.col("access_count") / F.col("daily_avg")).otherwise(F.lit(999.0))
    g = g.withColumn("deviation_factor", dev)
    flagged = ((F.col("deviation_factor") > deviation_threshold) | (F.col("distinct_resources") > distinct_threshold)
               | (F.col("after_hours_count") > after_hours_threshold) | (F.col("access_count") > count_threshold))
    return g.where(flagged).withColumn(
        "confidence", F.least(F.lit(0.95), F.lit(0.6) + F.col("deviation_factor") / F.lit(30.0)))


def partner_direction_anomaly(log: DataFrame, now, *, baseline_days: int = 7, lookback_hours: int = 6,
                              volume_threshold: float = 3.0, payload_z_threshold: float = 3.0,
                              error_threshold: int = 10) -> DataFrame:
    """E-06 (per-direction partner form): per (tenant, partner, direction) the last 6 h vs a baseline over
    [now-7d, now-6h] (daily request rate, payload mean / sample stddev, mTLS rate). Flagged on
    volume deviation > 3 (current vs a quarter of a baseline day), payload z > 3, any mTLS failure
    where the normal rate exceeds 0.99, or > 10 errors. Pairs without a baseline are not reported."""
    dt = col_type(log, "ts")
    lo, mid, hi = (time_lit(shift(now, days=baseline_days), dt), time_lit(shift(now, hours=lookback_hours), dt),
                   time_lit(now, dt))
    base = (log.where((F.col("ts") >= lo) & (F.col("ts") <= mid))
            .groupBy("tenant_id", "partner_id", "direction")
            .agg((F.count(F.lit(1)) / F.lit(float(baseline_days))).alias("avg_daily_requests"),
                 F.avg("payload_size").alias("avg_payload_size"),
                 F.stddev_samp("payload_size").alias("std_payload_size"),
                 (F.count_if("mtls_verified") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("normal_mtls_rate")))
    cur = (log.where((F.col("ts") > mid) & (F.col("ts") < hi))
           .groupBy("tenant_id", "partner_id", "partner_name", "direction")
           .agg(F.count(F.lit(1)).alias("request_count"), F.avg("payload_size").alias("avg_payload"),
                F.max("payload_size").alias("max_payload"),
                F.count_if(F.col("response_code") >= 400).alias("error_count"),
                F.count_if(~F.col("mtls_verified")).alias("mtls_fail_count"),
                F.count_distinct("data_type").alias("distinct_data_types")))
    j = cur.join(base, ["tenant_id", "partner_id", "direction"])
    vol = F.when(F.col("avg_daily_requests") > 0, F.col("request_count") / (F.col("avg_daily_requests") / 4.0)) \
        .otherwise(F.lit(999.0))
    z = F.when(F.col("std_payload_size") > 0,
               (F.col("avg_payload") - F.col("avg_payload_size")) / F.col("std_payload_size")).otherwise(F.lit(0.0))
    j = (j.withColumn("volume_deviation", vol).withColumn("payload_z_score", z)
         .withColumn("mtls_anomalous", (F.col("mtls_fail_count") > 0) & (F.col("normal_mtls_rate") > 0.99)))
    return j.where((F.col("volume_deviation") > volume_threshold) | (F.col("payload_z_score") > payload_z_threshold)
                   | F.col("mtls_anomalous") | (F.col("error_count") > error_threshold))
