"""Exposure management: normalise scanner findings, score, upsert, correlate, report.

Findings arrive as one DataFrame with a ``source_tool`` column; each tool's
mapping is a column expression, so all four tools are normalised in ONE
projection (``dispatch``) rather than one job per tool. Unknown tools are
split off as rejects (dead letters) with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import (col_type, ctem_score, exposure_key, hours_between, lookup,
                                       severity_from_matrix, shift, sla_deadline, time_lit, zone_consequence)

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): per-tool mappings
# ---------------------------------------------------------------------------

CLOUD_EXPLOITABILITY = {"CRITICAL": "high", "HIGH": "high", "MEDIUM": "medium", "LOW": "low", "INFORMATIONAL": "low"}
CLOUD_EXPLOITABILITY_SCORE = {"high": 0.9, "medium": 0.5, "low": 0.2}
CLOUD_ZONES = {"edge": "Zone1_EdgeInference", "orbital": "Zone1_EdgeInference", "demo": "Zone4_External",
               "public": "Zone4_External"}
CLOUD_ZONE_DEFAULT = "Zone3_Enterprise"

ML_PACKAGES = ("torch", "pytorch", "tensorflow", "tf", "sklearn", "scikit-learn", "keras", "onnx", "onnxruntime",
               "xgboost", "lightgbm", "transformers", "huggingface")

PROBE_MAP = {
    "escalation": ("safety_life", "AML.T0051"),
    "tool_use": ("safety_life", "AML.T0051"),
    "prompt_injection": ("safety_life", "AML.T0051"),
    "extraction": ("data_loss", "AML.T0044.001"),
    "exfiltration": ("data_loss", "AML.T0044.001"),
    "jailbreak": ("safety_life", "AML.T0051"),
    "encoding": ("data_loss", "AML.T0051"),
}
PROBE_DEFAULT = ("data_loss", "AML.T0051")

ATTACK_MAP = {
    "poisoning": ("safety_life", "AML.T0020"),
    "evasion": ("equipment", "AML.T0015"),
    "extraction": ("data_loss", "AML.T0044"),
    "inference": ("data_loss", "AML.T0044.001"),
}
ATTACK_DEFAULT = ("equipment", "AML.T0000")

KNOWN_TOOLS = ("wiz", "snyk", "garak", "art")
KEEP_STATUSES = ("Verified", "Closed")

EXPOSURE_COLUMNS = ["exposure_key", "ts", "source_tool", "title", "description", "severity", "original_severity",
                    "asset_id", "asset_type", "asset_zone", "exploitability_score", "physical_consequence",
                    "ctem_score", "atlas_technique", "attack_technique", "threat_model_ref", "status",
                    "assigned_to", "sla_deadline", "remediation_guidance", "evidence_url", "tenant_id"]


def _opt(df: DataFrame, name: str, default=None) -> Column:
    if name in df.columns:
        return F.col(name)
    return F.lit(default)


def _clamp01(c: Column) -> Column:
    return F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(1.0))


def _rate_band(rate: Column) -> Column:
    return F.when(rate >= 0.7, "high").when(rate >= 0.3, "medium").otherwise("low")


def _cvss_band(score: Column) -> Column:
    return F.when(score >= 7.0, "high").when(score >= 3.0, "medium").otherwise("low")


def normalise(findings: DataFrame, keep: tuple[str, ...] = ("finding_id",)) -> DataFrame:
    """P-02..P-05 + P-07..P-11 for every known tool in one projection.

    Expected input columns (absent ones default): source_tool, title, asset_id, severity,
    resource_type, package_name, package_manager, exploitability_score (CVSS 0-10), probe_type,
    attack_type, success_rate, deployment_zone, asset_zone, detected_at (timestamp), tenant_id,
    description, remediation, url, atlas_technique, attack_technique, threat_model_ref, cve.
    """
    f = findings
    tool = F.lower(F.col("source_tool"))
    sev_raw = F.upper(F.coalesce(_opt(f, "severity"), F.lit("")))
    rtype = F.lower(F.coalesce(_opt(f, "resource_type"), F.lit("")))
    pkg = F.lower(F.coalesce(_opt(f, "package_name"), F.lit("")))
    cvss = F.coalesce(_opt(f, "exploitability_score").cast("double"), F.lit(0.0))
    rate = F.coalesce(_opt(f, "success_rate").cast("double"), F.lit(0.0))
    probe = F.lower(F.coalesce(_opt(f, "probe_type"), F.lit("")))
    attack = F.lower(F.coalesce(_opt(f, "attack_type"), F.lit("")))

    cloud_expl = lookup(CLOUD_EXPLOITABILITY, F.when(sev_raw == "", "MEDIUM").otherwise(sev_raw), "medium")
    is_ml = F.exists(F.array(*[F.lit(p) for p in ML_PACKAGES]), lambda p: F.instr(pkg, p) > 0)
    probe_cons = lookup({k: v[0] for k, v in PROBE_MAP.items()}, probe, PROBE_DEFAULT[0])
    probe_tech = lookup({k: v[1] for k, v in PROBE_MAP.items()}, probe, PROBE_DEFAULT[1])
    attack_cons = lookup({k: v[0] for k, v in ATTACK_MAP.items()}, attack, ATTACK_DEFAULT[0])
    attack_tech = lookup({k: v[1] for k, v in ATTACK_MAP.items()}, attack, ATTACK_DEFAULT[1])

    zone = (F.when(tool == "wiz", lookup(CLOUD_ZONES, rtype, CLOUD_ZONE_DEFAULT))
            .when(tool == "snyk", F.lit(CLOUD_ZONE_DEFAULT))
            .when(tool == "garak", F.coalesce(_opt(f, "deployment_zone"), F.lit(CLOUD_ZONE_DEFAULT)))
            .otherwise(F.coalesce(_opt(f, "asset_zone"), F.lit(CLOUD_ZONE_DEFAULT))))
    consequence = (F.when(tool == "wiz", zone_consequence(zone))
                   .when(tool == "snyk", F.when(is_ml, "safety_life").otherwise("data_loss"))
                   .when(tool == "garak", probe_cons).otherwise(attack_cons))
    expl_band = (F.when(tool == "wiz", cloud_expl).when(tool == "snyk", _cvss_band(cvss))
                 .otherwise(_rate_band(rate)))
    expl_score = (F.when(tool == "wiz", lookup(CLOUD_EXPLOITABILITY_SCORE, cloud_expl, 0.5))
                  .when(tool == "snyk", _clamp01(cvss / 10.0)).otherwise(_clamp01(rate)))
    asset_type = (F.when(tool == "wiz", F.coalesce(_opt(f, "resource_type"), F.lit("")))
                  .when(tool == "snyk", F.coalesce(_opt(f, "package_manager"), F.lit("")))
                  .when(tool == "garak", F.lit("llm_model")).otherwise(F.lit("ml_model")))
    atlas = (F.when(tool == "garak", probe_tech).when(tool == "art", attack_tech)
             .otherwise(F.coalesce(_opt(f, "atlas_technique"), F.lit(""))))
    attack_t = (F.when(tool == "snyk", F.coalesce(_opt(f, "attack_technique"), _opt(f, "cve"), F.lit("")))
                .otherwise(F.coalesce(_opt(f, "attack_technique"), F.lit(""))))
    orig_sev = F.when(tool.isin("wiz", "snyk") & (sev_raw == ""), "MEDIUM").otherwise(sev_raw)

    title = F.coalesce(_opt(f, "title"), F.lit(""))
    asset = F.coalesce(_opt(f, "asset_id"), F.lit(""))
    ts = F.col("detected_at")
    extra = [c for c in keep if c in f.columns]
    stage = f.select(
        *extra, tool.alias("source_tool"), title.alias("title"), asset.alias("asset_id"), ts.alias("ts"),
        F.coalesce(_opt(f, "description"), F.lit("")).alias("description"),
        orig_sev.alias("original_severity"), asset_type.alias("asset_type"), zone.alias("asset_zone"),
        expl_band.alias("_band"), expl_score.alias("exploitability_score"),
        consequence.alias("physical_consequence"), atlas.alias("atlas_technique"),
        attack_t.alias("attack_technique"), F.coalesce(_opt(f, "threat_model_ref"), F.lit("")).alias("threat_model_ref"),
        F.coalesce(_opt(f, "remediation"), F.lit("")).alias("remediation_guidance"),
        F.coalesce(_opt(f, "url"), F.lit("")).alias("evidence_url"),
        F.coalesce(_opt(f, "tenant_id"), F.lit("")).alias("tenant_id"))
    sev = severity_from_matrix(F.col("_band"), F.col("physical_consequence"))
    return stage.select(
        exposure_key(F.col("source_tool"), F.col("title"), F.col("asset_id")).alias("exposure_key"),
        "ts", "source_tool", "title", "description", sev.alias("severity"), "original_severity", "asset_id",
        "asset_type", "asset_zone", "exploitability_score", "physical_consequence",
        ctem_score(F.col("exploitability_score"), F.col("physical_consequence")).alias("ctem_score"),
        "atlas_technique", "attack_technique", "threat_model_ref", F.lit("Open").alias("status"),
        F.lit("").alias("assigned_to"), sla_deadline(sev, F.col("ts")).alias("sla_deadline"),
        "remediation_guidance", "evidence_url", "tenant_id", *extra)


def dispatch(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P-06/S-09: (normalised exposures of known tools, rejects with an error reason)."""
    known = F.lower(F.col("source_tool")).isin(*KNOWN_TOOLS)
    ok = normalise(findings.where(known))
    rejects = (findings.where(~known | F.col("source_tool").isNull())
               .withColumn("error", F.concat(F.lit("unsupported source: "),
                                             F.coalesce(F.col("source_tool"), F.lit("null")))))
    return ok, rejects


# ---------------------------------------------------------------------------
# Upsert (S-11), insert-if-absent (S-14)
# ---------------------------------------------------------------------------

def latest_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, first by ``order`` (in-batch duplicates: latest wins)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def upsert_exposures(existing: DataFrame, incoming: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """S-11: key conflict updates ts/severity/score; Verified/Closed status is kept; new keys insert.

    One full outer join on ``exposure_key`` (sort-merge; bucket both tables on the
    key to make it shuffle-free). Incoming duplicates: latest ``ts`` wins.
    """
    if order is None:
        order = [F.desc("ts")] + ([F.desc("finding_id")] if "finding_id" in incoming.columns else [])
    inc = latest_per_key(incoming, "exposure_key", order)
    o = existing.alias("o")
    n = inc.alias("n")
    j = o.join(n, F.col("o.exposure_key") == F.col("n.exposure_key"), "full_outer")
    has_old, has_new = F.col("o.exposure_key").isNotNull(), F.col("n.exposure_key").isNotNull()
    out = []
    for c in EXPOSURE_COLUMNS:
        oc, nc = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == "status":
            v = F.when(has_old & oc.isin(*KEEP_STATUSES), oc).when(has_new, nc).otherwise(oc)
        elif c in ("ts", "severity", "ctem_score"):
            v = F.when(has_new, nc).otherwise(oc)
        else:
            v = F.when(has_old, oc).otherwise(nc)
        out.append(v.alias(c))
    out.append(F.when(has_new & has_old, "updated").when(has_new, "inserted").otherwise("unchanged").alias("change"))
    return j.select(*out)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """S-14: ``ON CONFLICT DO NOTHING`` = anti-join then append."""
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti"))


# ---------------------------------------------------------------------------
# Correlation and reporting (J-05, A-19, P-13, E-07, E-10)
# ---------------------------------------------------------------------------

def open_exposures_for_assets(assets: DataFrame, exposures: DataFrame, now, *, asset_col: str = "asset_id",
                              stale_hours: float = 24.0) -> DataFrame:
    """J-05: each alert asset -> all open exposures (not Verified/Closed) of its tenant, with staleness
    (P-38) and hours left to the SLA deadline."""
    ex = exposures.where(~F.col("status").isin(*KEEP_STATUSES)).select(
        F.col("tenant_id").alias("_tenant"), "asset_id", "exposure_key", "severity", "ctem_score", "source_tool", "status",
        "sla_deadline", "ts")
    j = assets.join(ex, (assets[asset_col] == ex["asset_id"]) & (assets["tenant_id"] == ex["_tenant"]),
                    "inner").drop(ex["asset_id"]).drop("_tenant")
    nowc = time_lit(now, col_type(exposures, "ts"))
    return (j.withColumn("stale", F.coalesce(F.col("ts") < time_lit(shift(now, hours=stale_hours),
                                                                     col_type(exposures, "ts")), F.lit(True)))
            .withColumn("sla_hours_left", hours_between(F.col("sla_deadline"), nowc)))


def exposure_stats(exposures: DataFrame) -> DataFrame:
    """A-19: counts by severity, by status (lower-cased, Q10) and by tool in ONE pass (GROUPING SETS),
    with open counts alongside."""
    e = exposures.withColumn("status_lc", F.lower(F.col("status")))
    g = (e.groupingSets([["severity"], ["status_lc"], ["source_tool"], []], "severity", "status_lc", "source_tool")
         .agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("status_lc") == "open").alias("open_count"),
              F.avg("ctem_score").alias("avg_score"), F.grouping_id().alias("gid")))
    dim = (F.when(F.col("gid") == 3, "severity").when(F.col("gid") == 5, "status")
           .when(F.col("gid") == 6, "source_tool").otherwise("total"))
    key = F.when(F.col("gid") == 7, F.lit("")).otherwise(
        F.coalesce(F.col("severity"), F.col("status_lc"), F.col("source_tool"), F.lit("")))
    return g.select(dim.alias("dimension"), key.alias("key"), "count", "open_count", "avg_score")


def list_exposures(exposures: DataFrame, *, severity: str | None = None, status: str | None = None,
                   source_tool: str | None = None, tenant_id: str | None = None, limit: int = 50,
                   offset: int = 0) -> DataFrame:
    """P-13: filtered, highest score first, paged with a unique tie-break."""
    cond = F.lit(True)
    if severity:
        cond = cond & (F.col("severity") == severity)
    if status:
        cond = cond & (F.lower(F.col("status")) == status.lower())
    if source_tool:
        cond = cond & (F.col("source_tool") == source_tool)
    if tenant_id:
        cond = cond & (F.col("tenant_id") == tenant_id)
    out = exposures.where(cond).orderBy(F.desc("ctem_score"), F.asc("exposure_key"))
    return (out.offset(offset) if offset else out).limit(limit)


def sla_breaches(exposures: DataFrame, now, *, at_risk_hours: int = 24) -> DataFrame:
    """E-10: open exposures past their deadline (escalation level by hours overdue) or due within 24 h."""
    nowc = time_lit(now, col_type(exposures, "sla_deadline"))
    over = hours_between(nowc, F.col("sla_deadline"))
    e = exposures.where(~F.col("status").isin(*KEEP_STATUSES))
    return (e.withColumn("hours_overdue", over)
            .withColumn("sla_state", F.when(over > 0, "breached").when(over > -at_risk_hours, "at_risk")
                        .otherwise("on_track"))
            .withColumn("escalation_level", F.when(over > 168, 3).when(over > 72, 2).when(over > 0, 1).otherwise(0))
            .where(F.col("sla_state") != "on_track"))


def weekly_risk_trend(exposures: DataFrame, now, *, days: int = 180,
                      open_statuses: tuple[str, ...] = ("Open", "InProgress")) -> DataFrame:
    """E-12: weekly (Monday) counts by severity, mean/max score and severity-weighted risk posture
    over open exposures of the last 180 days, with week-over-week change (lag over the weekly rows,
    at most 27 of them)."""
    from pyspark.sql import Window
    dt = col_type(exposures, "ts")
    e = exposures.where((F.col("ts") > time_lit(shift(now, days=days), dt)) & (F.col("ts") < time_lit(now, dt))
                        & F.col("status").isin(*open_statuses))
    weight = F.when(F.col("severity") == "CRITICAL", 4).when(F.col("severity") == "HIGH", 3) \
        .when(F.col("severity") == "MEDIUM", 2).otherwise(1)
    g = e.groupBy(F.date_trunc("week", F.col("ts")).alias("week")).agg(
        F.count(F.lit(1)).alias("total_exposures"),
        *[F.count_if(F.col("severity") == s).alias(f"{s.lower()}_count") for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
        F.round(F.avg("ctem_score"), 1).alias("avg_ctem_score"), F.max("ctem_score").alias("max_ctem_score"),
        F.round(F.sum(F.col("ctem_score") * weight) / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("risk_posture_score"))
    prev = F.lag("risk_posture_score").over(Window.orderBy("week"))
    has_prev = prev.isNotNull() & (prev != 0)
    return (g.withColumn("week_over_week_change", F.when(has_prev, F.round(F.col("risk_posture_score") - prev, 1)))
            .withColumn("trend", F.when(has_prev & (F.col("risk_posture_score") < prev), "IMPROVING").otherwise("DEGRADING")))


def new_assets(observations: DataFrame, now, *, recent_days: int = 7, prior_days: int = 30,
               asset_col: str = "asset_id", ts_col: str = "ts") -> DataFrame:
    """E-17: assets seen in the last 7 days that were not seen in the 30 days before (anti-join)."""
    dt = col_type(observations, ts_col)
    start = shift(now, days=recent_days)
    recent = observations.where((F.col(ts_col) >= time_lit(start, dt)) & (F.col(ts_col) < time_lit(now, dt))) \
        .groupBy(asset_col).agg(F.min(ts_col).alias("first_seen"))
    prior = observations.where((F.col(ts_col) >= time_lit(shift(start, days=prior_days), dt))
                               & (F.col(ts_col) < time_lit(start, dt))).select(asset_col).distinct()
    return recent.join(prior, asset_col, "left_anti")


def campaign_gaps(validations: DataFrame, alerts: DataFrame) -> DataFrame:
    """E-08: per campaign, the documented gap analysis (validations LEFT JOIN alerts seen during the
    campaign window on exposure = alert title) computed from per-validation match counts instead of
    the joined pairs: a validation with m matching alerts stands for max(m, 1) joined rows.

    ``validations``: (campaign_id, validation_id, exposure_id, ts, exploitable, detection_evaded,
    physical_consequence_demonstrated); ``alerts``: (alert_title, ts)."""
    v = validations.where(F.col("exploitable"))
    win = v.groupBy("campaign_id").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    keys = v.select("campaign_id", "exposure_id").distinct().join(win, "campaign_id")
    a = alerts.select(F.col("alert_title").alias("exposure_id"), F.col("ts").alias("alert_ts"))
    m = (keys.join(a, "exposure_id").where(F.col("alert_ts").between(F.col("start_time"), F.col("end_time")))
         .groupBy("campaign_id", "exposure_id").agg(F.count(F.lit(1)).alias("m")))
    j = v.join(m, ["campaign_id", "exposure_id"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    rows = F.greatest(F.col("m"), F.lit(1))
    ev, phys = F.col("detection_evaded"), F.col("physical_consequence_demonstrated")
    g = j.groupBy("campaign_id").agg(
        F.sum(rows).alias("total_tests"), F.sum("m").alias("detected_count"),
        F.sum(F.when(ev & ~phys, rows).otherwise(0)).alias("detection_gaps"),
        F.sum(F.when(ev & phys, rows).otherwise(0)).alias("critical_gaps"),
        F.sum(F.when(~ev & (F.col("m") == 0), 1).otherwise(0)).alias("timing_gaps"))
    return g.withColumn("exploitable_count", F.col("total_tests")).withColumn(
        "detection_rate", F.round(F.col("detected_count") * 100.0 / F.greatest(F.col("exploitable_count"), F.lit(1)), 1))


# Fixed values (must equal the documented technique list).
KNOWN_TECHNIQUES = (
    ("AML.T0020", "TM-01", "Poison Training Data"),
    ("AML.T0043", "TM-03/06/08", "Craft Adversarial Data"),
    ("AML.T0015", "TM-07/17", "Evade ML Model"),
    ("AML.T0044", "TM-04/11", "Full ML Model Access"),
    ("AML.T0044.001", "TM-12", "Query-Based Model Extraction"),
    ("AML.T0051", "TM-10", "LLM Prompt Injection"),
    ("AML.T0054", "TM-10", "LLM Jailbreak"),
    ("AML.T0029", "TM-09/14", "Denial of ML Service"),
    ("AML.T0010", "TM-05/15", "ML Supply Chain Compromise"),
    ("AML.T0018", "TM-05", "Backdoor ML Model"),
    ("AML.T0035.001", "TM-04", "Physical Access to ML Model"),
    ("AML.T0035.002", "TM-11", "Insider Access to ML Model"),
    ("AML.T0014", "TM-20", "Discover ML Model Ontology"),
    ("AML.T0024", "TM-13", "Infer Training Data Membership"),
    ("AML.T0048.003", "TM-02", "Exploit via Model-Serving Interface"),
)


def coverage_matrix(known: DataFrame, ctem: DataFrame, runtime: DataFrame, validation: DataFrame) -> DataFrame:
    """E-14: technique list LEFT JOIN three evidence aggregates (atlas_technique, n); coverage score
    = number of evidence kinds; status FULL / DETECTION_ONLY / DISCOVERY_ONLY / NO_COVERAGE."""
    def agg(df, name):
        return df.where(F.coalesce(F.col("atlas_technique"), F.lit("")) != "").groupBy("atlas_technique") \
            .agg(F.count(F.lit(1)).alias(name))
    j = (known.join(agg(ctem, "ctem_findings"), "atlas_technique", "left")
         .join(agg(runtime, "runtime_alerts"), "atlas_technique", "left")
         .join(agg(validation, "validation_tests"), "atlas_technique", "left"))
    hc, hr, hv = (F.col(c).isNotNull() for c in ("ctem_findings", "runtime_alerts", "validation_tests"))
    return j.select("atlas_technique", "threat_model_ref", "technique_name",
                    hc.alias("has_ctem_discovery"), F.coalesce("ctem_findings", F.lit(0)).alias("ctem_findings"),
                    hr.alias("has_runtime_detection"), F.coalesce("runtime_alerts", F.lit(0)).alias("runtime_alerts"),
                    hv.alias("has_red_team_validation"),
                    (hc.cast("int") + hr.cast("int") + hv.cast("int")).alias("coverage_score"),
                    F.when(hc & hr & hv, "FULL_COVERAGE").when(hr, "DETECTION_ONLY").when(hc, "DISCOVERY_ONLY")
                    .otherwise("NO_COVERAGE").alias("coverage_status"))


def weekly_triage(exposures: DataFrame, runtime_counts: DataFrame, now, *, days: int = 90,
                  open_statuses: tuple[str, ...] = ("Open", "InProgress"), boost: float = 1.5) -> DataFrame:
    """E-07: open exposures of the last 90 days LEFT JOIN runtime alert counts by tenant and technique;
    score x1.5 when seen at runtime, SLA status, days open and the 7-level triage priority.

    ``runtime_counts``: (tenant_id, atlas_technique, runtime_alerts) — one row per tenant and technique."""
    dt = col_type(exposures, "ts")
    nowc = time_lit(now, dt)
    e = exposures.where(F.col("status").isin(*open_statuses) & (F.col("ts") > time_lit(shift(now, days=days), dt))
                        & (F.col("ts") < nowc))
    j = e.join(runtime_counts, ["tenant_id", "atlas_technique"], "left")
    seen = F.col("runtime_alerts").isNotNull()
    sla = (F.when(nowc > F.col("sla_deadline"), "BREACHED")
           .when(hours_between(F.col("sla_deadline"), nowc) < 24, "AT_RISK").otherwise("ON_TRACK"))
    sev = F.col("severity")
    j = j.withColumn("adjusted_score", F.when(seen, F.col("ctem_score") * boost).otherwise(F.col("ctem_score"))) \
        .withColumn("sla_status", sla) \
        .withColumn("days_open", F.floor(hours_between(nowc, F.col("ts")) / 24).cast("int"))
    return j.withColumn("triage_priority", F.when((sev == "CRITICAL") & (F.col("sla_status") == "BREACHED"), 1)
                        .when(sev == "CRITICAL", 2).when((sev == "HIGH") & (F.col("sla_status") == "BREACHED"), 3)
                        .when((sev == "HIGH") & seen, 4).when(sev == "HIGH", 5).when(sev == "MEDIUM", 6).otherwise(7))


def runtime_correlation(exposures: DataFrame, alerts: DataFrame) -> DataFrame:
    """E-09: exposures whose technique is also seen in runtime alerts of their tenant. Instead of emitting every
    (exposure, alert) pair of a technique, each exposure carries the technique's alert count and
    latest alert (max_by): one aggregate of the alerts, one equi-join."""
    a = alerts.where(F.coalesce(F.col("atlas_technique"), F.lit("")) != "").groupBy("tenant_id", "atlas_technique").agg(
        F.count(F.lit(1)).alias("runtime_alerts"), F.max_by("alert_title", F.struct("ts", "alert_title")).alias("latest_alert"))
    return exposures.join(a, ["tenant_id", "atlas_technique"]).withColumn("combined_severity", F.lit("CRITICAL"))


VALIDATION_TYPES = ("manual_red_team", "adversarial_ml", "full_campaign")


def campaign_effectiveness(validations: DataFrame, now, *, days: int = 365) -> DataFrame:
    """E-13: per campaign over the last year (listed validation types): tests, exploitable,
    evaded, physical-consequence counts, distinct types, and exploit/evasion/detection rates."""
    dt = col_type(validations, "ts")
    v = validations.where((F.col("ts") > time_lit(shift(now, days=days), dt)) & (F.col("ts") < time_lit(now, dt))
                          & F.col("validation_type").isin(*VALIDATION_TYPES))
    g = v.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("total_tests"), F.count_if("exploitable").alias("exploitable_findings"),
        F.count_if("detection_evaded").alias("detection_evaded_count"),
        F.count_if("physical_consequence_demonstrated").alias("physical_consequence_count"),
        F.count_distinct("validation_type").alias("unique_types"))
    ex = F.greatest(F.col("exploitable_findings"), F.lit(1))
    tot = F.greatest(F.col("total_tests"), F.lit(1))
    return (g.withColumn("exploit_rate", F.round(F.col("exploitable_findings") * 100.0 / tot, 1))
            .withColumn("evasion_rate", F.round(F.col("detection_evaded_count") * 100.0 / ex, 1))
            .withColumn("detection_rate", F.round((F.col("exploitable_findings") - F.col("detection_evaded_count")) * 100.0 / ex, 1)))


def new_detection_gaps(validations: DataFrame, now, *, hours: int = 1) -> DataFrame:
    """E-15: validations of the last hour that evaded detection, with gap severity
    (physical consequence -> CRITICAL, low exploit complexity -> HIGH, else MEDIUM)."""
    dt = col_type(validations, "ts")
    v = validations.where((F.col("ts") > time_lit(shift(now, hours=hours), dt)) & (F.col("ts") <= time_lit(now, dt))
                          & F.col("detection_evaded"))
    return v.withColumn("gap_severity", F.when(F.col("physical_consequence_demonstrated"), "CRITICAL")
                        .when(F.col("exploit_complexity") == "low", "HIGH").otherwise("MEDIUM"))


# ---------------------------------------------------------------------------
# E-11 weekly operational KPIs
# ---------------------------------------------------------------------------

def remediations(findings: DataFrame, exposures: DataFrame) -> DataFrame:
    """Remediation rows for Verified exposures: assigned at the key's first detection, verified at
    its last (the confirming re-scan); the SLA deadline is the exposure's."""
    span = findings.groupBy("exposure_key").agg(F.min("ts").alias("assigned_date"), F.max("ts").alias("verified_date"))
    v = exposures.where(F.col("status") == "Verified").select("exposure_key", "sla_deadline")
    return v.join(span, "exposure_key").select(
        F.col("exposure_key").alias("exposure_id"), "assigned_date", "verified_date", "sla_deadline",
        F.lit("Verified").alias("status"), F.col("verified_date").alias("ts"))


def weekly_kpis(remediations: DataFrame, exposures: DataFrame, now, *, days: int = 30) -> DataFrame:
    """E-11 (one row): MTTR over verified remediations of the last 30 days, the same restricted to
    exposures that are CRITICAL (semi-join flag), SLA compliance, and the month-over-month count of
    distinct CRITICAL/HIGH exposure keys. Windows end at ``now``."""
    dt = col_type(remediations, "ts")
    lo, hi = time_lit(shift(now, days=days), dt), time_lit(now, dt)
    crit = exposures.where(F.col("severity") == "CRITICAL").select(
        F.col("exposure_key").alias("exposure_id")).distinct().withColumn("_crit", F.lit(True))
    r = (remediations.where((F.col("status") == "Verified") & (F.col("ts") > lo) & (F.col("ts") < hi))
         .join(crit, "exposure_id", "left"))
    hrs = hours_between(F.col("verified_date"), F.col("assigned_date"))
    on_time = F.col("verified_date") <= F.col("sla_deadline")
    m = r.agg(F.round(F.coalesce(F.avg(hrs), F.lit(0.0)), 1).alias("mttr_all_hours"),
              F.round(F.coalesce(F.avg(F.when(F.col("_crit"), hrs)), F.lit(0.0)), 1).alias("mttr_critical_hours"),
              F.count(F.lit(1)).alias("verified_total"), F.count_if(on_time).alias("on_time"))
    m = m.withColumn("sla_compliance_rate",
                     F.round(F.col("on_time") * 100.0 / F.greatest(F.col("verified_total"), F.lit(1)), 1))
    edt = col_type(exposures, "ts")
    e_lo, e_mid, e_hi = (time_lit(shift(now, days=2 * days), edt), time_lit(shift(now, days=days), edt),
                         time_lit(now, edt))
    ch = exposures.where(F.col("severity").isin("CRITICAL", "HIGH") & (F.col("ts") >= e_lo) & (F.col("ts") < e_hi))
    red = ch.agg(F.count_distinct(F.when(F.col("ts") > e_mid, F.col("exposure_key"))).alias("attack_path_current_month"),
                 F.count_distinct(F.when(F.col("ts") <= e_mid, F.col("exposure_key"))).alias("attack_path_prior_month"))
    return m.crossJoin(red)


def kpi_breakdowns(exposures: DataFrame, now, *, days: int = 30) -> DataFrame:
    """E-11 breakdowns as (metric, key, count): open exposures by severity and findings per source
    tool over the last 30 days."""
    dt = col_type(exposures, "ts")
    open_ = (exposures.where(F.col("status").isin("Open", "InProgress")).groupBy(F.col("severity").alias("key"))
             .agg(F.count(F.lit(1)).alias("count")).withColumn("metric", F.lit("open_exposures")))
    tools = (exposures.where((F.col("ts") > time_lit(shift(now, days=days), dt)) & (F.col("ts") < time_lit(now, dt)))
             .groupBy(F.col("source_tool").alias("key")).agg(F.count(F.lit(1)).alias("count"))
             .withColumn("metric", F.lit("tool_coverage")))
    return open_.unionByName(tools).select("metric", "key", "count")
