"""Readers for the driver's tables and the role views built on them.

A role view is a plain ``select`` that gives a driver table the column names
an operator expects (``events`` read as an audit log, ``orders`` read as the
investigation table, ...). Each has a DuckDB twin in ``plans/oracle.py``
with the same expressions, so oracle checks compare like with like.

Readers never ``select *``: each view lists its columns, so Parquet column
pruning and filter pushdown reach the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import apply_runtime_defaults

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixture clocks: every ``now`` of the reference is an explicit parameter.
EVENTS_NOW = "2024-01-31 00:00:00"
INVESTIGATIONS_NOW = "1998-08-02 06:00:00"
EXPOSURES_NOW = "1998-12-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_runtime_defaults(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to as many tasks as a shuffle has: for small rows that much work follows on."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _k(props: str = "props") -> Column:
    return F.get_json_object(F.col(props), "$.k").cast("bigint")


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _node(mod: int = 20) -> Column:
    return F.concat(F.lit("node-"), _s(F.col("user_id") % mod))


# ---------------------------------------------------------------------------
# Telemetry roles on ``events``
# ---------------------------------------------------------------------------

def audit_log(spark, sf_dir) -> DataFrame:
    """Workspace audit log (D-01, E-01)."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.lit("default").alias("tenant_id"), "ts",
        _s("user_id").alias("user_id"),
        F.col("event_type").alias("action"),
        _s(_k()).alias("target_resource"),
        F.concat(F.lit("10.0."), _s(F.col("user_id") % 250), F.lit("."), _s(_k() % 250)).alias("source_ip"),
    )


def query_log(spark, sf_dir) -> DataFrame:
    """Natural-language query log (D-02, D-03, E-02, E-03)."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.lit("default").alias("tenant_id"), "ts",
        _s("user_id").alias("user_id"),
        _s(_k()).alias("session_id"),
        F.col("value").alias("token_count"),
        (F.col("event_type") == "error").alias("safety_filter_triggered"),
    )


def api_log(spark, sf_dir) -> DataFrame:
    """API access log (D-07)."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.lit("default").alias("tenant_id"), "ts",
        _s("user_id").alias("caller_identity"),
        F.concat(F.lit("/v1/"), F.element_at(F.array(*[F.lit(x) for x in ("predict", "forecast", "inference", "nl-query",
                                                                         "status")]), (_k() % 5 + 1).cast("int")),
                 F.lit("/"), _s(_k())).alias("endpoint"),
        F.col("event_type").alias("method"),
    )


def inference_log(spark, sf_dir) -> DataFrame:
    """Edge inference log (D-04)."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.lit("default").alias("tenant_id"), "ts",
        _node().alias("edge_node_id"),
        (F.lit(1.0) - F.col("value") / F.lit(500.0)).alias("confidence_score"),
        (F.col("value") * F.lit(4.0)).alias("inference_latency_ms"),
        F.when(F.col("event_type") == "error", "fail").otherwise("pass").alias("physics_check_result"),
    )


def oracle_log(spark, sf_dir) -> DataFrame:
    """Physics-oracle check log (D-05, E-04)."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.lit("default").alias("tenant_id"), "ts",
        _node().alias("edge_node_id"),
        F.when(F.col("event_type") == "error", "fail").otherwise("pass").alias("check_result"),
        (F.col("value") * F.lit(25.0)).alias("latency_ms"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("E"), _s(_k()))).alias("error_state"),
    )


def sensor_log(spark, sf_dir) -> DataFrame:
    """Industrial sensor telemetry (D-09)."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.lit("default").alias("tenant_id"), "ts",
        _node().alias("edge_node_id"),
        (F.lit(10) + _k() % 8).alias("sensor_count"),
        F.col("value").alias("data_points_received"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("protocol_violations"),
        F.when(F.col("event_type") == "signup", "reconnecting").otherwise("connected").alias("connection_state"),
    )


def edge_telemetry(spark, sf_dir) -> DataFrame:
    """Edge node health (D-11)."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.lit("default").alias("tenant_id"), "ts",
        _node().alias("edge_node_id"),
        F.when(F.col("event_type") == "error", "fail")
         .when(F.col("event_type") == "signup", F.lit(None).cast("string"))
         .otherwise("pass").alias("boot_attestation"),
        F.when((F.col("event_type") == "purchase") & (_k() % 10 == 0), "fail").otherwise("ok").alias("disk_integrity"),
        (F.col("value") / F.lit(480.0)).alias("cpu_utilisation"),
        (_k() / F.lit(100.0)).alias("memory_utilisation"),
    )


def partner_log(spark, sf_dir) -> DataFrame:
    """Partner API log (D-10)."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.lit("default").alias("tenant_id"), "ts",
        F.concat(F.lit("p"), _s(F.col("user_id") % 15)).alias("partner_id"),
        F.concat(F.lit("partner-"), _s(F.col("user_id") % 15)).alias("partner_name"),
        F.col("value").alias("payload_size"),
        (F.col("event_type") != "error").alias("mtls_verified"),
    )


# Resource kinds of the derived access log; six of them are on the E-06 suspicious list.
RESOURCE_KINDS = ["model-weights", "training-data", "notebooks", "model-registry", "dashboards",
                  "hyperparameters", "jobs", "architecture-docs", "clusters", "model-config"]


def resource_access_log(spark, sf_dir) -> DataFrame:
    """Workspace access log with named resources (E-06 insider form): kind/k."""
    e = read(spark, sf_dir, "events")
    kind = F.element_at(F.array(*[F.lit(x) for x in RESOURCE_KINDS]), (F.pmod(_k(), F.lit(len(RESOURCE_KINDS))) + 1).cast("int"))
    return e.select(
        F.lit("default").alias("tenant_id"), "ts",
        _s("user_id").alias("user_id"),
        F.concat(kind, F.lit("/"), _s(_k())).alias("target_resource"),
        F.concat(F.lit("10.0."), _s(F.col("user_id") % 250), F.lit("."), _s(_k() % 250)).alias("source_ip"),
    )


def partner_traffic(spark, sf_dir) -> DataFrame:
    """Partner API log with direction, data type and response code (E-06 per-direction form)."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.lit("default").alias("tenant_id"), "ts",
        F.concat(F.lit("p"), _s(F.col("user_id") % 15)).alias("partner_id"),
        F.concat(F.lit("partner-"), _s(F.col("user_id") % 15)).alias("partner_name"),
        F.when(_k() % 2 == 0, "inbound").otherwise("outbound").alias("direction"),
        F.concat(F.lit("dt-"), _s(_k() % 6)).alias("data_type"),
        F.col("value").alias("payload_size"),
        F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404)
        .otherwise(200).alias("response_code"),
        (F.col("event_type") != "error").alias("mtls_verified"),
    )


def model_registry(spark, sf_dir) -> DataFrame:
    """Model registry changes (D-06)."""
    e = read(spark, sf_dir, "events")
    k = _k()
    return e.select(
        F.lit("default").alias("tenant_id"), "ts",
        _s("user_id").alias("user_id"),
        F.when(F.col("event_type") == "purchase", "stage_transition").otherwise("register").alias("action"),
        F.concat(F.lit("model-"), _s(k % 10)).alias("model_name"),
        _s(k).alias("model_version"),
        F.when(k % 3 == 0, "Production").otherwise("Staging").alias("stage"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, F.lit(""))
         .otherwise(F.concat(F.lit("approver-"), _s("user_id"))).alias("approved_by"),
    )


def cicd_audit(spark, sf_dir) -> DataFrame:
    """CI/CD pipeline runs (D-06)."""
    e = read(spark, sf_dir, "events")
    k = _k()
    return e.select(
        F.lit("default").alias("tenant_id"), "ts",
        F.concat(F.lit("pipe-"), _s(k % 12)).alias("pipeline_id"),
        _s("event_id").alias("commit_hash"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("dep-"), _s(k)))
         .when(F.col("event_type") == "click", F.lit("")).alias("dependency_changes"),
        F.when(F.col("value") < 100, 0).otherwise(1).alias("tests_passed"),
        _s("user_id").alias("deployer"),
    )


# ---------------------------------------------------------------------------
# Investigations on ``orders``
# ---------------------------------------------------------------------------

PRIORITY_SEVERITY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium",
                     "4-NOT SPECIFIED": "low", "5-LOW": "informational"}


def investigations(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    sev = F.when(F.col("o_orderpriority") == "1-URGENT", "critical") \
        .when(F.col("o_orderpriority") == "2-HIGH", "high") \
        .when(F.col("o_orderpriority") == "3-MEDIUM", "medium") \
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "low").otherwise("informational")
    state = (F.when(F.col("o_orderstatus") == "F", "closed")
             .when((F.col("o_orderstatus") == "O") & (key % 4 == 0), "awaiting_human")
             .when((F.col("o_orderstatus") == "O") & (key % 4 == 1), "enriching")
             .when((F.col("o_orderstatus") == "O") & (key % 4 == 2), "reasoning")
             .when(F.col("o_orderstatus") == "O", "received")
             .when(key % 2 == 0, "responding").otherwise("failed"))
    classification = (F.when(F.col("o_orderstatus") != "F", F.lit(""))
                      .when(key % 3 == 0, "false_positive")
                      .when(key % 3 == 1, "true_positive").otherwise("benign"))
    return o.select(
        _s(key).alias("investigation_id"),
        F.concat(F.lit("alert-"), _s(key)).alias("alert_id"),
        F.concat(F.lit("t"), _s(F.col("o_custkey") % 4)).alias("tenant_id"),
        state.alias("state"),
        sev.alias("severity"),
        classification.alias("classification"),
        F.concat(F.lit("Suspicious sign-in pattern "), _s(F.col("o_custkey") % 40)).alias("alert_title"),
        ((key % 100) / F.lit(100.0)).alias("confidence"),
        (F.col("o_totalprice") / F.lit(100000.0)).alias("total_cost_usd"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0),
                                                (key % 72).cast("int"))).alias("updated_at"),
        F.array(F.concat(F.lit("AML.T00"), F.lpad(_s(F.col("o_custkey") % 60), 2, "0"))).alias("atlas_techniques"),
        F.concat(F.lit("asset-"), _s(F.col("o_custkey") % 100 + 1)).alias("asset_id"),
        F.concat(F.lit("10."), _s(F.col("o_custkey") % 256), F.lit("."), _s(key % 256), F.lit(".7")).alias("src_ip"),
        F.concat(F.lit("family-"), _s(F.col("o_custkey") % 7)).alias("rule_family"),
        F.when(F.col("o_custkey") % 3 == 0, "server").when(F.col("o_custkey") % 3 == 1, "workstation")
         .otherwise("ot_device").alias("asset_class"),
    ).withColumn("graph_state", F.to_json(F.struct("severity", "classification", "alert_title", "confidence")))


# ---------------------------------------------------------------------------
# Model-call log on ``lineitem``
# ---------------------------------------------------------------------------

CALLS_NOW = "1998-08-02 00:30:00"
TIERS = ("tier0", "tier1", "tier1_plus", "tier2")


def call_log(spark, sf_dir) -> DataFrame:
    """Model-call log (A-05, A-15..A-18, P-40): one call per line item."""
    li = read(spark, sf_dir, "lineitem")
    m = F.col("l_suppkey") % 4
    return li.select(
        F.col("l_shipdate").alias("created_at"),
        F.concat(F.lit("t"), _s(F.col("l_orderkey") % 4)).alias("tenant_id"),
        _s(F.col("l_orderkey")).alias("investigation_id"),
        F.concat(F.lit("model-"), _s(m)).alias("model_id"),
        F.when(m == 0, "tier0").when(m == 1, "tier1").when(m == 2, "tier1_plus").otherwise("tier2").alias("model_tier"),
        F.concat(F.lit("task-"), _s(F.col("l_linenumber"))).alias("task_type"),
        (F.col("l_quantity") * 100).cast("bigint").alias("input_tokens"),
        F.round(F.col("l_tax") * 10000).cast("bigint").alias("output_tokens"),
        (F.col("l_extendedprice") / F.lit(10000.0)).alias("cost_usd"),
        (F.col("l_quantity") * F.lit(37.0)).alias("latency_ms"),
        F.when(F.col("l_returnflag") == "R", "error").otherwise("success").alias("status"),
        (F.lit(1.0) - F.col("l_discount") * 5).alias("confidence"),
    )


# ---------------------------------------------------------------------------
# Scanner findings on ``lineitem``
# ---------------------------------------------------------------------------

def findings(spark, sf_dir) -> DataFrame:
    """Raw scanner findings (P-02..P-06, S-11): one per line item; line 7 comes from an unsupported tool."""
    li = read(spark, sf_dir, "lineitem")
    ln, pk, sk = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    disc = F.col("l_discount")
    return li.select(
        (F.col("l_orderkey") * 10 + ln).alias("finding_id"),
        F.when(ln == 7, "qualys").when(ln % 4 == 0, "wiz").when(ln % 4 == 1, "snyk")
         .when(ln % 4 == 2, "garak").otherwise("art").alias("source_tool"),
        F.concat(F.lit("Exposure "), _s(pk % 997)).alias("title"),
        F.concat(F.lit("asset-"), _s(sk)).alias("asset_id"),
        F.when(disc >= 0.08, "CRITICAL").when(disc >= 0.05, "HIGH").when(disc >= 0.02, "MEDIUM")
         .otherwise("LOW").alias("severity"),
        F.when(pk % 5 == 0, "edge").when(pk % 5 == 1, "orbital").when(pk % 5 == 2, "demo")
         .when(pk % 5 == 3, "public").otherwise("s3").alias("resource_type"),
        F.when(pk % 6 == 0, "torch").when(pk % 6 == 1, "onnxruntime-gpu").when(pk % 6 == 2, "lodash")
         .when(pk % 6 == 3, "requests").otherwise("numpy").alias("package_name"),
        F.lit("pip").alias("package_manager"),
        (F.col("l_quantity") / F.lit(5.0)).alias("exploitability_score"),
        F.when(pk % 8 == 0, "escalation").when(pk % 8 == 1, "tool_use").when(pk % 8 == 2, "prompt_injection")
         .when(pk % 8 == 3, "extraction").when(pk % 8 == 4, "exfiltration").when(pk % 8 == 5, "jailbreak")
         .when(pk % 8 == 6, "encoding").otherwise("other").alias("probe_type"),
        F.when(pk % 5 == 0, "poisoning").when(pk % 5 == 1, "evasion").when(pk % 5 == 2, "extraction")
         .when(pk % 5 == 3, "inference").otherwise("other").alias("attack_type"),
        (disc * 10).alias("success_rate"),
        F.when(sk % 4 == 0, "Zone0_Safety").when(sk % 4 == 1, "Zone1_EdgeInference").when(sk % 4 == 2, "Zone2_SCADA")
         .otherwise("Zone3_Enterprise").alias("deployment_zone"),
        F.col("l_shipdate").alias("detected_at"),
        F.concat(F.lit("t"), _s(F.col("l_orderkey") % 4)).alias("tenant_id"),
    )


# ---------------------------------------------------------------------------
# Decision log (shadow vs analyst) on ``lineitem``; closures on ``labels`` + ``documents``
# ---------------------------------------------------------------------------

def decision_log(spark, sf_dir) -> DataFrame:
    """Shadow and analyst decisions per investigation (J-11, A-25, A-26)."""
    li = read(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    return li.select(
        F.concat(F.lit("t"), _s(key % 4)).alias("tenant_id"),
        F.concat(F.lit("family-"), _s(key % 7)).alias("rule_family"),
        _s(key).alias("investigation_id"),
        F.concat(F.lit("fp-"), _s(key % 60)).alias("pattern_id"),
        F.when(F.col("l_linenumber") % 2 == 1, "shadow").otherwise("analyst").alias("type"),
        F.when(F.col("l_returnflag") == "R", "true_positive").otherwise("false_positive").alias("decision"),
        (F.col("l_shipdate") + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.col("l_linenumber")))
        .alias("ts"),
    )


def closures(spark, sf_dir) -> DataFrame:
    """Auto-closure outcomes (A-24, W-05): decision = quality, truth = toxic."""
    lab = read(spark, sf_dir, "labels")
    doc = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    j = lab.join(doc, "doc_id")
    return j.select(
        _s("doc_id").alias("alert_id"),
        F.col("source").alias("rule_family"),
        F.col("lang").alias("severity"),
        F.when(F.col("n_chars") > 5000, "high").otherwise("low").alias("asset_criticality"),
        (F.col("quality") == 1).alias("auto_closed"),
        (F.col("toxic") == 0).alias("truly_fp"),
        F.concat(F.lit("fp-"), _s(F.col("doc_id") % 60)).alias("pattern_id"),
        (F.lit(EVENTS_NOW).cast("timestamp_ntz")
         - F.make_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("doc_id") % 90).cast("int"))).alias("pattern_created_at"),
    )


# ---------------------------------------------------------------------------
# Audit events on ``events`` (W-01..W-15, A-21, A-35)
# ---------------------------------------------------------------------------

AUDIT_TYPES = {"click": "investigation.state_changed", "view": "alert.classified", "purchase": "response.executed",
               "signup": "approval.requested", "error": "injection.detected"}


def audit_events(spark, sf_dir) -> DataFrame:
    """Audit events to be chained: five tenants (user_id % 5), ordered by time then id."""
    from tidewatch.operators.audit import EVENT_CATEGORY
    from tidewatch.functions.exprs import lookup
    e = read(spark, sf_dir, "events")
    etype = lookup(AUDIT_TYPES, F.col("event_type"))
    k = _k()
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return e.select(
        F.concat(F.lit("aud-"), _s("event_id")).alias("audit_id"),
        F.concat(F.lit("t"), _s(F.col("user_id") % 5)).alias("tenant_id"),
        stamp.alias("timestamp"), stamp.alias("ingested_at"),
        etype.alias("event_type"), lookup(EVENT_CATEGORY, etype).alias("event_category"),
        F.lit("info").alias("severity"), F.lit("agent").alias("actor_type"),
        F.concat(F.lit("user-"), _s("user_id")).alias("actor_id"),
        F.array().cast("array<string>").alias("actor_permissions"),
        F.concat(F.lit("inv-"), _s(F.col("event_id") % 997)).alias("investigation_id"),
        F.lit("").alias("alert_id"), F.array().cast("array<string>").alias("entity_ids"),
        F.to_json(F.struct(F.col("value"), k.alias("k"))).alias("context"),
        F.when(F.col("event_type") == "view", F.concat(F.lit('{"classification":"'), F.when(k % 2 == 0, "true_positive")
                                                         .otherwise("false_positive"), F.lit('"}')))
         .otherwise(F.lit("{}")).alias("decision"),
        F.lit("{}").alias("outcome"), F.lit("1.0").alias("record_version"),
    )


# ---------------------------------------------------------------------------
# Incident vectors on ``embeddings`` (J-15, R-01..R-03, W-07, W-08, E-25)
# ---------------------------------------------------------------------------

def vectors(spark, sf_dir) -> DataFrame:
    """Past-incident vectors with payload: two versions per document (v1/v2), label = technique family."""
    e = read(spark, sf_dir, "embeddings")
    vid = F.col("vec_id")
    return e.select(
        _s(vid).alias("id"), F.col("embedding").alias("vec"), F.col("label"),
        F.concat(F.lit("t"), _s(vid % 4)).alias("tenant_id"),
        (vid % 400).cast("double").alias("age_days"),
        F.array(F.concat(F.lit("AML.T00"), _s(F.col("label") + 10))).alias("techniques"),
        (vid % 13 == 0).alias("rare_important"),
        F.concat(F.lit("doc-"), _s(F.floor(vid / 2))).alias("doc_id"),
        F.concat(F.lit("v"), _s(vid % 2 + 1)).alias("version"),
    )


# ---------------------------------------------------------------------------
# Raw vendor alerts on ``orders`` (S-01 .. S-06): JSON text as each SIEM sends it
# ---------------------------------------------------------------------------

def vendor_alerts(spark, sf_dir) -> DataFrame:
    """One raw alert per order, as Sentinel, Elastic or Splunk JSON (by order key % 3).

    Includes heartbeats/health checks (key % 97 == 0), CSV and list annotations, missing
    severities and the Elastic rule-level threat fallback, so every adapter branch is exercised. An alert takes much more time than its
    order takes bytes, so the orders of a few large files are dealt to all tasks first."""
    o = spread(read(spark, sf_dir, "orders"))
    key, cust, pri = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    title = F.concat(F.lit("Suspicious sign-in pattern "), _s(cust % 40))
    tenant = F.concat(F.lit("t"), _s(cust % 4))
    ip = F.concat(F.lit("10."), _s(cust % 256), F.lit("."), _s(key % 256), F.lit(".7"))
    hb = key % 97 == 0
    sentinel = F.to_json(F.struct(
        F.concat(F.lit("S-"), _s(key)).alias("SystemAlertId"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("TimeGenerated"),
        F.when(hb, F.lit(" Heartbeat")).otherwise(title).alias("AlertName"),
        F.lit("Sign-in anomaly").alias("Description"),
        F.when(pri == "1-URGENT", "High").when(pri == "2-HIGH", "Medium").when(pri == "3-MEDIUM", "Low")
         .when(pri == "4-NOT SPECIFIED", "Informational").otherwise("").alias("Severity"),
        F.when(cust % 2 == 0, F.lit("InitialAccess, Execution")).otherwise(F.lit("Persistence,,")).alias("Tactics"),
        F.when(cust % 3 == 0, F.lit("")).otherwise(F.lit("T1078, T1059.001")).alias("Techniques"),
        F.concat(F.lit('[{"$id":"1","Type":"ip","Address":"'), ip, F.lit('"}]')).alias("Entities"),
        F.lit("Azure Sentinel").alias("ProductName"), tenant.alias("TenantId")))
    tactic = lambda n: F.struct(F.lit(n).alias("name"))
    sub = lambda i: F.struct(F.lit(i).alias("id"))
    tech = lambda i, subs: F.struct(F.lit(i).alias("id"), F.array(*[sub(x) for x in subs]).alias("subtechnique"))
    params = F.when(cust % 3 == 0, F.array().cast("array<struct<tactic:struct<name:string>,technique:array<struct<id:string,subtechnique:array<struct<id:string>>>>>>")) \
        .otherwise(F.array(F.struct(tactic("Initial Access").alias("tactic"),
                                    F.array(tech("T1078", ["T1078.004"]), tech("T1078", [])).alias("technique")),
                           F.struct(tactic("Initial Access").alias("tactic"),
                                    F.array(tech("T1110", [])).alias("technique"))))
    rule_threat = F.array(F.struct(tactic("Credential Access").alias("tactic"),
                                   F.array(tech("T1110", ["T1110.001"])).alias("technique")))
    elastic = F.to_json(F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("@timestamp"),
        F.struct(F.struct(F.concat(F.lit("E-"), _s(key)).alias("id"),
                          F.when(hb, F.lit("Test Alert")).otherwise(title).alias("name"),
                          F.lit("Rule hit").alias("description"),
                          F.when(pri == "1-URGENT", "critical").when(pri == "2-HIGH", "HIGH ")
                           .when(pri == "3-MEDIUM", "medium").when(pri == "4-NOT SPECIFIED", "bogus").alias("severity"),
                          rule_threat.alias("threat")).alias("rule"),
                 F.struct(F.when(key % 11 == 0, F.concat(F.lit("orig-"), _s(cust % 9))).alias("user")).alias("original_event"))
        .alias("signal"),
        F.struct(F.struct(F.struct(F.struct(params.alias("threat")).alias("parameters")).alias("rule")).alias("alert"))
        .alias("kibana"),
        F.when(key % 2 == 1, F.array(tenant)).alias("kibana.space_ids"), tenant.alias("tenant_id"),
        F.struct(F.lit("endpoint").alias("type")).alias("agent"),
        F.struct(F.concat(F.lit("web-"), _s(key % 50)).alias("name"),
                 F.struct(F.lit("linux").alias("family")).alias("os")).alias("host"),
        F.when(key % 2 == 0, F.struct(F.concat(F.lit("svc-"), _s(cust % 9)).alias("name"),
                                      F.when(key % 4 == 0, F.lit("corp")).alias("domain"))).alias("user"),
        F.struct(ip.alias("ip")).alias("source"),
        F.when(key % 5 == 0, F.struct(F.concat(F.lit("10.9.9."), _s(key % 256)).alias("ip"))).alias("destination"),
        F.when(key % 7 == 0, F.struct(_s(key % 30000).alias("pid"), F.lit("cmd.exe /c whoami").alias("command_line")))
        .alias("process")))
    epoch = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    splunk = F.to_json(F.struct(
        F.concat(F.lit("N-"), _s(key)).alias("event_id"),
        F.when(key % 10 == 0, F.concat(_s(epoch), F.lit(".5"))).otherwise(_s(epoch)).alias("_time"),
        F.when(hb, F.lit("Health Check - indexers")).otherwise(title).alias("search_name"),
        F.lit("Notable").alias("description"),
        F.when(pri == "1-URGENT", "critical").when(pri == "2-HIGH", "High").when(pri == "3-MEDIUM", "medium")
         .when(pri == "4-NOT SPECIFIED", "info").otherwise("").alias("urgency"),
        ip.alias("src"), ip.alias("src_ip"), F.concat(F.lit("10.9.9."), _s(key % 256)).alias("dest"),
        F.concat(F.lit("host-"), _s(cust % 20)).alias("src_host"), F.concat(F.lit("u"), _s(cust % 30)).alias("user"),
        F.when(key % 7 == 0, F.lit("powershell.exe")).alias("process_name"),
        F.when(key % 7 == 0, _s(key % 30000)).alias("process_id"),
        tenant.alias("tenant_id")))
    # the tactic field is a JSON list for some events and a CSV string for others
    tactic = F.when(key % 2 == 0, F.lit('["initial-access","execution"]')) \
        .otherwise(F.lit('"persistence, privilege-escalation"'))
    ann = F.concat(F.lit(',"annotations":{"mitre_attack":{"mitre_tactic":'), tactic,
                   F.lit(',"mitre_technique_id":"T1078,T1548"}}}'))
    splunk = F.regexp_replace(splunk, r"\}$", ann)
    src = F.when(key % 3 == 0, "sentinel").when(key % 3 == 1, "elastic").otherwise("splunk")
    raw = F.when(key % 3 == 0, sentinel).when(key % 3 == 1, elastic).otherwise(splunk)
    return o.select(src.alias("source"), raw.alias("raw"))
