"""X-05 / X-06: the investigation pipeline as one table-wide batch.

canonical alerts -> structured entities (T-01) -> FP short-circuit (J-08, early exit: matched
alerts are closed before any enrichment) -> IOC enrichment (J-03) -> gates (P-26..P-28) ->
final state with its decision chain. The model verdict is an input column; every per-alert
lookup of the reference is one set-based join over the whole batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import enrich as EN
from tidewatch.operators import fp as FP
from tidewatch.operators import gates as GT
from tidewatch.operators.entities import parse_entities_df
from tidewatch.session import checkpoint_dir

STEP = "struct<agent:string,action:string,pattern_id:string,confidence:double>"


def _step(agent: str, action: str, pattern=None, confidence=None):
    return F.struct(F.lit(agent).alias("agent"), F.lit(action).alias("action"),
                    (pattern if pattern is not None else F.lit(None)).cast("string").alias("pattern_id"),
                    (confidence if confidence is not None else F.lit(None)).cast("double").alias("confidence"))


def run_investigations(alerts: DataFrame, verdicts: DataFrame, patterns: DataFrame, iocs: DataFrame, now,
                       *, fp_threshold: float = FP.FP_CONFIDENCE_THRESHOLD) -> DataFrame:
    """One row per alert: state, classification, confidence, ioc_matches, needs_approval and
    the ordered ``decision_chain`` (X-06 log rows are ``posexplode(decision_chain)``).

    Sides with a row per alert meet by sort and merge: texts and maps made from small columns look small enough to send to
    every task, and would pass through the driver.

    ``alerts``: canonical alerts (alert_id, tenant_id, title, severity, entities_raw, raw_payload,
    rule_family, asset_class); ``verdicts``: (alert_id, classification, confidence, actions).
    """
    parsed = parse_entities_df(alerts, "entities_raw", "raw_payload", "p")
    ents = parsed.select("alert_id", "tenant_id", F.explode("p.entities").alias("e"))
    grouped = (ents.groupBy("alert_id", F.concat(F.col("e.entity_type"), F.lit("s")).alias("k"))
               .agg(F.collect_set("e.primary_value").alias("v"))
               .groupBy("alert_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("entities")))
    base = parsed.select("alert_id", "tenant_id", F.col("title").alias("alert_title"), "severity", "rule_family",
                         "asset_class").join(grouped.hint("merge"), "alert_id", "left") \
        .withColumn("entities", F.coalesce("entities", F.create_map().cast("map<string,array<string>>")))
    checkpoint_dir(alerts.sparkSession)
    base = base.checkpoint()  # parsed once, read by every step below
    # FP short-circuit first; matched alerts leave the pipeline here (no enrichment cost)
    fp = FP.match_fp_patterns(base, patterns, threshold=fp_threshold).select(
        "alert_id", F.col("pattern_id").alias("fp_pattern"), F.col("confidence").alias("fp_confidence"))
    b = base.join(fp.hint("merge"), "alert_id", "left")
    closed = b.where(F.col("fp_pattern").isNotNull()).select(
        "alert_id", "tenant_id", "severity", F.lit("closed").alias("state"),
        F.lit("false_positive").alias("classification"), F.col("fp_confidence").alias("confidence"),
        F.lit(0).cast("bigint").alias("ioc_matches"), F.lit(False).alias("needs_approval"),
        F.array(_step("ioc_extractor", "extract"), _step("fp_short_circuit", "auto_close_fp", F.col("fp_pattern"),
                                                        F.col("fp_confidence"))).alias("decision_chain"))
    rest = b.where(F.col("fp_pattern").isNull())
    # enrichment: IOC hits on the alert's entity values (one join for the whole batch)
    vals = rest.select("alert_id", "tenant_id", F.explode("entities").alias("k", "vs")) \
        .select("alert_id", "tenant_id", F.expr("substring(k, 1, length(k) - 1)").alias("entity_type"),
                F.explode("vs").alias("value"))
    hits = EN.enrich_iocs(vals, iocs.hint("merge"), now).groupBy("alert_id").agg(F.count_if("ioc_match").alias("ioc_matches"))
    r = rest.join(hits.hint("merge"), "alert_id", "left").join(verdicts.hint("merge"), "alert_id", "left") \
        .withColumn("ioc_matches", F.coalesce("ioc_matches", F.lit(0)).cast("bigint"))
    needs = GT.needs_human_approval(F.col("actions"), F.coalesce("confidence", F.lit(0.0)), F.col("severity"))
    state = F.when(needs, "awaiting_human").otherwise("responding")
    chain = F.array(_step("ioc_extractor", "extract"), _step("context_enricher", "enrich", None, None),
                    _step("reasoning_agent", "classify", None, F.col("confidence")),
                    F.when(needs, _step("response_agent", "request_approval"))
                    .otherwise(_step("response_agent", "execute_actions")))
    done = r.select("alert_id", "tenant_id", "severity", state.alias("state"), "classification", "confidence",
                    "ioc_matches", needs.alias("needs_approval"), chain.alias("decision_chain"))
    return closed.unionByName(done)


def transition_log(investigations: DataFrame) -> DataFrame:
    """X-06 / P-43: one row per decision step, in order (``posexplode``)."""
    return investigations.select("alert_id", F.posexplode("decision_chain").alias("step_no", "step")) \
        .select("alert_id", "step_no", "step.*")


def case_facts(investigations: DataFrame) -> DataFrame:
    """A-34: per investigation the facts handed to reasoning (entity values, IOC hits, decision
    steps) and the token estimate = characters of their JSON form / 4."""
    facts = F.struct(F.col("alert_id"), F.col("classification"), F.col("ioc_matches"), F.col("decision_chain"))
    return investigations.select("alert_id", F.size("decision_chain").alias("timeline_steps"),
                                 F.floor(F.length(F.to_json(facts)) / 4).cast("bigint").alias("token_estimate"))
