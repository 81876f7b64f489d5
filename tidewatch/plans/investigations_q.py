"""Registered queries over the investigations' event log (X-05, X-06, A-34).

Cases are the open investigations. Roles beside them: detections on OT devices come from untrusted telemetry, tenant t2 runs in shadow mode,
a case with a verdict gets a human decision a day after its last update, and the patterns of tenant t1 are revoked later.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import gates as GT
from tidewatch.operators import investigations as IV
from tidewatch.plans.enrich_q import ioc_table
from tidewatch.plans.oracle_roles import with_roles
from tidewatch.plans.registry import ORACLES, QUERIES, register
from tidewatch.session import checkpoint_dir
from tidewatch.sources import tables as TB

REVOKED_AT = "2002-01-01 00:00:00"


def _cases(spark, sf):
    inv = TB.investigations(spark, sf).where(F.col("state") != "closed")
    fp = QUERIES["j08_fp_pattern_match"](spark, sf).select("alert_id", F.col("pattern_id").alias("fp_pattern"), F.col("confidence").alias("fp_confidence"))
    detections = F.array(F.struct(F.when(F.col("asset_class") == "ot_device", "untrusted").otherwise("trusted").alias("telemetry_trust_level"),
                                  F.lit("").alias("attestation_status")))
    actions = F.array(F.struct((F.col("investigation_id").cast("bigint") % 4).cast("int").alias("tier")))
    return (inv.join(fp, "alert_id", "left")
            .select("investigation_id", "tenant_id", F.col("created_at").alias("opened_at"), "updated_at", "classification", "fp_pattern", "fp_confidence", "confidence",
                    "asset_id", "src_ip", "atlas_techniques", "alert_title",
                    GT.trust_constraint(detections)["requires_human_review"].alias("all_untrusted"),
                    GT.needs_human_approval(actions, F.col("confidence"), F.col("severity")).alias("needs_approval"), (F.col("tenant_id") == "t2").alias("shadow")))


def folded(spark, sf, cases=None):
    """The log of all cases, folded. ``cases``: ``_cases``, where the caller has written them (they are read several times)."""
    checkpoint_dir(spark)
    c = cases if cases is not None else _cases(spark, sf).checkpoint()
    log = IV.pipeline_events(c)
    approved = F.when(F.col("classification") == "true_positive", True).when(F.col("classification") == "benign", False)
    decided = c.select("investigation_id", "tenant_id", (F.col("updated_at") + F.expr("INTERVAL 1 DAY")).alias("at"), approved.alias("approved"))
    revoked = c.where((F.col("tenant_id") == "t1") & F.col("fp_pattern").isNotNull()).select(F.col("fp_pattern").alias("pattern_id"))
    again = IV.reopen_events(log, revoked, F.lit(REVOKED_AT).cast(c.schema["opened_at"].dataType))
    return IV.fold(log.unionByName(IV.decision_events(decided)).unionByName(again))


CASES_SQL = f"""
, fp AS (SELECT alert_id, pattern_id FROM ({ORACLES['j08_fp_pattern_match']}) q)
, cases AS (SELECT i.*, fp.pattern_id IS NOT NULL AS fp, asset_class = 'ot_device' AS untrusted,
                   CAST(investigation_id AS BIGINT) % 4 >= {GT.DESTRUCTIVE_ACTION_TIER} OR (confidence < {GT.ESCALATION_CONFIDENCE_THRESHOLD} AND severity IN {GT.ESCALATION_SEVERITIES!r}) AS needs
            FROM investigations i LEFT JOIN fp USING (alert_id) WHERE state <> 'closed')
, route AS (SELECT *, CASE WHEN fp THEN 'fp' WHEN untrusted THEN 'force_human_review' WHEN needs THEN 'request_approval' WHEN tenant_id = 't2' THEN 'shadow_decision_logged'
                           ELSE 'respond' END AS r FROM cases)
"""


def _x06(spark, sf):
    return folded(spark, sf).groupBy("from_state", "to_state", "agent", "action", "applied").agg(F.count(F.lit(1)).alias("events"))


register("x06_transition_log", with_roles(CASES_SQL + """
, e AS (
  SELECT '' AS from_state, 'received' AS to_state, 'graph' AS agent, 'open' AS action, true AS applied FROM route
  UNION ALL SELECT 'received', 'parsing', 'ioc_extractor', 'start_ioc_extraction', true FROM route
  UNION ALL SELECT 'parsing', 'closed', 'fp_short_circuit', 'auto_close_fp', true FROM route WHERE r = 'fp'
  UNION ALL SELECT 'parsing', 'enriching', 'graph', 'start_enrichment', true FROM route WHERE r <> 'fp'
  UNION ALL SELECT 'enriching', 'reasoning', 'reasoning_agent', 'start_reasoning', true FROM route WHERE r <> 'fp'
  UNION ALL SELECT 'reasoning', 'awaiting_human', CASE r WHEN 'request_approval' THEN 'reasoning_agent' ELSE 'orchestrator' END, r, true FROM route WHERE r NOT IN ('fp', 'respond')
  UNION ALL SELECT 'reasoning', 'responding', 'response_agent', 'start_response', true FROM route WHERE r = 'respond'
  UNION ALL SELECT 'responding', 'closed', 'response_agent', 'execute_actions', true FROM route WHERE r = 'respond'
  UNION ALL SELECT CASE WHEN r IN ('fp', 'respond') THEN 'closed' ELSE 'awaiting_human' END, 'responding', 'human', 'approval_granted', r NOT IN ('fp', 'respond')
            FROM route WHERE classification = 'true_positive'
  UNION ALL SELECT CASE WHEN r IN ('fp', 'respond') THEN 'closed' ELSE 'responding' END, 'closed', 'response_agent', 'execute_actions', r NOT IN ('fp', 'respond')
            FROM route WHERE classification = 'true_positive'
  UNION ALL SELECT CASE WHEN r IN ('fp', 'respond') THEN 'closed' ELSE 'awaiting_human' END, 'closed', 'human', 'approval_rejected', r NOT IN ('fp', 'respond')
            FROM route WHERE classification = 'benign'
  UNION ALL SELECT 'closed', 'received', 'fp_governance', 'reopen', true FROM route WHERE r = 'fp' AND tenant_id = 't1')
SELECT from_state, to_state, agent, action, applied, CAST(COUNT(*) AS BIGINT) AS events FROM e GROUP BY ALL
""", "investigations"))(_x06)


def _x05_states(spark, sf):
    s = IV.current_states(folded(spark, sf))
    return s.groupBy("tenant_id", "state").agg(F.count(F.lit(1)).alias("cases"), F.sum("events").alias("events"), F.sum("refused").alias("refused"),
                                               F.sum("reopened").alias("reopened"))


register("x05_investigation_states", with_roles(CASES_SQL + """
, d AS (SELECT *, r IN ('fp', 'respond') AS shut, r = 'fp' AND tenant_id = 't1' AS again, CASE classification WHEN 'true_positive' THEN 2 WHEN 'benign' THEN 1 ELSE 0 END AS said FROM route)
, s AS (SELECT tenant_id, CASE WHEN again THEN 'received' WHEN shut OR said > 0 THEN 'closed' ELSE 'awaiting_human' END AS state,
               CASE r WHEN 'fp' THEN 3 WHEN 'respond' THEN 6 ELSE 5 + said END + again::INT AS events, CASE WHEN shut THEN said ELSE 0 END AS refused, again::INT AS reopened FROM d)
SELECT tenant_id, state, CAST(COUNT(*) AS BIGINT) AS cases, CAST(SUM(events) AS BIGINT) AS events, CAST(SUM(refused) AS BIGINT) AS refused,
       CAST(SUM(reopened) AS BIGINT) AS reopened
FROM s GROUP BY tenant_id, state
""", "investigations"))(_x05_states)


def _similar(c):
    """The five latest cases before each of the same title and tenant, taken from the rows before it in one sort: no pairs, no join."""
    w = Window.partitionBy("tenant_id", "alert_title").orderBy("opened_at", "investigation_id")
    own = F.struct(F.col("investigation_id").alias("incident_id"))
    before = F.array(*[F.lag(own, i).over(w) for i in range(1, 6)])
    known = c.where(F.col("tenant_id").isNotNull() & F.col("alert_title").isNotNull())
    rows = (known.select("investigation_id", F.col("alert_title").alias("title"), before.alias("b"))
            .select("investigation_id", "title", F.posexplode("b").alias("p", "o")).where(F.col("o").isNotNull()))
    return rows.select("investigation_id", "o.incident_id", "title", (F.col("p") + 1).alias("rank"))


def _a34_facts(spark, sf):
    """Facts of every case: its asset and address, those that an IOC names, its technique, and the five latest earlier cases of the same title and tenant."""
    checkpoint_dir(spark)
    c = _cases(spark, sf).checkpoint()
    states = IV.current_states(folded(spark, sf, c))
    ents = c.select("investigation_id", "tenant_id", F.explode(F.array("asset_id", "src_ip")).alias("value"))
    iocs = ents.join(ioc_table(spark, sf).select("tenant_id", "value", "ioc_type").distinct(), ["tenant_id", "value"]).select("investigation_id", F.col("ioc_type").alias("type"), "value")
    similar = _similar(c)
    f = IV.case_facts(states, ents.select("investigation_id", "value"), iocs,
                      c.select("investigation_id", F.explode("atlas_techniques").alias("technique_id")), similar)
    return f.groupBy("tenant_id", "state", F.size("entities").cast("bigint").alias("entities"), F.size("similar_incidents").cast("bigint").alias("similar_incidents")).agg(
        F.count(F.lit(1)).alias("cases"), F.sum(F.size("techniques")).alias("techniques"))


register("a34_case_facts_by_state", with_roles(CASES_SQL + """
, d AS (SELECT *, CASE WHEN r = 'fp' AND tenant_id = 't1' THEN 'received' WHEN r IN ('fp', 'respond') OR classification IN ('true_positive', 'benign') THEN 'closed' ELSE 'awaiting_human' END AS st,
               LEAST(5, ROW_NUMBER() OVER (PARTITION BY tenant_id, alert_title ORDER BY created_at, investigation_id) - 1) AS sim FROM route)
SELECT tenant_id, st AS state, CAST(2 AS BIGINT) AS entities, CAST(sim AS BIGINT) AS similar_incidents, CAST(COUNT(*) AS BIGINT) AS cases,
       CAST(SUM(len(atlas_techniques)) AS BIGINT) AS techniques
FROM d GROUP BY ALL
""", "investigations"))(_a34_facts)
