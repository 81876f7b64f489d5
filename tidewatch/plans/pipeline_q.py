"""Registered end-to-end investigation pipeline (X-05) and its transition log (X-06 / P-43)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import pipeline as PL
from tidewatch.plans.enrich_q import ioc_table
from tidewatch.plans.fp_q import fp_patterns
from tidewatch.plans.registry import register, tidy
from tidewatch.session import checkpoint_dir
from tidewatch.sources import adapters as AD
from tidewatch.sources import tables as TB


def investigations_run(spark, sf):
    checkpoint_dir(spark)
    alerts = (AD.union_sources(TB.vendor_alerts(spark, sf))
              .select("alert_id", "tenant_id", "title", "severity", "entities_raw", "raw_payload")
              .withColumn("rule_family", F.lit("")).withColumn("asset_class", F.lit(""))
              .checkpoint(eager=True))
    o = TB.read(spark, sf, "orders")
    k = F.col("o_orderkey")
    verdicts = o.select(
        F.concat(F.when(k % 3 == 0, "S-").when(k % 3 == 1, "E-").otherwise("N-"), k.cast("string")).alias("alert_id"),
        F.when(k % 5 == 0, "true_positive").when(k % 5 == 1, "benign").otherwise("false_positive").alias("classification"),
        ((k % 100) / F.lit(100.0)).alias("confidence"),
        F.array(F.struct(F.lit("isolate_host").alias("action"), (k % 4).cast("int").alias("tier"))).alias("actions"))
    return PL.run_investigations(alerts, verdicts, fp_patterns(spark, sf), ioc_table(spark, sf), TB.EVENTS_NOW)


def _x05(spark, sf):
    r = investigations_run(spark, sf)
    return tidy(r.groupBy("state", "classification").agg(F.count(F.lit(1)).alias("alerts"),
                                                          F.sum("ioc_matches").alias("ioc_matches")))


register("x05_investigation_pipeline", None)(_x05)


def _p43(spark, sf):
    log = PL.transition_log(investigations_run(spark, sf))
    return log.groupBy("step_no", "agent", "action").agg(F.count(F.lit(1)).alias("steps"))


register("p43_decision_timeline", None)(_p43)


def _a34(spark, sf):
    f = PL.case_facts(investigations_run(spark, sf))
    return f.groupBy("timeline_steps").agg(F.count(F.lit(1)).alias("cases"),
                                           F.sum("token_estimate").cast("bigint").alias("tokens"))


register("a34_case_facts", None)(_a34)


def _p33(spark, sf):
    """Revocation events hit a fixed hash slice of the mined patterns; every investigation whose
    decision chain auto-closed it through one of them is re-opened."""
    from tidewatch.operators import fp as FP
    pats = fp_patterns(spark, sf)
    revoked = pats.where(F.substring(F.md5(F.concat(F.lit("revoke:"), "pattern_id")), 1, 1).isin("0", "1", "2", "3"))
    run = investigations_run(spark, sf).withColumnRenamed("alert_id", "investigation_id")
    r = FP.closed_by_pattern(run, revoked)
    return r.groupBy("tenant_id", "severity", "state").agg(F.count(F.lit(1)).alias("reopened"))


register("p33_reopen_revoked_closures", None)(_p33)
