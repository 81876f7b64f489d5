"""Registered sequence queries (W-11, W-12, W-14, ST-05, ST-06, ST-11 batch twins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.exprs import lookup
from tidewatch.operators import sequences as SQ
from tidewatch.plans.oracle_roles import with_roles
from tidewatch.plans.registry import register
from tidewatch.sources import tables as TB


def _events(spark, sf):
    return TB.read(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")


TIER_OF = "CASE user_id % 3 WHEN 0 THEN 'premium' WHEN 1 THEN 'standard' ELSE 'trial' END"


def _w11(spark, sf):
    e = _events(spark, sf).withColumn("tenant_id", F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string"))) \
        .withColumn("tier", F.expr(TIER_OF))
    q = SQ.quota_check(e, "tenant_id", "ts", 3600, lookup(SQ.TENANT_HOURLY_QUOTA, F.col("tier")))
    return q.groupBy("tenant_id").agg(F.max("trailing_count").alias("max_trailing"),
                                      F.count_if("over_quota").alias("over_quota"))


register("w11_tenant_hourly_quota", f"""
WITH e AS (SELECT 't' || CAST(user_id % 5 AS VARCHAR) AS tenant_id, ts,
                  CASE {TIER_OF} WHEN 'premium' THEN 500 WHEN 'standard' THEN 100 ELSE 20 END AS lim FROM events)
, w AS (SELECT tenant_id, lim, COUNT(*) OVER (PARTITION BY tenant_id ORDER BY ts
               RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS c FROM e)
SELECT tenant_id, CAST(MAX(c) AS BIGINT) AS max_trailing, CAST(COUNT(*) FILTER (WHERE c > lim) AS BIGINT) AS over_quota
FROM w GROUP BY tenant_id
""")(_w11)

PRIORITY_OF = {"error": "critical", "purchase": "high", "signup": "normal", "click": "low", "view": "low"}


def _w12(spark, sf):
    e = _events(spark, sf).withColumn("priority", lookup(PRIORITY_OF, F.col("event_type")))
    q = SQ.quota_check(e, "priority", "ts", 60, lookup(SQ.PRIORITY_MINUTE_LIMIT, F.col("priority")))
    return q.groupBy("priority").agg(F.max("trailing_count").alias("max_trailing"),
                                     F.count_if("over_quota").alias("over_quota"))


register("w12_priority_minute_limit", """
WITH e AS (SELECT CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'normal'
                  ELSE 'low' END AS priority, ts FROM events)
, l AS (SELECT *, CASE priority WHEN 'critical' THEN 200 WHEN 'high' THEN 100 WHEN 'normal' THEN 50 ELSE 20 END AS lim FROM e)
, w AS (SELECT priority, lim, COUNT(*) OVER (PARTITION BY priority ORDER BY ts
               RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS c FROM l)
SELECT priority, CAST(MAX(c) AS BIGINT) AS max_trailing, CAST(COUNT(*) FILTER (WHERE c > lim) AS BIGINT) AS over_quota
FROM w GROUP BY priority
""")(_w12)


def _w14(spark, sf):
    e = _events(spark, sf).withColumn("node", F.concat(F.lit("node-"), (F.col("user_id") % 20).cast("string"))) \
        .withColumn("ok", F.col("event_type") != "error")
    r = SQ.failure_runs(e, "node", "ts", "ok", "event_id", threshold=2)
    return r.groupBy("node").agg(F.max("failure_run").cast("bigint").alias("longest_failure_run"),
                                 F.count_if("breaker_open").alias("breaker_open_events"))


register("w14_consecutive_failures", """
WITH e AS (SELECT 'node-' || CAST(user_id % 20 AS VARCHAR) AS node, ts, event_id, event_type <> 'error' AS ok FROM events)
, g AS (SELECT *, SUM(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM e)
, r AS (SELECT *, SUM(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY node, grp ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)
SELECT node, CAST(MAX(run) AS BIGINT) AS longest_failure_run, CAST(COUNT(*) FILTER (WHERE run >= 2) AS BIGINT) AS breaker_open_events
FROM r GROUP BY node
""")(_w14)


def _calls_with_severity(spark, sf):
    c = TB.call_log(spark, sf)
    sev = F.when(F.col("investigation_id").cast("bigint") % 4 == 0, "critical") \
        .when(F.col("investigation_id").cast("bigint") % 4 == 1, "high").otherwise("medium")
    return c.withColumn("severity", sev)


def _st05(spark, sf):
    c = _calls_with_severity(spark, sf).select("tenant_id", "created_at", "investigation_id", "task_type",
                                               "confidence", "severity")
    e = SQ.escalation_budget(c, "tenant_id", "created_at", "confidence", "severity",
                             order_cols=("investigation_id", "task_type"))
    return e.groupBy("tenant_id").agg(F.count_if("escalated").alias("escalated"), F.count(F.lit(1)).alias("calls"))


register("st05_escalation_budget", with_roles("""
, c AS (SELECT tenant_id, epoch(created_at) AS t, ROW_NUMBER() OVER (PARTITION BY tenant_id ORDER BY created_at, investigation_id, task_type) AS n
        FROM call_log WHERE confidence < 0.6 AND CAST(investigation_id AS BIGINT) % 4 IN (0, 1))
, r AS (SELECT tenant_id, n, [t] AS g, 1 AS granted FROM c WHERE n = 1
        UNION ALL SELECT tenant_id, n, CASE WHEN len(f) < 10 THEN list_append(f, t) ELSE f END, CASE WHEN len(f) < 10 THEN 1 ELSE 0 END
        FROM (SELECT c.tenant_id, c.n, c.t, list_filter(r.g, lambda x: c.t - x < 3600) AS f FROM r JOIN c ON c.tenant_id = r.tenant_id AND c.n = r.n + 1))
SELECT l.tenant_id, CAST(COALESCE(MAX(e.granted), 0) AS BIGINT) AS escalated, CAST(COUNT(*) AS BIGINT) AS calls
FROM call_log l LEFT JOIN (SELECT tenant_id, SUM(granted) AS granted FROM r GROUP BY tenant_id) e ON l.tenant_id = e.tenant_id GROUP BY l.tenant_id
""", "call_log").replace("WITH ", "WITH RECURSIVE ", 1))(_st05)


def _st06(spark, sf):
    c = TB.call_log(spark, sf).select("task_type", "created_at", "investigation_id")
    b = SQ.dual_trigger_batches(c, "task_type", "created_at", order_cols=("investigation_id",))
    return b.groupBy("task_type").agg(F.count_distinct("batch_no").alias("batches"),
                                      F.count_if("closed_by_count").alias("closed_by_count"))


register("st06_dual_trigger_batches", with_roles("""
, c AS (SELECT task_type, epoch(created_at) AS t, ROW_NUMBER() OVER (PARTITION BY task_type ORDER BY created_at, investigation_id) AS n FROM call_log)
, r AS (SELECT task_type, n, 0 AS batch, 1 AS size, t AS flushed, 0 AS closed FROM c WHERE n = 1
        UNION ALL SELECT task_type, n, CASE WHEN s = 50 THEN b + 1 ELSE b END, CASE WHEN s = 50 THEN 0 ELSE s END,
                         CASE WHEN s = 50 OR late THEN t ELSE flushed END, CASE WHEN s = 50 THEN 1 ELSE 0 END
        FROM (SELECT c.task_type, c.n, c.t, r.flushed, r.size > 0 AND c.t - r.flushed >= 21600 AS late,
                     CASE WHEN r.size > 0 AND c.t - r.flushed >= 21600 THEN r.batch + 1 ELSE r.batch END AS b,
                     CASE WHEN r.size > 0 AND c.t - r.flushed >= 21600 THEN 1 ELSE r.size + 1 END AS s
              FROM r JOIN c ON c.task_type = r.task_type AND c.n = r.n + 1))
SELECT task_type, CAST(COUNT(DISTINCT CASE WHEN closed = 1 THEN batch - 1 ELSE batch END) AS BIGINT) AS batches,
       CAST(SUM(closed) AS BIGINT) AS closed_by_count
FROM r GROUP BY task_type
""", "call_log").replace("WITH ", "WITH RECURSIVE ", 1))(_st06)


def _st06_closures(spark, sf):
    """Every closed batch of the queue of an event type, by a clock at the end of the events."""
    c = SQ.batch_closures(_events(spark, sf), "event_type", "ts", TB.EVENTS_NOW)
    return c.select("event_type", "batch_no", "size", F.unix_micros("opened_at").alias("opened_us"),
                    F.unix_micros("closed_at").alias("closed_us"), "closed_by")


register("st06_batch_closures", """
WITH RECURSIVE c AS (SELECT event_type, epoch_us(ts) AS t, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events WHERE event_type IS NOT NULL)
, r AS (SELECT event_type, n, 0::BIGINT AS no, 1::BIGINT AS size, t AS opened, t AS flushed, 0::BIGINT AS late_size, 0::BIGINT AS late_opened, 0::BIGINT AS late_at,
               false AS late, false AS counted, t FROM c WHERE n = 1
        UNION ALL
        SELECT event_type, n, CASE WHEN s = 50 THEN b + 1 ELSE b END, CASE WHEN s = 50 THEN 0 ELSE s END, o, CASE WHEN s = 50 OR is_late THEN t ELSE flushed END,
               size, opened, due, is_late, s = 50, t
        FROM (SELECT *, CASE WHEN is_late THEN no + 1 ELSE no END AS b, CASE WHEN is_late THEN 1 ELSE size + 1 END AS s,
                     CASE WHEN is_late OR size = 0 THEN t ELSE opened END AS o
              FROM (SELECT c.event_type, c.n, c.t, r.no, r.size, r.opened, r.flushed, greatest(r.flushed + 21600000000, r.opened) AS due,
                           r.size > 0 AND greatest(r.flushed + 21600000000, r.opened) <= c.t AS is_late
                    FROM r JOIN c ON c.event_type = r.event_type AND c.n = r.n + 1)))
, last AS (SELECT * FROM r QUALIFY ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY n DESC) = 1)
SELECT event_type, CASE WHEN counted THEN no - 2 ELSE no - 1 END AS batch_no, late_size AS size, late_opened AS opened_us, late_at AS closed_us, 'time' AS closed_by
FROM r WHERE late
UNION ALL SELECT event_type, no - 1, 50, opened, t, 'count' FROM r WHERE counted
UNION ALL SELECT event_type, no, size, opened, greatest(flushed + 21600000000, opened), 'time' FROM last
WHERE size > 0 AND greatest(flushed + 21600000000, opened) <= epoch_us(TIMESTAMP '2024-01-31 00:00:00')
""")(_st06_closures)


def _st11(spark, sf):
    g = SQ.silent_gaps(_events(spark, sf), "event_type", "ts")
    return g.select("event_type", F.date_format("silent_from", "yyyy-MM-dd HH:mm:ss").alias("silent_from"),
                    F.col("silent_buckets").cast("bigint").alias("silent_buckets"))


register("st11_silent_sources", """
WITH b AS (SELECT DISTINCT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS b FROM events)
, l AS (SELECT event_type, b, LAG(b) OVER (PARTITION BY event_type ORDER BY b) AS p FROM b)
SELECT event_type, strftime(to_timestamp((p + 1) * 3600), '%Y-%m-%d %H:%M:%S') AS silent_from,
       CAST(b - p - 1 AS BIGINT) AS silent_buckets
FROM l WHERE b - p > 1
""")(_st11)


def _a36(spark, sf):
    c = TB.call_log(spark, sf).select("task_type", "created_at", "investigation_id", "status", "confidence")
    b = SQ.dual_trigger_batches(c, "task_type", "created_at", order_cols=("investigation_id",))
    from pyspark.sql import Window
    job = F.concat_ws("#", "task_type", F.col("batch_no").cast("string"))
    w = Window.partitionBy("task_type", "batch_no").orderBy("created_at", "investigation_id")
    b = b.withColumn("job_id", job).withColumn("pos", F.row_number().over(w) - 1)
    kind = F.when(F.col("task_type").isin("task-1", "task-2", "task-3"), "fp_pattern_generation") \
        .when(F.col("task_type").isin("task-4", "task-5"), "playbook_generation").otherwise("other")
    tasks = b.select("job_id", "pos", kind.alias("task_type"))
    results = b.select("job_id", "pos", "status", (F.col("confidence") >= 0.7).alias("valid"))
    # jobs whose number is a multiple of 3 returned one result more than they had tasks
    extra = b.groupBy("job_id", "batch_no").agg(F.count(F.lit(1)).alias("n")).where(F.col("batch_no") % 3 == 0) \
        .select("job_id", F.col("n").alias("pos"), F.lit("success").alias("status"), F.lit(True).alias("valid"))
    z = SQ.zip_results(tasks, results.unionByName(extra))
    return SQ.result_summary(z.withColumn("task_family", F.split("job_id", "#").getItem(0)), ("task_family",))


register("a36_batch_result_summary", None)(_a36)
