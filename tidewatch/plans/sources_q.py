"""Registered source-adapter queries (S-01 .. S-06, P-01) on vendor JSON derived from ``orders``.

The oracle computes the expected canonical fields directly from ``orders`` (no JSON), so it
checks the Spark side's JSON parsing, fallbacks and entity building end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.plans.registry import register
from tidewatch.sources import adapters as AD
from tidewatch.sources import tables as TB


def _s06(spark, sf):
    c = AD.union_sources(TB.vendor_alerts(spark, sf))
    return c.select("alert_id", "source", "timestamp", "title", "severity",
                    F.array_join("tactics", "|").alias("tactics"), F.array_join("techniques", "|").alias("techniques"),
                    F.json_array_length("entities_raw").cast("bigint").alias("n_entities"), "product", "tenant_id")


S06_SQL = """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, o_orderdate AS d FROM orders)
SELECT 'S-' || CAST(k AS VARCHAR) AS alert_id, 'sentinel' AS source, strftime(d, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
       'Suspicious sign-in pattern ' || CAST(c % 40 AS VARCHAR) AS title,
       CASE p WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' WHEN '3-MEDIUM' THEN 'low'
              WHEN '4-NOT SPECIFIED' THEN 'informational' ELSE 'medium' END AS severity,
       CASE WHEN c % 2 = 0 THEN 'InitialAccess|Execution' ELSE 'Persistence' END AS tactics,
       CASE WHEN c % 3 = 0 THEN '' ELSE 'T1078|T1059.001' END AS techniques,
       CAST(1 AS BIGINT) AS n_entities, 'Azure Sentinel' AS product, 't' || CAST(c % 4 AS VARCHAR) AS tenant_id
FROM o WHERE k % 3 = 0 AND k % 97 <> 0
UNION ALL
SELECT 'E-' || CAST(k AS VARCHAR), 'elastic', strftime(d, '%Y-%m-%dT%H:%M:%S.000Z'),
       'Suspicious sign-in pattern ' || CAST(c % 40 AS VARCHAR),
       CASE p WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' ELSE 'medium' END,
       CASE WHEN c % 3 = 0 THEN 'Credential Access' ELSE 'Initial Access' END,
       CASE WHEN c % 3 = 0 THEN 'T1110|T1110.001' ELSE 'T1078|T1078.004|T1110' END,
       CAST(2 + (k % 2 = 0)::INT + (k % 5 = 0)::INT + (k % 7 = 0)::INT + (k % 11 = 0)::INT AS BIGINT),
       'endpoint', 't' || CAST(c % 4 AS VARCHAR)
FROM o WHERE k % 3 = 1 AND k % 97 <> 0
UNION ALL
SELECT 'N-' || CAST(k AS VARCHAR), 'splunk',
       strftime(d, '%Y-%m-%dT%H:%M:%S') || CASE WHEN k % 10 = 0 THEN '.500000' ELSE '' END || '+00:00',
       'Suspicious sign-in pattern ' || CAST(c % 40 AS VARCHAR),
       CASE p WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
              WHEN '4-NOT SPECIFIED' THEN 'informational' ELSE 'medium' END,
       CASE WHEN k % 2 = 0 THEN 'initial-access|execution' ELSE 'persistence|privilege-escalation' END,
       'T1078|T1548', CAST(4 + (k % 7 = 0)::INT AS BIGINT), 'splunk_es', 't' || CAST(c % 4 AS VARCHAR)
FROM o WHERE k % 3 = 2 AND k % 97 <> 0
"""
register("s06_canonical_alerts", S06_SQL, headline=True)(_s06)


def _p01(spark, sf):
    good, bad = AD.validate_canonical(AD.union_sources(TB.vendor_alerts(spark, sf)))
    return good.groupBy("source").agg(F.count(F.lit(1)).alias("valid")).join(
        bad.groupBy("source").agg(F.count(F.lit(1)).alias("rejected")), "source", "full_outer") \
        .select("source", F.coalesce("valid", F.lit(0)).cast("bigint").alias("valid"),
                F.coalesce("rejected", F.lit(0)).cast("bigint").alias("rejected"))


register("p01_validate_canonical", f"""
WITH e AS ({S06_SQL})
SELECT source, CAST(COUNT(*) AS BIGINT) AS valid, CAST(0 AS BIGINT) AS rejected FROM e GROUP BY source
""")(_p01)


def _t01(spark, sf):
    from tidewatch.operators.entities import parse_entities_df
    from tidewatch.session import checkpoint_dir
    checkpoint_dir(spark)
    # the canonical alert table is a stored stage (alerts.normalized); parsing reads it
    c = AD.union_sources(TB.vendor_alerts(spark, sf)).select("source", "entities_raw", "raw_payload") \
        .checkpoint(eager=True)
    p = parse_entities_df(c, "entities_raw", "raw_payload", "p")
    ents = p.select("source", F.explode("p.entities").alias("e")) \
        .groupBy("source", F.col("e.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("entities"))
    errs = p.select("source", F.lit("parse_error").alias("entity_type"), F.size("p.parse_errors").alias("n")) \
        .groupBy("source", "entity_type").agg(F.sum("n").cast("bigint").alias("entities"))
    return ents.unionByName(errs)


register("t01_entity_parse", """
WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 97 <> 0)
, s AS (SELECT COUNT(*) AS n FROM o WHERE k % 3 = 0)
, e AS (SELECT COUNT(*) AS n, SUM((k % 2 = 0)::INT + (k % 11 = 0)::INT) AS acc, SUM(1 + (k % 5 = 0)::INT) AS ip,
               SUM((k % 7 = 0)::INT) AS proc FROM o WHERE k % 3 = 1)
, p AS (SELECT COUNT(*) AS n, SUM((k % 7 = 0)::INT) AS proc FROM o WHERE k % 3 = 2)
SELECT 'sentinel' AS source, 'ip' AS entity_type, CAST(n AS BIGINT) AS entities FROM s
UNION ALL SELECT 'elastic', 'host', CAST(n AS BIGINT) FROM e
UNION ALL SELECT 'elastic', 'account', CAST(acc AS BIGINT) FROM e
UNION ALL SELECT 'elastic', 'ip', CAST(ip AS BIGINT) FROM e
UNION ALL SELECT 'elastic', 'process', CAST(proc AS BIGINT) FROM e
UNION ALL SELECT 'splunk', 'ip', CAST(2 * n AS BIGINT) FROM p
UNION ALL SELECT 'splunk', 'host', CAST(n AS BIGINT) FROM p
UNION ALL SELECT 'splunk', 'account', CAST(n AS BIGINT) FROM p
UNION ALL SELECT 'splunk', 'process', CAST(proc AS BIGINT) FROM p
UNION ALL SELECT 'sentinel', 'parse_error', CAST(0 AS BIGINT)
UNION ALL SELECT 'elastic', 'parse_error', CAST(0 AS BIGINT)
UNION ALL SELECT 'splunk', 'parse_error', CAST(0 AS BIGINT)
""")(_t01)


def _u06(spark, sf):
    c = AD.union_sources(TB.vendor_alerts(spark, sf))
    merged = F.array_distinct(F.concat("techniques", "tactics"))
    return c.groupBy("source", F.size(merged).cast("bigint").alias("n_items")).agg(F.count(F.lit(1)).alias("alerts"))


register("u06_ordered_distinct_merge", f"""
WITH e AS ({S06_SQL})
SELECT source, CAST(len(list_distinct(
         (CASE WHEN techniques = '' THEN []::VARCHAR[] ELSE string_split(techniques, '|') END)
      || (CASE WHEN tactics = '' THEN []::VARCHAR[] ELSE string_split(tactics, '|') END))) AS BIGINT) AS n_items,
       CAST(COUNT(*) AS BIGINT) AS alerts
FROM e GROUP BY ALL
""")(_u06)


def _e21(spark, sf):
    d = AD.data_quality(AD.union_sources(TB.vendor_alerts(spark, sf)))
    return d.groupBy("source", F.round("data_quality_score", 6).alias("data_quality_score"),
                     F.size("dq_warnings").cast("bigint").alias("warnings")).agg(F.count(F.lit(1)).alias("alerts"))


register("e21_alert_data_quality", f"""
WITH e AS ({S06_SQL})
, w AS (SELECT source, (tactics = '' AND techniques = '') AS no_mitre FROM e)
SELECT source, ROUND(1.0 - CASE WHEN no_mitre THEN 0.1 ELSE 0 END, 6) AS data_quality_score,
       CAST(no_mitre::INT AS BIGINT) AS warnings, CAST(COUNT(*) AS BIGINT) AS alerts FROM w GROUP BY ALL
""")(_e21)


def _e24(spark, sf):
    c = AD.union_sources(TB.vendor_alerts(spark, sf))
    # a rule catalogue is small: the distinct rule titles per tactic are bounded by its size
    idx = c.select(F.explode("tactics").alias("tactic"), F.col("title").alias("rule")).distinct() \
        .groupBy("tactic").agg(F.array_sort(F.collect_list("rule")).alias("rules"))
    return idx.select("tactic", F.size("rules").cast("bigint").alias("rules"),
                      F.element_at("rules", 1).alias("first_rule"))


register("e24_tactic_rule_index", f"""
WITH e AS ({S06_SQL})
, x AS (SELECT DISTINCT unnest(CASE WHEN tactics = '' THEN []::VARCHAR[] ELSE string_split(tactics, '|') END) AS tactic,
               title AS rule FROM e)
SELECT tactic, CAST(COUNT(*) AS BIGINT) AS rules, MIN(rule) AS first_rule FROM x GROUP BY tactic
""")(_e24)


def firewall_log(spark, sf):
    """Firewall records on ``events`` (CEF-style columns)."""
    e = TB.read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    act = F.element_at(F.array(*[F.lit(a) for a in ("accept", "Drop", "reset-both", "Block", "weird")]),
                       (F.col("event_id") % 5 + 1).cast("int"))
    src = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("10.1."), (F.col("user_id") % 250).cast("string"), F.lit(".9"))) \
        .otherwise(F.concat(F.lit("203.0."), (F.col("user_id") % 250).cast("string"), F.lit(".9")))
    dst = F.when(k % 2 == 0, F.concat(F.lit("192.168.0."), (k % 250).cast("string"))) \
        .otherwise(F.concat(F.lit("198.51.100."), (k % 250).cast("string")))
    ext = F.when(k % 4 == 0, F.concat(F.lit("cat=malware;app=ssl proto=6"))) \
        .when(k % 4 == 1, F.lit("attack=sqli appcat=web")).when(k % 4 == 2, F.lit("act=x;  y=1")).otherwise(F.lit(""))
    return e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("TimeGenerated"), src.alias("SourceIP"),
                    (k * 7).cast("string").alias("SourcePort"), dst.alias("DestinationIP"), F.lit("443").alias("DestinationPort"),
                    F.lit("tcp").alias("Protocol"), act.alias("DeviceAction"), ext.alias("AdditionalExtensions"),
                    F.when(F.col("event_type") == "error", F.lit("sig-1")).alias("DeviceEventClassID"),
                    F.lit("https").alias("ApplicationProtocol"), F.lit("acme").alias("DeviceVendor"))


def _e18(spark, sf):
    n = AD.normalise_network(firewall_log(spark, sf))
    return n.groupBy("action", "direction", F.coalesce("threat_name", F.lit("-")).alias("threat_name"),
                     "application").agg(F.count(F.lit(1)).alias("events"))


register("e18_firewall_normalise", """
WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
, f AS (SELECT ['accept', 'Drop', 'reset-both', 'Block', 'weird'][event_id % 5 + 1] AS act,
               CASE WHEN user_id % 3 = 0 THEN '10.1.' ELSE '203.0.' END AS src,
               CASE WHEN k % 2 = 0 THEN '192.168.0.' ELSE '198.51.100.' END AS dst,
               CASE WHEN k % 4 = 0 THEN 'cat=malware;app=ssl proto=6' WHEN k % 4 = 1 THEN 'attack=sqli appcat=web'
                    WHEN k % 4 = 2 THEN 'act=x;  y=1' ELSE '' END AS ext,
               CASE WHEN event_type = 'error' THEN 'sig-1' END AS cls FROM e)
, n AS (SELECT CASE act WHEN 'accept' THEN 'allow' WHEN 'Drop' THEN 'drop' WHEN 'reset-both' THEN 'reset'
                        WHEN 'Block' THEN 'deny' ELSE lower(act) END AS action,
               CASE WHEN src = '10.1.' AND dst = '192.168.0.' THEN 'internal' WHEN src = '10.1.' THEN 'outbound'
                    WHEN dst = '192.168.0.' THEN 'inbound' ELSE 'external-to-external' END AS direction,
               COALESCE(NULLIF(regexp_extract(ext, '(?:^|[;\\s])cat=([^;\\s]*)', 1), ''),
                        NULLIF(regexp_extract(ext, '(?:^|[;\\s])attack=([^;\\s]*)', 1), ''), cls, '-') AS threat_name,
               COALESCE(NULLIF(regexp_extract(ext, '(?:^|[;\\s])app=([^;\\s]*)', 1), ''),
                        NULLIF(regexp_extract(ext, '(?:^|[;\\s])appcat=([^;\\s]*)', 1), ''), 'https') AS application
        FROM f)
SELECT action, direction, threat_name, application, CAST(COUNT(*) AS BIGINT) AS events FROM n GROUP BY ALL
""")(_e18)
