"""Registered enrichment queries: IOC load / enrichment / stats / listing (S-20, J-03, A-20,
P-14) and asset-graph consequence (J-12) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.exprs import time_lit
from tidewatch.operators import enrich as EN
from tidewatch.operators import text as TX
from tidewatch.plans.registry import register, tidy
from tidewatch.plans.rules_q import ts
from tidewatch.plans.text_q import sq
from tidewatch.sources import tables as TB

NOW = TB.EVENTS_NOW


def _obs(df, text_col, id_col, src_prefix):
    return EN.ioc_rows(df, text_col, F.concat(F.lit("t"), (F.col(id_col) % 4).cast("string")),
                       time_lit(NOW) - F.make_interval(F.lit(0), F.lit(0), F.lit(0), (F.col(id_col) % 10).cast("int")),
                       F.concat(F.lit(src_prefix), (F.col(id_col) % 3).cast("string")), TX.regex_iocs)


def ioc_table(spark, sf):
    """Threat-intel feed: IOCs found in ``pages``, tenant-scoped, with TTL."""
    return EN.load_iocs(_obs(TB.read(spark, sf, "pages"), "html", "page_id", "feed-"))


def _ioc_sql(table: str, text: str, idc: str, prefix: str) -> str:
    return f"""
  x_{table} AS (
    SELECT 't' || CAST({idc} % 4 AS VARCHAR) AS tenant_id, TIMESTAMP '{NOW}' - to_days(CAST({idc} % 10 AS BIGINT)) AS loaded_at,
           '{prefix}' || CAST({idc} % 3 AS VARCHAR) AS source,
           list_filter(list_distinct(regexp_extract_all({text}, {sq(TX.RE_IPV4)})),
                lambda ip: list_bool_and(list_transform(string_split(ip, '.'), lambda p: CAST(p AS INTEGER) <= 255))) AS ips,
           list_distinct(list_transform(regexp_extract_all({text}, {sq(TX.RE_SHA256)}), lambda h: lower(h))) AS sha256,
           list_distinct(list_transform(regexp_extract_all({text}, {sq(TX.RE_SHA1)}), lambda h: lower(h))) AS sha1_all,
           list_distinct(regexp_extract_all({text}, {sq(TX.RE_IOC_DOMAIN)})) AS dom_all
    FROM {table}),
  y_{table} AS (SELECT *, list_filter(sha1_all, lambda h: NOT list_bool_or(list_transform(sha256, lambda s: contains(s, h)) || [false])) AS sha1
                FROM x_{table}),
  z_{table} AS (SELECT *, list_filter(dom_all, lambda d: NOT list_contains(ips || sha256 || sha1, d)) AS domains FROM y_{table}),
  obs_{table} AS (
    SELECT tenant_id, loaded_at, source, unnest(ips) AS value, 'ip' AS ioc_type, 70 AS confidence FROM z_{table}
    UNION ALL SELECT tenant_id, loaded_at, source, unnest(sha256), 'filehash', 80 FROM z_{table}
    UNION ALL SELECT tenant_id, loaded_at, source, unnest(sha1), 'filehash', 70 FROM z_{table}
    UNION ALL SELECT tenant_id, loaded_at, source, unnest(domains), 'dns', 60 FROM z_{table})"""


IOC_SQL = "WITH" + _ioc_sql("pages", "html", "page_id", "feed-") + """,
  iocs AS (
    SELECT * EXCLUDE (rn), loaded_at + to_seconds(CAST(CASE WHEN confidence > 80 THEN 2592000 WHEN confidence >= 50
                                                              THEN 604800 ELSE 86400 END AS BIGINT)) AS expires_at
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant_id, ioc_type, value
                                       ORDER BY loaded_at DESC, confidence DESC, source) AS rn FROM obs_pages)
    WHERE rn = 1)
"""


def _s20(spark, sf):
    return ioc_table(spark, sf).select("tenant_id", "ioc_type", "value", F.col("confidence").cast("bigint").alias("confidence"),
                                       F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


register("s20_ioc_load", IOC_SQL + """
SELECT tenant_id, ioc_type, value, CAST(confidence AS BIGINT) AS confidence,
       strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at FROM iocs
""")(_s20)


def _j03(spark, sf):
    ents = _obs(TB.read(spark, sf, "documents"), "text", "doc_id", "doc-") \
        .select("tenant_id", F.col("ioc_type").alias("entity_type"), "value").distinct()
    e = EN.enrich_iocs(ents, ioc_table(spark, sf), NOW)
    return e.where("ioc_match").select("tenant_id", "entity_type", "value",
                                       F.col("ioc_confidence").cast("bigint").alias("ioc_confidence"), "ioc_source")


register("j03_ioc_enrichment", IOC_SQL + "," + _ioc_sql("documents", "text", "doc_id", "doc-") + f"""
, ents AS (SELECT DISTINCT tenant_id, ioc_type AS entity_type, value FROM obs_documents)
SELECT e.tenant_id, e.entity_type, e.value, CAST(i.confidence AS BIGINT) AS ioc_confidence, i.source AS ioc_source
FROM ents e JOIN iocs i ON e.tenant_id = i.tenant_id AND e.entity_type = i.ioc_type AND e.value = i.value
WHERE i.expires_at > {ts(NOW)}
""")(_j03)


def _a20(spark, sf):
    return EN.ioc_stats(ioc_table(spark, sf), NOW)


register("a20_ioc_stats", IOC_SQL + f"""
, g AS (SELECT ioc_type, source, GROUPING(ioc_type, source) AS gid, COUNT(*) AS n,
               COUNT(*) FILTER (WHERE loaded_at >= {ts(NOW, hours=24)} AND loaded_at < {ts(NOW)}) AS n24,
               COUNT(*) FILTER (WHERE loaded_at >= {ts(NOW, days=7)} AND loaded_at < {ts(NOW)}) AS n7
        FROM iocs GROUP BY GROUPING SETS ((ioc_type), (source), ()))
SELECT CASE gid WHEN 1 THEN 'ioc_type' WHEN 2 THEN 'source' ELSE 'total' END AS dimension,
       CASE WHEN gid = 3 THEN '' ELSE COALESCE(ioc_type, source) END AS key,
       CAST(n AS BIGINT) AS count, CAST(n24 AS BIGINT) AS new_24h, CAST(n7 AS BIGINT) AS new_7d FROM g
""")(_a20)


def _p14(spark, sf):
    return EN.list_iocs(ioc_table(spark, sf), "EXAMPLE", limit=20, offset=2).select("tenant_id", "ioc_type", "value")


register("p14_list_iocs", IOC_SQL + """
SELECT tenant_id, ioc_type, value FROM iocs WHERE value ILIKE '%EXAMPLE%'
ORDER BY loaded_at DESC, tenant_id, ioc_type, value LIMIT 20 OFFSET 2
""")(_p14)


# ---------------------------------------------------------------- J-12 asset graph on TPC-H tables
ZONES = ("Zone0_Safety", "Zone1_EdgeInference", "Zone2_SCADA", "Zone3_Enterprise", "Cloud_Production",
         "IT_UserWorkstations")


EDGES_PER_TASK = 250_000


def graph(spark, sf):
    """Edges, zones, and the number of tasks for the edges: by their rows (a count of the files' footers), so that a task's memory
    does not grow with the table. Edges are dealt by asset, the key of the joins that follow."""
    li = TB.read(spark, sf, "lineitem")
    part = TB.read(spark, sf, "part")
    tasks = li.count() // EDGES_PER_TASK + 1
    deploys = li.select(F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")).alias("model_id"),
                        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("asset_id")).repartition(tasks, "asset_id").distinct()
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.col("p_partkey") % len(ZONES) + 1).cast("int"))
    resides = part.select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("asset_id"), zone.alias("zone"))
    return deploys, resides, tasks


def _j12(spark, sf):
    deploys, resides, tasks = graph(spark, sf)
    c = EN.consequence_by_asset(None, deploys, resides, tasks=tasks)
    return c.select("asset_id", F.array_join(F.coalesce("consequences", F.array().cast("array<string>")), "|")
                    .alias("consequences"), "worst_consequence", "consequence_severity", "path_found")


_ZSQL = "CASE " + " ".join(f"WHEN p_partkey % {len(ZONES)} = {i} THEN '{z}'" for i, z in enumerate(ZONES)) + " END"
_CONS = {"Zone0_Safety": "safety_life", "Zone1_EdgeInference": "equipment", "Zone2_SCADA": "downtime",
         "Zone3_Enterprise": "data_loss", "Cloud_Production": "downtime", "IT_UserWorkstations": "data_loss"}
_CSQL = "CASE zone " + " ".join(f"WHEN '{z}' THEN '{c}'" for z, c in _CONS.items()) + " END"
register("j12_graph_consequence", f"""
WITH dep AS (SELECT DISTINCT 'supp-' || CAST(l_suppkey AS VARCHAR) AS model_id, 'part-' || CAST(l_partkey AS VARCHAR) AS asset_id
             FROM lineitem)
, res AS (SELECT 'part-' || CAST(p_partkey AS VARCHAR) AS asset_id, {_ZSQL} AS zone FROM part)
, res2 AS (SELECT asset_id, zone, {_CSQL} AS consequence FROM res)
, paths AS (SELECT DISTINCT a.asset_id, r.consequence
            FROM dep a JOIN dep b ON a.model_id = b.model_id AND b.asset_id <> a.asset_id
            JOIN res2 r ON r.asset_id = b.asset_id)
, agg AS (SELECT asset_id, string_agg(consequence, '|' ORDER BY consequence) AS consequences,
                 arg_max(consequence, CASE consequence WHEN 'safety_life' THEN 4 WHEN 'equipment' THEN 3
                                        WHEN 'downtime' THEN 2 ELSE 1 END) AS worst FROM paths GROUP BY asset_id)
SELECT r.asset_id, COALESCE(g.consequences, '') AS consequences, COALESCE(g.worst, r.consequence) AS worst_consequence,
       CASE COALESCE(g.worst, r.consequence) WHEN 'safety_life' THEN 'CRITICAL' WHEN 'equipment' THEN 'HIGH'
            WHEN 'downtime' THEN 'MEDIUM' ELSE 'LOW' END AS consequence_severity, g.asset_id IS NOT NULL AS path_found
FROM res2 r LEFT JOIN agg g ON r.asset_id = g.asset_id
""")(_j12)


# ---------------------------------------------------------------- J-16 / J-04 / P-24 / P-25 / J-20
INV = TB.INVESTIGATIONS_NOW


def _playbooks(spark, sf):
    p = TB.read(spark, sf, "part")
    sev = F.element_at(F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low", "informational")]),
                       (F.col("p_size") % 5 + 1).cast("int"))
    return p.select(F.concat(F.lit("pb-"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("playbook_id"),
                    sev.alias("severity"))


def _j16(spark, sf):
    alerts = TB.investigations(spark, sf).where(F.col("state") == "awaiting_human")
    return EN.select_playbooks(alerts, _playbooks(spark, sf), 3).select(
        "alert_id", "playbook_id", F.col("rank").cast("bigint").alias("rank"))


from tidewatch.plans.oracle_roles import with_roles  # noqa: E402

register("j16_playbooks_by_severity", with_roles("""
, pb AS (SELECT 'pb-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS playbook_id,
                ['critical', 'high', 'medium', 'low', 'informational'][p_size % 5 + 1] AS severity FROM part)
, j AS (SELECT a.alert_id, p.playbook_id, ROW_NUMBER() OVER (PARTITION BY a.alert_id ORDER BY p.playbook_id) AS rank
        FROM investigations a JOIN pb p ON a.severity = p.severity WHERE a.state = 'awaiting_human')
SELECT alert_id, playbook_id, CAST(rank AS BIGINT) AS rank FROM j WHERE rank <= 3
""", "investigations"))(_j16)


def _profiles(spark, sf):
    c = TB.read(spark, sf, "customer")
    upd = time_lit(INV) - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), (F.col("c_custkey") % 48).cast("int"))
    return c.select(
        F.concat(F.lit("t"), (F.col("c_custkey") % 4).cast("string")).alias("tenant_id"),
        F.concat(F.lit("asset-"), (F.col("c_custkey") % 100 + 1).cast("string")).alias("entity_id"),
        (F.col("c_custkey") % 10).cast("int").alias("priority"), upd.alias("updated_at"))


def _p25(spark, sf):
    inv = TB.investigations(spark, sf).where(F.col("state") != "closed") \
        .select("alert_id", "tenant_id", F.col("asset_id").alias("entity_id"))
    prof = _profiles(spark, sf)
    prof = prof.groupBy("tenant_id", "entity_id").agg(F.max_by("priority", "updated_at").alias("priority"),
                                                      F.max("updated_at").alias("updated_at"))
    er = EN.entity_risk(inv, prof, INV)
    return EN.alert_risk(er).groupBy("risk_state").agg(F.count(F.lit(1)).alias("alerts"))


register("p25_alert_risk_rollup", with_roles(f"""
, prof0 AS (SELECT 't' || CAST(c_custkey % 4 AS VARCHAR) AS tenant_id,
                   'asset-' || CAST(c_custkey % 100 + 1 AS VARCHAR) AS entity_id, c_custkey % 10 AS priority,
                   {ts(INV)} - to_hours(CAST(c_custkey % 48 AS BIGINT)) AS updated_at
            FROM customer)
, prof AS (SELECT tenant_id, entity_id, arg_max(priority, updated_at) AS priority, MAX(updated_at) AS updated_at
           FROM prof0 GROUP BY tenant_id, entity_id)
, e AS (SELECT i.alert_id, p.priority,
               EXTRACT(EPOCH FROM ({ts(INV)} - p.updated_at)) / 3600.0 AS fresh
        FROM investigations i LEFT JOIN prof p ON i.tenant_id = p.tenant_id AND i.asset_id = p.entity_id
        WHERE i.state <> 'closed')
, r AS (SELECT alert_id, CASE WHEN priority IS NULL THEN 0 WHEN fresh > 24 THEN 1 WHEN priority < 3 THEN 2
                              WHEN priority < 6 THEN 3 ELSE 4 END AS rk FROM e)
, a AS (SELECT alert_id, MAX(rk) AS rk FROM r GROUP BY alert_id)
SELECT CASE rk WHEN 0 THEN 'no_baseline' WHEN 1 THEN 'unknown' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' ELSE 'high' END
       AS risk_state, CAST(COUNT(*) AS BIGINT) AS alerts FROM a GROUP BY 1
""", "investigations"))(_p25)


def _j20(spark, sf):
    iocs = ioc_table(spark, sf)
    sources = spark.range(4).select(F.concat(F.lit("feed-"), F.col("id").cast("string")).alias("source"))
    loads = iocs.select("source", "loaded_at", F.when(F.col("expires_at") > time_lit(NOW), "ok").otherwise("stale")
                        .alias("status"))
    f = EN.feed_status(sources, loads, iocs)
    return f.select("source", F.date_format("last_loaded_at", "yyyy-MM-dd").alias("last_loaded_at"), "last_status",
                    F.col("ioc_count").cast("bigint").alias("ioc_count"))


register("j20_feed_status", IOC_SQL + f"""
, s AS (SELECT 'feed-' || CAST(i AS VARCHAR) AS source FROM range(4) t(i))
, l AS (SELECT source, MAX(loaded_at) AS last_loaded_at,
               arg_max(CASE WHEN expires_at > {ts(NOW)} THEN 'ok' ELSE 'stale' END, loaded_at) AS last_status,
               COUNT(*) AS n FROM iocs GROUP BY source)
SELECT s.source, strftime(l.last_loaded_at, '%Y-%m-%d') AS last_loaded_at, l.last_status,
       CAST(COALESCE(l.n, 0) AS BIGINT) AS ioc_count
FROM s LEFT JOIN l ON s.source = l.source
""")(_j20)


def _j06(spark, sf):
    inv = TB.investigations(spark, sf)
    m = EN.technique_crosswalk(inv, EN.rule_crosswalk(spark))
    return m.groupBy("atlas_id", "attack_id").agg(F.count(F.lit(1)).alias("investigations"))


def _j06_sql() -> str:
    from tidewatch.operators.rules import RULES
    pairs = sorted({(m.atlas_technique, m.attack_technique) for m in RULES.values() if m.attack_technique})
    values = ", ".join(f"('{a}', '{t}')" for a, t in pairs)
    return with_roles(f"""
, cw AS (SELECT * FROM (VALUES {values}) t(atlas_id, attack_id))
, ex AS (SELECT unnest(atlas_techniques) AS atlas_id FROM investigations)
SELECT ex.atlas_id, cw.attack_id, CAST(COUNT(*) AS BIGINT) AS investigations FROM ex JOIN cw USING (atlas_id)
GROUP BY 1, 2
""", "investigations")


register("j06_technique_crosswalk", _j06_sql())(_j06)


def _j07(spark, sf):
    from tidewatch.operators.rules import RULES
    inv = TB.investigations(spark, sf)
    techs = inv.select(F.col("investigation_id").alias("case_id"), F.explode("atlas_techniques").alias("technique_id"))
    intel = spark.createDataFrame(sorted({(m.atlas_technique, m.threat_model_ref) for m in RULES.values()}),
                                  "technique_id string, detail string")
    ents = inv.select(F.col("investigation_id").alias("case_id"), F.explode(F.array("asset_id", "src_ip")).alias("value"))
    # case IOCs: the investigation's own entity values that the IOC feed knows (tenant-scoped)
    live = ioc_table(spark, sf).select("tenant_id", "value")
    hits = inv.select(F.col("investigation_id").alias("case_id"), "tenant_id",
                      F.explode(F.array("asset_id", "src_ip")).alias("value")).join(live, ["tenant_id", "value"], "left_semi")
    detail = live.select("value", F.lit("known-ioc").alias("detail")).distinct()
    d = EN.deep_retrieval(techs, ents, hits.drop("tenant_id"), intel, detail)
    return d.groupBy("type", "detail").agg(F.count(F.lit(1)).alias("rows"))


def _j07_sql() -> str:
    from tidewatch.operators.rules import RULES
    values = ", ".join(f"('{a}', '{r}')" for a, r in sorted({(m.atlas_technique, m.threat_model_ref) for m in RULES.values()}))
    return with_roles(f"""
, intel AS (SELECT * FROM (VALUES {values}) t(technique_id, detail))
, t AS (SELECT unnest(atlas_techniques) AS technique_id FROM investigations)
SELECT 'technique_intel' AS type, COALESCE(i.detail, 'unavailable') AS detail, CAST(COUNT(*) AS BIGINT) AS rows
FROM t LEFT JOIN intel i USING (technique_id) GROUP BY 2
""", "investigations")


register("j07_deep_retrieval", _j07_sql())(_j07)


def stix_feed(spark, sf):
    """STIX 2.1 indicators published from the IOC table (the feed format the loader accepts)."""
    i = ioc_table(spark, sf)
    pattern = (F.when(F.col("ioc_type") == "ip", F.concat(F.lit("[ipv4-addr:value = '"), F.col("value"), F.lit("']")))
               .when(F.col("ioc_type") == "dns", F.concat(F.lit("[domain-name:value = '"), F.col("value"), F.lit("']")))
               .when(F.length("value") == 64, F.concat(F.lit("[file:hashes.'SHA-256' = '"), F.col("value"), F.lit("']")))
               .otherwise(F.concat(F.lit("[file:hashes.'SHA-1' = '"), F.col("value"), F.lit("']"))))
    kc = F.when(F.col("confidence") >= 70, F.array(
        F.struct(F.lit("mitre-attack").alias("kill_chain_name"), F.lit("t1071.001--web-protocols").alias("phase_name")),
        F.struct(F.lit("lockheed").alias("kill_chain_name"), F.lit("delivery").alias("phase_name"))))
    return i.select(F.to_json(F.struct(
        F.concat(F.lit("indicator--"), F.md5(F.concat_ws("|", "tenant_id", "value"))).alias("id"), pattern.alias("pattern"),
        F.col("confidence").cast("int").alias("confidence"),
        F.array(F.when(F.col("confidence") >= 70, "malicious-activity").otherwise("anomalous-activity")).alias("labels"),
        F.date_format("loaded_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("valid_from"),
        F.date_format("expires_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("valid_until"),
        F.col("source").alias("created_by_ref"), kc.alias("kill_chain_phases"))).alias("raw"))


def _e20(spark, sf):
    d = EN.stix_to_iocs(stix_feed(spark, sf))
    return d.select("indicator_type", "indicator_value", F.col("confidence").cast("bigint").alias("confidence"),
                    "severity", F.array_join("mitre_techniques", ",").alias("mitre"), "expiry")


register("e20_stix_to_iocs", IOC_SQL + """
SELECT CASE WHEN ioc_type = 'ip' THEN 'ipv4' WHEN ioc_type = 'dns' THEN 'domain'
            WHEN length(value) = 64 THEN 'file_hash_sha256' ELSE 'file_hash_sha1' END AS indicator_type,
       value AS indicator_value, CAST(confidence AS BIGINT) AS confidence,
       CASE WHEN confidence >= 70 THEN 'high' ELSE 'medium' END AS severity,
       CASE WHEN confidence >= 70 THEN 't1071.001' ELSE '' END AS mitre,
       strftime(expires_at, '%Y-%m-%dT%H:%M:%SZ') AS expiry
FROM iocs
""")(_e20)


def _e16(spark, sf):
    inf = TB.inference_log(spark, sf).select(F.col("edge_node_id").alias("asset_id"), F.lit("inference").alias("source"),
                                              "ts", (F.col("physics_check_result") != "fail").alias("ok"),
                                              F.format_number("confidence_score", 3).alias("detail"))
    orc = TB.oracle_log(spark, sf).select(F.col("edge_node_id").alias("asset_id"), F.lit("oracle").alias("source"), "ts",
                                           F.col("error_state").isNull().alias("ok"), F.col("check_result").alias("detail"))
    sen = TB.sensor_log(spark, sf).select(F.col("edge_node_id").alias("asset_id"), F.lit("sensor").alias("source"), "ts",
                                           (F.col("protocol_violations") == 0).alias("ok"), F.col("connection_state").alias("detail"))
    obs = inf.unionByName(orc).unionByName(sen)
    ov = spark.createDataFrame([("node-0", "Zone0_Safety"), ("node-7", "Zone1_EdgeInference")], "asset_id string, zone string")
    inv = EN.asset_inventory(obs, ov)
    return tidy(inv.select("asset_id", F.array_join("sources", ",").alias("sources"), "events", "failures", "failure_rate",
                           "latest_detail", "asset_class", "zone"))


register("e16_asset_inventory", with_roles("""
, obs AS (SELECT edge_node_id AS asset_id, 'inference' AS source, ts, physics_check_result <> 'fail' AS ok,
                 printf('%.3f', confidence_score) AS detail FROM inference_log
          UNION ALL SELECT edge_node_id, 'oracle', ts, error_state IS NULL, check_result FROM oracle_log
          UNION ALL SELECT edge_node_id, 'sensor', ts, protocol_violations = 0, connection_state FROM sensor_log)
, g AS (SELECT asset_id, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, COUNT(*) AS events,
               COUNT(*) FILTER (WHERE NOT ok) AS failures, arg_max(detail, (ts, source, detail)) AS latest_detail
        FROM obs GROUP BY asset_id)
, ov AS (SELECT * FROM (VALUES ('node-0', 'Zone0_Safety'), ('node-7', 'Zone1_EdgeInference')) t(asset_id, zone))
SELECT g.asset_id, sources, CAST(events AS BIGINT) AS events, CAST(failures AS BIGINT) AS failures,
       ROUND(failures / events, 6) AS failure_rate, latest_detail,
       CASE WHEN contains(sources, 'sensor') THEN 'ot_gateway' WHEN contains(sources, 'inference') THEN 'edge_inference'
            ELSE 'edge_node' END AS asset_class, COALESCE(ov.zone, 'Zone3_Enterprise') AS zone
FROM g LEFT JOIN ov ON g.asset_id = ov.asset_id
""", "inference_log", "oracle_log", "sensor_log"))(_e16)


def _e19(spark, sf):
    e = TB.read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    flags = F.to_json(F.struct(*[((k % (i + 2)) == 0).alias(name) for i, (name, _) in enumerate(EN.ANOMALY_DESCRIPTIONS)]))
    rec = e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("UserPrincipalName"),
                   F.lit("10.0.0.1").alias("SourceIPAddress"),
                   (F.floor(F.col("value")) % 12).cast("int").alias("InvestigationPriority"), flags.alias("ActivityInsights"))
    b = EN.behaviour_context(rec)
    return b.groupBy("risk_level", F.size("anomalies").cast("bigint").alias("n_anomalies")).agg(
        F.count(F.lit(1)).alias("records"))


def _e19_sql() -> str:
    n = " + ".join(f"(CAST(json_extract_string(props, '$.k') AS BIGINT) % {i + 2} = 0)::INT"
                   for i in range(len(EN.ANOMALY_DESCRIPTIONS)))
    return f"""
WITH r AS (SELECT CAST(floor(value) AS BIGINT) % 12 AS p, {n} AS n FROM events)
SELECT CASE WHEN p BETWEEN 0 AND 2 THEN 'low' WHEN p BETWEEN 3 AND 5 THEN 'medium' WHEN p BETWEEN 6 AND 7 THEN 'high'
            WHEN p BETWEEN 8 AND 10 THEN 'critical' ELSE 'unknown' END AS risk_level,
       CAST(n AS BIGINT) AS n_anomalies, CAST(COUNT(*) AS BIGINT) AS records
FROM r GROUP BY ALL
"""


register("e19_behaviour_context", _e19_sql())(_e19)
