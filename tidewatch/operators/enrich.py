"""Enrichment joins: IOC table and lookups (S-20, J-03, A-20, P-14), asset-graph consequence
(J-12, J-13), behaviour-risk roll-up (J-04, P-24, P-25) and playbook selection (J-16).

Every "lookup per alert" of the reference becomes one set-based join: N alerts cost a fixed
number of joins, not N x k round trips.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import (RISK_RANK, ZONE_CONSEQUENCE, ZONE_CONSEQUENCE_DEFAULT, classify_risk, col_type, ioc_expires_at, lookup, shift, time_lit,
                                       zone_consequence)
from tidewatch.operators.common import first_per_key
from tidewatch.operators.text import let

# Fixed values (must equal the reference): consequence -> severity and order of severity.
CONSEQUENCE_SEVERITY = {"safety_life": "CRITICAL", "equipment": "HIGH", "downtime": "MEDIUM", "data_loss": "LOW"}
CONSEQUENCE_RANK = {"safety_life": 4, "equipment": 3, "downtime": 2, "data_loss": 1}


# ---------------------------------------------------------------------------
# IOCs
# ---------------------------------------------------------------------------

def load_iocs(observed: DataFrame) -> DataFrame:
    """S-20: (tenant_id, ioc_type, value, confidence 0-100, source, loaded_at) -> IOC table with
    ``expires_at`` by confidence tier; a re-loaded key keeps its latest load (cache overwrite)."""
    latest = first_per_key(observed, ["tenant_id", "ioc_type", "value"],
                           [F.desc("loaded_at"), F.desc("confidence"), F.asc("source")])
    return latest.withColumn("expires_at", ioc_expires_at(F.col("loaded_at"), F.col("confidence")))


def enrich_iocs(entities: DataFrame, iocs: DataFrame, now, *, type_col: str = "entity_type",
                value_col: str = "value") -> DataFrame:
    """J-03: exact (tenant, type, value) match against live IOCs (expires_at > now); the IOC's
    fields override the entity's where present. A left join: unmatched entities stay."""
    live = iocs.where(F.col("expires_at") > time_lit(now, col_type(iocs, "expires_at"))).select(
        "tenant_id", F.col("ioc_type").alias(type_col), F.col("value").alias(value_col),
        F.col("confidence").alias("ioc_confidence"), F.col("source").alias("ioc_source"), "expires_at")
    return entities.join(live, ["tenant_id", type_col, value_col], "left") \
        .withColumn("ioc_match", F.col("ioc_confidence").isNotNull())


def ioc_stats(iocs: DataFrame, now) -> DataFrame:
    """A-20: total, by type and by source in ONE pass, with loads of the last 24 h and 7 days."""
    dt = col_type(iocs, "loaded_at")
    new24 = (F.col("loaded_at") >= time_lit(shift(now, hours=24), dt)) & (F.col("loaded_at") < time_lit(now, dt))
    new7 = (F.col("loaded_at") >= time_lit(shift(now, days=7), dt)) & (F.col("loaded_at") < time_lit(now, dt))
    g = (iocs.groupingSets([["ioc_type"], ["source"], []], "ioc_type", "source")
         .agg(F.count(F.lit(1)).alias("count"), F.count_if(new24).alias("new_24h"), F.count_if(new7).alias("new_7d"),
              F.grouping_id().alias("gid")))
    dim = F.when(F.col("gid") == 1, "ioc_type").when(F.col("gid") == 2, "source").otherwise("total")
    return g.select(dim.alias("dimension"), F.when(F.col("gid") == 3, F.lit(""))
                    .otherwise(F.coalesce("ioc_type", "source")).alias("key"), "count", "new_24h", "new_7d")


def list_iocs(iocs: DataFrame, search: str | None = None, *, limit: int = 50, offset: int = 0) -> DataFrame:
    """P-14: case-insensitive substring search (ILIKE), newest first, paged with a unique tie-break."""
    d = iocs
    if search:
        d = d.where(F.col("value").ilike(f"%{search}%"))
    d = d.orderBy(F.desc("loaded_at"), "tenant_id", "ioc_type", "value")
    return (d.offset(offset) if offset else d).limit(limit)


# ---------------------------------------------------------------------------
# Asset graph (J-12 / J-13)
# ---------------------------------------------------------------------------

def consequence_by_asset(affects: DataFrame, deploys: DataFrame, resides: DataFrame,
                         zone_consequences: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """J-12 per asset: zones reached by finding -> asset <- model -> downstream asset -> zone,
    where the downstream asset differs from the start asset (no edge used twice); the distinct
    consequences reached and the worst one, with the asset's own zone as static fallback.

    Instead of enumerating paths, count each model's assets per zone once; a zone is reachable
    from asset ``a`` through model ``m`` iff ``count(m, z) - [zone(a) = z] > 0``. A model is then one row:
    the consequences that all its assets reach, as bits, and its zones with a single asset. So an
    (asset, model) edge is one row with one set of bits, and an asset's sets are joined by OR.

    ``deploys``: (model_id, asset_id); ``resides``: (asset_id, zone); ``zone_consequences``:
    optional (zone, consequence) table overriding the static zone map. ``tasks``: how many tasks the edges
    are dealt to by model (else as the session says).
    """
    zc = (F.coalesce(F.col("zc.consequence"), zone_consequence(F.col("zone")))
          if zone_consequences is not None else zone_consequence(F.col("zone")))
    res = resides
    if zone_consequences is not None:
        res = resides.join(zone_consequences.alias("zc"), "zone", "left")
    res = res.select("asset_id", "zone", zc.alias("consequence"))
    names = {*ZONE_CONSEQUENCE.values(), ZONE_CONSEQUENCE_DEFAULT}
    if zone_consequences is not None:  # as many as the table of zones has
        names |= {r.consequence for r in zone_consequences.select("consequence").distinct().collect()} - {None}
    words = [sorted(names)[i:i + 63] for i in range(0, len(names), 63)]  # a long has 63 bits beside its sign
    bits = [lookup({c: 1 << i for i, c in enumerate(w)}, F.col("consequence"), 0).cast("long") for w in words]

    edges = deploys.distinct()
    per_mz = (edges.join(res.distinct(), "asset_id").groupBy("model_id", "zone", "consequence")
              .agg(F.count(F.lit(1)).alias("n_assets")))
    single = F.when(F.col("n_assets") == 1, F.struct("zone", *[b.alias(f"b{i}") for i, b in enumerate(bits)]))
    models = per_mz.groupBy("model_id").agg(
        F.collect_list(single).alias("single"),
        *[F.bit_or(F.when(F.col("n_assets") > 1, b).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bits)])
    start = edges.join(res.select("asset_id", F.col("zone").alias("own_zone")).distinct(), "asset_id", "left")
    if tasks:
        start, models = (x.repartition(tasks, "model_id") for x in (start, models))
    others = F.filter("single", lambda z: ~F.coalesce(z["zone"] == F.col("own_zone"), F.lit(False)))

    def reached(b):
        return F.aggregate(others, F.col(b), lambda acc, z: acc.bitwiseOR(z[b]))
    reach = start.join(models, "model_id").groupBy("asset_id").agg(*[F.bit_or(reached(f"b{i}")).alias(f"b{i}") for i in range(len(words))])
    held = F.array_compact(F.array(*[F.when(F.col(f"b{i}").bitwiseAND(F.lit(1 << j).cast("long")) != 0, F.lit(c))
                                     for i, w in enumerate(words) for j, c in enumerate(w)]))
    reach = reach.select("asset_id", held.alias("consequences")).where(F.size("consequences") > 0)
    own = res.select("asset_id", F.col("consequence").alias("own_consequence"))
    rank = lambda c: lookup(CONSEQUENCE_RANK, c, 0)
    out = own.join(reach, "asset_id", "left")
    worst = F.aggregate(F.coalesce("consequences", F.array().cast("array<string>")), F.lit(None).cast("string"),
                        lambda acc, c: F.when(acc.isNull() | (rank(c) > rank(acc)), c).otherwise(acc))
    return (out.withColumn("path_found", F.size(F.coalesce("consequences", F.array())) > 0)
            .withColumn("worst_consequence", F.coalesce(worst, F.col("own_consequence")))
            .withColumn("consequence_severity", lookup(CONSEQUENCE_SEVERITY, F.col("worst_consequence"))))


def asset_context(assets: DataFrame, resides: DataFrame, owners: DataFrame) -> DataFrame:
    """J-13: asset -> zone and owner (two left joins)."""
    return assets.join(resides, "asset_id", "left").join(owners, "asset_id", "left")


# ---------------------------------------------------------------------------
# Behaviour risk (J-04, P-24, P-25) and playbooks (J-16)
# ---------------------------------------------------------------------------

def entity_risk(entities: DataFrame, profiles: DataFrame, now, *, key: Sequence[str] = ("tenant_id", "entity_id"),
                max_stale_hours: float = 24.0) -> DataFrame:
    """J-04 + P-24: each entity's behaviour profile (left join) classified: no profile ->
    no_baseline, stale -> unknown, else low/medium/high by priority."""
    j = entities.join(profiles, list(key), "left")
    fresh = (F.unix_micros(time_lit(now).cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 3.6e9
    return j.withColumn("freshness_hours", fresh).withColumn(
        "risk_state", classify_risk(F.col("priority"), F.col("freshness_hours"), max_stale_hours))


def alert_risk(entity_risks: DataFrame, alert_col: str = "alert_id") -> DataFrame:
    """P-25: per alert the worst risk among its entities; an alert with no entity rows or only
    no-baseline ones stays no_baseline (absent data is never 'low')."""
    rank = lookup(RISK_RANK, F.col("risk_state"), 0)
    inv = {v: k for k, v in RISK_RANK.items()}
    g = entity_risks.groupBy(alert_col).agg(F.max(rank).alias("_r"))
    return g.withColumn("risk_state", lookup(inv, F.col("_r"), "no_baseline")).drop("_r")


def select_playbooks(alerts: DataFrame, playbooks: DataFrame, k: int = 3) -> DataFrame:
    """J-16: playbooks matching the alert severity, first ``k`` by playbook id. An alert's first ``k`` are among the first ``k`` of
    its severity, so only those are joined."""
    first = Window.partitionBy("severity").orderBy("playbook_id")
    few = playbooks.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r")
    j = alerts.select("alert_id", "severity").join(few, "severity")
    w = Window.partitionBy("alert_id").orderBy("playbook_id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ioc_rows(df: DataFrame, text_col: str, tenant: Column, loaded_at: Column, source: Column,
             regex_iocs) -> DataFrame:
    """IOC observations from free text (T-02 output): ip 70, sha256 80, sha1 70, domain 60. One scan: each
    text gives one array of observations, which is exploded."""
    parts = [("ips", "ip", 70), ("sha256", "filehash", 80), ("sha1", "filehash", 70), ("domains", "dns", 60)]

    def observed(values: Column, kind: str, confidence: int) -> Column:
        return F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(kind).alias("ioc_type"), F.lit(confidence).alias("confidence")))

    def found(r):
        return F.concat(*[observed(r[f], t, c) for f, t, c in parts])
    return (df.select(tenant.alias("tenant_id"), loaded_at.alias("loaded_at"), source.alias("source"),
                      F.explode(let(regex_iocs(F.col(text_col)), found)).alias("o"))
            .select("tenant_id", "loaded_at", "source", "o.value", "o.ioc_type", "o.confidence"))


def feed_status(sources: DataFrame, loads: DataFrame, iocs: DataFrame) -> DataFrame:
    """J-20: every configured source, its latest load (max_by over load time) and IOC count;
    two left joins, sources without loads or IOCs still listed."""
    latest = loads.groupBy("source").agg(F.max("loaded_at").alias("last_loaded_at"),
                                         F.max_by("status", "loaded_at").alias("last_status"))
    counts = iocs.groupBy("source").agg(F.count(F.lit(1)).alias("ioc_count"))
    return sources.join(latest, "source", "left").join(counts, "source", "left") \
        .withColumn("ioc_count", F.coalesce("ioc_count", F.lit(0)))


def rule_crosswalk(spark) -> DataFrame:
    """Explicit ATLAS <-> ATT&CK crosswalk from the detection rules' technique pairs (Q9: the
    reference's column-based crosswalk is empty, so the mapping is an explicit table)."""
    from tidewatch.operators.rules import RULES
    pairs = sorted({(m.atlas_technique, m.attack_technique) for m in RULES.values() if m.attack_technique})
    return spark.createDataFrame([(a, t, "ATLAS") for a, t in pairs], "atlas_id string, attack_id string, framework string")


def technique_crosswalk(items: DataFrame, crosswalk: DataFrame, technique_col: str = "atlas_techniques",
                        key: str = "investigation_id") -> DataFrame:
    """J-06: each technique of each item (exploded) joined to the crosswalk; framework compared
    case-insensitively (Q9); exact mappings carry confidence 1.0 and source 'taxonomy'."""
    cw = crosswalk.where(F.lower(F.col("framework")) == "atlas").select("atlas_id", "attack_id")
    ex = items.select(key, F.explode(technique_col).alias("atlas_id"))
    return ex.join(cw, "atlas_id").withColumn("confidence", F.lit(1.0)).withColumn("source", F.lit("taxonomy"))


def deep_retrieval(case_techniques: DataFrame, case_entities: DataFrame, case_iocs: DataFrame,
                   intel: DataFrame, entity_detail: DataFrame, case_col: str = "case_id") -> DataFrame:
    """J-07: second pass per case — intel for every technique (left join, 'unavailable' when the
    intel table has none) and deep context only for entities that also matched an IOC in the same
    case (semi-join), again defaulting to 'unavailable'."""
    t = case_techniques.join(intel, "technique_id", "left").select(
        case_col, F.lit("technique_intel").alias("type"), F.col("technique_id").alias("key"),
        F.coalesce(F.col("detail"), F.lit("unavailable")).alias("detail"))
    hot = case_entities.join(case_iocs.select(case_col, "value").distinct(), [case_col, "value"], "left_semi")
    e = hot.join(entity_detail, "value", "left").select(
        case_col, F.lit("entity_deep_context").alias("type"), F.col("value").alias("key"),
        F.coalesce(F.col("detail"), F.lit("unavailable")).alias("detail"))
    return t.unionByName(e)


# ---------------------------------------------------------------------------
# E-20 STIX 2.1 indicators -> IOC documents
# ---------------------------------------------------------------------------

# Fixed values (must equal the documented parser): pattern -> indicator type, first match wins.
STIX_PATTERNS = (
    (r"ipv4-addr:value\s*=\s*'([^']+)'", "ipv4"),
    (r"ipv6-addr:value\s*=\s*'([^']+)'", "ipv6"),
    (r"domain-name:value\s*=\s*'([^']+)'", "domain"),
    (r"file:hashes\.'SHA-256'\s*=\s*'([^']+)'", "file_hash_sha256"),
    (r"file:hashes\.'SHA-1'\s*=\s*'([^']+)'", "file_hash_sha1"),
    (r"file:hashes\.'MD5'\s*=\s*'([^']+)'", "file_hash_md5"),
    (r"url:value\s*=\s*'([^']+)'", "url"),
    (r"email-addr:value\s*=\s*'([^']+)'", "email"),
)
STIX_SCHEMA = ("struct<id:string,pattern:string,confidence:int,labels:array<string>,description:string,"
               "valid_from:string,valid_until:string,created_by_ref:string,"
               "kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>>")


def stix_to_iocs(raw: DataFrame, col: str = "raw") -> DataFrame:
    """E-20: indicator JSON -> (indicator_type, indicator_value, confidence default 50, severity from
    labels, MITRE ids from mitre-attack kill-chain phases, validity); unparseable patterns dropped."""
    s = raw.select(F.from_json(F.col(col), STIX_SCHEMA).alias("s")).where(F.col("s").isNotNull())
    p = F.coalesce(F.col("s.pattern"), F.lit(""))
    typ, val = F.lit("unknown"), F.lit("")
    for rx, name in reversed(STIX_PATTERNS):
        hit = p.rlike("(?i)" + rx)
        typ = F.when(hit, F.lit(name)).otherwise(typ)
        val = F.when(hit, F.regexp_extract(p, "(?i)" + rx, 1)).otherwise(val)
    labels = F.coalesce(F.col("s.labels"), F.array().cast("array<string>"))
    sev = (F.when(F.array_contains(labels, "malicious-activity"), "high")
           .when(F.array_contains(labels, "anomalous-activity"), "medium")
           .when(F.array_contains(labels, "benign"), "low").otherwise("medium"))
    mitre = F.filter(F.transform(F.filter(F.coalesce(F.col("s.kill_chain_phases"), F.array()),
                                          lambda ph: ph["kill_chain_name"] == "mitre-attack"),
                                 lambda ph: F.regexp_extract(ph["phase_name"], r"[Tt]\d{4}(?:\.\d{3})?", 0)),
                     lambda m: m != "")
    out = s.select(F.concat(F.lit("stix-"), F.coalesce(F.col("s.id"), F.lit(""))).alias("doc_id"),
                   typ.alias("indicator_type"), val.alias("indicator_value"),
                   F.coalesce(F.col("s.confidence"), F.lit(50)).alias("confidence"), sev.alias("severity"),
                   mitre.alias("mitre_techniques"), F.col("s.valid_from").alias("first_seen"),
                   F.col("s.valid_until").alias("expiry"),
                   F.array(F.coalesce(F.col("s.created_by_ref"), F.lit("unknown"))).alias("sources"))
    return out.where(F.col("indicator_value") != "")


def asset_inventory(observations: DataFrame, overrides: DataFrame | None = None, default_zone: str = "Zone3_Enterprise") -> DataFrame:
    """E-16: one row per asset from the union of telemetry observations
    (asset_id, source, ts, ok, detail): sources seen, first/last seen, event and failure counts,
    failure rate, the latest detail (max_by ts), a class from the sources, and the zone from the
    override table (left join) else the default."""
    g = observations.groupBy("asset_id").agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("events"),
        F.count_if(~F.col("ok")).alias("failures"), F.max_by("detail", F.struct("ts", "source", "detail")).alias("latest_detail"))
    g = g.withColumn("failure_rate", F.col("failures") / F.col("events")).withColumn(
        "asset_class", F.when(F.array_contains("sources", "sensor"), "ot_gateway")
        .when(F.array_contains("sources", "inference"), "edge_inference").otherwise("edge_node"))
    if overrides is not None:
        g = g.join(overrides.select("asset_id", F.col("zone").alias("_z")), "asset_id", "left")
        return g.withColumn("zone", F.coalesce("_z", F.lit(default_zone))).drop("_z")
    return g.withColumn("zone", F.lit(default_zone))


# ---------------------------------------------------------------------------
# E-19 behaviour-analytics context
# ---------------------------------------------------------------------------

# Fixed values (must equal the documented mapping), in their documented order.
ANOMALY_DESCRIPTIONS = (
    ("FirstTimeUserConnectedViaCountry", "User connected from a country for the first time"),
    ("FirstTimeConnectionToApplication", "User accessed this application for the first time"),
    ("CountryUncommonlyConnectedFromAmongPeers", "Connection from a country uncommon among the user's peer group"),
    ("FirstTimeUserAccessedResource", "User accessed this resource for the first time"),
    ("ActivityAtypicalComparedToUserHistory", "Activity is atypical compared to the user's baseline behaviour"),
    ("ApplicationUncommonlyAccessedAmongPeers", "Application is uncommon among the user's peer group"),
    ("ActionUncommonlyPerformedByUser", "This action type is unusual for this user"),
    ("FirstTimeUserUsedDevice", "User used this device for the first time"),
    ("DeviceUncommonlyUsedAmongPeers", "Device is uncommon among the user's peer group"),
)


def behaviour_context(records: DataFrame) -> DataFrame:
    """E-19: priority bands (0-2 low, 3-5 medium, 6-7 high, 8-10 critical, else unknown) and the
    descriptions of the insight flags that are exactly true, in the documented order; malformed
    insight JSON counts as no insights."""
    ins = F.coalesce(F.from_json(F.col("ActivityInsights"), "map<string,boolean>"),
                     F.create_map().cast("map<string,boolean>"))
    p = F.coalesce(F.col("InvestigationPriority").cast("int"), F.lit(0))
    band = (F.when(p.between(0, 2), "low").when(p.between(3, 5), "medium").when(p.between(6, 7), "high")
            .when(p.between(8, 10), "critical").otherwise("unknown"))
    anomalies = F.array_compact(F.array(*[F.when(F.coalesce(ins[k], F.lit(False)), F.lit(d)) for k, d in ANOMALY_DESCRIPTIONS]))
    return records.select("UserPrincipalName", "SourceIPAddress", p.alias("investigation_priority"),
                          band.alias("risk_level"), anomalies.alias("anomalies"),
                          F.coalesce(ins["FirstTimeUserConnectedViaCountry"], F.lit(False)).alias("is_first_time_country"),
                          F.coalesce(ins["ActivityAtypicalComparedToUserHistory"], F.lit(False)).alias("is_atypical_for_user"))
