"""Vendor alert adapters (S-01 .. S-06): raw JSON alerts -> canonical alert rows.

Each adapter is ``DataFrame(raw JSON text) -> DataFrame(canonical)``: a typed
``from_json`` (or VARIANT where a field may be a list *or* a string) followed by column
expressions. Heartbeat/health events are filtered, not returned as nulls. ``union_sources``
is the registry: one canonical table from every source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.exprs import lookup

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference)
# ---------------------------------------------------------------------------
HEARTBEAT_NAMES = ("heartbeat", "test alert", "health check")
HEALTH_PREFIX = "Health"
CANONICAL_SEVERITIES = ("critical", "high", "medium", "low", "informational")
URGENCY_MAP = {"critical": "critical", "high": "high", "medium": "medium", "low": "low",
               "informational": "informational", "info": "informational"}

CANONICAL_COLUMNS = ["alert_id", "source", "timestamp", "title", "description", "severity", "tactics", "techniques",
                     "entities_raw", "product", "tenant_id", "raw_payload"]

ENTITY = T.StructType([T.StructField(n, T.StringType()) for n in
                       ("$id", "Type", "HostName", "OSFamily", "Name", "UPNSuffix", "Address", "ProcessId",
                        "CommandLine")])

SENTINEL_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in
                                ("SystemAlertId", "TimeGenerated", "AlertName", "Description", "Severity", "Tactics",
                                 "Techniques", "Entities", "ProductName", "TenantId")])

_THREAT = T.ArrayType(T.StructType([
    T.StructField("tactic", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("technique", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("subtechnique", T.ArrayType(T.StructType([T.StructField("id", T.StringType())])))]))),
]))
ELASTIC_SCHEMA = T.StructType([
    T.StructField("@timestamp", T.StringType()),
    T.StructField("signal", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("rule", T.StructType([
            T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
            T.StructField("description", T.StringType()), T.StructField("severity", T.StringType()),
            T.StructField("threat", _THREAT)])),
        T.StructField("original_event", T.StructType([T.StructField(n, T.StringType())
                                                      for n in ("source_ip", "dest_ip", "user")]))])),
    T.StructField("kibana", T.StructType([T.StructField("alert", T.StructType([T.StructField("rule", T.StructType([
        T.StructField("parameters", T.StructType([T.StructField("threat", _THREAT)]))]))]))])),
    T.StructField("kibana.space_ids", T.ArrayType(T.StringType())),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("agent", T.StructType([T.StructField("type", T.StringType())])),
    T.StructField("host", T.StructType([T.StructField("name", T.StringType()),
                                        T.StructField("os", T.StructType([T.StructField("family", T.StringType())]))])),
    T.StructField("user", T.StructType([T.StructField("name", T.StringType()), T.StructField("domain", T.StringType())])),
    T.StructField("source", T.StructType([T.StructField("ip", T.StringType())])),
    T.StructField("destination", T.StructType([T.StructField("ip", T.StringType())])),
    T.StructField("process", T.StructType([T.StructField("name", T.StringType()), T.StructField("pid", T.StringType()),
                                           T.StructField("command_line", T.StringType()),
                                           T.StructField("args", T.StringType())])),
])


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def split_csv(c: Column) -> Column:
    """Comma list -> trimmed non-empty items (empty/absent -> [])."""
    return F.coalesce(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""),
                      F.array().cast("array<string>"))


def _number_entities(cands: list[Column]) -> Column:
    """Keep present candidates and give them sequential ``$id`` values, then JSON text."""
    present = F.array_compact(F.array(*cands))
    numbered = F.transform(present, lambda e, i: e.withField("`$id`", (i + 1).cast("string")))
    return F.to_json(numbered)


def _entity(**fields) -> Column:
    return F.struct(*[(fields.get(n, F.lit(None)).cast("string")).alias(n) for n in ENTITY.fieldNames()])


# ---------------------------------------------------------------------------
# S-01 Sentinel
# ---------------------------------------------------------------------------

Fields = tuple[Column, list[Column]]  # which parsed rows are alerts, and their canonical columns


def sentinel_fields(a: str) -> Fields:
    """S-01: drop heartbeats; lower-case severity (default medium); CSV tactics/techniques."""
    name = F.coalesce(F.col(f"{a}.AlertName"), F.lit(""))
    sev = F.col(f"{a}.Severity")
    return ~F.lower(F.trim(name)).isin(*HEARTBEAT_NAMES), [
        F.coalesce(F.col(f"{a}.SystemAlertId"), F.lit("")).alias("alert_id"), F.lit("sentinel").alias("source"),
        F.coalesce(F.col(f"{a}.TimeGenerated"), F.lit("")).alias("timestamp"), name.alias("title"),
        F.coalesce(F.col(f"{a}.Description"), F.lit("")).alias("description"),
        F.when(_nonempty(sev), F.lower(F.trim(sev))).otherwise("medium").alias("severity"),
        split_csv(F.col(f"{a}.Tactics")).alias("tactics"), split_csv(F.col(f"{a}.Techniques")).alias("techniques"),
        F.coalesce(F.col(f"{a}.Entities"), F.lit("[]")).alias("entities_raw"),
        F.coalesce(F.col(f"{a}.ProductName"), F.lit("")).alias("product"),
        F.coalesce(F.col(f"{a}.TenantId"), F.lit("default")).alias("tenant_id")]


# ---------------------------------------------------------------------------
# S-02 / S-03 Elastic
# ---------------------------------------------------------------------------

def _threat_tactics(threat: Column) -> Column:
    names = F.transform(F.coalesce(threat, F.array()), lambda t: t["tactic"]["name"])
    return F.array_distinct(F.filter(names, _nonempty))


def _threat_techniques(threat: Column) -> Column:
    ids = F.flatten(F.transform(F.coalesce(threat, F.array()), lambda t: F.flatten(F.transform(
        F.coalesce(t["technique"], F.array()), lambda x: F.concat(
            F.array(x["id"]), F.transform(F.coalesce(x["subtechnique"], F.array()), lambda s: s["id"]))))))
    return F.array_distinct(F.filter(ids, _nonempty))


def elastic_entities(a: str = "a") -> Column:
    """S-03: host, user, source/destination ip, process and original-event entities, numbered."""
    host, user, proc, orig = (F.col(f"{a}.host"), F.col(f"{a}.user"), F.col(f"{a}.process"),
                              F.col(f"{a}.signal.original_event"))
    cands = [
        F.when(_nonempty(host["name"]), _entity(Type=F.lit("host"), HostName=host["name"],
                                                OSFamily=F.coalesce(host["os"]["family"], F.lit("")))),
        F.when(_nonempty(user["name"]), _entity(Type=F.lit("account"), Name=user["name"],
                                                UPNSuffix=F.when(_nonempty(user["domain"]), user["domain"]))),
        F.when(_nonempty(F.col(f"{a}.source.ip")), _entity(Type=F.lit("ip"), Address=F.col(f"{a}.source.ip"))),
        F.when(_nonempty(F.col(f"{a}.destination.ip")),
               _entity(Type=F.lit("ip"), Address=F.col(f"{a}.destination.ip"))),
        F.when(_nonempty(proc["name"]) | _nonempty(proc["pid"]),
               _entity(Type=F.lit("process"), ProcessId=F.coalesce(proc["pid"], F.lit("")),
                       CommandLine=F.coalesce(proc["command_line"], proc["args"], F.lit("")))),
        F.when(_nonempty(orig["source_ip"]), _entity(Type=F.lit("ip"), Address=orig["source_ip"])),
        F.when(_nonempty(orig["dest_ip"]), _entity(Type=F.lit("ip"), Address=orig["dest_ip"])),
        F.when(_nonempty(orig["user"]), _entity(Type=F.lit("account"), Name=orig["user"])),
    ]
    return _number_entities(cands)


def elastic_fields(a: str) -> Fields:
    """S-02: nested threat arrays -> ordered distinct tactics and technique/sub-technique ids with the
    rule-level fallback; severity whitelist; tenant from the first space id."""
    name = F.coalesce(F.col(f"{a}.signal.rule.name"), F.lit(""))
    params = F.col(f"{a}.kibana.alert.rule.parameters.threat")
    rule_threat = F.col(f"{a}.signal.rule.threat")
    tac, tech = _threat_tactics(params), _threat_techniques(params)
    sev = F.lower(F.trim(F.col(f"{a}.signal.rule.severity")))
    spaces = F.col(f"{a}.`kibana.space_ids`")
    return ~F.lower(F.trim(name)).isin(*HEARTBEAT_NAMES), [
        F.coalesce(F.col(f"{a}.signal.rule.id"), F.col(f"{a}.signal.id"), F.lit("")).alias("alert_id"),
        F.lit("elastic").alias("source"), F.coalesce(F.col(f"{a}.`@timestamp`"), F.lit("")).alias("timestamp"),
        name.alias("title"), F.coalesce(F.col(f"{a}.signal.rule.description"), F.lit("")).alias("description"),
        F.when(sev.isin(*CANONICAL_SEVERITIES), sev).otherwise("medium").alias("severity"),
        F.when(F.size(tac) > 0, tac).otherwise(_threat_tactics(rule_threat)).alias("tactics"),
        F.when(F.size(tech) > 0, tech).otherwise(_threat_techniques(rule_threat)).alias("techniques"),
        elastic_entities(a).alias("entities_raw"),
        F.coalesce(F.col(f"{a}.agent.type"), F.lit("elastic")).alias("product"),
        F.when(spaces.isNotNull(), F.coalesce(spaces.getItem(0), F.lit("default")))
         .otherwise(F.coalesce(F.col(f"{a}.tenant_id"), F.lit("default"))).alias("tenant_id")]


# ---------------------------------------------------------------------------
# S-04 / S-05 Splunk
# ---------------------------------------------------------------------------

SPLUNK_FIELDS = ("event_id", "sid", "_time", "search_name", "rule_title", "description", "urgency", "src", "src_ip",
                 "dest", "dest_ip", "src_host", "dest_host", "user", "src_user", "dest_user", "process_name",
                 "process", "process_id", "process_exec", "source", "tenant_id")
# String-typed fields keep a nested list's raw JSON text, so "list or CSV" is decided per value.
SPLUNK_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in SPLUNK_FIELDS] + [
    T.StructField("annotations", T.StructType([T.StructField("mitre_attack", T.StructType([
        T.StructField("mitre_tactic", T.StringType()), T.StructField("mitre_technique_id", T.StringType())]))]))])


def _list_or_csv(value: Column) -> Column:
    """A JSON field that may be a list or a CSV string -> trimmed non-empty strings."""
    as_list = F.from_json(value, "array<string>")
    items = F.when(F.ltrim(value).startswith("["), F.transform(as_list, lambda x: F.trim(x))) \
        .otherwise(F.transform(F.split(value, ","), lambda x: F.trim(x)))
    return F.coalesce(F.filter(items, lambda x: x != ""), F.array().cast("array<string>"))


def splunk_entities(a: str = "a") -> Column:
    """S-05: src/src_ip, dest/dest_ip ips, src/dest hosts, users, process; first-seen de-dup
    across all those fields (a value already used by an earlier field is skipped)."""
    from tidewatch.operators.text import let
    fields = [("src", "ip"), ("src_ip", "ip"), ("dest", "ip"), ("dest_ip", "ip"), ("src_host", "host"),
              ("dest_host", "host"), ("user", "account"), ("src_user", "account"), ("dest_user", "account")]
    vals = F.array(*[F.struct(F.col(f"{a}.{f}").alias("v"), F.lit(t).alias("t")) for f, t in fields])
    # bind the candidate array once: referenced inside the lambda it would be rebuilt per element
    kept = let(vals, lambda vs: F.filter(vs, lambda x, i: _nonempty(x["v"]) & ~F.exists(
        F.slice(vs, 1, i), lambda y: _nonempty(y["v"]) & (y["v"] == x["v"]))))
    ents = F.transform(kept, lambda x: F.when(x["t"] == "ip", _entity(Type=F.lit("ip"), Address=x["v"]))
                       .when(x["t"] == "host", _entity(Type=F.lit("host"), HostName=x["v"]))
                       .otherwise(_entity(Type=F.lit("account"), Name=x["v"])))
    pname = F.coalesce(F.col(f"{a}.process_name"), F.col(f"{a}.process"))
    proc = F.when(_nonempty(pname), F.array(_entity(Type=F.lit("process"),
                                                     ProcessId=F.coalesce(F.col(f"{a}.process_id"), F.lit("")),
                                                     CommandLine=F.coalesce(F.col(f"{a}.process_exec"), F.lit(""))))) \
        .otherwise(F.array().cast(T.ArrayType(ENTITY)))
    allents = F.concat(ents, proc)
    return F.to_json(F.transform(allents, lambda e, i: e.withField("`$id`", (i + 1).cast("string"))))


def splunk_time(raw: Column) -> Column:
    """Epoch seconds -> ISO 8601 with +00:00 (fraction only when present); otherwise as given."""
    raw = F.coalesce(raw, F.lit(""))
    num = raw.try_cast("double")
    ts = F.timestamp_micros((num * 1_000_000).cast("bigint"))
    frac = F.when(num != F.floor(num), F.concat(F.lit("."), F.date_format(ts, "SSSSSS"))).otherwise(F.lit(""))
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), frac, F.lit("+00:00"))
    return F.when(num.isNotNull(), iso).otherwise(raw)


def splunk_fields(a: str) -> Fields:
    """S-04: drop ``Health*`` searches; urgency map; epoch-or-ISO time; list-or-CSV annotations."""
    sname = F.coalesce(F.col(f"{a}.search_name"), F.lit(""))
    urg = F.col(f"{a}.urgency")
    return F.col(a).isNotNull() & ~sname.startswith(HEALTH_PREFIX), [
        F.coalesce(F.col(f"{a}.event_id"), F.col(f"{a}.sid"), F.lit("")).alias("alert_id"),
        F.lit("splunk").alias("source"), splunk_time(F.col(f"{a}._time")).alias("timestamp"),
        F.when(sname != "", sname).otherwise(F.coalesce(F.col(f"{a}.rule_title"), F.lit(""))).alias("title"),
        F.coalesce(F.col(f"{a}.description"), F.lit("")).alias("description"),
        F.when(_nonempty(urg), lookup(URGENCY_MAP, F.lower(F.trim(urg)), "medium")).otherwise("medium").alias("severity"),
        _list_or_csv(F.col(f"{a}.annotations.mitre_attack.mitre_tactic")).alias("tactics"),
        _list_or_csv(F.col(f"{a}.annotations.mitre_attack.mitre_technique_id")).alias("techniques"),
        splunk_entities(a).alias("entities_raw"),
        F.coalesce(F.col(f"{a}.source"), F.lit("splunk_es")).alias("product"),
        F.coalesce(F.col(f"{a}.tenant_id"), F.lit("default")).alias("tenant_id")]


# ---------------------------------------------------------------------------
# S-06 registry, P-01 validation
# ---------------------------------------------------------------------------

ADAPTERS = {"sentinel": (SENTINEL_SCHEMA, sentinel_fields), "elastic": (ELASTIC_SCHEMA, elastic_fields),
            "splunk": (SPLUNK_SCHEMA, splunk_fields)}


def to_canonical(raw: DataFrame, source: str, col: str = "raw") -> DataFrame:
    """The canonical rows of one source. The JSON is parsed once a row (behind a generator, so
    that the filter does not parse it again)."""
    schema, fields = ADAPTERS[source]
    keep, columns = fields("a")
    parsed = raw.select(F.col(col).alias("raw_payload"), F.explode(F.array(F.from_json(F.col(col), schema))).alias("a"))
    return parsed.where(keep).select(*columns, "raw_payload")


def sentinel_to_canonical(raw: DataFrame, col: str = "raw") -> DataFrame:
    return to_canonical(raw, "sentinel", col)


def elastic_to_canonical(raw: DataFrame, col: str = "raw") -> DataFrame:
    return to_canonical(raw, "elastic", col)


def splunk_to_canonical(raw: DataFrame, col: str = "raw") -> DataFrame:
    return to_canonical(raw, "splunk", col)


def union_sources(raw: DataFrame, source_col: str = "source", col: str = "raw") -> DataFrame:
    """S-06: each raw row through the adapter of its ``source``. One scan: a row is parsed once, by its own
    source's schema (the others get null), and each canonical column branches on the source."""
    src = F.col(source_col)
    parsed = raw.where(src.isin(*ADAPTERS)).select(src.alias("_source"), F.col(col).alias("raw_payload"), F.explode(F.array(F.struct(
        *[F.from_json(F.when(src == n, F.col(col)), schema).alias(n) for n, (schema, _) in ADAPTERS.items()]))).alias("_p"))
    parsed = parsed.select("_source", "raw_payload", "_p.*")
    made = {n: fields(n) for n, (_, fields) in ADAPTERS.items()}
    keep = F.coalesce(*[F.when(F.col("_source") == n, m[0]) for n, m in made.items()])
    names = [c for c in CANONICAL_COLUMNS if c != "raw_payload"]

    def branch(i: int) -> Column:
        return F.coalesce(*[F.when(F.col("_source") == n, m[1][i]) for n, m in made.items()])
    return parsed.where(keep).select(*[branch(i).alias(c) for i, c in enumerate(names)], "raw_payload")


def validate_canonical(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P-01: severity in the five values and an ISO-8601 timestamp; else reject with a reason."""
    ts = F.regexp_replace(F.regexp_replace(F.col("timestamp"), "Z$", ""), r"[+-]\d{2}:\d{2}$", "")
    ts_ok = F.try_to_timestamp(ts).isNotNull()
    sev_ok = F.col("severity").isin(*CANONICAL_SEVERITIES)
    good = alerts.where(ts_ok & sev_ok)
    bad = alerts.where(~(ts_ok & sev_ok)).withColumn(
        "error", F.when(~sev_ok, "invalid severity").otherwise("invalid timestamp"))
    return good, bad


def data_quality(alerts: DataFrame) -> DataFrame:
    """E-21: per alert: errors (missing required fields, -0.3 each), warnings (source, entities,
    MITRE mapping, severity, timestamp shape, tenant) and the score floored at 0."""
    def empty(c):
        return F.col(c).isNull() | (F.col(c).cast("string") == "")
    req = [(c, empty(c)) for c in ("alert_id", "title", "timestamp")]
    ents = F.coalesce(F.col("entities_raw"), F.lit(""))
    no_ents = (ents == "") | (ents == "[]")
    bad_ents = ~no_ents & ~ents.startswith("[")
    no_mitre = (F.size(F.coalesce("tactics", F.array())) == 0) & (F.size(F.coalesce("techniques", F.array())) == 0)
    errors = F.array_compact(F.array(*[F.when(m, F.lit(f"Missing required field: {c}")) for c, m in req]))
    warnings = F.array_compact(F.array(
        F.when(empty("source"), F.lit("Missing source field — cannot identify adapter")),
        F.when(no_ents, F.lit("Empty entities_raw field - IOC extraction will use fallback")),
        F.when(bad_ents, F.lit("entities_raw doesn't look like JSON array")),
        F.when(no_mitre, F.lit("No MITRE tactics or techniques mapped to this alert")),
        F.when(~F.coalesce(F.col("severity"), F.lit("")).isin(*CANONICAL_SEVERITIES),
               F.concat(F.lit("Unexpected severity value: "), F.coalesce(F.col("severity"), F.lit("")))),
        F.when(~empty("timestamp") & ~F.col("timestamp").contains("T"), F.lit("Timestamp may not be in ISO 8601 format")),
        F.when(empty("tenant_id"), F.lit("Missing tenant_id — will use 'default'"))))
    score = (F.lit(1.0) - F.lit(0.3) * F.size(errors) - F.when(empty("source"), 0.1).otherwise(0.0)
             - F.when(no_ents, 0.2).when(bad_ents, 0.1).otherwise(0.0) - F.when(no_mitre, 0.1).otherwise(0.0))
    return alerts.withColumn("dq_errors", errors).withColumn("dq_warnings", warnings) \
        .withColumn("valid", F.size(errors) == 0).withColumn("data_quality_score", F.greatest(F.lit(0.0), score))


def incremental_read(df: DataFrame, ts_col: str, high_water_mark) -> tuple[DataFrame, DataFrame]:
    """S-07 batch form: rows strictly after the stored high-water mark (pushed to the scan), and
    the next mark = max(ts) of what was read (unchanged when nothing new arrived)."""
    from tidewatch.functions.exprs import col_type, time_lit
    new = df.where(F.col(ts_col) > time_lit(high_water_mark, col_type(df, ts_col)))
    mark = new.agg(F.count(F.lit(1)).alias("rows_read"),
                   F.coalesce(F.max(ts_col), time_lit(high_water_mark, col_type(df, ts_col))).alias("next_high_water_mark"))
    return new, mark


# ---------------------------------------------------------------------------
# E-18 firewall / CEF record normalisation
# ---------------------------------------------------------------------------

# Fixed values (must equal the documented normaliser)
FIREWALL_ACTIONS = {
    "allow": "allow", "deny": "deny", "drop": "drop", "drop-icmp": "drop", "reset-client": "reset",
    "reset-server": "reset", "reset-both": "reset", "accept": "allow", "close": "allow", "timeout": "drop",
    "ip-conn": "allow", "dns": "allow", "Accept": "allow", "Drop": "drop", "Reject": "deny", "Block": "deny",
    "allowed": "allow", "blocked": "deny", "dropped": "drop", "rejected": "deny", "permitted": "allow",
}
INTERNAL_PREFIXES = ("10.", "172.16.", "172.17.", "172.18.", "172.19.", "172.20.", "172.21.", "172.22.", "172.23.",
                     "172.24.", "172.25.", "172.26.", "172.27.", "172.28.", "172.29.", "172.30.", "172.31.",
                     "192.168.", "100.64.")


def parse_extensions(ext: Column) -> Column:
    """``k1=v1;k2=v2`` or space separated -> MAP (a repeated key keeps its last value)."""
    from tidewatch.operators.text import let
    pairs = F.transform(F.filter(F.split(F.coalesce(ext, F.lit("")), r"[;\s]+"), lambda p: F.contains(p, F.lit("="))),
                        lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"),
                                           F.trim(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v")))
    last = let(pairs, lambda ps: F.filter(ps, lambda x, i: ~F.exists(
        F.slice(ps, i + 2, F.size(ps)), lambda y: y["k"] == x["k"])))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def _internal(ip: Column) -> Column:
    c = F.coalesce(ip, F.lit(""))
    out = F.lit(False)
    for p in INTERNAL_PREFIXES:
        out = out | c.startswith(p)
    return out


def normalise_network(records: DataFrame) -> DataFrame:
    """E-18: CEF/firewall rows -> normalised network events (action map, extensions, direction)."""
    ext = parse_extensions(F.col("AdditionalExtensions"))
    raw_action = F.coalesce(F.col("DeviceAction"), F.lit(""))
    action = F.coalesce(lookup(FIREWALL_ACTIONS, raw_action), lookup(FIREWALL_ACTIONS, F.lower(raw_action)),
                        F.lower(raw_action))
    si, di = _internal(F.col("SourceIP")), _internal(F.col("DestinationIP"))
    direction = (F.when(si & di, "internal").when(si, "outbound").when(di, "inbound").otherwise("external-to-external"))

    def first_nonempty(*cs):
        return F.coalesce(*[F.when(F.coalesce(c, F.lit("")) != "", c) for c in cs])
    return records.withColumn("_ext", ext).select(
        F.col("TimeGenerated").alias("timestamp"), F.coalesce(F.col("SourceIP"), F.lit("")).alias("source_ip"),
        F.coalesce(F.col("SourcePort").cast("int"), F.lit(0)).alias("source_port"),
        F.coalesce(F.col("DestinationIP"), F.lit("")).alias("destination_ip"),
        F.coalesce(F.col("DestinationPort").cast("int"), F.lit(0)).alias("destination_port"),
        F.upper(F.coalesce(F.col("Protocol"), F.lit(""))).alias("protocol"), action.alias("action"),
        direction.alias("direction"),
        first_nonempty(F.col("_ext")["cat"], F.col("_ext")["attack"], F.col("DeviceEventClassID")).alias("threat_name"),
        first_nonempty(F.col("_ext")["app"], F.col("_ext")["appcat"], F.col("ApplicationProtocol")).alias("application"),
        F.coalesce(F.col("DeviceVendor"), F.lit("")).alias("vendor"))
