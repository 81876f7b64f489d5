"""Shared Column builders.

Everything here returns a ``Column`` built from native Spark expressions, so
callers stay inside whole-stage codegen. Lookup tables are small literal maps
(``F.create_map``) folded into the expression; no joins, no UDFs.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results)
# ---------------------------------------------------------------------------

# (exploitability, consequence) -> severity; anything else is MEDIUM.
SEVERITY_MATRIX = {
    ("high", "safety_life"): "CRITICAL",
    ("high", "equipment"): "CRITICAL",
    ("high", "downtime"): "HIGH",
    ("high", "data_loss"): "MEDIUM",
    ("medium", "safety_life"): "CRITICAL",
    ("medium", "equipment"): "HIGH",
    ("medium", "downtime"): "MEDIUM",
    ("medium", "data_loss"): "LOW",
    ("low", "safety_life"): "HIGH",
    ("low", "equipment"): "MEDIUM",
    ("low", "downtime"): "LOW",
    ("low", "data_loss"): "LOW",
}
SEVERITY_DEFAULT = "MEDIUM"

CONSEQUENCE_WEIGHTS = {"safety_life": 1.0, "equipment": 0.8, "downtime": 0.5, "data_loss": 0.3}
CONSEQUENCE_WEIGHT_DEFAULT = 0.3

SLA_HOURS = {"CRITICAL": 24, "HIGH": 72, "MEDIUM": 336, "LOW": 720}
SLA_HOURS_DEFAULT = 720

ZONE_CONSEQUENCE = {
    "Zone0_PhysicalProcess": "safety_life",
    "Zone0_Safety": "safety_life",
    "Zone0_FieldDevices": "safety_life",
    "Zone1_EdgeInference": "equipment",
    "Zone1_BasicControl": "equipment",
    "Zone1_SensorNetwork": "equipment",
    "Zone1_PLCNetwork": "equipment",
    "Zone2_Operations": "downtime",
    "Zone2_AreaSupervisory": "downtime",
    "Zone2_SCADA": "downtime",
    "Zone2_HMI": "downtime",
    "Zone3_Enterprise": "data_loss",
    "Zone3_SiteOperations": "downtime",
    "Zone3_Manufacturing": "downtime",
    "Zone3_5_DMZ": "data_loss",
    "Zone4_External": "data_loss",
    "Zone4_Corporate": "data_loss",
    "Zone4_Cloud": "data_loss",
    "Zone5_Internet": "data_loss",
    "Cloud_Production": "downtime",
    "Cloud_Staging": "data_loss",
    "Cloud_Development": "data_loss",
    "Cloud_Management": "downtime",
    "IT_DataCenter": "downtime",
    "IT_UserWorkstations": "data_loss",
    "IT_NetworkInfra": "downtime",
    "OT_FieldBus": "equipment",
    "OT_ControlNetwork": "equipment",
    "OT_ProcessNetwork": "safety_life",
    "OT_SafetyInstrumentedSystem": "safety_life",
}
ZONE_CONSEQUENCE_DEFAULT = "data_loss"

# IOC cache lifetime by confidence: > 80 -> 30 days, >= 50 -> 7 days, else 24 hours.
IOC_TTL_SECONDS = (2_592_000, 604_800, 86_400)

# Incident relevance weights and decay.
SCORE_ALPHA, SCORE_BETA, SCORE_GAMMA, SCORE_DELTA = 0.4, 0.3, 0.15, 0.15
DECAY_LAMBDA = 0.023
SHORT_TERM_WEIGHT, LONG_TERM_WEIGHT = 0.7, 0.3
RARE_IMPORTANT_FLOOR = 0.1

# Detection confidence floors and telemetry trust.
SAFETY_CONFIDENCE_FLOORS = {"ATLAS-DETECT-005": 0.7, "ATLAS-DETECT-009": 0.7}
SAFETY_RELEVANT_RULES = ("ATLAS-DETECT-004", "ATLAS-DETECT-005", "ATLAS-DETECT-009")
TRUST_DOWNGRADE_FACTOR = 0.7
UNTRUSTED_TELEMETRY_SOURCES = ("edge_node_telemetry", "opcua_telemetry")

# Risk bands for a behaviour priority: < 3 low, < 6 medium, else high; stale > 24 h.
RISK_LOW_BELOW, RISK_MEDIUM_BELOW, RISK_MAX_STALE_HOURS = 3, 6, 24.0
RISK_RANK = {"no_baseline": 0, "unknown": 1, "low": 2, "medium": 3, "high": 4}

# Severity rank used for ordering queues (critical first).
SEVERITY_RANK = {"critical": 1, "high": 2, "medium": 3, "low": 4, "informational": 5}


# ---------------------------------------------------------------------------
# Literals and time
# ---------------------------------------------------------------------------

def map_lit(d: Mapping) -> Column:
    """A literal MAP column from a Python dict (folded into the plan)."""
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def lookup(d: Mapping, key: Column, default=None) -> Column:
    """``d[key]`` with a default, as one native map access."""
    v = map_lit(d)[key]
    return v if default is None else F.coalesce(v, F.lit(default))


def to_datetime(value) -> _dt.datetime:
    if isinstance(value, _dt.datetime):
        return value.replace(tzinfo=None) if value.tzinfo else value
    if isinstance(value, _dt.date):
        return _dt.datetime(value.year, value.month, value.day)
    s = str(value).replace("T", " ").rstrip("Z")
    return _dt.datetime.fromisoformat(s)


def time_lit(value, dtype: T.DataType | None = None) -> Column:
    """A timestamp literal of the same type as the column it is compared with.

    Comparing a ``timestamp_ntz`` column with a ``timestamp`` literal would
    wrap the column in a cast and defeat Parquet filter pushdown.
    """
    s = to_datetime(value).strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(dtype, T.TimestampType):
        return F.lit(s).cast("timestamp")
    return F.lit(s).cast("timestamp_ntz")


def col_type(df: DataFrame, name: str) -> T.DataType:
    return df.select(name).schema[0].dataType


def in_window(df: DataFrame, col: str, start, end) -> Column:
    """``start <= col < end`` with literals matching the column type."""
    dt = col_type(df, col)
    return (F.col(col) >= time_lit(start, dt)) & (F.col(col) < time_lit(end, dt))


def shift(now, **delta) -> _dt.datetime:
    return to_datetime(now) - _dt.timedelta(**delta)


def hours_between(later: Column, earlier: Column) -> Column:
    """Fractional hours between two timestamps (any of the two types)."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def epoch_seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


# ---------------------------------------------------------------------------
# Exposure scoring (P-07 .. P-11)
# ---------------------------------------------------------------------------

def _matrix_map() -> Column:
    return map_lit({f"{e}|{c}": s for (e, c), s in SEVERITY_MATRIX.items()})


def severity_from_matrix(exploitability: Column, consequence: Column) -> Column:
    key = F.concat_ws("|", F.lower(exploitability), F.lower(consequence))
    return F.coalesce(_matrix_map()[key], F.lit(SEVERITY_DEFAULT))


def ctem_score(exploitability_score: Column, consequence: Column) -> Column:
    w = lookup(CONSEQUENCE_WEIGHTS, F.lower(consequence), CONSEQUENCE_WEIGHT_DEFAULT)
    return F.round(exploitability_score * w * F.lit(10.0), 2)


def sla_hours(severity: Column) -> Column:
    return lookup(SLA_HOURS, F.upper(severity), SLA_HOURS_DEFAULT)


def sla_deadline(severity: Column, base: Column) -> Column:
    return base + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), sla_hours(severity))


def zone_consequence(zone: Column) -> Column:
    return lookup(ZONE_CONSEQUENCE, zone, ZONE_CONSEQUENCE_DEFAULT)


def exposure_key(source_tool: Column, title: Column, asset_id: Column) -> Column:
    raw = F.concat_ws(":", F.coalesce(source_tool, F.lit("")), F.coalesce(title, F.lit("")),
                      F.coalesce(asset_id, F.lit("")))
    return F.substring(F.sha2(raw, 256), 1, 16)


def exploitability_band(score: Column, high: float = 0.7, medium: float = 0.4) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


# ---------------------------------------------------------------------------
# IOC / risk
# ---------------------------------------------------------------------------

def ioc_ttl_seconds(confidence: Column) -> Column:
    hi, mid, lo = IOC_TTL_SECONDS
    return F.when(confidence > 80, hi).when(confidence >= 50, mid).otherwise(lo)


def ioc_expires_at(loaded_at: Column, confidence: Column) -> Column:
    return loaded_at + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0),
                                       ioc_ttl_seconds(confidence))


def classify_risk(priority: Column, freshness_hours: Column,
                  max_stale_hours: float = RISK_MAX_STALE_HOURS) -> Column:
    return (F.when(priority.isNull(), "no_baseline")
            .when(freshness_hours > max_stale_hours, "unknown")
            .when(priority < RISK_LOW_BELOW, "low")
            .when(priority < RISK_MEDIUM_BELOW, "medium")
            .otherwise("high"))


def severity_rank(severity: Column) -> Column:
    return lookup(SEVERITY_RANK, F.lower(severity), 6)


# ---------------------------------------------------------------------------
# Networks
# ---------------------------------------------------------------------------

IPV4_RE = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def ipv4_to_long(ip: Column) -> Column:
    """Dotted quad -> 32-bit integer as BIGINT; null when not a valid address."""
    parts = [F.regexp_extract(ip, IPV4_RE, i).cast("bigint") for i in range(1, 5)]
    ok = ip.rlike(IPV4_RE)
    for p in parts:
        ok = ok & (p <= 255)
    val = parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]
    return F.when(ok, val)


IPV6_CHARS = r"^[0-9A-Fa-f:]{2,39}$"
IPV6_BAD = r":::|^:[^:]|[^:]:$|::.*::|[0-9A-Fa-f]{5}"


def address_key(ip: Column) -> Column:
    """An address as text that orders like the address: ``4`` and 8, or ``6`` and 32 hex digits; null
    when it is neither a dotted quad nor colon-separated IPv6."""
    v4 = F.concat(F.lit("4"), F.lpad(F.lower(F.hex(ipv4_to_long(ip))), 8, "0"))
    halves = F.split(ip, "::")

    def groups(half: Column) -> Column:
        return F.transform(F.filter(F.split(F.coalesce(half, F.lit("")), ":"), lambda g: g != ""), lambda g: F.lpad(F.lower(g), 4, "0"))
    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    n = F.size(left) + F.size(right)
    whole = F.when(F.size(halves) == 2, n <= 7).otherwise(n == 8)
    v6 = F.concat(F.lit("6"), F.array_join(left, ""), F.repeat(F.lit("0"), 4 * (F.lit(8) - n)), F.array_join(right, ""))
    ok = ip.rlike(IPV6_CHARS) & F.contains(ip, F.lit(":")) & ~ip.rlike(IPV6_BAD) & whole
    return F.when(ipv4_to_long(ip).isNotNull(), v4).when(ok, v6)


def network_range(cidr: Column) -> Column:
    """STRUCT<lo, hi> of address keys of ``address/bits`` (host bits are ignored, no bits: that one address); nulls
    when it is malformed."""
    parts = F.split(cidr, "/")
    key = address_key(F.get(parts, F.lit(0)))
    digits = F.length(key) - 1
    given = F.get(parts, F.lit(1))
    bits = F.when(F.size(parts) == 1, digits * 4).when((F.size(parts) == 2) & given.rlike(r"^[0-9]{1,3}$"), given.try_cast("int"))
    ok = key.isNotNull() & (bits >= 0) & (bits <= digits * 4)
    full, rest = F.floor(bits / 4).cast("int"), bits % 4
    head = F.substring(key, F.lit(1), full + 1)
    nibble = F.conv(F.substring(key, full + 2, F.lit(1)), 16, 10).cast("int")
    step = F.pow(F.lit(2), 4 - rest).cast("int")
    low = nibble - nibble % step

    def end(digit: Column, fill: str) -> Column:
        part = F.when(rest > 0, F.concat(head, F.lower(F.hex(digit)))).otherwise(head)
        return F.when(ok, F.rpad(part, digits + 1, F.lit(fill)))
    return F.struct(end(low, "0").alias("lo"), end(low + step - 1, "f").alias("hi"))


def cidr_contains(cidr: Column, ip: Column) -> Column:
    """``ip`` inside the network ``cidr`` (IPv4 or IPv6); false when either is malformed."""
    net, x = network_range(cidr), address_key(ip)
    return F.coalesce((x >= net["lo"]) & (x <= net["hi"]), F.lit(False))


def is_private_ipv4(ip: Column) -> Column:
    x = ipv4_to_long(ip)
    return ((x >= 167772160) & (x <= 184549375)) | ((x >= 2886729728) & (x <= 2887778303)) | \
        ((x >= 3232235520) & (x <= 3232301055))


# ---------------------------------------------------------------------------
# Vectors and sets
# ---------------------------------------------------------------------------

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(F.coalesce(a, F.array()), F.coalesce(b, F.array())))
    i = F.size(F.array_intersect(F.coalesce(a, F.array()), F.coalesce(b, F.array())))
    return F.when(u > 0, i / u).otherwise(F.lit(0.0))


# ---------------------------------------------------------------------------
# Scoring (R-01, R-04)
# ---------------------------------------------------------------------------

def recency_decay(age_days: Column, rare_important: Column | None = None) -> Column:
    short = F.exp(F.lit(-DECAY_LAMBDA) * age_days)
    long_ = F.lit(1.0) / (F.lit(1.0) + F.log(F.lit(1.0) + age_days / F.lit(365.0)))
    r = F.lit(SHORT_TERM_WEIGHT) * short + F.lit(LONG_TERM_WEIGHT) * long_
    if rare_important is not None:
        r = F.when(F.coalesce(rare_important, F.lit(False)), F.greatest(r, F.lit(RARE_IMPORTANT_FLOOR))).otherwise(r)
    return r


def incident_score(similarity: Column, age_days: Column, same_tenant: Column, overlap: Column,
                   rare_important: Column | None = None) -> Column:
    return (F.lit(SCORE_ALPHA) * similarity
            + F.lit(SCORE_BETA) * recency_decay(age_days, rare_important)
            + F.lit(SCORE_GAMMA) * F.when(same_tenant, 1.0).otherwise(0.0)
            + F.lit(SCORE_DELTA) * overlap)


def confidence_floor(rule_id: Column, confidence: Column) -> Column:
    return F.greatest(confidence, lookup(SAFETY_CONFIDENCE_FLOORS, rule_id, 0.0))


def trust_downgrade(confidence: Column, source: Column) -> Column:
    return F.when(source.isin(*UNTRUSTED_TELEMETRY_SOURCES), confidence * F.lit(TRUST_DOWNGRADE_FACTOR)) \
        .otherwise(confidence)


def trust_level(source: Column) -> Column:
    return F.when(source.isin(*UNTRUSTED_TELEMETRY_SOURCES), "untrusted").otherwise("trusted")


# ---------------------------------------------------------------------------
# Hashing
# ---------------------------------------------------------------------------

def row_digest(*cols: Column) -> Column:
    """64-bit content hash of a row, combinable with ``bit_xor`` (order-free)."""
    return F.xxhash64(*cols)


def stable_order_key(seed: int | str, key: Column) -> Column:
    """Repeatable pseudo-random order (replaces ``random.sample``): md5 of seed and key,
    a hex string that orders identically in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
