"""Text jobs over tables of free text (T-02 .. T-19, W-13).

Each operator is a column expression (``regexp_extract_all``, higher-order
``transform/filter/aggregate``, which run interpreted) evaluated in the JVM on the
executors; a document is never shipped to Python. Patterns are Java regexes
equivalent to the reference's (``(?i)`` for IGNORECASE).

Sequential semantics of the reference (redaction classes applied one after
another to already-redacted text) are kept by chaining columns: class k
extracts from the output of class k-1 and folds its replacements with
``aggregate`` in first-appearance order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): patterns, word lists, limits
# ---------------------------------------------------------------------------

RE_IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
RE_SHA256 = r"\b[a-fA-F0-9]{64}\b"
RE_SHA1 = r"\b[a-fA-F0-9]{40}\b"
RE_MD5 = r"\b[a-fA-F0-9]{32}\b"
RE_IPV6 = r"\b[0-9a-fA-F:]{7,}\b"
RE_IOC_DOMAIN = (r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+"
                 r"(?:com|net|org|io|ru|cn|xyz|gov|edu|mil|co|uk|de|fr|us|ca|au)\b")
RE_SUMMARY_DOMAIN = r"\b[a-zA-Z0-9][-a-zA-Z0-9]*(?:\.[a-zA-Z0-9][-a-zA-Z0-9]*)*\.[a-zA-Z]{2,}\b"
RE_EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
RE_HOSTNAME = r"\b[A-Z][A-Z0-9_-]{2,15}(?:\.[a-zA-Z0-9.-]+)?\b"
RE_USER_IN_HOSTNAME = r"\b[A-Za-z][A-Za-z0-9]{1,19}[-_][A-Za-z]{2,15}(?:\d{1,3})?\b"
RE_PATH_USER = r"(?:/home/|/Users/|[A-Za-z]:\\Users\\)([a-zA-Z][a-zA-Z0-9._-]{1,20})"
RE_CHAT_HANDLE = r"@[a-zA-Z][a-zA-Z0-9._-]{1,20}\b"
RE_TECHNIQUE = r"\b(T\d{4}(?:\.\d{3})?|AML\.T\d{4})\b"
RE_DANGEROUS = r"""[;|&`$(){}\[\]<>'"]"""
RE_SENTENCE_BOUNDARY = r"(?<=[.!?])\s+"

HOSTNAME_EXCLUSIONS = ("SERVER", "ROUTER", "SWITCH", "PRINTER", "BUILD", "TEST", "PROD", "DEV", "STAGE", "STAGING",
                       "BACKUP", "PROXY", "GATEWAY", "MONITOR", "ADMIN", "NODE", "WORKER", "MASTER", "SLAVE",
                       "PRIMARY", "SECONDARY", "REPLICA", "CLUSTER")
PII_PATTERNS = (RE_IPV4, RE_EMAIL, RE_HOSTNAME, RE_USER_IN_HOSTNAME, RE_PATH_USER, RE_CHAT_HANDLE)
ECS_FIELD_EXCLUSIONS = ("@timestamp", "@version", "@metadata", "@message", "@fields", "@source", "@tags", "@type")

INJECTION_PATTERNS = (
    r"(?i)you\s+are\s+now\b",
    r"(?i)pretend\s+you\s+are\b",
    r"(?i)role[\s-]?play\s+as\b",
    r"(?i)act\s+as\s+(?:a|an|if)\b",
    r"(?i)ignore\s+(?:previous|all|your|the\s+above)\s+instructions?\b",
    r"(?i)disregard\s+(?:your|all|the|previous)\s+(?:instructions?|rules?|prompt)\b",
    r"(?i)override\s+your\s+(?:instructions?|rules?|guidelines?)\b",
    r"(?i)forget\s+(?:everything|all|your)\s+(?:instructions?|rules?)?\b",
    r"(?i)\bDAN\b.*Do\s+Anything\s+Now",
    r"(?i)\bjailbreak\b",
    r"(?i)\bDo\s+Anything\s+Now\b",
    r"(?i)(?:print|show|reveal|repeat|output)\s+(?:your\s+)?system\s+prompt\b",
    r"(?i)what\s+(?:is|are)\s+your\s+(?:system\s+)?instructions?\b",
    r"(?i)(?:enter|enable|activate)\s+developer\s+mode\b",
)
RE_MARKUP = r"(?is)```\s*(?:system|tool|assistant|human)\b.*?```"
REDACTED_INJECTION = "[REDACTED_INJECTION_ATTEMPT]"
REDACTED_MARKUP = "[REDACTED_MARKUP]"
RE_FACTUAL_VERBS = r"(?i)\b(?:connected|accessed|created|deleted|modified|executed|downloaded|uploaded)\b"
RE_INSTRUCTION_VERBS = r"(?i)\b(?:ignore|pretend|override|forget|reveal|act\s+as)\b"

MAX_FIELD_LENGTH = 2048
CONTEXT_BUDGET_BY_TIER = {"tier_0": 4096, "tier_1": 8192, "tier_1_plus": 16384, "tier_2": 16384}
DEFAULT_CONTEXT_BUDGET = 8192
CHARS_PER_TOKEN = 4
RISK_ORDER = {"benign": 0, "suspicious": 1, "malicious": 2}
RISK_ACTION = {"benign": "pass", "suspicious": "summarize", "malicious": "quarantine"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_all(text, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(pattern), group)


def _lits(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


# ---------------------------------------------------------------------------
# T-02 regex IOC fallback, T-05 validation, T-04 sanitising
# ---------------------------------------------------------------------------

def valid_ipv4(ip: Column) -> Column:
    """T-05: dotted quad with every octet <= 255."""
    return ip.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") & F.forall(F.split(ip, r"\."), lambda p: p.cast("int") <= 255)


def valid_hash(value: Column, algorithm: Column | None = None) -> Column:
    """T-05: hex of the algorithm's length (auto-detect 64/40/32 when no algorithm)."""
    v = F.lower(F.trim(value))
    lens = {"sha256": 64, "sha1": 40, "md5": 32}
    hexv = v.rlike(r"^[a-f0-9]+$")
    if algorithm is None:
        return hexv & F.length(v).isin(*lens.values())
    algo = F.regexp_replace(F.lower(algorithm), "-", "")
    want = F.create_map(*[x for k, n in lens.items() for x in (F.lit(k), F.lit(n))])[algo]
    return hexv & want.isNotNull() & (F.length(v) == want)


def regex_iocs(text) -> Column:
    """T-02: struct(ips, sha256, sha1, domains, raw_iocs) with the reference's confidences
    (.7 / .8 / .7 / .6) implied by the field; ``raw_iocs`` is the sorted distinct union. Each regex runs once a
    text: what several fields need is bound."""
    t = _c(text)
    found = F.struct(F.filter(F.array_distinct(extract_all(t, RE_IPV4)), valid_ipv4).alias("ips"),
                     F.array_distinct(F.transform(extract_all(t, RE_SHA256), F.lower)).alias("sha256"),
                     F.array_distinct(F.transform(extract_all(t, RE_SHA1), F.lower)).alias("sha1"),
                     F.array_distinct(extract_all(t, RE_IOC_DOMAIN)).alias("domains"))

    def without_parts(f):
        sha1 = F.filter(f["sha1"], lambda h: ~F.exists(f["sha256"], lambda s: F.contains(s, h)))
        return F.struct(f["ips"].alias("ips"), f["sha256"].alias("sha256"), sha1.alias("sha1"), f["domains"].alias("domains"))

    def without_seen(f):
        seen = F.array_union(F.array_union(f["ips"], f["sha256"]), f["sha1"])
        return let(seen, lambda s: F.struct(
            f["ips"].alias("ips"), f["sha256"].alias("sha256"), f["sha1"].alias("sha1"), F.array_except(f["domains"], s).alias("domains"),
            F.array_sort(F.array_union(s, f["domains"])).alias("raw_iocs")))
    return let(let(found, without_parts), without_seen)


def ioc_entities(text) -> Column:
    """T-02 as entity structs (type, value, confidence, algorithm)."""
    def ent(arr, typ, conf, algo=None):
        return F.transform(arr, lambda v: F.struct(F.lit(typ).alias("entity_type"), v.alias("primary_value"),
                                                   F.lit(conf).alias("confidence"),
                                                   F.lit(algo).cast("string").alias("algorithm")))
    return let(regex_iocs(text), lambda r: F.concat(
        ent(r["ips"], "ip", 0.7), ent(r["sha256"], "filehash", 0.8, "SHA256"),
        ent(r["sha1"], "filehash", 0.7, "SHA1"), ent(r["domains"], "dns", 0.6)))


def sanitize_value(value, field_name: str = "") -> Column:
    """T-04: strip query-injection characters (except command lines), empty -> null. The value is kept
    whole, ``oversize`` flags one beyond the reference's field length."""
    v = _c(value)
    if field_name.lower() not in ("commandline", "command_line"):
        v = F.regexp_replace(v, RE_DANGEROUS, "")
    return F.nullif(F.trim(v), F.lit(""))


def oversize(value) -> Column:
    """T-04: whether a value is longer than ``MAX_FIELD_LENGTH`` (the reference cuts it there)."""
    return F.coalesce(F.length(_c(value)) > MAX_FIELD_LENGTH, F.lit(False))


# ---------------------------------------------------------------------------
# T-06 / T-07 / W-13 PII redaction and re-identification
# ---------------------------------------------------------------------------

def let(value: Column, fn) -> Column:
    """Bind ``value`` once and pass it to ``fn`` (a lambda variable is evaluated once).

    Without it, an expression referenced inside a higher-order lambda is inlined by
    the optimizer and re-evaluated for every array element.
    """
    return F.transform(F.array(value), fn).getItem(0)


_MAP_TYPE = "array<struct<value:string,placeholder:string>>"


def _number(values: Column, prefix: str, start: Column) -> Column:
    """W-13: placeholders PREFIX_NNN numbered by first appearance, continuing after ``start``."""
    return F.transform(values, lambda v, i: F.struct(
        v.alias("value"), F.concat(F.lit(prefix + "_"), F.format_string("%03d", start + i + 1)).alias("placeholder")))


def _apply(text: Column, pairs: Column) -> Column:
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["value"], p["placeholder"]))


def _count(mapping: Column, prefix: str) -> Column:
    return F.size(F.filter(mapping, lambda p: F.startswith(p["placeholder"], F.lit(prefix + "_"))))


def _stage(state: Column, extract, prefix: str) -> Column:
    """One redaction class: extract from the current text, reuse known placeholders, number
    new values after the prefix's current count, and replace in first-appearance order."""
    def step(st):
        def with_found(found):
            known = F.transform(st["map"], lambda p: p["value"])

            def with_new(new):
                reuse = F.filter(st["map"], lambda p: F.array_contains(found, p["value"]))
                return F.struct(_apply(_apply(st["text"], reuse), new).alias("text"),
                                F.concat(st["map"], new).alias("map"))
            return let(_number(F.filter(found, lambda v: ~F.array_contains(known, v)), prefix,
                               _count(st["map"], prefix)), with_new)
        return let(extract(st), with_found)
    return let(state, step)


def _hostnames(st: Column) -> Column:
    placeholders = F.transform(st["map"], lambda p: p["placeholder"])

    def keep(m):
        base = F.regexp_replace(F.upper(F.split(m, r"\.").getItem(0)), r"[0-9]+$", "")
        parts = F.split(base, "[-_]")
        short_alpha = m.rlike(r"^[A-Za-z]+$") & (F.length(m) <= 5)
        return (~F.array_contains(placeholders, m) & ~short_alpha
                & ~F.exists(parts, lambda p: F.array_contains(_lits(HOSTNAME_EXCLUSIONS), p)))
    return F.filter(F.array_distinct(extract_all(st["text"], RE_HOSTNAME)), keep)


def _host_users(st: Column) -> Column:
    def keep(m):
        second = F.regexp_extract(m, r"^[^-_]*[-_](.*)$", 1)
        return ~F.array_contains(_lits(HOSTNAME_EXCLUSIONS), F.regexp_replace(F.upper(second), r"[0-9]+$", ""))
    return F.filter(F.array_distinct(extract_all(st["text"], RE_USER_IN_HOSTNAME)), keep)


def _handles(st: Column) -> Column:
    return F.filter(F.array_distinct(extract_all(st["text"], RE_CHAT_HANDLE)),
                    lambda m: ~F.array_contains(_lits(ECS_FIELD_EXCLUSIONS), F.lower(m)))


def _path_users(state: Column) -> Column:
    """Path user names: numbered like the other USER values; inside each matched path only the
    first occurrence of the name is replaced (as the reference does)."""
    def step(st):
        def with_matches(mz):
            known = F.transform(st["map"], lambda p: p["value"])
            users = F.transform(mz, lambda z: z["user"])

            def with_new(new):
                m2 = F.concat(st["map"], new)

                def fix(acc, z):
                    ph = F.filter(m2, lambda p: p["value"] == z["user"]).getItem(0)["placeholder"]
                    pos = F.position(z["user"], z["full"])
                    head = F.substring(z["full"], F.lit(1), pos - 1)
                    tail = F.substring(z["full"], pos + F.length(z["user"]), F.length(z["full"]))
                    return F.replace(acc, z["full"], F.concat(head, ph, tail))
                return F.struct(F.aggregate(mz, st["text"], fix).alias("text"), m2.alias("map"))
            return let(_number(F.filter(F.array_distinct(users), lambda v: ~F.array_contains(known, v)), "USER",
                               _count(st["map"], "USER")), with_new)
        mz = F.array_distinct(F.arrays_zip(extract_all(st["text"], RE_PATH_USER, 0).alias("full"),
                                           extract_all(st["text"], RE_PATH_USER, 1).alias("user")))
        return let(mz, with_matches)
    return let(state, step)


def redact_state(text, explicit=None) -> Column:
    """T-06 as one column: STRUCT<text, map> after all classes (IP_SRC, USER, HOST, HOST, USER, USER)."""
    t = _c(text)
    if explicit is not None:
        ex = _c(explicit)
        pairs = F.transform(ex, lambda e, i: F.struct(e["value"].alias("value"), F.concat(
            e["prefix"], F.lit("_"), F.format_string("%03d", F.size(F.filter(F.slice(ex, 1, i + 1),
                                                                              lambda x: x["prefix"] == e["prefix"]))))
            .alias("placeholder")))
        state = let(pairs, lambda ps: F.struct(_apply(t, ps).alias("text"), ps.alias("map")))
    else:
        state = F.struct(t.alias("text"), F.array().cast(_MAP_TYPE).alias("map"))
    state = _stage(state, lambda st: F.array_distinct(extract_all(st["text"], RE_IPV4)), "IP_SRC")
    state = _stage(state, lambda st: F.array_distinct(extract_all(st["text"], RE_EMAIL)), "USER")
    state = _stage(state, _hostnames, "HOST")
    state = _stage(state, _host_users, "HOST")
    state = _path_users(state)
    return _stage(state, _handles, "USER")


def redact_pii(df: DataFrame, text_col: str, explicit: str | None = None, out_text: str = "redacted_text",
               out_map: str = "redaction_map") -> DataFrame:
    """T-06: replace IPs, emails, hostnames, host-user names, path users and chat handles by
    stable placeholders, class after class on the already-redacted text; one map per row (case).

    ``explicit`` optionally names an ``ARRAY<STRUCT<value, prefix>>`` column redacted first.
    Adds ``out_text`` and ``out_map`` (ARRAY<STRUCT<value, placeholder>>). A text that no class pattern
    matches is passed on; the others are redacted once (behind a generator, so that filters on the result
    do not repeat the work).
    """
    st = redact_state(text_col, explicit)
    if explicit is None:
        hit = F.coalesce(F.col(text_col).rlike("|".join(f"(?:{p})" for p in PII_PATTERNS)), F.lit(False))
        none = F.struct(F.col(text_col).alias("text"), F.array().cast(_MAP_TYPE).alias("map"))
        st = F.when(hit, st).otherwise(none)
    return df.select("*", F.explode(F.array(st)).alias("_red")).withColumn(out_text, F.col("_red.text")) \
        .withColumn(out_map, F.col("_red.map")).drop("_red")


def reidentify(text, mapping) -> Column:
    """T-07: restore values, longest placeholder first."""
    ordered = F.array_sort(_c(mapping), lambda a, b: F.length(b["placeholder"]) - F.length(a["placeholder"]))
    return F.aggregate(ordered, _c(text), lambda acc, p: F.replace(acc, p["placeholder"], p["value"]))


def placeholder_counts(mapping) -> Column:
    """Per-prefix counts of a redaction map (IP_SRC, USER, HOST)."""
    m = _c(mapping)

    def n(prefix):
        return F.size(F.filter(m, lambda p: F.startswith(p["placeholder"], F.lit(prefix + "_"))))
    return F.struct(*[n(pre).alias(pre.lower()) for pre in ("IP_SRC", "USER", "HOST")])


# ---------------------------------------------------------------------------
# T-08 .. T-10 injection
# ---------------------------------------------------------------------------

def injection_match_count(text) -> Column:
    """Number of the 14 patterns that occur at least once."""
    t = _c(text)
    return sum((F.coalesce(t.rlike(p), F.lit(False))).cast("int") for p in INJECTION_PATTERNS)


def classify_injection(*cols) -> Column:
    """T-08: struct(match_count, risk, action, confidence) over ``title description entities`` joined by spaces."""
    combined = F.concat_ws(" ", *[F.coalesce(_c(c), F.lit("")) for c in cols])
    n = injection_match_count(combined)
    risk = F.when(n == 0, "benign").when(n <= 2, "suspicious").otherwise("malicious")
    conf = (F.when(n == 0, F.lit(1.0)).when(n <= 2, F.least(F.lit(0.5) + n * 0.15, F.lit(0.9)))
            .otherwise(F.least(F.lit(0.7) + n * 0.05, F.lit(0.99))))
    action = F.when(risk == "benign", "pass").when(risk == "suspicious", "summarize").otherwise("quarantine")
    return F.struct(n.alias("match_count"), risk.alias("risk"), action.alias("action"), conf.alias("confidence"))


def sanitise_input(text) -> Column:
    """T-09: redact fenced role markup then each injection pattern; list what was found. A text in which none is found stays as it
    is; the others go through the steps one after the other, each on the text that the last one left."""
    t = _c(text)
    steps = [(RE_MARKUP, REDACTED_MARKUP, "embedded_markup")]
    steps += [(p, REDACTED_INJECTION, "injection:" + p.replace("(?i)", "", 1)[:40]) for p in INJECTION_PATTERNS]
    found = F.lit(False)
    for pat, _, _ in steps:
        found = found | t.rlike(pat)
    none = F.struct(t.alias("text"), F.array().cast("array<string>").alias("detections"))
    each = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("pat", "repl", "label"), x)]) for x in steps])

    def step(acc, s):
        return F.when(F.rlike(acc["text"], s["pat"]), F.struct(
            F.regexp_replace(acc["text"], s["pat"], s["repl"]).alias("text"),
            F.concat(acc["detections"], F.array(s["label"])).alias("detections"))).otherwise(acc)
    return F.when(found, F.aggregate(each, none, step)).otherwise(none)


def stricter_verdict(regex_risk, other_risk, regex_conf, other_conf) -> Column:
    """T-10: only a suspicious regex verdict consults the second opinion; the stricter wins."""
    rr, orr = _c(regex_risk), _c(other_risk)
    rank = F.create_map(*[x for k, v in RISK_ORDER.items() for x in (F.lit(k), F.lit(v))])
    use_other = (rr == "suspicious") & orr.isNotNull() & (rank[orr] > rank[rr])
    risk = F.when(use_other, orr).otherwise(rr)
    conf = (F.when(use_other, _c(other_conf))
            .when((rr == "suspicious") & orr.isNotNull(), F.greatest(_c(regex_conf), _c(other_conf)))
            .otherwise(_c(regex_conf)))
    return F.struct(risk.alias("risk"), conf.alias("confidence"))


# ---------------------------------------------------------------------------
# T-11 .. T-13 entity list, facts, summary
# ---------------------------------------------------------------------------

def summary_entities(text) -> Column:
    """T-11: SHA-256, MD5 (not inside a SHA-256), IPv4, IPv6-ish, domains, emails; first-seen order."""
    t = _c(text)
    sha = extract_all(t, RE_SHA256)
    md5 = F.filter(extract_all(t, RE_MD5), lambda m: ~F.exists(sha, lambda s: F.contains(s, m)))
    return F.array_distinct(F.concat(sha, md5, extract_all(t, RE_IPV4), extract_all(t, RE_IPV6),
                                     extract_all(t, RE_SUMMARY_DOMAIN), extract_all(t, RE_EMAIL)))


def sentences(text) -> Column:
    """Split after . ! ? followed by whitespace; trimmed, empties dropped."""
    return F.filter(F.transform(F.split(_c(text), RE_SENTENCE_BOUNDARY), lambda x: F.trim(x)), lambda s: s != "")


def _is_instruction(s: Column) -> Column:
    inj = F.lit(False)
    for p in INJECTION_PATTERNS:
        inj = inj | s.rlike(p)
    return inj | s.rlike(RE_INSTRUCTION_VERBS)


def facts(text, entities=None) -> Column:
    """T-12: sentences without instruction shape that mention an entity or a factual verb.

    Pass ``entities`` as a materialised column: referenced inside the lambda, an
    inline extraction would be re-run for every sentence.
    """
    ents = summary_entities(text) if entities is None else _c(entities)
    return let(ents, lambda es: F.filter(sentences(text), lambda s: ~_is_instruction(s) & (
        F.exists(es, lambda e: F.contains(s, e)) | s.rlike(RE_FACTUAL_VERBS))))


def remove_instructions(text) -> Column:
    return F.array_join(F.filter(sentences(text), lambda s: ~_is_instruction(s)), " ")


def summarize_df(df: DataFrame, text_col: str, out: str = "summary") -> DataFrame:
    """T-13: "Entities: ..." + unique facts + remaining clean sentences, or a fixed notice.

    Entities and sentences are computed once per row as columns, then reused.
    """
    d = (df.withColumn("_ents", summary_entities(text_col))
         .withColumn("_sents", sentences(text_col))
         .withColumn("_instr", F.transform("_sents", _is_instruction)))
    pairs = F.arrays_zip(F.col("_sents").alias("s"), F.col("_instr").alias("i"))
    facts_ = F.transform(F.filter(pairs, lambda z: ~z["i"] & (
        F.exists("_ents", lambda e: F.contains(z["s"], e)) | z["s"].rlike(RE_FACTUAL_VERBS))), lambda z: z["s"])
    clean = sentences(F.array_join(F.transform(F.filter(pairs, lambda z: ~z["i"]), lambda z: z["s"]), " "))
    body = F.array_distinct(F.concat(facts_, clean))
    parts = F.concat(F.when(F.size("_ents") > 0, F.array(F.concat(F.lit("Entities: "), F.array_join("_ents", ", "))))
                     .otherwise(F.array().cast("array<string>")), body)
    res = F.when(F.size(parts) == 0, F.lit("No actionable content detected.")).otherwise(F.array_join(parts, " "))
    return d.withColumn(out, res).drop("_ents", "_sents", "_instr")


def summarize(text) -> Column:
    """Column form of T-13 for short texts (alert fields); use ``summarize_df`` on documents."""
    ents = summary_entities(text)
    clean = sentences(remove_instructions(text))
    body = F.array_distinct(F.concat(facts(text, ents), clean))
    parts = F.concat(F.when(F.size(ents) > 0, F.array(F.concat(F.lit("Entities: "), F.array_join(ents, ", "))))
                     .otherwise(F.array().cast("array<string>")), body)
    return F.when(F.size(parts) == 0, F.lit("No actionable content detected.")).otherwise(F.array_join(parts, " "))


def transform_content_df(df: DataFrame, text_col: str, action_col: str, out: str = "content") -> DataFrame:
    """T-13 switch: pass / summarize / quarantine."""
    d = summarize_df(df, text_col, "_summary")
    a = F.col(action_col)
    return d.withColumn(out, F.when(a == "summarize", F.col("_summary"))
                        .when(a == "quarantine", F.lit("Content quarantined for security review."))
                        .otherwise(F.col(text_col))).drop("_summary")


# ---------------------------------------------------------------------------
# T-14 technique ids, T-16 evidence, T-17 budget, T-19 JSON parse
# ---------------------------------------------------------------------------

def technique_ids(text) -> Column:
    return F.array_sort(F.array_distinct(extract_all(text, RE_TECHNIQUE, 1)))


#: Technique ids that may go to every task as one array (under 2 MB).
MAX_KNOWN_IDS = 100_000


def quarantine_techniques(df: DataFrame, text_col: str, known: DataFrame, id_col: str = "technique_id") -> DataFrame:
    """T-14/U-03: technique ids in the text that are not in the taxonomy, and the text with those ids
    stripped at word boundaries. Nulls in other columns do not matter.

    A taxonomy of up to ``MAX_KNOWN_IDS`` ids (they are counted) joins as one row with its array of ids, so texts are not shuffled. A
    larger one is joined by id with the distinct id lists of the texts, and these come back by their list."""
    ids = known.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    nothing = F.array().cast("array<string>")
    found = F.coalesce(technique_ids(text_col), nothing)
    if ids.count() <= MAX_KNOWN_IDS:
        one = ids.agg(F.collect_list("_id").alias("_known"))
        out = df.crossJoin(F.broadcast(one)).withColumn("quarantined", F.when(
            F.size(found) > 0, F.array_sort(F.array_except(found, "_known"))).otherwise(nothing)).drop("_known")
    else:
        cited = df.withColumn("_found", found)
        lists = cited.select("_found").distinct()
        unknown = (lists.select("_found", F.explode("_found").alias("_id")).join(ids, "_id", "left_anti")
                   .groupBy("_found").agg(F.array_sort(F.collect_set("_id")).alias("_unknown")))
        out = (cited.join(unknown, "_found", "left").withColumn("quarantined", F.coalesce("_unknown", nothing)).select(*df.columns, "quarantined"))
    pattern = F.concat(F.lit(r"\b(?:"), F.array_join(F.transform(F.col("quarantined"), lambda x: F.regexp_replace(
        x, r"\.", r"\\.")), "|"), F.lit(r")\b"))
    return out.withColumn("validated_text", F.when(F.size("quarantined") > 0, F.regexp_replace(
        F.col(text_col), pattern, F.lit(""))).otherwise(F.col(text_col)))


def xml_escape(text) -> Column:
    t = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def evidence_block(text, tag: str = "evidence") -> Column:
    """T-16: strip any evidence tags the text carries, escape, wrap in one evidence element."""
    stripped = F.regexp_replace(_c(text), rf"(?i)</?\s*{tag}[^>]*>", "")
    return F.concat(F.lit(f"<{tag}>"), xml_escape(stripped), F.lit(f"</{tag}>"))


def context_budget(tier) -> Column:
    m = F.create_map(*[x for k, v in CONTEXT_BUDGET_BY_TIER.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[_c(tier)], F.lit(DEFAULT_CONTEXT_BUDGET))


def truncate_to_budget(text, budget_tokens) -> Column:
    """T-17: keep the first budget*4 characters."""
    return F.substring(_c(text), 1, _c(budget_tokens) * CHARS_PER_TOKEN)


def parse_json_or_default(text, schema: str, default_json: str) -> Column:
    """T-19: typed parse of a JSON text column; malformed or empty -> the default value."""
    t = _c(text)
    return F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, schema)).otherwise(F.from_json(F.lit(default_json), schema))


def json_shape_errors(text, required: Sequence[str], types: Mapping[str, str] | None = None) -> Column:
    """T-15: errors for non-JSON text, missing required keys and wrong value types (VARIANT parse)."""
    v = F.try_parse_json(_c(text))
    errs = [F.when(v.isNull(), F.lit("Response is not valid JSON"))]
    for k in required:
        errs.append(F.when(v.isNotNull() & F.try_variant_get(v, f"$.{k}", "variant").isNull(),
                           F.lit(f"Missing required field: {k}")))
    for k, typ in (types or {}).items():
        actual = F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
        ok = {"string": actual == "STRING", "boolean": actual == "BOOLEAN", "array": actual.startswith("ARRAY"),
              "number": actual.isin("BIGINT", "DOUBLE", "BOOLEAN") | actual.startswith("DECIMAL")}[typ]
        errs.append(F.when(v.isNotNull() & F.try_variant_get(v, f"$.{k}", "variant").isNotNull() & ~ok,
                           F.lit(f"Field '{k}' expected {typ}")))
    return F.array_compact(F.array(*errs))


# ---------------------------------------------------------------------------
# E-22 section-aware chunking with one-paragraph overlap
# ---------------------------------------------------------------------------

# Fixed values (must equal the reference's documented chunker)
RE_SECTION_HEADER = r"^(#{1,3})\s+(.+)$"
CHUNK_IOC_PATTERNS = {
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "domain": r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b",
    "sha256": r"\b[a-fA-F0-9]{64}\b",
    "sha1": r"\b[a-fA-F0-9]{40}\b",
    "md5": r"\b[a-fA-F0-9]{32}\b",
    "cve": r"CVE-\d{4}-\d{4,7}",
    "mitre_technique": r"T\d{4}(?:\.\d{3})?",
    "email": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
    "url": r"https?://[^\s<>\"{}|\\^`\[\]]+",
}
FP_DOMAINS = ("microsoft.com", "github.com", "google.com", "example.com", "windows.net", "azure.com", "office.com",
              "outlook.com", "amazonaws.com", "cloudfront.net", "googleapis.com")
RFC1918_PREFIXES = ("10.", "192.168.", "172.")


def _prefixer(prefix: str):
    return lambda m: F.concat(F.lit(prefix), m)


def chunk_iocs(text) -> Column:
    """Typed IOC strings ("type:value") of one chunk, de-duplicated and sorted."""
    t = _c(text)
    parts = []
    for typ, pat in CHUNK_IOC_PATTERNS.items():
        found = extract_all(t, pat)
        if typ == "domain":
            found = F.filter(found, lambda m: ~F.array_contains(_lits(FP_DOMAINS), F.lower(m)))
        if typ == "ipv4":
            found = F.filter(found, lambda m: ~(m.startswith("10.") | m.startswith("192.168.") | m.startswith("172.")))
        prefix = typ + ":"
        parts.append(F.transform(found, _prefixer(prefix)))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def chunk_documents(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", *,
                    max_chunk_tokens: int = 512) -> DataFrame:
    """E-22: split each document into markdown sections; a section longer than ``max_chunk_tokens``
    (4 chars per token) is filled paragraph by paragraph, carrying the last paragraph into the
    next chunk. One row per chunk: (doc, chunk_index, section, content, iocs, mitre techniques).

    Lines are numbered with ``posexplode`` and sections with a running header count over the
    document's own lines, so every window holds at most one document."""
    from pyspark.sql import Window
    lines = docs.select(doc_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    hdr = F.regexp_extract("line", RE_SECTION_HEADER, 2)
    is_h = F.col("line").rlike(RE_SECTION_HEADER)
    w = Window.partitionBy(doc_col).orderBy("pos")
    lines = lines.withColumn("is_h", is_h).withColumn("sec", F.sum(F.col("is_h").cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hname", F.when(F.col("is_h"), F.trim(hdr)))
    secs = (lines.groupBy(doc_col, "sec")
            .agg(F.max("hname").alias("hname"),
                 F.array_sort(F.collect_list(F.when(~F.col("is_h"), F.struct("pos", "line")))).alias("ls"))
            .where(F.size("ls") > 0)
            .select(doc_col, "sec", F.coalesce("hname", F.lit("Introduction")).alias("section"),
                    F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content")))
    paras = F.split(F.col("content"), "\n\n")
    st = "struct<chunks:array<string>,cur:array<string>,len:int>"

    def step(acc, p):
        ptok = F.floor(F.length(p) / 4).cast("int")
        flush = (acc["len"] + ptok > max_chunk_tokens) & (F.size(acc["cur"]) > 0)
        last = F.element_at(acc["cur"], -1)
        chunks = F.when(flush, F.concat(acc["chunks"], F.array(F.array_join(acc["cur"], "\n\n")))).otherwise(acc["chunks"])
        cur = F.when(flush, F.array(last)).otherwise(acc["cur"])
        ln = F.when(flush, F.floor(F.length(last) / 4).cast("int")).otherwise(acc["len"])
        return F.struct(chunks.alias("chunks"), F.concat(cur, F.array(p)).alias("cur"), (ln + ptok).alias("len"))

    filled = F.aggregate(paras, F.struct(F.array().cast("array<string>").alias("chunks"),
                                         F.array().cast("array<string>").alias("cur"), F.lit(0).alias("len")).cast(st),
                         step, lambda acc: F.when(F.size(acc["cur"]) > 0, F.concat(
                             acc["chunks"], F.array(F.array_join(acc["cur"], "\n\n")))).otherwise(acc["chunks"]))
    pieces = F.when(F.floor(F.length("content") / 4) <= max_chunk_tokens, F.array(F.col("content"))).otherwise(filled)
    ch = secs.select(doc_col, "sec", "section", F.posexplode(pieces).alias("k", "raw"))
    wi = Window.partitionBy(doc_col).orderBy("sec", "k")
    ch = ch.withColumn("chunk_index", F.row_number().over(wi) - 1)
    return ch.select(doc_col, "chunk_index", "section", F.trim(F.col("raw")).alias("content"),
                     chunk_iocs("raw").alias("iocs_in_chunk"),
                     F.array_sort(F.array_distinct(extract_all("raw", r"T\d{4}(?:\.\d{3})?"))).alias("mitre_techniques_in_chunk"))
