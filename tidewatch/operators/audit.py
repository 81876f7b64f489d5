"""Hash-chained audit table: build (W-15), verify (W-01/W-02), samples (W-03/W-04),
compliance and evidence reports (A-21, A-35), month partitions, export and drop gate
(S-15..S-19).

Record digest = SHA-256 of the canonical JSON of every stored column except
``record_hash``: keys sorted, compact separators (Spark ``to_json`` over a struct
whose fields are in sorted order); nested context/decision/outcome are stored and
hashed as JSON strings (Q11: hash exactly what is stored).

Stored format: a tenant's records are numbered in (timestamp, audit_id) order and cut into segments of
one hour. Within a segment each record's ``previous_hash`` is the hash before it; a segment's first
record carries ``segment_seed(tenant, sequence)`` (the tenant's very first one 64 zeros, one that goes on
after a stored head in the same hour that head's hash). ``chain_segments`` lists the segments' heads and
links them by a running digest; stored when the chain is built, that table is what ties the segments together. So the sequential step, each digest covering the one before, is bounded by
a tenant's hour, and the largest tenant is chained by as many tasks as it has hours. Numbering takes counts by
(tenant, segment) and a rank within the segment, both in the JVM. Verification is an equi-join on (tenant, seq - 1); seeds are
public, so it takes one only where an hour begins, and compares every segment with the stored table of heads and digests: records
rewritten up to the end of their hour link well among themselves, but their head is not the stored one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import ship_package
from pyspark.sql import types as T

from tidewatch.functions.exprs import stable_order_key
from tidewatch.operators.reports import top_k_per_key

# Fixed values (must equal the reference)
GENESIS_HASH = "0" * 64
GENESIS_EVENT = "system.genesis"
RECORD_VERSION = "1.0"
MAX_PAGE = 1000

# Audit event vocabulary -> category (P-30).
EVENT_CATEGORY = {
    "alert.classified": "decision", "alert.auto_closed": "decision", "alert.escalated": "decision",
    "alert.short_circuited": "decision", "investigation.state_changed": "decision",
    "investigation.enriched": "decision", "playbook.selected": "decision", "playbook.generated": "decision",
    "ctem.exposure_scored": "decision", "atlas.detection_fired": "decision", "routing.tier_selected": "decision",
    "routing.provider_failover": "decision", "response.prepared": "action", "response.executed": "action",
    "response.rolled_back": "action", "ioc.enriched": "action", "fp_pattern.created": "action",
    "fp_pattern.activated": "action", "ctem.remediation_assigned": "action", "ctem.remediation_verified": "action",
    "knowledge.indexed": "action", "embedding.reindexed": "action", "response.generated": "action",
    "approval.requested": "approval", "approval.granted": "approval", "approval.denied": "approval",
    "approval.timed_out": "approval", "approval.escalated": "approval", "fp_pattern.approved": "approval",
    "fp_pattern.revoked": "approval", "shadow.go_live_approved": "approval", "injection.detected": "security",
    "injection.quarantined": "security", "technique.quarantined": "security",
    "accumulation.threshold_breached": "security", "spend.soft_limit": "security", "spend.hard_limit": "security",
    "canary.promoted": "decision", "canary.rolled_back": "decision", "shadow.decision_logged": "decision",
    "degradation.entered": "system", "degradation.exited": "system", "kill_switch.activated": "system",
    "kill_switch.deactivated": "system", "config.changed": "system", "circuit_breaker.opened": "system",
    "circuit_breaker.closed": "system", "system.genesis": "system",
}

AUDIT_SCHEMA = T.StructType([
    T.StructField("audit_id", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("sequence_number", T.LongType()),
    T.StructField("previous_hash", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("ingested_at", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("actor_type", T.StringType()),
    T.StructField("actor_id", T.StringType()),
    T.StructField("actor_permissions", T.ArrayType(T.StringType())),
    T.StructField("investigation_id", T.StringType()),
    T.StructField("alert_id", T.StringType()),
    T.StructField("entity_ids", T.ArrayType(T.StringType())),
    T.StructField("context", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("record_hash", T.StringType()),
    T.StructField("record_version", T.StringType()),
])
HASHED = sorted(f.name for f in AUDIT_SCHEMA.fields if f.name != "record_hash")
_HEAD = [c for c in HASHED if c < "previous_hash"]
_MID = [c for c in HASHED if "previous_hash" < c < "sequence_number"]
_TAIL = [c for c in HASHED if c > "sequence_number"]
_EVENT_FIELDS = [f.name for f in AUDIT_SCHEMA.fields
                 if f.name not in ("sequence_number", "previous_hash", "record_hash")]


def record_digest(df_cols: Sequence[str] = HASHED) -> Column:
    """SHA-256 of the canonical JSON of the hashed columns (sorted keys, compact)."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in df_cols]), {"ignoreNullFields": "false"}), 256)


def genesis_rows(events: DataFrame, timestamp: str = "1970-01-01T00:00:00.000Z") -> DataFrame:
    """One genesis event per tenant present in ``events``."""
    t = events.select("tenant_id").distinct()
    return t.select(
        F.concat(F.lit("genesis-"), F.col("tenant_id")).alias("audit_id"), "tenant_id",
        F.lit(timestamp).alias("timestamp"), F.lit(timestamp).alias("ingested_at"),
        F.lit(GENESIS_EVENT).alias("event_type"), F.lit("system").alias("event_category"),
        F.lit("info").alias("severity"), F.lit("system").alias("actor_type"), F.lit("audit-service").alias("actor_id"),
        F.array().cast("array<string>").alias("actor_permissions"), F.lit("").alias("investigation_id"),
        F.lit("").alias("alert_id"), F.array().cast("array<string>").alias("entity_ids"),
        F.lit("{}").alias("context"), F.lit("{}").alias("decision"), F.lit("{}").alias("outcome"),
        F.lit(RECORD_VERSION).alias("record_version"), F.lit(0).alias("_genesis"))


def segment_seed(tenant: Column, sequence: Column) -> Column:
    """``previous_hash`` of a record that begins a segment."""
    return F.sha2(F.concat_ws("|", F.lit("segment"), tenant, sequence.cast("string")), 256)


def segment_of(timestamp: Column) -> Column:
    """A record's segment: the hour of its ISO timestamp."""
    return F.substring(timestamp, 1, 13)


def canonical_pieces(df: DataFrame) -> DataFrame:
    """Add the canonical JSON around the two chain fields, by the serializer that verification uses."""
    def piece(cols):
        return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}) if cols else F.lit("{}")
    return df.withColumn("_head", piece(_HEAD)).withColumn("_mid", piece(_MID)).withColumn("_tail", piece(_TAIL))


def link_hash(previous: str, sequence: int, head: str, mid: str, tail: str) -> str:
    """SHA-256 of a record's canonical JSON, put together from its pieces and chain fields."""
    parts = [head[1:-1], f'"previous_hash":"{previous}"', mid[1:-1], f'"sequence_number":{sequence}', tail[1:-1]]
    return hashlib.sha256(("{" + ",".join(x for x in parts if x) + "}").encode("utf-8")).hexdigest()


def _chain_partition(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (tenant, segment, sequence); ``_seed`` is set on each segment's first row."""
    last = GENESIS_HASH
    for pdf in it:
        prevs, hashes = [], []
        for seed, seq, head, mid, tail in zip(pdf["_seed"], pdf["sequence_number"], pdf["_head"], pdf["_mid"], pdf["_tail"]):
            prevs.append(seed if seed is not None else last)
            last = link_hash(prevs[-1], seq, head, mid, tail)
            hashes.append(last)
        out = pdf.drop(columns=["_head", "_mid", "_tail", "_seed"])
        out["previous_hash"], out["record_hash"] = prevs, hashes
        yield out


#: Records that one task of the chain sorts and hashes, about.
ROWS_PER_TASK = 200_000


def number_events(events: DataFrame, heads: DataFrame | None = None, *, with_genesis: bool = True, tasks: int | None = None) -> DataFrame:
    """The events with ``sequence_number``, ``_segment`` and ``_seed`` (first record of a segment).

    ``heads`` (tenant_id, sequence_number, timestamp, record_hash: each tenant's last stored record) continues
    stored chains: an event earlier than its tenant's head goes into the head's segment. A tenant without a head
    gets a genesis record. ``tasks``: how many the records are dealt to, by tenant and segment, if not as many as a shuffle has.
    """
    ev = events.select(*_EVENT_FIELDS).withColumn("_genesis", F.lit(1))
    if with_genesis:
        first = genesis_rows(events)
        if heads is not None:
            first = first.join(heads.select("tenant_id"), "tenant_id", "left_anti")
        ev = first.select(*_EVENT_FIELDS, "_genesis").unionByName(ev)
    if heads is None:
        ev = ev.withColumns({"_head_seq": F.lit(-1).cast("long"), "_head_segment": F.lit(""), "_head_hash": F.lit(None).cast("string")})
    else:
        h = heads.select("tenant_id", F.col("sequence_number").alias("_head_seq"), segment_of(F.col("timestamp")).alias("_head_segment"),
                         F.col("record_hash").alias("_head_hash"))
        ev = ev.join(h, "tenant_id", "left").withColumns({"_head_seq": F.coalesce("_head_seq", F.lit(-1)),
                                                          "_head_segment": F.coalesce("_head_segment", F.lit(""))})
    ev = ev.withColumn("_segment", F.greatest(segment_of(F.col("timestamp")), "_head_segment"))
    counts = ev.groupBy("tenant_id", "_segment").agg(F.count(F.lit(1)).alias("_n"))
    if tasks is not None:
        ev = ev.repartition(tasks, "tenant_id", "_segment")
    # tenants x hours rows.
    before = Window.partitionBy("tenant_id").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("tenant_id", "_segment", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("tenant_id", "_segment").orderBy("_genesis", "timestamp", "audit_id")
    numbered = ev.withColumn("_rank", F.row_number().over(own)).join(base, ["tenant_id", "_segment"])
    seq = F.col("_base") + F.col("_rank") + F.col("_head_seq")
    seed = (F.when(seq == 0, F.lit(GENESIS_HASH))
            .when(F.col("_segment") == F.col("_head_segment"), F.col("_head_hash"))
            .otherwise(segment_seed(F.col("tenant_id"), seq)))
    return (numbered.withColumn("sequence_number", seq).withColumn("_seed", F.when(F.col("_rank") == 1, seed))
            .drop("_genesis", "_head_seq", "_head_segment", "_head_hash", "_base", "_rank"))


def build_chain(events: DataFrame, heads: DataFrame | None = None, *, with_genesis: bool = True) -> DataFrame:
    """W-15/ST-04 batch twin: per-tenant sequence numbers and hash links, segment by segment.

    ``events`` carries the stored event columns (all of AUDIT_SCHEMA except sequence, previous_hash and
    record_hash); ``heads`` appends to stored chains (see ``number_events``).
    """
    spark = events.sparkSession
    ship_package(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(events.count() / ROWS_PER_TASK))
    rows = number_events(events, heads, with_genesis=with_genesis, tasks=n)
    kept = _EVENT_FIELDS + ["sequence_number"]
    # The JSON pieces are as long as a record; they are made of the sorted rows, not sorted with them.
    ordered = canonical_pieces(rows.repartition(n, "tenant_id", "_segment").sortWithinPartitions("tenant_id", "_segment", "sequence_number")) \
        .select(*kept, "_seed", "_head", "_mid", "_tail")
    types = {f.name: f for f in AUDIT_SCHEMA.fields}
    out_schema = T.StructType([types[c] for c in kept + ["previous_hash", "record_hash"]])
    return ordered.mapInPandas(_chain_partition, out_schema).select(*AUDIT_SCHEMA.fieldNames())


def chain_heads(records: DataFrame) -> DataFrame:
    """Each tenant's last record, the ``heads`` of a later append."""
    last = records.groupBy("tenant_id").agg(F.max_by(F.struct("sequence_number", "timestamp", "record_hash"), "sequence_number").alias("h"))
    return last.select("tenant_id", "h.sequence_number", "h.timestamp", "h.record_hash")


def chain_segments(records: DataFrame) -> DataFrame:
    """(tenant, first_seq, last_seq, head_hash, digest): the segments in order; ``digest`` covers the heads of all
    segments up to this one. The rows are tenants x hours, the records themselves are not sorted; the digest is carried along the
    sorted heads. (Proofs that need not read all heads are in ``merkle``.)"""
    starts = records.where((F.col("sequence_number") == 0) | (F.col("previous_hash") == segment_seed(F.col("tenant_id"), F.col("sequence_number"))))
    top = records.groupBy("tenant_id").agg(F.max("sequence_number").alias("top"))
    w = Window.partitionBy("tenant_id").orderBy("first_seq")
    s = (starts.select("tenant_id", F.col("sequence_number").alias("first_seq")).join(top, "tenant_id")
         .withColumn("last_seq", F.coalesce(F.lead("first_seq").over(w) - 1, F.col("top"))).drop("top"))
    ends = records.select(F.col("tenant_id").alias("tenant_id"), F.col("sequence_number").alias("last_seq"), F.col("record_hash").alias("head_hash"))
    heads = s.join(ends, ["tenant_id", "last_seq"])
    spark = records.sparkSession
    ship_package(spark)
    ordered = (heads.select("tenant_id", "first_seq", "last_seq", "head_hash")
               .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tenant_id").sortWithinPartitions("tenant_id", "first_seq"))
    return ordered.mapInPandas(_running_digests, "tenant_id string, first_seq long, last_seq long, head_hash string, digest string")


def _running_digests(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Heads sorted by (tenant, first_seq), each with the digest of all of its tenant's up to it."""
    tenant, acc = None, GENESIS_HASH
    for pdf in it:
        out = []
        for t, h in zip(pdf["tenant_id"], pdf["head_hash"]):
            if t != tenant:
                tenant, acc = t, GENESIS_HASH
            acc = hashlib.sha256((acc + h).encode()).hexdigest()
            out.append(acc)
        yield pdf.assign(digest=out)


#: Sequence numbers to a bucket, by which records find the segment they are in.
_SPAN = 1024


def segments_differing(records: DataFrame, segments: DataFrame, whole: bool = True) -> DataFrame:
    """(tenant_id, first_seq, last_seq, error): the segments of ``segments`` (a stored ``chain_segments``) whose last record
    has another hash in ``records``, whose last record and all after it are missing (``whole``), or whose stored digest does
    not follow from the digest before."""
    at = records.groupBy(F.col("tenant_id").alias("tenant_id"), F.col("sequence_number").alias("last_seq")).agg(
        F.min("record_hash").alias("_lo"), F.max("record_hash").alias("_hi"))
    top = records.groupBy(F.col("tenant_id").alias("tenant_id")).agg(F.max("sequence_number").alias("_top"))
    w = Window.partitionBy("tenant_id").orderBy("first_seq")
    s = segments.select("tenant_id", "first_seq", "last_seq", "head_hash", (F.col("digest") != F.sha2(F.concat(
        F.lag("digest", 1, GENESIS_HASH).over(w), "head_hash"), 256)).alias("_broken"))
    j = s.join(at, ["tenant_id", "last_seq"], "left").join(top, "tenant_id", "left")
    gone = F.lit(whole) & (F.col("last_seq") > F.coalesce("_top", F.lit(-1)))
    error = (F.when((F.col("_lo") != F.col("head_hash")) | (F.col("_hi") != F.col("head_hash")), F.lit("segment differs from its stored head"))
             .when(gone, F.lit("segment's stored head is missing")).when(F.col("_broken"), F.lit("stored digest does not link")))
    return j.select("tenant_id", "first_seq", "last_seq", error.alias("error")).where("error is not null")


def verify_chain(records: DataFrame, segments: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """W-01: per record, recomputed hash, link to the predecessor (seq - 1) or, where an hour begins, a segment's seed,
    sequence gaps and repeated sequence numbers (a forked or repeated tail). With ``segments``, the ``chain_segments``
    stored when the chain was built, all records of a segment that is not as stored are reported too, and (``whole``: the
    records are not a range) stored tails that are missing, on a row with a null ``audit_id``. Without that table a
    rewritten whole segment cannot be told from the true one, its seed being public.

    Returns only records with errors: (tenant_id, sequence_number, audit_id, errors ARRAY<STRING>).
    Counts and predecessors are equi-joins on (tenant, seq), parallel even for one huge tenant.
    """
    # explicit aliases give every side of the self-join its own attribute ids
    r = records.select(*[F.col(c).alias(c) for c in ("tenant_id", "sequence_number", "audit_id", "previous_hash",
                                                     "record_hash")], segment_of(F.col("timestamp")).alias("_hour"),
                       record_digest().alias("_expected"))
    at = records.groupBy(F.col("tenant_id").alias("tenant_id"), F.col("sequence_number").alias("sequence_number")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("record_hash").alias("_lo"), F.max("record_hash").alias("_hi"),
        F.max(segment_of(F.col("timestamp"))).alias("_before"))
    prev = at.select("tenant_id", (F.col("sequence_number") + 1).alias("sequence_number"), "_lo", "_hi", "_before", F.lit(True).alias("_has_prev"))
    own = at.select("tenant_id", "sequence_number", "_n")
    first = records.groupBy(F.col("tenant_id").alias("tenant_id")).agg(F.min("sequence_number").alias("_first"))
    j = r.join(own, ["tenant_id", "sequence_number"]).join(prev, ["tenant_id", "sequence_number"], "left").join(first, "tenant_id")
    is_first = F.col("sequence_number") == F.col("_first")
    p = F.col("previous_hash")
    seeded = (p == segment_seed(F.col("tenant_id"), F.col("sequence_number"))) & (F.col("_hour") > F.col("_before"))
    linked = (p == F.col("_lo")) | (p == F.col("_hi")) | seeded
    seq = F.col("sequence_number").cast("string")
    if segments is None:
        j = j.withColumn("_segment", F.lit(None).cast("string"))
    else:
        bad = segments_differing(records, segments, whole).checkpoint()
        spans = bad.select(F.col("tenant_id").alias("_t"), "first_seq", "last_seq", "error", F.explode(F.sequence(
            F.floor(F.col("first_seq") / _SPAN), F.floor(F.col("last_seq") / _SPAN))).alias("_b"))
        within = ((F.col("tenant_id") == F.col("_t")) & (F.floor(F.col("sequence_number") / _SPAN) == F.col("_b"))
                  & F.col("sequence_number").between(F.col("first_seq"), F.col("last_seq")))
        j = j.join(spans, within, "left").withColumn("_segment", F.concat(F.lit("Record seq="), seq, F.lit(": "), "error"))
    errs = F.array_compact(F.array(
        F.when(F.col("record_hash") != F.col("_expected"), F.concat(F.lit("Record seq="), seq, F.lit(": hash mismatch"))),
        F.when(~is_first & F.col("_has_prev") & ~linked, F.concat(F.lit("Record seq="), seq, F.lit(": previous_hash does not link"))),
        F.when(~is_first & F.col("_has_prev").isNull(), F.concat(F.lit("Sequence gap: expected predecessor of "), seq)),
        F.when(F.col("_n") > 1, F.concat(F.lit("Sequence repeated: "), seq)), F.col("_segment")))
    found = j.select("tenant_id", "sequence_number", "audit_id", errs.alias("errors")).where(F.size("errors") > 0)
    if segments is None:
        return found
    tails = bad.where(F.col("error").contains("missing")).select("tenant_id", F.col("last_seq").alias("sequence_number"), F.lit(None).cast("string").alias("audit_id"),
                              F.array(F.concat(F.lit("Record seq="), F.col("last_seq").cast("string"), F.lit(": "), "error")).alias("errors"))
    return found.unionByName(tails)


def verify_range(records: DataFrame, tenant: str | None = None, start_seq: int | None = None,
                 end_seq: int | None = None, segments: DataFrame | None = None) -> DataFrame:
    """W-02: verify a tenant and/or sequence range (the range's first record is its own start); with ``segments``, also the
    stored heads that lie in it."""
    r = records
    if tenant is not None:
        r = r.where(F.col("tenant_id") == tenant)
    if start_seq is not None:
        r = r.where(F.col("sequence_number") >= start_seq)
    if end_seq is not None:
        r = r.where(F.col("sequence_number") <= end_seq)
    return verify_chain(r, segments, whole=tenant is None and start_seq is None and end_seq is None)


def chain_summary(records: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Per tenant: records, first/last sequence, head hash, error count (a verification log row)."""
    errs = verify_chain(records, segments).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("errors"))
    g = records.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("records"), F.min("sequence_number").alias("first_seq"),
        F.max("sequence_number").alias("last_seq"),
        F.max_by("record_hash", "sequence_number").alias("head_hash"))
    return g.join(errs, "tenant_id", "left").withColumn("errors", F.coalesce("errors", F.lit(0)).cast("bigint")) \
        .withColumn("valid", F.col("errors") == 0)


def last_n(records: DataFrame, n: int = 100) -> DataFrame:
    """W-03: the last ``n`` records per tenant (window group-limit: trimmed before the shuffle)."""
    return top_k_per_key(records, ["tenant_id"], n, [F.desc("sequence_number")], "rank")


def repeatable_sample(records: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """W-04: ``n`` records per tenant in a seeded hash order (replaces random sampling, Q17)."""
    return top_k_per_key(records, ["tenant_id"], n, [stable_order_key(seed, F.col("audit_id")), F.col("audit_id")],
                         "rank")


def with_month(records: DataFrame) -> DataFrame:
    """S-16: ``month`` partition column (YYYY-MM) from the ISO timestamp."""
    return records.withColumn("month", F.substring("timestamp", 1, 7))


def compliance_by_category(records: DataFrame, tenant: str | None = None, month: str | None = None) -> DataFrame:
    """A-21: events per category for a tenant and month (Q12: the month IS applied)."""
    r = with_month(records)
    if tenant is not None:
        r = r.where(F.col("tenant_id") == tenant)
    if month is not None:
        r = r.where(F.col("month") == month)
    return r.groupBy("tenant_id", "month", "event_category").agg(F.count(F.lit(1)).alias("events"))


def partition_listing(records: DataFrame) -> DataFrame:
    """S-16: month partitions with row counts."""
    return with_month(records).groupBy("month").agg(F.count(F.lit(1)).alias("rows"))


def content_fingerprint(records: DataFrame, keys: Sequence[str] = ("month",)) -> DataFrame:
    """S-17: order-free content check of a table or export: count and the sum of 64-bit row hashes (a sum, so
    repeated rows do not cancel)."""
    r = with_month(records) if "month" in keys and "month" not in records.columns else records
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), multiset_digest(*AUDIT_SCHEMA.fieldNames()).alias("fingerprint"))


def multiset_digest(*cols: str) -> Column:
    """Aggregate: SHA-256 over the count and two sums of row hashes, whatever the order of the rows."""
    one = F.xxhash64(*cols).cast("decimal(38,0)")
    two = F.xxhash64(F.lit("second"), *cols).cast("decimal(38,0)")
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum(one).cast("string"), F.sum(two).cast("string")), 256)


def export_month(records: DataFrame, month: str, path: str) -> DataFrame:
    """S-17: write one month by tenant and sequence range, read it back, and return (month, rows,
    fingerprint, verified): whether what was read equals what was to be written."""
    m = with_month(records).where(F.col("month") == month)
    (m.drop("month").repartitionByRange("tenant_id", "sequence_number").sortWithinPartitions("tenant_id", "sequence_number")
     .write.mode("overwrite").parquet(path))
    back = content_fingerprint(records.sparkSession.read.parquet(path).withColumn("month", F.lit(month)))
    return (back.join(content_fingerprint(m).select("month", F.col("fingerprint").alias("_f")), "month")
            .withColumn("verified", F.col("fingerprint") == F.col("_f")).drop("_f"))


def forward_months(now_month: str, ahead: int = 3) -> list[str]:
    """S-16: the months whose partitions are created ahead of time, the current one included."""
    y, m = map(int, now_month.split("-"))
    return [f"{y + (m - 1 + i) // 12:04d}-{(m - 1 + i) % 12 + 1:02d}" for i in range(ahead + 1)]


def droppable_months(partitions: DataFrame, exports: DataFrame, holds: DataFrame, now_month: str,
                     buffer_months: int = 1) -> DataFrame:
    """S-18: months older than the buffer, exported and verified, with no legal-hold tenant in them.

    ``partitions``: (month, tenant_id) present; ``exports``: (month, verified); ``holds``: (tenant_id).
    """
    cutoff = F.date_format(F.add_months(F.to_date(F.lit(now_month + "-01")), -buffer_months), "yyyy-MM")
    held = partitions.join(holds.select("tenant_id").distinct(), "tenant_id", "left_semi").select("month").distinct()
    ok = exports.where(F.col("verified")).select("month").distinct()
    return (partitions.select("month").distinct().where(F.col("month") < cutoff)
            .join(ok, "month", "left_semi").join(held, "month", "left_anti"))


def evidence_package(records: DataFrame, investigation_col: str = "investigation_id", segments: DataFrame | None = None) -> DataFrame:
    """A-35: per tenant and investigation: events by category and by class (state transitions, model
    interactions, actions, approvals, retrieval), last classification, actions done and pending, chain errors of its
    records, and a package hash over its record hashes. Only bounded aggregates: no list of records is collected."""
    r = records.where(F.col(investigation_col) != "")
    keys = ["tenant_id", investigation_col]
    t = F.col("event_type")
    said = F.get_json_object("decision", "$.classification")
    g = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.max_by(said, F.when(said.isNotNull(), F.struct("timestamp", "sequence_number"))).alias("last_classification"),
        F.count_if(t.startswith("investigation.")).alias("state_transitions"),
        F.count_if(F.contains("context", F.lit("llm_"))).alias("llm_interactions"),
        F.count_if(t.startswith("response.")).alias("actions"),
        F.count_if(t.startswith("approval.")).alias("approvals"),
        F.count_if(F.coalesce(F.get_json_object("context", "$.retrieval_stores_queried"), F.lit("[]")) != "[]").alias("retrievals"),
        F.count_if(t == "response.executed").alias("actions_done"), F.count_if(t == "response.prepared").alias("actions_pending"),
        multiset_digest("sequence_number", "record_hash").alias("package_hash"))
    cats = r.groupBy(*keys, "event_category").agg(F.count(F.lit(1)).alias("n"))
    by_cat = cats.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("event_category", "n"))).alias("events_by_category"))
    bad = verify_chain(records, segments).select("tenant_id", "sequence_number", "audit_id", F.size("errors").alias("_e"))
    errors = (r.select(*keys, "sequence_number", "audit_id").join(bad, ["tenant_id", "sequence_number", "audit_id"])
              .groupBy(*keys).agg(F.sum("_e").alias("chain_errors")))
    return (g.join(by_cat, keys).join(errors, keys, "left")
            .withColumn("chain_errors", F.coalesce("chain_errors", F.lit(0)).cast("bigint"))
            .withColumn("chain_verified", F.col("chain_errors") == 0))


def categorise_events(events: DataFrame, type_col: str = "event_type") -> tuple[DataFrame, DataFrame]:
    """P-30: (valid events with ``event_category``, rejects with an unknown type).

    The vocabulary is a literal map folded into the projection (no join needed)."""
    from tidewatch.functions.exprs import lookup
    cat = lookup(EVENT_CATEGORY, F.col(type_col))
    e = events.withColumn("event_category", cat)
    return e.where(F.col("event_category").isNotNull()), \
        e.where(F.col("event_category").isNull()).withColumn("error", F.lit("unknown event type"))


def list_events(records: DataFrame, tenant: str, *, event_type: str | None = None, date_from: str | None = None,
                date_to: str | None = None, limit: int = 100, before: tuple[str, int] | None = None) -> DataFrame:
    """P-15: tenant is mandatory; optional type and ISO date range; newest first. A page holds
    ``MAX_PAGE`` rows at most; a larger request is refused, and ``before`` (timestamp, sequence
    number of the last row seen) gives the next page."""
    if not 1 <= int(limit) <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    r = records.where(F.col("tenant_id") == tenant)
    if event_type:
        r = r.where(F.col("event_type") == event_type)
    if date_from:
        r = r.where(F.col("timestamp") >= date_from)
    if date_to:
        r = r.where(F.col("timestamp") <= date_to)
    if before:
        r = r.where(F.struct("timestamp", "sequence_number") < F.struct(F.lit(before[0]).alias("timestamp"),
                                                                        F.lit(int(before[1])).alias("sequence_number")))
    return r.orderBy(F.desc("timestamp"), F.desc("sequence_number")).limit(int(limit))


def search_events(records: DataFrame, *, actor: str | None = None, event_type: str | None = None,
                  tenant: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """P-16: case-insensitive actor substring, type, tenant and date range."""
    r = records
    if actor:
        r = r.where(F.lower(F.col("actor_id")).contains(actor.lower()))
    if event_type:
        r = r.where(F.col("event_type") == event_type)
    if tenant:
        r = r.where(F.col("tenant_id") == tenant)
    if date_from:
        r = r.where(F.col("timestamp") >= date_from)
    if date_to:
        r = r.where(F.col("timestamp") <= date_to)
    return r


def audit_stats(records: DataFrame, today: str) -> DataFrame:
    """A-22: counts by event type and by actor (GROUPING SETS, one pass) with today's count."""
    g = (records.groupingSets([["event_type"], ["actor_id"], []], "event_type", "actor_id")
         .agg(F.count(F.lit(1)).alias("count"),
              F.count_if(F.substring("timestamp", 1, 10) == today).alias("today"), F.grouping_id().alias("gid")))
    dim = F.when(F.col("gid") == 1, "event_type").when(F.col("gid") == 2, "actor_id").otherwise("total")
    return g.select(dim.alias("dimension"), F.when(F.col("gid") == 3, F.lit(""))
                    .otherwise(F.coalesce("event_type", "actor_id")).alias("key"), "count", "today")


def stream_lag(offsets: DataFrame, stored: DataFrame, threshold: int = 1000) -> DataFrame:
    """J-18: per tenant, produced offset vs the stored table's max sequence (left join of two
    aggregates); lag above ``threshold`` is flagged."""
    o = offsets.groupBy("tenant_id").agg(F.max("offset").alias("stream_offset"))
    s = stored.groupBy("tenant_id").agg(F.max("sequence_number").alias("table_max_seq"))
    j = o.join(s, "tenant_id", "left").withColumn("table_max_seq", F.coalesce("table_max_seq", F.lit(0)))
    return j.withColumn("lag", F.col("stream_offset") - F.col("table_max_seq")) \
        .withColumn("lagging", F.col("lag") > threshold)
