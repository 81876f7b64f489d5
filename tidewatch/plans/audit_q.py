"""Registered audit-chain queries (W-01..W-04, W-15, A-21, A-35, S-16, S-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import audit as AU
from tidewatch.operators import merkle as ME
from tidewatch.plans.registry import register
from tidewatch.session import checkpoint_dir
from tidewatch.sources import tables as TB

AUDIT_EVENTS_SQL = """
WITH ev AS (
  SELECT 'aud-' || CAST(event_id AS VARCHAR) AS audit_id, 't' || CAST(user_id % 5 AS VARCHAR) AS tenant_id,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp,
         CASE event_type WHEN 'click' THEN 'decision' WHEN 'view' THEN 'decision' WHEN 'purchase' THEN 'action'
              WHEN 'signup' THEN 'approval' ELSE 'security' END AS event_category,
         CASE event_type WHEN 'purchase' THEN 'response.executed' ELSE event_type END AS et,
         'inv-' || CAST(event_id % 997 AS VARCHAR) AS investigation_id,
         CASE WHEN event_type = 'view' THEN
              CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 THEN 'true_positive'
                   ELSE 'false_positive' END END AS classification
  FROM events)
, seq AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant_id ORDER BY timestamp, audit_id) AS sequence_number FROM ev)
"""


_CHAINS: dict[tuple[str, str], DataFrame] = {}
_SEGMENTS: dict[tuple[str, str], DataFrame] = {}


def chain(spark, sf):
    """The built chain is the stored audit table: checkpointed once per application in the session's shared
    folder; verification and evidence read it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CHAINS:
        checkpoint_dir(spark)
        _CHAINS[key] = AU.build_chain(TB.audit_events(spark, sf)).checkpoint(eager=True)
    return _CHAINS[key]


def segments(spark, sf):
    """The stored table of the built chain's segments, which verification compares the records with."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SEGMENTS:
        _SEGMENTS[key] = AU.chain_segments(chain(spark, sf)).checkpoint(eager=True)
    return _SEGMENTS[key]


def numbered(spark, sf):
    """The audit table without hashes, for reports that need none: no sequential step."""
    return AU.number_events(TB.audit_events(spark, sf))


def _w15(spark, sf):
    checkpoint_dir(spark)
    c = AU.build_chain(TB.audit_events(spark, sf)).checkpoint(eager=True)
    s = AU.chain_summary(c, AU.chain_segments(c).checkpoint(eager=True))
    return s.select("tenant_id", "records", "first_seq", "last_seq", "errors", "valid")


register("w15_audit_chain_build", AUDIT_EVENTS_SQL + """
SELECT tenant_id, CAST(COUNT(*) + 1 AS BIGINT) AS records, CAST(0 AS BIGINT) AS first_seq,
       CAST(COUNT(*) AS BIGINT) AS last_seq, CAST(0 AS BIGINT) AS errors, true AS valid
FROM seq GROUP BY tenant_id
""", headline=True)(_w15)


def _w01_clean(spark, sf):
    return AU.verify_chain(chain(spark, sf), segments(spark, sf)).select("tenant_id", "sequence_number", "audit_id",
                                                    F.array_join("errors", "; ").alias("errors"))


register("w01_verify_chain_clean", """
SELECT CAST(NULL AS VARCHAR) AS tenant_id, CAST(NULL AS BIGINT) AS sequence_number, CAST(NULL AS VARCHAR) AS audit_id,
       CAST(NULL AS VARCHAR) AS errors WHERE false
""")(_w01_clean)


def _w01_tampered(spark, sf):
    c = chain(spark, sf)
    hit = (F.col("tenant_id") == "t1") & (F.col("sequence_number") == 5)
    bad = c.withColumn("context", F.when(hit, F.lit('{"tampered":true}')).otherwise(F.col("context")))
    return AU.verify_chain(bad, segments(spark, sf)).select("tenant_id", "sequence_number", "audit_id",
                                       F.array_join("errors", "; ").alias("errors"))


register("w01_verify_chain_tampered", AUDIT_EVENTS_SQL + """
SELECT tenant_id, CAST(sequence_number AS BIGINT) AS sequence_number, audit_id,
       'Record seq=5: hash mismatch' AS errors FROM seq WHERE tenant_id = 't1' AND sequence_number = 5
""")(_w01_tampered)


def _w01_forked(spark, sf):
    c = chain(spark, sf)
    last = c.join(AU.chain_heads(c).select("tenant_id", "sequence_number"), ["tenant_id", "sequence_number"], "left_semi")
    return AU.verify_chain(c.unionByName(last.select(*c.columns)), segments(spark, sf)).select("tenant_id", "sequence_number", "audit_id",
                                                                         F.array_join("errors", "; ").alias("errors"))


register("w01_verify_chain_forked", AUDIT_EVENTS_SQL + """
, t AS (SELECT *, MAX(sequence_number) OVER (PARTITION BY tenant_id) AS top FROM seq)
SELECT tenant_id, CAST(sequence_number AS BIGINT) AS sequence_number, audit_id,
       'Sequence repeated: ' || CAST(sequence_number AS VARCHAR) AS errors
FROM t, (VALUES (1), (2)) WHERE sequence_number = top
""")(_w01_forked)


def _w15_segments(spark, sf):
    s = AU.chain_segments(chain(spark, sf))
    w = Window.partitionBy("tenant_id").orderBy("first_seq")
    return s.select("tenant_id", "first_seq", "last_seq", F.row_number().over(w).cast("bigint").alias("segment"))


register("w15_chain_segments", AUDIT_EVENTS_SQL + """
, u AS (SELECT tenant_id, substr(timestamp, 1, 13) AS hour, sequence_number AS s FROM seq
        UNION ALL SELECT tenant_id, '', 0 FROM (SELECT DISTINCT tenant_id FROM ev))
SELECT tenant_id, CAST(MIN(s) AS BIGINT) AS first_seq, CAST(MAX(s) AS BIGINT) AS last_seq,
       CAST(ROW_NUMBER() OVER (PARTITION BY tenant_id ORDER BY hour) AS BIGINT) AS segment
FROM u GROUP BY tenant_id, hour
""")(_w15_segments)


def _w02(spark, sf):
    c = chain(spark, sf)
    bad = c.where(~((F.col("tenant_id") == "t2") & (F.col("sequence_number") == 10)))
    return AU.verify_range(bad, tenant="t2", start_seq=3, end_seq=40, segments=segments(spark, sf)).select(
        "tenant_id", "sequence_number", F.array_join("errors", "; ").alias("errors"))


register("w02_verify_range_gap", AUDIT_EVENTS_SQL + """
SELECT 't2' AS tenant_id, CAST(11 AS BIGINT) AS sequence_number, 'Sequence gap: expected predecessor of 11' AS errors
FROM (SELECT COUNT(*) AS n FROM seq WHERE tenant_id = 't2') WHERE n >= 11
""")(_w02)


def _w03(spark, sf):
    return AU.last_n(chain(spark, sf), 100).select("tenant_id", "audit_id", F.col("rank").cast("bigint").alias("rank"))


register("w03_last_100_per_tenant", AUDIT_EVENTS_SQL + """
, g AS (SELECT tenant_id, 'genesis-' || tenant_id AS audit_id, '' AS timestamp FROM (SELECT DISTINCT tenant_id FROM ev))
, u AS (SELECT tenant_id, audit_id, timestamp, 1 AS o FROM ev UNION ALL SELECT tenant_id, audit_id, timestamp, 0 FROM g)
, r AS (SELECT tenant_id, audit_id, ROW_NUMBER() OVER (PARTITION BY tenant_id ORDER BY o DESC, timestamp DESC, audit_id DESC) AS rank
        FROM u)
SELECT tenant_id, audit_id, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 100
""")(_w03)


def _w04(spark, sf):
    return AU.repeatable_sample(chain(spark, sf), 100).select("tenant_id", "audit_id")


register("w04_repeatable_sample", AUDIT_EVENTS_SQL + """
, g AS (SELECT DISTINCT tenant_id, 'genesis-' || tenant_id AS audit_id FROM ev)
, u AS (SELECT tenant_id, audit_id FROM ev UNION ALL SELECT tenant_id, audit_id FROM g)
, r AS (SELECT tenant_id, audit_id, ROW_NUMBER() OVER (PARTITION BY tenant_id ORDER BY md5('42:' || audit_id), audit_id) AS rn
        FROM u)
SELECT tenant_id, audit_id FROM r WHERE rn <= 100
""")(_w04)


def _a21(spark, sf):
    return AU.compliance_by_category(numbered(spark, sf), month="2024-01")


register("a21_compliance_by_category", AUDIT_EVENTS_SQL + """
SELECT tenant_id, '2024-01' AS month, event_category, CAST(COUNT(*) AS BIGINT) AS events FROM ev
WHERE substr(timestamp, 1, 7) = '2024-01' GROUP BY tenant_id, event_category
""")(_a21)


def _s16(spark, sf):
    return AU.partition_listing(numbered(spark, sf))


register("s16_partition_listing", AUDIT_EVENTS_SQL + """
SELECT month, CAST(SUM(n) AS BIGINT) AS rows FROM (
  SELECT substr(timestamp, 1, 7) AS month, COUNT(*) AS n FROM ev GROUP BY 1
  UNION ALL SELECT '1970-01', COUNT(DISTINCT tenant_id) FROM ev) GROUP BY month
""")(_s16)


def _s17(spark, sf):
    return AU.content_fingerprint(chain(spark, sf))


register("s17_export_fingerprint", None)(_s17)


def _a35(spark, sf):
    p = AU.evidence_package(chain(spark, sf), segments=segments(spark, sf))
    return p.select("tenant_id", "investigation_id", "events", "last_classification", "state_transitions", "actions", "approvals",
                    "actions_done", F.size("events_by_category").cast("bigint").alias("categories"), "chain_verified")


register("a35_evidence_package", AUDIT_EVENTS_SQL + """
SELECT tenant_id, investigation_id, CAST(COUNT(*) AS BIGINT) AS events,
       arg_max(classification, (timestamp, sequence_number)) FILTER (WHERE classification IS NOT NULL) AS last_classification,
       CAST(COUNT(*) FILTER (WHERE et = 'click') AS BIGINT) AS state_transitions,
       CAST(COUNT(*) FILTER (WHERE et = 'response.executed') AS BIGINT) AS actions,
       CAST(COUNT(*) FILTER (WHERE et = 'signup') AS BIGINT) AS approvals,
       CAST(COUNT(*) FILTER (WHERE et = 'response.executed') AS BIGINT) AS actions_done,
       CAST(COUNT(DISTINCT event_category) AS BIGINT) AS categories, true AS chain_verified
FROM seq GROUP BY tenant_id, investigation_id
""")(_a35)


def _s18(spark, sf):
    c = AU.with_month(numbered(spark, sf))
    parts = c.select("month", "tenant_id").distinct()
    exports = c.select("month").distinct().withColumn("verified", F.col("month") != "2023-12")
    holds = spark.createDataFrame([("t-legal",)], "tenant_id string")
    return AU.droppable_months(parts, exports, holds, "2024-03")


register("s18_droppable_months", AUDIT_EVENTS_SQL + """
SELECT DISTINCT m AS month FROM (SELECT substr(timestamp, 1, 7) AS m FROM ev UNION ALL SELECT '1970-01')
WHERE m < '2024-02' AND m <> '2023-12'
""")(_s18)


# ---------------------------------------------------------------- Merkle proofs over the segments
def _w15_merkle_peaks(spark, sf):
    """Peaks of each tenant's tree over its hours; a leaf covers the hour's first and last record here (audit id, time, category),
    which SQL can hash as well."""
    n = numbered(spark, sf).select("tenant_id", "_segment", "sequence_number", F.concat_ws("|", "audit_id", "timestamp", "event_category").alias("said"))
    s = n.groupBy("tenant_id", "_segment").agg(F.min("sequence_number").alias("first_seq"), F.max("sequence_number").alias("last_seq"),
                                               F.min_by("said", "sequence_number").alias("a"), F.max_by("said", "sequence_number").alias("b"))
    s = s.select("tenant_id", "first_seq", "last_seq", F.sha2(F.concat_ws("|", "a", "b"), 256).alias("head_hash"))
    p = ME.peaks_of(ME.grow(ME.leaves(s).checkpoint()).checkpoint())
    return p.select("tenant_id", F.col("level").cast("bigint").alias("level"), "idx", "hash")


register("w15_merkle_peaks", AUDIT_EVENTS_SQL.replace("WITH ev", "WITH RECURSIVE ev") + """
, u AS (SELECT tenant_id, substr(timestamp, 1, 13) AS hour, sequence_number AS s, audit_id || '|' || timestamp || '|' || event_category AS said FROM seq
        UNION ALL SELECT tenant_id, '1970-01-01T00', 0, 'genesis-' || tenant_id || '|1970-01-01T00:00:00.000Z|system' FROM (SELECT DISTINCT tenant_id FROM ev))
, g AS (SELECT tenant_id, hour, MIN(s) AS first_seq, MAX(s) AS last_seq, sha256(arg_min(said, s) || '|' || arg_max(said, s)) AS head FROM u GROUP BY tenant_id, hour)
, leaf AS (SELECT tenant_id, ROW_NUMBER() OVER (PARTITION BY tenant_id ORDER BY first_seq) - 1 AS idx,
                  sha256('leaf|' || tenant_id || '|' || first_seq || '|' || last_seq || '|' || head) AS hash FROM g)
, total AS (SELECT tenant_id, CAST(COUNT(*) AS BIGINT) AS n FROM leaf GROUP BY tenant_id)
, tree AS (SELECT tenant_id, 0 AS level, CAST(idx AS BIGINT) AS idx, hash FROM leaf
           UNION ALL
           SELECT a.tenant_id, a.level + 1, a.idx // 2, sha256(a.hash || b.hash)
           FROM tree a JOIN tree b ON b.tenant_id = a.tenant_id AND b.level = a.level AND b.idx = a.idx + 1 WHERE a.idx % 2 = 0)
SELECT t.tenant_id, CAST(level AS BIGINT) AS level, idx, hash FROM tree t JOIN total USING (tenant_id)
WHERE (n >> level) % 2 = 1 AND idx = (n >> level) - 1
""")(_w15_merkle_peaks)


def _w02_merkle_hours(spark, sf):
    """Every hour proved from its own records and the trusted peaks; one record of tenant t1 was rewritten with its hash."""
    c = chain(spark, sf)
    leaves = ME.leaves(segments(spark, sf)).checkpoint()
    nodes = ME.grow(leaves).checkpoint()
    hit = (F.col("tenant_id") == "t1") & (F.col("sequence_number") == 5)
    bad = c.withColumn("context", F.when(hit, F.lit('{"tampered":true}')).otherwise(F.col("context")))
    bad = bad.withColumn("record_hash", F.when(hit, AU.record_digest()).otherwise(F.col("record_hash")))
    v = ME.verify_hours(bad, leaves, nodes, ME.peaks_of(nodes))
    return v.select("tenant_id", "idx", "first_seq", "last_seq", "records", F.col("steps").cast("bigint").alias("steps"), "proven")


register("w02_merkle_hours", AUDIT_EVENTS_SQL + """
, u AS (SELECT tenant_id, substr(timestamp, 1, 13) AS hour, sequence_number AS s FROM seq
        UNION ALL SELECT tenant_id, '', 0 FROM (SELECT DISTINCT tenant_id FROM ev))
, g AS (SELECT tenant_id, CAST(MIN(s) AS BIGINT) AS first_seq, CAST(MAX(s) AS BIGINT) AS last_seq, CAST(COUNT(*) AS BIGINT) AS records,
               CAST(ROW_NUMBER() OVER (PARTITION BY tenant_id ORDER BY hour) - 1 AS BIGINT) AS idx, CAST(COUNT(*) OVER (PARTITION BY tenant_id) AS BIGINT) AS n
        FROM u GROUP BY tenant_id, hour)
SELECT tenant_id, idx, first_seq, last_seq, records,
       CAST((SELECT COUNT(*) FROM range(0, 40) AS r(k) WHERE ((idx >> k) | 1) < (n >> k)) AS BIGINT) AS steps,
       NOT (tenant_id = 't1' AND 5 BETWEEN first_seq AND last_seq) AS proven
FROM g
""")(_w02_merkle_hours)
