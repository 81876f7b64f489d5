"""Proofs over the audit chain: an append-only Merkle tree per tenant whose leaves are the chain's closed segments (hours).

Node (level, idx) covers the leaves ``idx * 2^level`` up to the next such multiple and exists once all of them do; so a node, once
written, never changes, and n leaves have one peak for each bit of n. The peaks are all that has to be kept in a safe place.

* ``grow`` adds leaves: new nodes come from the new leaves and the peaks alone, whatever the tenant holds already. Nodes are merged by
  grouped aggregation, ``SPAN_BITS`` levels a step (a group holds ``2^SPAN_BITS`` nodes at most), so 100,000 hours take two steps.
* ``proofs`` gives the siblings from a leaf up to its peak, and ``verify_hours`` recomputes hours from their records alone and
  carries them up to the trusted peaks: a rewritten hour is found without reading the rest of the table or of the tree.
* ``not_extended`` lists the old peaks that are no nodes of a later tree: appended history must keep them all.

A segment is added when its hour is over; the hour a tenant still writes to is not a leaf yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import audit as AU

SPAN_BITS = 10
LEVELS = 62
NODE_SCHEMA = "tenant_id string, level int, idx long, hash string"


def leaf_hash(tenant: Column, first_seq: Column, last_seq: Column, head: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("leaf"), tenant, first_seq.cast("string"), last_seq.cast("string"), head), 256)


def size_of(peaks: DataFrame) -> DataFrame:
    """(tenant_id, n): leaves under the peaks."""
    return peaks.groupBy("tenant_id").agg(F.sum(F.expr("shiftleft(1L, level)")).alias("n"))


def leaves(segments: DataFrame, peaks: DataFrame | None = None) -> DataFrame:
    """Segments (tenant_id, first_seq, last_seq, head_hash) numbered on after the stored ``peaks``: ``tenant_id, idx, first_seq, last_seq, hash``.
    A tenant's segments are one row an hour."""
    own = F.row_number().over(Window.partitionBy("tenant_id").orderBy("first_seq")).cast("long") - 1
    s = segments.select("tenant_id", "first_seq", "last_seq", leaf_hash(F.col("tenant_id"), F.col("first_seq"), F.col("last_seq"), F.col("head_hash")).alias("hash"), own.alias("idx"))
    if peaks is not None:
        s = s.join(size_of(peaks), "tenant_id", "left").withColumn("idx", F.col("idx") + F.coalesce("n", F.lit(0))).drop("n")
    return s.select("tenant_id", "idx", "first_seq", "last_seq", "hash")


def _merged(rows: DataFrame) -> DataFrame:
    """The new nodes over ``rows`` (tenant_id, k, idx, hash, new): new nodes of k 0 and the peaks of k 0 to ``SPAN_BITS`` - 1, in
    blocks of ``2^SPAN_BITS``. At each k the known nodes follow one another from an even place on."""
    block = F.shiftright(F.expr("shiftleft(idx, k)"), SPAN_BITS)
    groups = rows.groupBy("tenant_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("k", "idx", "hash"))).alias("known"), F.max("new").alias("new")).where("new")
    nodes = F.expr(f"""aggregate(sequence(1, {SPAN_BITS}),
        named_struct('cur', filter(known, x -> x.k = 0), 'made', filter(known, x -> false)),
        (acc, k) -> named_struct(
          'cur', concat(filter(known, x -> x.k = k), {_pairs('acc.cur')}),
          'made', concat(acc.made, {_pairs('acc.cur')})),
        acc -> acc.made)""")
    return groups.select("tenant_id", F.explode(nodes).alias("x")).select("tenant_id", "x.k", "x.idx", "x.hash")


def _pairs(cur: str) -> str:
    return (f"transform(filter({cur}, (x, i) -> i % 2 = 1), (y, i) -> named_struct('k', k, 'idx', shiftright(y.idx, 1), "
            f"'hash', sha2(concat({cur}[2 * i].hash, y.hash), 256)))")


def grow(new_leaves: DataFrame, peaks: DataFrame | None = None) -> DataFrame:
    """All nodes (tenant_id, level, idx, hash) that ``new_leaves`` complete, themselves included, given the ``peaks`` before."""
    spark = new_leaves.sparkSession
    if peaks is None:
        peaks = spark.createDataFrame([], NODE_SCHEMA)
    top = new_leaves.agg(F.max("idx")).first()[0]
    out = fresh = new_leaves.select("tenant_id", F.lit(0).alias("level"), "idx", "hash")
    base = 0
    while top is not None and (top + 1) >> base > 1:
        held = peaks.where(F.col("level").between(base, base + SPAN_BITS - 1))
        k = (F.col("level") - base).alias("k")
        rows = (fresh.select("tenant_id", k, "idx", "hash", F.lit(True).alias("new"))
                .unionByName(held.select("tenant_id", k, "idx", "hash", F.lit(False).alias("new"))))
        made = _merged(rows).select("tenant_id", (F.col("k") + base).alias("level"), "idx", "hash")
        out = out.unionByName(made)
        base += SPAN_BITS
        fresh = made.where(F.col("level") == base)
    return out


def peaks_of(nodes: DataFrame) -> DataFrame:
    """The peaks among ``nodes``: all nodes of a tree, or the peaks before together with what ``grow`` added."""
    # The leaves of the tree end with the last node of any level.
    n = nodes.groupBy("tenant_id").agg(F.max(F.expr("shiftleft(idx + 1, level)")).alias("n"))
    at = F.expr("shiftright(n, level)")
    return nodes.join(n, "tenant_id").where((at % 2 == 1) & (F.col("idx") == at - 1)).select("tenant_id", "level", "idx", "hash")


def roots(peaks: DataFrame) -> DataFrame:
    """One hash per tenant over its peaks (62 at most), the smallest first: ``tenant_id, leaves, root``."""
    g = peaks.groupBy("tenant_id").agg(F.sum(F.expr("shiftleft(1L, level)")).alias("leaves"), F.array_sort(F.collect_list(F.struct("level", "hash"))).alias("p"))
    root = F.expr("aggregate(slice(p, 2, size(p)), p[0].hash, (acc, x) -> sha2(concat(x.hash, acc), 256))")
    return g.select("tenant_id", "leaves", root.alias("root"))


def proofs(asked: DataFrame, nodes: DataFrame, peaks: DataFrame) -> DataFrame:
    """For each asked leaf (tenant_id, idx): ``path``, its siblings (level, right, hash) up to its peak, and ``peak``, that peak's hash.
    A leaf that the tree does not hold has neither."""
    a = asked.select("tenant_id", "idx").distinct().join(size_of(peaks), "tenant_id", "left")
    steps = (a.select("tenant_id", "idx", "n", F.explode(F.expr(f"sequence(0, {LEVELS})")).alias("level"))
             .where(F.expr("shiftright(idx, level) | 1") < F.expr("shiftright(n, level)"))
             .select("tenant_id", "idx", "level", F.expr("shiftright(idx, level) ^ 1").alias("at")))
    side = nodes.select("tenant_id", "level", F.col("idx").alias("at"), "hash")
    path = (steps.join(side, ["tenant_id", "level", "at"], "left").groupBy("tenant_id", "idx")
            .agg(F.array_sort(F.collect_list(F.struct("level", (F.col("at") % 2 == 1).alias("right"), "hash"))).alias("path")))
    tops = peaks.select("tenant_id", F.col("level").alias("_level"), F.col("idx").alias("_at"), F.col("hash").alias("peak"))
    out = a.join(path, ["tenant_id", "idx"], "left").withColumn("path", F.coalesce("path", F.expr("CAST(array() AS array<struct<level:int,right:boolean,hash:string>>)")))
    return (out.withColumn("_level", F.size("path")).withColumn("_at", F.expr("shiftright(idx, size(path))"))
            .join(tops, ["tenant_id", "_level", "_at"], "left").select("tenant_id", "idx", "path", "peak"))


def carried(leaf: str = "hash", path: str = "path") -> Column:
    """The hash that a leaf and its path lead to; null where a sibling is missing."""
    return F.expr(f"aggregate({path}, {leaf}, (acc, x) -> IF(x.right, sha2(concat(acc, x.hash), 256), sha2(concat(x.hash, acc), 256)))")


def verify_hours(records: DataFrame, asked: DataFrame, nodes: DataFrame, peaks: DataFrame) -> DataFrame:
    """Segments ``asked`` (tenant_id, idx, first_seq, last_seq) proved from ``records``, which need only hold those segments:
    ``records``, ``errors`` (records whose own hash or link does not hold), ``steps`` (siblings read) and ``proven``: the recomputed head leads to the trusted peak."""
    key = ["tenant_id", "idx"]
    r = records.select("tenant_id", "sequence_number", "previous_hash", "record_hash", AU.record_digest().alias("own"))
    spans = asked.select("tenant_id", "idx", "first_seq", "last_seq", F.explode(F.sequence(F.floor(F.col("first_seq") / AU._SPAN), F.floor(F.col("last_seq") / AU._SPAN))).alias("_b"))
    inside = (r.withColumn("_b", F.floor(F.col("sequence_number") / AU._SPAN)).join(spans, ["tenant_id", "_b"])
              .where(F.col("sequence_number").between(F.col("first_seq"), F.col("last_seq"))))
    before = inside.select(*key, (F.col("sequence_number") + 1).alias("sequence_number"), F.col("own").alias("_prev")).distinct()
    linked = inside.join(before, [*key, "sequence_number"], "left")
    wrong = (F.col("own") != F.col("record_hash")) | ((F.col("sequence_number") > F.col("first_seq")) & ~F.col("previous_hash").eqNullSafe(F.col("_prev")))
    found = linked.groupBy(*key).agg(F.count(F.lit(1)).alias("records"), F.count_if(wrong).alias("errors"),
                                     F.max(F.when(F.col("sequence_number") == F.col("last_seq"), F.col("own"))).alias("head"))
    j = asked.select(*key, "first_seq", "last_seq").join(found, key, "left").join(proofs(asked, nodes, peaks), key, "left")
    j = j.withColumn("hash", leaf_hash(F.col("tenant_id"), F.col("first_seq"), F.col("last_seq"), F.col("head")))
    proven = F.coalesce((F.col("errors") == 0) & (F.col("records") == F.col("last_seq") - F.col("first_seq") + 1) & (carried() == F.col("peak")), F.lit(False))
    return j.select(*key, "first_seq", "last_seq", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("errors", F.lit(0)).alias("errors"),
                    F.size("path").alias("steps"), proven.alias("proven"))


def not_extended(old_peaks: DataFrame, nodes: DataFrame) -> DataFrame:
    """The old peaks that are no nodes of the later tree: history was rewritten. One row looked up per old peak."""
    key = ["tenant_id", "level", "idx"]
    now = nodes.select(*key, F.col("hash").alias("now"))
    return old_peaks.join(now, key, "left").where(~F.col("hash").eqNullSafe(F.col("now"))).select(*key, "hash", "now")
