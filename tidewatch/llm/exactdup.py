"""Exact deduplication by a persistent index of digests, in DataFrame functions alone.

Texts are equal when they are identical without ASCII white space; a text stands for its group by the SHA-256 of what is left.
The index is a Parquet table of one entry per digest (digest, keep_id, chars, delivery), bucketed and sorted by digest,
that outlives the session. A delivery of new documents is

1. reduced to its best row per digest (partial aggregates, so a digest that a third of all rows share costs one row a task),
2. freed of the digests that are known by a sort-merge anti-join with the index, whose buckets are read in place: only the
   small aggregate is shuffled, by the same hash,
3. appended: each task writes its own bucket. An entry once written is never changed.

So whoever comes first stays. Within a delivery the row with the most code points in its original text stays, then the smallest id
(null last). ``exact_duplicates`` wants that order over a whole table, and so delivers it in ``deliveries`` parts by falling length
(cut at approximate quantiles; where exactly they are cut does not matter, as rows of one length are in one part): a text finds every longer
form of itself in the index. Texts are read and digested once; all else works on written rows of about 50 bytes.

Every row then looks its entry up. Rows of one digest are not sent to one task: a digest held by more than one row in ``HOT`` is
joined by broadcast (there are fewer than ``HOT`` of those, whatever the size), all others by sort-merge.

A delivery written again after a failure finds its own entries (they carry its name) and gives the same result. Each delivery adds
one file a bucket at most; ``buckets`` is fixed when an index is made and is kept beside it.

Cases: null text is empty, and all texts without a word are equal to it; of repeated rows (same id and text) one stays; a null id
is the largest; very long texts are digested in the JVM row by row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import partitions, prepare, scratch

WHITE_SPACE = " \t\n\x0b\f\r"
#: One row in so many makes a digest hot.
HOT = 1000
ENTRY = "digest BINARY, keep_id BIGINT, chars BIGINT, delivery STRING"


def spaceless(text: Column) -> Column:
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digested(docs: DataFrame) -> DataFrame:
    """``digest, doc_id, chars, copies``: each row's digest and length; repeated rows are counted in one."""
    text = F.coalesce("text", F.lit(""))
    return (docs.select(F.unhex(F.sha2(spaceless(text), 256)).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.length(text).cast("long").alias("chars"))
            .groupBy("digest", "doc_id", "chars").agg(F.count("*").alias("copies")))


@dataclass(frozen=True)
class DigestIndex:
    """A bucketed table of digests at ``path``."""

    spark: SparkSession
    path: str
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int | None = None) -> DigestIndex:
        """The index at a path, made where there is none. ``buckets`` (the session's shuffle partitions by default) count for a new one only."""
        layout = os.path.join(path, "layout")
        try:
            buckets = spark.read.parquet(layout).first()["buckets"]
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            buckets = buckets or partitions(spark)
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(layout)
        index = cls(spark, path, buckets)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {index.table} ({ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                  f"INTO {buckets} BUCKETS LOCATION '{os.path.join(path, 'entries')}'")
        spark.catalog.refreshTable(index.table)
        return index

    @property
    def table(self) -> str:
        return "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, rows: DataFrame, delivery: str) -> None:
        """Add the digests of ``digested`` rows that the index does not know."""
        best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id"))
        fresh = (rows.groupBy("digest").agg(best.alias("best"))
                 .join(self.entries().select("digest").hint("merge"), "digest", "left_anti"))
        (fresh.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("chars"), F.lit(delivery).alias("delivery"))
         .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))

    def decide(self, rows: DataFrame, delivery: str | None = None) -> DataFrame:
        """``doc_id, keep_id, group_size, kept, digest`` of each document of ``digested`` rows that were appended; a written table is expected.

        ``group_size`` counts the documents of ``rows``. Given a ``delivery``, only rows that came in with it can stay."""
        found = F.lit(True) if delivery is None else F.col("delivery") == delivery
        groups = scratch(self.spark, "groups")
        (rows.groupBy("digest").agg(F.sum("copies").alias("group_size"))
         .join(self.entries().hint("merge"), "digest")
         .select("digest", "keep_id", F.col("chars").alias("keep_chars"), found.alias("found"), "group_size").write.parquet(groups))
        groups = self.spark.read.parquet(groups)
        total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
        hot = F.col("group_size") * HOT > total
        few = F.broadcast(groups.filter(hot))  # fewer than HOT rows
        placed = (rows.join(few, "digest")
                  .unionByName(rows.join(few.select("digest"), "digest", "left_anti").join(groups.filter(~hot).hint("merge"), "digest")))
        first = (F.col("copy") == 1) & F.col("found") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
        return (placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
                .select("doc_id", "keep_id", "group_size", first.alias("kept"), "digest"))


def written(docs: DataFrame) -> DataFrame:
    """``digested`` rows as a table in the shared folder."""
    spark = prepare(docs.sparkSession)
    path = scratch(spark, "digests")
    digested(docs).write.parquet(path)
    return spark.read.parquet(path)


def deliver(index: DigestIndex, docs: DataFrame, delivery: str) -> DataFrame:
    """Add a delivery of documents to an index: each row with ``kept`` false where an equal text came in before it."""
    rows = written(docs)
    index.append(rows, delivery)
    return index.decide(rows, delivery)


def exact_duplicates(docs: DataFrame, path: str | None = None, deliveries: int = 4) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of each document, by an index of the whole table (at ``path``, which must be new;
    in the shared folder by default)."""
    spark = prepare(docs.sparkSession)
    index = DigestIndex.open(spark, path or scratch(spark, "digest index"))
    rows = written(docs)
    cuts = rows.agg(F.percentile_approx("chars", [i / deliveries for i in range(1, deliveries)])).first()[0] if deliveries > 1 else None
    upto = None
    for at in [*sorted(set(cuts or []), reverse=True), None]:  # the longest texts first
        part = rows if upto is None else rows.filter(F.col("chars") <= upto)
        index.append(part if at is None else part.filter(F.col("chars") > at), "all" if at is None else f"over {at}")
        upto = at
    return index.decide(rows).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT doc_id, text_sha256, count(*) OVER g AS group_size,
         first_value(doc_id) OVER o AS keep_id, row_number() OVER o AS place
  FROM t
  WINDOW g AS (PARTITION BY text_sha256),
         o AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM ranked"""
