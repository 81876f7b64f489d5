"""Table writes: keyed upsert, append-only audit writes, evidence objects, bulk export and
embedding metadata enforcement (S-12, S-13, S-15, S-19, S-22, S-23).

Plain Parquet has no MERGE, so an upsert is computed as a DataFrame (latest incoming row per
key, full outer join with the current table) and written as a NEW version directory; readers
switch to it only after the write has finished, so a failed job leaves the old version intact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column], *,
           keep_from_existing: Sequence[str] = ("created_at",)) -> DataFrame:
    """S-12/S-13: insert new keys, replace existing ones with the latest incoming row (by
    ``order``), except the columns in ``keep_from_existing`` (e.g. created_at) which stay.
    In-batch duplicates collapse to one row per key first."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    inc = incoming.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    o, n = existing.alias("o"), inc.alias("n")
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    j = o.join(n, cond, "full_outer")
    has_new = F.col(f"n.{keys[0]}").isNotNull()
    has_old = F.col(f"o.{keys[0]}").isNotNull()
    cols = []
    for c in existing.columns:
        if c in keys:
            cols.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif c in keep_from_existing:
            cols.append(F.when(has_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            cols.append(F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return j.select(*cols)


def write_version(df: DataFrame, table_path: str, version: str) -> str:
    """Write a new version directory of a table and return its path (readers switch after success)."""
    path = f"{table_path}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def append_only(df: DataFrame, path: str, partition_cols: Sequence[str] = ()) -> None:
    """S-15: audit rows are only ever appended (no overwrite mode is offered for this table)."""
    w = df.write.mode("append")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(path)


def evidence_objects(records: DataFrame, ts_col: str = "timestamp", content_col: str = "content") -> DataFrame:
    """S-19: evidence rows keyed tenant/yyyy/mm/dd with a SHA-256 of the content."""
    return records.withColumn("yyyy", F.substring(ts_col, 1, 4)).withColumn("mm", F.substring(ts_col, 6, 2)) \
        .withColumn("dd", F.substring(ts_col, 9, 2)).withColumn("content_sha256", F.sha2(F.col(content_col), 256))


def store_evidence(evidence: DataFrame, path: str) -> None:
    """S-19: written partitioned by tenant and date (object-store layout tenant/yyyy/mm/dd)."""
    evidence.write.mode("append").partitionBy("tenant_id", "yyyy", "mm", "dd").parquet(path)


def verify_evidence(stored: DataFrame, content_col: str = "content") -> DataFrame:
    """S-19: objects whose recomputed hash no longer matches the stored one."""
    return stored.where(F.sha2(F.col(content_col), 256) != F.col("content_sha256"))


def export_tenant(records: DataFrame, tenant: str, path: str, fmt: str = "parquet") -> None:
    """S-22: bulk export of one tenant's records in the requested format."""
    records.where(F.col("tenant_id") == tenant).write.mode("overwrite").format(fmt).save(path)


EMBEDDING_METADATA = ("embedding_model_id", "embedding_dimensions", "embedding_version")


def enforce_embedding_metadata(points: DataFrame, defaults: dict, enforce: bool = True) -> tuple[DataFrame, DataFrame]:
    """S-23: fill missing metadata from ``defaults``; with ``enforce`` rows still lacking any of the
    three required keys are rejected. Returns (accepted, rejected)."""
    d = points
    for k in EMBEDDING_METADATA:
        if k not in d.columns:
            d = d.withColumn(k, F.lit(None).cast("string"))
        if k in defaults:
            d = d.withColumn(k, F.coalesce(F.col(k).cast("string"), F.lit(str(defaults[k]))))
    ok = F.lit(True)
    for k in EMBEDDING_METADATA:
        ok = ok & F.col(k).isNotNull()
    if not enforce:
        return d, d.where(F.lit(False))
    return d.where(ok), d.where(~ok).withColumn("error", F.lit("missing embedding metadata"))
