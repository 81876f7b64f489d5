"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewatch.session import apply_runtime_defaults, checkpoint_dir

# Words of every contract: what lies between ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch. Texts may be long, so a batch holds few rows.
ARROW_ROWS = 1000

Columns = dict[str, list]


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: UTC, package on the executors, small Arrow batches."""
    apply_runtime_defaults(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    checkpoint_dir(spark)
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def map_columns(df: DataFrame, fn: Callable[[Iterator[Columns]], Iterator[Columns]], schema: str) -> DataFrame:
    """``mapInArrow`` over plain Python lists: ``fn`` gets an iterator of {column: values} and
    yields the same for ``schema``. Batches stream, so memory is bounded by a batch."""
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(target)

    def run(batches):
        def columns():
            for b in batches:
                if b.num_rows:
                    yield {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        for out in fn(columns()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes: ``bytes.split`` splits at exactly the contract's
    white space (space, tab, \\n, \\v, \\f, \\r)."""
    return text.encode("utf-8").split() if text else []


def partitions(spark: SparkSession) -> int:
    """Partitions of a keyed shuffle, as the session sets them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpointed(df: DataFrame) -> DataFrame:
    """``checkpoint()``, after which what only the steps before it needed is let go: Spark's cleaner removes shuffles and (with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``) checkpoints once the driver's JVM has collected their handles, which it
    would else do only when its own memory is short, however full the disks are."""
    out = df.checkpoint()
    release(df.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Have the driver's JVM collect what nothing refers to, so that Spark's cleaner removes its files."""
    gc.collect()  # Python's handles of JVM objects
    spark._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder for a written table."""
    return os.path.join(checkpoint_dir(spark), f"{re.sub(r'[^a-z0-9]+', '-', name)}-{uuid.uuid4().hex}")
