"""Registry of named queries over the driver's tables and their DuckDB oracles.

``register(name, sql)`` attaches a Spark builder ``(spark, sf_dir) -> DataFrame``
and, when the operator is SQL-expressible, the equivalent DuckDB SQL. Results
are normalised at the edge only: doubles rounded to 6 places and integral
types widened to BIGINT, identically in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Edge normalisation shared with the oracle SQL (ROUND(x, 6), BIGINT)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), places)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)
