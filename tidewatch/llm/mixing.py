"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells (source, language, topic). A cell starts with its tokens; each round scales the
cells so that the sums over each dimension in turn match that dimension's target shares, until the
largest change is below ``tolerance`` or ``rounds`` are done. A cell's weight is its raked tokens over its tokens. With
``share`` of all tokens as the goal, the factor that turns weights into sampling probabilities
(``min(1, factor x weight)``) is calibrated so that the expected tokens meet the goal, also where cells reach 1. A document is drawn when a hash
of (seed, doc_id, text hash) mapped to [0, 1) is below its cell's probability; the hash makes the draw repeatable.

Target shares are smoothed: the share of a value to the power ``alpha``, set to sum 1 (1 keeps a
dimension as it is, 0 makes its values equal). Other targets can be given as a table.

Scale: tokens are counted per row, cells are summed with map-side partial sums, so a source with a third of
all rows costs one row a task. The table of cells is raked on the driver when it has at most ``MAX_CELLS`` rows (counted
first), and its probabilities are broadcast; beyond that both are Spark jobs of the same arithmetic, and Spark splits the skewed
keys of the join by cell. Text is read twice, never shuffled.

Cases: null text has no tokens (probability of its cell; it adds nothing to sums); null source, language or
topic is a value of its own, ``(null)``; a cell without tokens has weight 1; a null id is drawn by its text; equal rows are
drawn alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD_RE, prepare

DIMS = ("source", "lang", "topic")
ALPHA = {"source": 0.5, "lang": 0.7, "topic": 1.0}
ROUNDS, TOLERANCE, SHARE, SEED = 24, 1e-12, 0.6, "mix"
#: Cells that are raked on the driver (some 20 MB); beyond that Spark jobs do it.
MAX_CELLS = 200_000
#: Halvings that find the factor between weights and probabilities; more where a weight is so small that the factor's
#: relative error would still be over ``EXACT``. Both ways of raking stop by the same rule.
HALVINGS, EXACT = 60, 1e-15


def topic(text: Column) -> Column:
    """A coarse topic of a text by its form, the first that holds: table, markup, dialogue, prose."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(t.contains(" | "), "table").when(t.rlike(r"[#$%&*]{3}"), "markup")
            .when(t.contains("!") | t.contains("?"), "dialogue").otherwise("prose"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the cell, tokens (words) and the uniform number of each document."""
    t = F.coalesce("text", F.lit(""))
    code = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.md5(t.cast("binary")))).cast("binary"))
    return docs.select(
        "doc_id", F.coalesce("source", F.lit("(null)")).alias("source"), F.coalesce("lang", F.lit("(null)")).alias("lang"),
        F.coalesce(topic(F.col("text")), F.lit("(null)")).alias("topic"),
        F.regexp_count(t, F.lit(WORD_RE)).cast("long").alias("tokens"),
        (F.conv(F.substring(code, 1, 12), 16, 10).cast("long") / F.lit(float(2**48))).alias("draw"))


def targets(cells: DataFrame, dim: str, alpha: float) -> DataFrame:
    """``dim`` and its target share of the tokens."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("n")).where("n > 0")
    powered = sums.select(dim, F.pow(F.col("n").cast("double"), F.lit(alpha)).alias("p"))
    total = powered.agg(F.sum("p").alias("total"))
    return powered.crossJoin(F.broadcast(total)).select(dim, (F.col("p") / F.col("total")).alias("target"))


def _wide(low: float, high: float, done: int, goal: float) -> bool:
    """Whether the span of the factor is still to be narrowed after ``done`` halvings."""
    return done < HALVINGS or (goal > 0 and high - low > EXACT * high)


def _rake_local(rows: list, alpha: dict[str, float], rounds: int, share: float) -> list[tuple]:
    if not rows:
        return []
    tokens = np.array([r["tokens"] for r in rows], dtype=float)
    raked, total = tokens.copy(), tokens.sum()
    codes, wanted = {}, {}
    for d in DIMS:
        _, codes[d] = np.unique([r[d] for r in rows], return_inverse=True)
        n = np.bincount(codes[d], tokens)
        p = np.where(n > 0, np.power(np.maximum(n, 1), alpha[d]), 0.0)
        wanted[d] = total * p / max(p.sum(), 1e-300)
    for _ in range(rounds):
        old = raked.copy()
        for d in DIMS:
            now = np.bincount(codes[d], raked)
            raked *= np.divide(wanted[d], now, out=np.ones_like(now), where=now > 0)[codes[d]]
        if np.abs(raked - old).max(initial=0) <= TOLERANCE * total:
            break
    weight = np.divide(raked, tokens, out=np.ones_like(raked), where=tokens > 0)
    low, high = 0.0, 1 / max(weight[tokens > 0].min(initial=1.0), 1e-300)
    done = 0
    while _wide(low, high, done, share * total):
        done += 1
        mid = (low + high) / 2
        low, high = (mid, high) if (tokens * np.minimum(1, mid * weight)).sum() < share * total else (low, mid)
    p = np.minimum(1, high * weight)
    return [(*(r[d] for d in DIMS), float(w), float(q)) for r, w, q in zip(rows, weight, p)]


def _rake_spark(cells: DataFrame, alpha: dict[str, float], rounds: int, share: float) -> DataFrame:
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    aims = {d: targets(cells, d, alpha[d]).withColumn("target", F.col("target") * F.lit(float(total))).checkpoint() for d in DIMS}
    raked = cells.withColumn("raked", F.col("tokens").cast("double"))
    for _ in range(rounds):
        before = raked
        for d in DIMS:
            sums = raked.groupBy(d).agg(F.sum("raked").alias("now")).join(aims[d], d, "left")
            raked = raked.join(sums, d).withColumn(
                "raked", F.when(F.col("now") > 0, F.col("raked") * F.coalesce("target", F.lit(0.0)) / F.col("now"))
                .otherwise(F.col("raked"))).drop("now", "target")
        raked = raked.checkpoint()
        moved = raked.alias("a").join(before.alias("b"), list(DIMS)).agg(F.max(F.abs(F.col("a.raked") - F.col("b.raked")))).first()[0]
        if (moved or 0) <= TOLERANCE * total:
            break
    weighed = raked.withColumn("weight", F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(F.lit(1.0)))
    least = weighed.where("tokens > 0").agg(F.min("weight")).first()[0]
    low, high = 0.0, 1 / max(1.0 if least is None else least, 1e-300)
    done = 0
    while _wide(low, high, done, share * total):
        done += 5  # 32 factors a pass narrow the span as far as 5 halvings
        tries = np.linspace(low, high, 33)[1:]
        got = weighed.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(float(x)) * F.col("weight"))).alias(f"f{i}")
                            for i, x in enumerate(tries)]).first()
        k = next((i for i in range(32) if (got[i] or 0) >= share * total), 31)
        low, high = (float(tries[k - 1]) if k else low), float(tries[k])
    return weighed.select(*DIMS, "weight", F.least(F.lit(1.0), F.lit(high) * F.col("weight")).alias("probability"))


def rake(cells: DataFrame, alpha: dict[str, float] | None = None, rounds: int = ROUNDS, share: float = SHARE,
         max_cells: int = MAX_CELLS) -> DataFrame:
    """Weight and probability of each cell of (source, lang, topic, tokens)."""
    spark, alpha = cells.sparkSession, alpha or ALPHA
    if cells.count() > max_cells:
        return _rake_spark(cells, alpha, rounds, share)
    rows = cells.orderBy(*DIMS).collect()
    # At most max_cells rows.
    return F.broadcast(spark.createDataFrame(_rake_local(rows, alpha, rounds, share), "source string, lang string, topic string, "
                                             "weight double, probability double"))


def mix(docs: DataFrame, share: float = SHARE, alpha: dict[str, float] | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """A row for each document: its cell, tokens, weight, probability and whether it is drawn."""
    prepare(docs.sparkSession)
    k = keyed(docs)
    cells = k.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")).checkpoint()
    done = rake(cells, alpha, share=share, max_cells=max_cells)
    return (k.join(done, list(DIMS))
            .select("doc_id", *DIMS, "tokens", "weight", "probability", (F.col("draw") < F.col("probability")).alias("drawn")))


def drawn_documents(docs: DataFrame, columns: Sequence[str], share: float = SHARE) -> DataFrame:
    """The drawn documents themselves, with ``columns``: the draw is decided on the row, nothing is joined by id."""
    prepare(docs.sparkSession)
    cells = keyed(docs).groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")).checkpoint()
    done = rake(cells, share=share).select(*[F.col(d).alias(f"_{d}") for d in DIMS], "probability")
    t = keyed_columns(docs)
    same = reduce(lambda a, b: a & b, [F.col(f"_k.{d}") == F.col(f"_{d}") for d in DIMS])
    return t.join(done, same).where(F.col("_k.draw") < F.col("probability")).select(*columns)


def keyed_columns(docs: DataFrame) -> DataFrame:
    """``docs`` with the cell and draw in one struct column ``_k`` (no clash with other columns)."""
    t = F.coalesce("text", F.lit(""))
    code = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.md5(t.cast("binary")))).cast("binary"))
    return docs.withColumn("_k", F.struct(
        F.coalesce("source", F.lit("(null)")).alias("source"), F.coalesce("lang", F.lit("(null)")).alias("lang"),
        topic(F.col("text")).alias("topic"),
        (F.conv(F.substring(code, 1, 12), 16, 10).cast("long") / F.lit(float(2**48))).alias("draw")))


def mix_sql(share: float = SHARE, rounds: int = ROUNDS) -> str:
    """The same rows in DuckDB, the rounds and halvings unrolled."""
    dims = ", ".join(DIMS)
    q = [f"""k AS MATERIALIZED (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang,
  CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN regexp_matches(coalesce(text, ''), '[#$%&*]{{3}}') THEN 'markup'
       WHEN contains(coalesce(text, ''), '!') OR contains(coalesce(text, ''), '?') THEN 'dialogue' ELSE 'prose' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
  FROM documents)""",
         f"r0 AS MATERIALIZED (SELECT {dims}, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE AS raked FROM k GROUP BY {dims})",
         "total AS MATERIALIZED (SELECT sum(tokens)::DOUBLE AS total FROM r0)"]
    for d in DIMS:
        q.append(f"t_{d} AS MATERIALIZED (SELECT {d}, pow(n, {ALPHA[d]}::DOUBLE) / sum(pow(n, {ALPHA[d]}::DOUBLE)) OVER () * (SELECT total FROM total) AS target "
                 f"FROM (SELECT {d}, sum(tokens)::DOUBLE AS n FROM r0 GROUP BY {d}) WHERE n > 0)")
    at = 0
    for _ in range(rounds):
        for d in DIMS:
            q.append(f"r{at + 1} AS MATERIALIZED (SELECT {dims}, tokens, CASE WHEN now > 0 THEN raked * coalesce(target, 0) / now ELSE raked END AS raked "
                     f"FROM (SELECT *, sum(raked) OVER (PARTITION BY {d}) AS now FROM r{at}) LEFT JOIN t_{d} USING ({d}))")
            at += 1
    q.append(f"w AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN raked / tokens ELSE 1.0 END AS weight FROM r{at})")
    q.append("h0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS lo, 1 / coalesce(min(weight), 1.0) AS hi FROM w WHERE tokens > 0)")
    for i in range(HALVINGS):
        q.append(f"h{i + 1} AS MATERIALIZED (SELECT CASE WHEN under THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN under THEN hi ELSE (lo + hi) / 2 END AS hi "
                 f"FROM (SELECT lo, hi, (SELECT sum(tokens * least(1.0, (lo + hi) / 2 * weight)) FROM w) < {share} * (SELECT total FROM total) AS under FROM h{i}))")
    return f"""WITH {', '.join(q)}
SELECT doc_id, {', '.join('k.' + d for d in DIMS)}, k.tokens, round(weight, 6) AS weight, round(least(1.0, hi * weight), 6) AS probability,
  draw < least(1.0, hi * weight) AS drawn FROM k JOIN w USING ({dims}), h{HALVINGS}"""
