"""Phrases whose words keep together, counted in a word suffix tree that is built in groups, after ERA.

The tree of all word suffixes within pieces, cut at ``max_words``, is never held whole. It is partitioned vertically: suffixes go by
the words they begin with into groups that a memory budget bounds, and each group's subtree is built on its own.

1. A first scan counts the words of each language (tree depth 1). Words are 64-bit hashes of (language, word) from there on; the table
   of words shows whether two words share a hash, in which case the scan starts over with another seed, so counts are exact.
2. ``plan``: prefixes are gathered in ``BUCKETS`` buckets by hash, with their exact counts, and consecutive buckets fill a group up to the
   budget. A bucket beyond the budget is extended: its suffixes are dealt by their further words over as many groups as it fills.
   The plan is two arrays of ``BUCKETS`` numbers at any size; so groups grow with the corpus once it holds more than ``BUCKETS`` budgets
   of suffixes, which costs sorting on disk but no memory (below).
3. ``subtrees``: a scan writes the suffixes of each block of text, sorted and with equal ones counted once, to their groups. Spark sorts a
   group; its sorted suffixes are the leaves of its subtree in order, so a node's total is the sum over a run of leaves. They
   are streamed with one open node per depth.
4. Reading is elastic: the tree is built to depth 2 for the words seen ``min_count`` times, and read on to depth ``max_words`` only from
   pairs that reach ``min_count``, since no longer phrase can hold others. Words and pairs worth reading are marked in bitmaps of fixed
   size (``WORD_BITS``, ``PAIR_BITS``); a wrongly marked one costs a row and is counted out at its node.

A cut of a phrase needs the counts of both its parts, which are phrases or words with at least its count, so they are
all in the tables; they are joined in, the few most frequent ones (fewer than ``HOT`` of a length) by broadcast. Products are decimals
of 38 digits. Each language's first rows are found by a ranking with a limit in each task; only these get their words as text.

Cases: null text is empty, null lang is ``und``; a null id, ties and repeated rows make no difference (each row counts); a text longer than a
block is a block of its own, with about 60 bytes a word in memory; a word of any length is a word; extra columns are ignored; an
empty table, or one without a frequent phrase, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import hashing
from tidewatch.llm.common import partitions, prepare, scratch

_U = np.uint64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PIECE_END = np.zeros(256, dtype=bool)
PIECE_END[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
GAP = PIECE_END.copy()
GAP[list(b" \t")] = True
#: Bytes of text whose words are sorted at once, and bytes hashed at once.
BLOCK, SEGMENT = 8 << 20, 1 << 20
BUCKET_BITS, WORD_BITS, PAIR_BITS = 16, 22, 26
BUCKETS = 1 << BUCKET_BITS
#: Suffixes of a group at most (48 bytes each in a sort), and groups a task should have at least.
BUDGET, GROUPS_A_TASK = 1 << 20, 4
HOT = 1000
_STEP = _U(0xD1342543DE82EF95)


@dataclass
class Block:
    """The words of some texts in order: hash, number of the piece, language, place in ``raw``."""

    hashes: np.ndarray
    pieces: np.ndarray
    langs: np.ndarray
    raw: bytes
    starts: np.ndarray
    ends: np.ndarray


def _segments(raw: bytes) -> Iterator[tuple[int, int]]:
    """Parts of about ``SEGMENT`` bytes that end between words."""
    b, at = np.frombuffer(raw, np.uint8), 0
    while at < len(b):
        to = min(len(b), at + SEGMENT)
        while to < len(b) and not GAP[b[to]]:
            ahead = np.flatnonzero(GAP[b[to:to + SEGMENT]])
            to = to + int(ahead[0]) if len(ahead) else min(len(b), to + SEGMENT)
        yield at, to
        at = to


def tokens(raw: bytes, seed: int) -> tuple[np.ndarray, ...]:
    """Hash, piece, start and end of each word of lower-cased bytes. Each seed takes another polynomial."""
    found, piece = [], 0
    code = np.random.RandomState(seed).permutation(256).astype(np.uint8)
    for at, to in _segments(raw):
        b = np.frombuffer(raw, np.uint8, to - at, at)
        ends_piece = PIECE_END[b]
        turn = np.flatnonzero(np.diff(np.concatenate([[True], GAP[b], [True]]).astype(np.int8)))
        s, e = turn[::2], turn[1::2]
        number = np.cumsum(ends_piece, dtype=np.int64)
        # A very long word is hashed alone; only the last one can reach beyond a segment.
        alone = np.flatnonzero(e - s > hashing.LONGEST)
        short = len(s) - int(len(alone) > 0 and alone[-1] == len(s) - 1)
        h = np.zeros(len(s), _U)
        if short:
            h[:short] = hashing.spans(code[b[:e[short - 1]]], s[:short], e[:short])
        for i in alone.tolist():
            h[i] = xxhash.xxh64_intdigest(raw[at + s[i]:at + e[i]], seed=seed)
        found.append((h, number[s] + piece, s + at, e + at))
        piece += int(number[-1])
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, _U), *[np.zeros(0, np.int64)] * 3)


def blocks(batches, seed: int) -> Iterator[tuple[Block, list[str]]]:
    """Texts in blocks of about ``BLOCK`` bytes, and the names of the languages."""
    names: dict[str, int] = {}
    texts, langs, size = [], [], 0

    def block():
        raw = b"\n".join(texts)  # a piece ends between texts
        h, piece, s, e = tokens(raw, seed)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        lang = np.array(langs)[np.searchsorted(starts, s, "right") - 1] if len(s) else np.zeros(0, np.int64)
        base = np.array([xxhash.xxh64_intdigest(n, seed=seed + 1000) for n in names], dtype=_U)
        h = hashing.mix(h ^ base[lang]) if len(s) else h
        h[h == 0] = 1  # 0 stands for no word
        return Block(h, piece, lang, raw, s, e), list(names)

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text:
                texts.append(text.translate(LOWER))
                langs.append(names.setdefault(lang, len(names)))
                size += len(text) + 1
                if size >= BLOCK:
                    yield block()
                    texts, langs, size = [], [], 0
    if texts:
        yield block()


def _batches(columns: dict[str, pa.Array | np.ndarray]) -> Iterator[pa.RecordBatch]:
    table = pa.table({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in columns.items()})
    yield from table.to_batches(max_chunksize=1 << 16)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """``hash, lang, word, n`` of all words."""

    def run(batches):
        for b, names in blocks(batches, seed):
            if not len(b.hashes):
                continue
            u, first, inverse, n = np.unique(b.hashes, return_index=True, return_inverse=True, return_counts=True)
            # Words of one hash within a block: told apart by another hash.
            other = tokens(b.raw, seed + 1)[0]
            odd = np.flatnonzero((other != other[first][inverse]) | (b.langs != b.langs[first][inverse]))
            n = n - np.bincount(inverse[odd], minlength=len(u))
            at, count = np.concatenate([first, odd]), np.concatenate([n, np.ones(len(odd), n.dtype)])
            word = [b.raw[i:j].decode() for i, j in zip(b.starts[at].tolist(), b.ends[at].tolist())]
            yield from _batches({"hash": b.hashes[at].view(np.int64), "lang": pa.array(names).take(pa.array(b.langs[at])),
                                 "word": pa.array(word), "n": count.astype(np.int64)})

    return (_texts(docs).mapInArrow(run, "hash long, lang string, word string, n long")
            .groupBy("hash", "lang", "word").agg(F.sum("n").alias("n")))


def vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """The written table of words, and the seed under which no two of them share a hash."""
    spark, seed = docs.sparkSession, 1
    while True:
        path = scratch(spark, "words")
        word_counts(docs, seed).write.parquet(path)
        words = spark.read.parquet(path)
        if not words.groupBy("hash").count().filter("count > 1").limit(1).count():
            return words, seed
        seed += 2


@dataclass
class Plan:
    """The group of a suffix: ``first`` of its prefix's bucket, plus its own hash modulo ``parts``."""

    first: np.ndarray
    parts: np.ndarray

    def groups(self, prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        b = self.bucket(prefix)
        return (self.first[b] + (suffix % self.parts[b].astype(_U)).astype(np.int32)).astype(np.int32)

    def whole(self, prefix: np.ndarray) -> np.ndarray:
        """Whether all suffixes of a prefix are in one group."""
        return self.parts[self.bucket(prefix)] == 1

    @staticmethod
    def bucket(prefix: np.ndarray) -> np.ndarray:
        return (prefix >> _U(64 - BUCKET_BITS)).astype(np.int64)


def plan(weights: dict[int, int], budget: int) -> Plan:
    """Buckets in order into groups of at most ``budget`` suffixes; a bucket beyond that over several groups of its own."""
    first, parts = np.zeros(BUCKETS, np.int32), np.ones(BUCKETS, np.int32)
    group, filled = 0, 0
    for b in range(BUCKETS):
        w = weights.get(b, 0)
        if filled and filled + w > budget:
            group, filled = group + 1, 0
        first[b] = group
        if w > budget:
            parts[b] = -(-w // budget)
            group += int(parts[b])
        else:
            filled += w
    return Plan(first, parts)


def _spot(node: Column, bits: int) -> Column:
    return F.shiftrightunsigned(node, 64 - bits)


def planned(prefixes: DataFrame) -> Plan:
    """The plan for prefixes (``node``, ``n``); ``BUCKETS`` rows at most come to the driver."""
    t = prefixes.groupBy(_spot(F.col("node"), BUCKET_BITS).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    weights = dict(zip(t["bucket"].to_pylist(), t["n"].to_pylist()))
    share = sum(weights.values()) // (GROUPS_A_TASK * partitions(prefixes.sparkSession)) + 1
    return plan(weights, max(min(BUDGET, share), 16 * sum(weights.values()) // BUCKETS + 1))


def bitmap(prefixes: DataFrame, bits: int) -> np.ndarray:
    """2^bits marks, set for each ``node``."""
    spot = _spot(F.col("node"), bits)
    t = (prefixes.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("at"))
         .agg(F.bit_or(F.expr("shiftleft(1L, CAST(spot & 63L AS INT))")).alias("set")).toArrow())
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[t["at"].to_numpy()] = t["set"].to_numpy()
    return out


def marked(bits: np.ndarray, node: np.ndarray) -> np.ndarray:
    spot = node >> _U(64 - (len(bits).bit_length() + 5))
    return (bits[(spot >> _U(6)).astype(np.int64)].view(_U) >> (spot & _U(63)) & _U(1)).astype(bool)


def step(node: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    return hashing.mix(node * _STEP + word)


def suffixes(b: Block, depth: int, words: np.ndarray | None, pairs: np.ndarray | None) -> np.ndarray:
    """The words of each suffix worth reading, ``depth`` rows, 0 beyond its end: pairs of marked words for depth 2, else all runs of
    marked pairs of three words or more."""
    h, piece = b.hashes, b.pieces
    if len(h) < 2:
        return np.zeros((depth, 0), _U)
    live = piece[1:] == piece[:-1]
    if pairs is None:
        good = marked(words, h)
        at = np.flatnonzero(live & good[1:] & good[:-1])
        return np.stack([h[at], h[at + 1]])
    at = np.flatnonzero(live)
    live[at] = marked(pairs, step(h[at], h[at + 1]))
    live = np.concatenate([live, np.zeros(depth, bool)])
    at = np.flatnonzero(live[:len(h) - 1] & live[1:len(h)])
    out = np.zeros((depth, len(at)), _U)
    out[0], out[1], out[2] = h[at], h[at + 1], h[at + 2]
    on = np.arange(len(at))
    for d in range(3, depth):
        on = on[live[at[on] + d - 1]]
        out[d, on] = h[at[on] + d]
    return out


def subtrees(docs: DataFrame, seed: int, depth: int, min_count: int, prefixes: DataFrame, words: np.ndarray | None, pairs: np.ndarray | None) -> DataFrame:
    """``words array<long>, node, n`` of the tree's nodes at depths 2 (for depth 2) or 3 to ``depth`` with ``min_count`` leaves, of groups by
    the first words (one for depth 2, else two) that ``prefixes`` counts. A prefix dealt over several groups gives each its part of a
    node above the leaves, whatever it counts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((planned(prefixes), words, pairs))
    names = [f"w{d}" for d in range(1, depth + 1)]

    def leaves(batches):
        groups, words, pairs = shared.value
        for b, _ in blocks(batches, seed):
            w = suffixes(b, depth, words, pairs)
            if not w.shape[1]:
                continue
            w = w[:, np.lexsort(w[::-1])]
            new = np.concatenate([[True], (w[:, 1:] != w[:, :-1]).any(axis=0)])
            start = np.flatnonzero(new)
            w, n = w[:, start], np.diff(np.append(start, w.shape[1]))
            prefix = w[0] if depth == 2 else step(w[0], w[1])
            leaf = prefix
            for row in w[1 if depth == 2 else 2:]:
                leaf = step(leaf, row)
            yield from _batches({"grp": groups.groups(prefix, leaf), **{c: w[i].view(np.int64) for i, c in enumerate(names)}, "n": n.astype(np.int64)})

    def totals(batches):
        groups = shared.value[0]
        lowest, held = (2 if depth == 2 else 3), {}

        def nodes(d, key, n):
            """Nodes of depth ``d``: their words and totals."""
            w = key[1:].view(_U)
            node = w[0]
            for row in w[1:]:
                node = step(node, row)
            prefix = w[0] if depth == 2 else step(w[0], w[1])
            whole = groups.whole(prefix) if d < depth else np.ones(len(n), bool)
            ok = (w[d - 1] != 0) & (~whole | (n >= min_count))
            columns = {c: (key[i + 1] if i < d else np.zeros(len(n), np.int64))[ok] for i, c in enumerate(names)}
            return _batches({"depth": np.full(int(ok.sum()), d, np.int32), **columns, "node": node.view(np.int64)[ok], "n": n[ok]})

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(depth + 1)])
            count = np.asarray(b.column(depth + 1))
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for i in range(lowest + 1):
                new[1:] |= rows[i, 1:] != rows[i, :-1]
            for d in range(lowest, depth + 1):
                if d > lowest:
                    new[1:] |= rows[d, 1:] != rows[d, :-1]
                start = np.flatnonzero(new)
                key, n = rows[:d + 1, start], np.add.reduceat(count, start)
                if d in held:
                    before, total = held[d]
                    if (before[:, 0] == key[:, 0]).all():
                        n[0] += total[0]
                    else:
                        yield from nodes(d, before, total)
                held[d] = key[:, -1:], n[-1:]  # may go on in the next batch
                yield from nodes(d, key[:, :-1], n[:-1])
        for d, (key, n) in held.items():
            yield from nodes(d, key, n)

    columns = ", ".join(f"{c} long" for c in names)
    found = (_texts(docs).mapInArrow(leaves, f"grp int, {columns}, n long")
             .repartition(partitions(spark), "grp").sortWithinPartitions("grp", *names)
             .mapInArrow(totals, f"depth int, {columns}, node long, n long"))
    return found.select(F.slice(F.array(*names), 1, F.col("depth")).alias("words"), "node", "n")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def frequent_phrases(docs: DataFrame, min_count: int = 30, max_words: int = 4) -> tuple[DataFrame, DataFrame]:
    """The written table of words (``hash, lang, word, n``), and that of the phrases (``words, n``) of 2 to ``max_words`` words that occur ``min_count`` times."""
    prepare(docs.sparkSession)
    words, seed = vocabulary(docs)
    often = words.filter(F.col("n") >= min_count).select(F.col("hash").alias("node"), "n")
    pairs = _written(subtrees(docs, seed, 2, min_count, often, bitmap(often, WORD_BITS), None), "pairs")
    if max_words == 2:
        return words, pairs.select("words", "n")
    # A node of a dealt prefix comes in parts.
    deeper = subtrees(docs, seed, max_words, min_count, pairs, None, bitmap(pairs, PAIR_BITS))
    deeper = deeper.groupBy("words").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    return words, _written(pairs.select("words", "n").unionByName(deeper), "phrases")


def _with_count(df: DataFrame, key: str, counts: DataFrame, hot: DataFrame, name: str) -> DataFrame:
    """The count of the phrase ``key`` as ``name`` (and its lang, for a single word); rows of the most frequent ones are not brought together."""
    rest = df.join(F.broadcast(hot.select(F.col("words").alias(key))), key, "left_anti")

    def found(rows, table):
        return rows.join(table.select(F.col("words").alias(key), F.col("n").alias(name), F.col("lang").alias(f"{name}_lang")), key)
    return found(df, F.broadcast(hot)).unionByName(found(rest, counts))


def _dec(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, min_count: int = 30, max_words: int = 4, keep: int = 2000, overlap_percent: int = 80) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``keep`` phrases by score."""
    words, phrases = frequent_phrases(docs, min_count, max_words)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    longer = (phrases.filter(F.size("words") > 2)
              .select(F.explode(F.expr("flatten(transform(sequence(2, size(words) - 1), k -> "
                                       "transform(sequence(1, size(words) - k + 1), i -> slice(words, i, k))))")).alias("words"), F.col("n").alias("by"))
              .groupBy("words").agg(F.max("by").alias("by")))
    stay = (phrases.join(longer, "words", "left")
            .filter(F.col("by").isNull() | (_dec("by") * 100 < _dec("n") * overlap_percent)).select("words", F.col("n").alias("a")))
    counts = (words.filter(F.col("n") >= min_count).select(F.array("hash").alias("words"), "n", "lang")
              .unionByName(phrases.withColumn("lang", F.lit(None).cast("string"))))
    all_words = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT > all_words  # fewer than HOT phrases of each length
    hot, counts = counts.filter(hot), counts.filter(~hot)
    cuts = (stay.withColumn("k", F.explode(F.expr("sequence(1, size(words) - 1)")))
            .select("words", "a", "k", F.expr("slice(words, 1, k)").alias("head"), F.expr("slice(words, k + 1, size(words) - k)").alias("tail")))
    cuts = _with_count(_with_count(cuts, "head", counts, hot, "l"), "tail", counts, hot, "r")
    score = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    scored = (cuts.withColumn("score", score).groupBy("words", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.max("l_lang").alias("lang"))
              .select("words", "a", "lang", "cut.score", "cut.l", "cut.r"))
    order = [F.col("score").desc(), F.col("a").desc()]
    first = scored.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= keep).drop("rank")
    spelt = (first.select("*", F.posexplode("words").alias("place", "hash")).join(words.select("hash", "word"), "hash")
             .groupBy("lang", "words", "a", "l", "r", "score").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("spelt"))
             .select("lang", F.array_join(F.col("spelt.word"), " ").alias("phrase"), "a", "l", "r", "score"))
    by_lang = Window.partitionBy("lang").orderBy(*order, "phrase")
    return (spelt.withColumn("rank", F.row_number().over(by_lang)).filter(F.col("rank") <= keep).join(total, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


#: DuckDB SQL of ``collocations(documents)``.
PHRASES_SQL = r"""
WITH split AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
  FROM documents),
pieces AS (SELECT lang, doc, unnest(p) AS piece, generate_subscripts(p, 1) AS piece_no FROM split),
worded AS (SELECT lang, doc, piece_no, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
single AS (SELECT lang, doc, piece_no, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM worded),
windows AS MATERIALIZED (
  SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4
  FROM single WINDOW o AS (PARTITION BY doc, piece_no ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, 1 AS k, w1, NULL AS w2, NULL AS w3, NULL AS w4, w1 AS phrase, count(*) AS a FROM windows GROUP BY lang, w1
  UNION ALL SELECT lang, 2, w1, w2, NULL, NULL, concat_ws(' ', w1, w2), count(*) FROM windows WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30
  UNION ALL SELECT lang, 3, w1, w2, w3, NULL, concat_ws(' ', w1, w2, w3), count(*) FROM windows WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30
  UNION ALL SELECT lang, 4, w1, w2, w3, w4, concat_ws(' ', w1, w2, w3, w4), count(*) FROM windows WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
parts AS (
  SELECT lang, concat_ws(' ', w1, w2) AS part, a FROM f WHERE k > 2
  UNION ALL SELECT lang, concat_ws(' ', w2, w3), a FROM f WHERE k > 2
  UNION ALL SELECT lang, concat_ws(' ', w3, w4), a FROM f WHERE k = 4
  UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3), a FROM f WHERE k = 4
  UNION ALL SELECT lang, concat_ws(' ', w2, w3, w4), a FROM f WHERE k = 4),
inside AS (SELECT lang, part AS phrase, max(a) AS most FROM parts GROUP BY lang, part),
stay AS MATERIALIZED (
  SELECT f.* FROM f LEFT JOIN inside USING (lang, phrase) WHERE k > 1 AND (most IS NULL OR 100 * most < 80 * a)),
cuts AS (
  SELECT lang, phrase, a, 1 AS cut, w1 AS head, concat_ws(' ', w2, w3, w4) AS tail FROM stay
  UNION ALL SELECT lang, phrase, a, 2, concat_ws(' ', w1, w2), concat_ws(' ', w3, w4) FROM stay WHERE k > 2
  UNION ALL SELECT lang, phrase, a, 3, concat_ws(' ', w1, w2, w3), w4 FROM stay WHERE k > 3),
headed AS MATERIALIZED (SELECT c.*, f.a AS l FROM cuts c JOIN f ON f.lang = c.lang AND f.phrase = c.head),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, c.l, f.a AS r, CAST((2000000::HUGEINT * c.a) // (c.l + f.a) AS BIGINT) AS score
  FROM headed c JOIN f ON f.lang = c.lang AND f.phrase = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
