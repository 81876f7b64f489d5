"""Repeated passages of ``window`` words, found by FM-indexes over shards of repeated candidates.

A window is 20 consecutive words of a document. It is removed when its word sequence also starts earlier
(smaller doc_id, or earlier in the same document). Documents of equal text (md5) are settled first: a later copy
repeats from its first window to its last.

1. **Candidates.** The anchor of a window is the least hash among its six-word grams (the first, if
   several). Equal windows have equal anchors at equal places, so a window whose anchor occurs once is unique. Each run
   of windows with one anchor is a candidate if that anchor occurs again anywhere.
2. **Shards.** Candidate runs (their words as 64-bit hashes) are shuffled and sorted by anchor; a task cuts its
   sorted rows into shards of about ``BLOCK`` words at anchor boundaries. So memory is bounded whatever a partition
   holds, and all windows that could be equal are in one shard. Runs of an anchor with over ``HOT`` places are dealt window by
   window instead, by the hash of the window. Of equal runs within a task only the earliest goes on to the shuffle, the others are
   repeated whole and settled. So a passage in a third of all documents neither lands in one task nor stays whole.
3. **FM-index.** The text of a shard is its runs in document order, as five-word symbols that step by five. Its
   Burrows-Wheeler transform is kept as a wavelet matrix (packed bits with block counts). The runs are streamed
   through the index: backward search, four symbols for 20 words, all windows of a batch at once; a window drops out as soon as fewer
   than two places match. The rows of an interval that are left are in document order, so the first of
   them is the earliest start; windows that start later are reported, as spans of words.
4. Spans return to their documents by doc_id, the covered words are removed.

The text is shuffled by doc_id once: the plan uses that exchange three times. Hash tables, anchors and
spans are small beside it.

Cases: null text has no words; a null id counts as smaller than any other (rows without one are keyed by their text, so any
number of them is as well dealt as rows with ids); rows equal in id and text get equal
results and do not repeat each other; rows of one id with different texts count as ordered by a hash of
their text; texts under 20 words are left alone; words of any length are hashed whole; extra columns are ignored (``deduplicated``
returns them); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_columns, partitions, prepare, words
from tidewatch.llm.hashing import mix, word_hashes

WINDOW, GRAM, STEP = 20, 6, 5
BLOCK, HOT, SETTLE = 1_000_000, 10_000, 100_000
_U = np.uint64

RUN_SCHEMA = "key long, doc_id long, row long, start int, n int, words binary"
SPAN_SCHEMA = "doc_id long, row long, first int, last int"
RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words."""
    out = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for j in range(size):
        out = (out + h[j:len(h) - size + 1 + j]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
    return mix(out)


def anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (anchor hash, anchor place, first window); a run goes up to the next."""
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = _rolled(h, gram)
    span = window - gram + 1
    # Hash above, place below: the minimum of a window tells the place of its least hash, the first of equal ones.
    low = (g & _U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    have = 1
    while have < span:  # minima of 1, 2, 4, ... and at last ``span`` consecutive values
        by = min(have, span - have)
        low, have = np.minimum(low[:-by], low[by:]), have + by
    at = (low & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return g[at[first]].view(np.int64), at[first], first


class WaveletMatrix:
    """Rank over a sequence of symbols: a packed bit vector with block counts for each bit of the alphabet."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels = []
        n = len(seq)
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b) & 1
            padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(packed) + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            one = bit.astype(bool)
            self.levels.append((packed, before[:-1].astype(np.int32), int(n - before[-1])))
            seq = np.concatenate([seq[~one], seq[one]])

    @staticmethod
    def _ones(level, i: np.ndarray) -> np.ndarray:
        packed, before, _ = level
        block = i >> 6
        under = (_U(1) << (i & 63).astype(np.uint64)) - _U(1)
        return before[block] + np.bitwise_count(packed[block] & under)

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often ``symbol`` stands before lo and before hi."""
        at = np.zeros_like(lo)
        for k, level in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            both = [self._ones(level, x) for x in (at, lo, hi)]
            at, lo, hi = (np.where(one, level[2] + o, x - o) for x, o in zip((at, lo, hi), both))
        return lo - at, hi - at


class FMIndex:
    """Backward search over runs of words, for patterns of ``window`` words.

    Symbols are the ``step``-word grams; the symbol before place p is the one at p - step. Rows are sorted by their
    first ``window`` words, equal ones by place, which is what patterns up to that length need."""

    def __init__(self, runs: list[np.ndarray], window: int = WINDOW, step: int = STEP):
        self.window, self.step = window, step
        lengths = np.array([len(r) for r in runs], dtype=np.int64)
        ends = np.cumsum(lengths + window)  # a gap after each run, so nothing reaches over its end
        n = int(ends[-1])
        self.begin = ends - lengths - window
        inside = np.repeat(self.begin, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.run_of = np.repeat(np.arange(len(runs)), lengths + window)
        word = np.zeros(n, dtype=np.int64)
        word[inside] = np.unique(np.concatenate(runs), return_inverse=True)[1] + 1
        self.left = np.zeros(n, dtype=np.int64)  # words up to the run's end
        self.left[inside] = np.repeat(lengths, lengths) - (inside - np.repeat(self.begin, lengths))
        self.symbol = self._ranked(self._ranked(self._ranked(word, word, 1), None, 2), word, 4)
        full = self._ranked(self._ranked(self.symbol, self.symbol, step), None, 2 * step)
        self.suffix = np.argsort(full, kind="stable")
        self.sigma = int(self.symbol.max()) + 1
        before = self.suffix - step
        last = np.where((before >= 0) & (self.run_of[np.maximum(before, 0)] == self.run_of[self.suffix]), self.symbol[before], 0)
        self.bwt = WaveletMatrix(last, self.sigma)
        self.starts = np.zeros(self.sigma + 1, dtype=np.int64)
        np.cumsum(np.bincount(self.symbol, minlength=self.sigma), out=self.starts[1:])

    def _ranked(self, a: np.ndarray, b: np.ndarray | None, by: int) -> np.ndarray:
        """Order-preserving ids of (a at p, b at p + by)."""
        b = a if b is None else b
        moved = np.zeros_like(b)
        moved[:len(b) - by] = b[by:]
        return np.unique(a * (int(b.max()) + 1) + moved, return_inverse=True)[1]

    def earliest(self, at: np.ndarray) -> np.ndarray:
        """For each place, the first place with the same ``window`` words (itself, if none is before)."""
        w, s = self.window, self.step
        out = at.copy()
        live = np.arange(len(at))
        c = self.symbol[at + (w - s)]
        lo, hi = self.starts[c], self.starts[c + 1]
        for back in range(w - 2 * s, -1, -s):
            more = hi - lo > 1
            live, lo, hi = live[more], lo[more], hi[more]
            c = self.symbol[at[live] + back]
            before_lo, before_hi = self.bwt.rank(c, lo, hi)
            lo, hi = self.starts[c] + before_lo, self.starts[c] + before_hi
        out[live] = self.suffix[lo]
        return out


def _order(run: tuple) -> tuple:
    """Document order of (doc_id, row, start, ...)."""
    return run[0] is not None, run[0] or 0, run[1], run[2]


def _spans(block: list[tuple], window: int, step: int) -> dict[str, list]:
    """Spans of repeated words of a shard's runs (doc_id, row, start, words). A run that equals an earlier one is
    repeated whole; the index holds the first of each."""
    out = {"doc_id": [], "row": [], "first": [], "last": []}

    def add(run: tuple, first: int, n: int) -> None:
        if out["first"] and out["doc_id"][-1] == run[0] and out["row"][-1] == run[1] and first <= out["last"][-1] + 1:
            out["last"][-1] = max(out["last"][-1], first + n - 1)
        else:
            for k, v in zip(out, (run[0], run[1], first, first + n - 1)):
                out[k].append(v)

    block.sort(key=_order)
    firsts: dict[bytes, tuple] = {}
    for run in block:
        # Rows equal in id and text are one document.
        if firsts.setdefault(run[3], run)[:3] != run[:3]:
            add(run, run[2], len(run[3]) // 8)
    runs = list(firsts.values())
    if len(runs) < 2:
        return out
    index = FMIndex([np.frombuffer(r[3], dtype=np.uint64) for r in runs], window, step)
    places = np.flatnonzero(index.left >= window)
    for at in range(0, len(places), 200_000):
        part = places[at:at + 200_000]
        for p in part[index.earliest(part) < part].tolist():
            run = runs[index.run_of[p]]
            add(run, run[2] + p - int(index.begin[index.run_of[p]]), window)
    return out


def _search(batches):
    """Cut sorted runs into shards and search each; rows without words are settled spans already."""
    block, size, key = [], 0, None
    for b in batches:
        done = {"doc_id": [], "row": [], "first": [], "last": []}
        for k, d, t, s, n, w in zip(b["key"], b["doc_id"], b["row"], b["start"], b["n"], b["words"]):
            if w is None:
                for name, v in zip(done, (d, t, s, s + n - 1)):
                    done[name].append(v)
                continue
            if size >= BLOCK and k != key:
                yield _spans(block, WINDOW, STEP)
                block, size = [], 0
            key = k
            block.append((d, t, s, w))
            size += len(w) // 8 + WINDOW
        yield done
    if block:
        yield _spans(block, WINDOW, STEP)


def _shared(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The documents dealt by doc_id, each with its md5 and the texts of that id that are later copies. Every
    consumer takes all columns, so that one exchange serves them all."""
    held = docs.select(*columns, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("_text_id"))
    held = held.withColumn("_row", F.xxhash64("_text_id")).withColumn("_side", _side("doc_id", "_row"))
    ids = held.select("doc_id", "_side", "_text_id")
    first = ids.groupBy("_text_id").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNotNull().alias("o"), "doc_id")).alias("f")).where("n > 1")
    copies = (ids.join(first, "_text_id").where(F.struct(F.col("doc_id").isNotNull().alias("o"), "doc_id") > F.col("f"))
              .groupBy(F.col("doc_id").alias("_id"), F.col("_side").alias("_id_side")).agg(F.collect_set("_text_id").alias("_copies")).hint("shuffle_hash"))
    return (held.join(copies, _same_document(), "left")
            .withColumn("_copy", F.coalesce(F.array_contains("_copies", F.col("_text_id")), F.lit(False)))
            .drop("_id", "_id_side", "_copies", "_text_id"))


def _side(doc_id: str, row: str):
    """What tells rows without an id apart, by their text; 0 for all others."""
    return F.when(F.col(doc_id).isNull(), F.col(row)).otherwise(F.lit(0).cast("long"))


def _same_document():
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_side") == F.col("_id_side"))


def _spans_of(shared: DataFrame) -> DataFrame:
    """(doc_id, spans) of the documents that have spans to remove."""
    spark = shared.sparkSession
    n = partitions(spark)

    def find(batches):
        for b in batches:
            out = {"anchor": [], "doc_id": [], "side": [], "place": []}
            for d, side, text, copy in zip(b["doc_id"], b["_side"], b["text"], b["_copy"]):
                if not copy and text:
                    a, at, _ = anchors(word_hashes(text))
                    out["anchor"] += a.tolist()
                    out["place"] += at.tolist()
                    out["doc_id"] += [d] * len(a)
                    out["side"] += [side] * len(a)
            yield out

    found = map_columns(shared, find, "anchor long, doc_id long, side long, place int")
    # Counted with map-side sums; Spark splits the join's partition of an anchor that is everywhere.
    often = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    places = (found.join(often, "anchor").groupBy(F.col("doc_id").alias("_id"), F.col("side").alias("_id_side"))
              .agg(F.collect_list(F.struct("place", (F.col("n") > HOT).alias("hot"))).alias("_places")))

    def cut(batches):
        names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
        first: dict[bytes, tuple] = {}  # by words: the earliest run of this task, with its key

        def rows(found):
            return dict(zip(names, map(list, zip(*found))))

        def held():
            return rows([(k, *run, len(w) // 8, w) for w, (k, run) in first.items()])

        for b in batches:
            settled = []
            for d, t, text, copy, places in zip(b["doc_id"], b["_row"], b["text"], b["_copy"], b["_places"]):
                if copy or not text or not places:
                    continue
                h = word_hashes(text)
                a, at, start = anchors(h)
                hot = {p["place"]: p["hot"] for p in places}
                upto = np.append(start[1:], len(h) - WINDOW + 1).tolist()
                runs = []
                for key, place, s, e in zip(a.tolist(), at.tolist(), start.tolist(), upto):
                    if place in hot:
                        runs += [(key, s, e)] if not hot[place] else [(None, x, x + 1) for x in range(s, e)]
                for key, s, e in runs:
                    w, run = h[s:e + WINDOW - 1].tobytes(), (d, t, s)
                    old = first.get(w)
                    if old is None:
                        first[w] = (_window_key(w) if key is None else key, run)
                    elif old[1] != run:
                        early, late = sorted((old[1], run), key=_order)
                        first[w] = (old[0], early)
                        settled.append((late[2], *late, len(w) // 8, None))
            if settled:
                yield rows(settled)
            if len(first) > SETTLE:
                yield held()
                first.clear()
        if first:
            yield held()

    wanted = shared.join(places.hint("shuffle_hash"), _same_document(), "left").where("_places is not null").drop("_id", "_id_side")
    runs = map_columns(wanted, cut, RUN_SCHEMA).repartition(n, "key").sortWithinPartitions("key")
    return (map_columns(runs, _search, SPAN_SCHEMA).groupBy(F.col("doc_id").alias("_id"), _side("doc_id", "row").alias("_id_side"))
            .agg(F.collect_list(F.struct("row", (F.shiftleft(F.col("first").cast("long"), 32) + F.col("last")).alias("span"))).alias("_spans")))


def _window_key(w: bytes) -> int:
    return int(mix(_rolled(np.frombuffer(w, dtype=np.uint64), len(w) // 8)).view(np.int64)[0])


def _kept(text: str | None, row: int, copy: bool, spans: list | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    ws = words(text)
    if copy and len(ws) >= WINDOW:
        return [], len(ws)
    mine = [s["span"] for s in spans or () if s["row"] == row]
    if not mine:
        return ws, len(ws)
    stays = np.ones(len(ws), dtype=bool)
    for s in mine:
        stays[s >> 32:(s & 0xFFFFFFFF) + 1] = False
    return [w for w, k in zip(ws, stays.tolist()) if k], len(ws)


def _joined(docs: DataFrame, columns: list[str]) -> DataFrame:
    prepare(docs.sparkSession)
    shared = _shared(docs, columns)
    spans = _spans_of(shared).hint("shuffle_hash")
    return shared.join(spans, _same_document(), "left").drop("_id", "_id_side")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row."""
    def run(batches):
        for b in batches:
            out = {"doc_id": b["doc_id"], "n_words": [], "n_removed": [], "kept_sha256": []}
            for text, t, copy, spans in zip(b["text"], b["_row"], b["_copy"], b["_spans"]):
                kept, n = _kept(text, t, copy, spans)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(kept))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield out

    return map_columns(_joined(docs, ["doc_id", "text"]), run, RESULT_SCHEMA)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents in their own columns without their repeated words. An untouched text stays as it is; what is
    left of another is joined by single spaces; a document with nothing left goes."""
    cols = docs.columns

    def run(batches):
        for b in batches:
            out = {c: [] for c in cols}
            for i, (text, t, copy, spans) in enumerate(zip(b["text"], b["_row"], b["_copy"], b["_spans"])):
                kept, n = _kept(text, t, copy, spans)
                if n and not kept:
                    continue
                for c in cols:
                    out[c].append(b[c][i])
                if len(kept) < n:
                    out["text"][-1] = b" ".join(kept).decode()
                    if "n_chars" in out:
                        out["n_chars"][-1] = len(out["text"][-1])
            if out["text"]:
                yield out

    return map_columns(_joined(docs, cols), run, docs.schema)
