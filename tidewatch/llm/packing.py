"""Best-fit-decreasing packing of tokenized documents into sequences.

A document's ids are cut into pieces only where it is longer than a sequence. Best fit decreasing puts
pieces, longest first, each into the open sequence it fills most tightly. What it does depends on the
pieces' lengths alone, and a length is at most ``capacity``; so the packing is planned on the histogram of lengths
(``capacity`` numbers, whatever the corpus holds) and then applied to the rows in parallel:

1. rows -> pieces (tokenizer in Arrow batches), written once as a checkpoint of small rows;
2. histogram of lengths, by length and salt; its sum by length comes to the driver: ``capacity`` rows at most;
3. ``plan``: best fit decreasing over runs of equal sequences. A segment tree over remaining capacities
   finds the tightest open sequence for a length in logarithmic time. Within a run, equal pieces go on in one
   step, which is what the one-by-one procedure does as well;
4. a piece's rank among those of its length (salted, so a length that a third of all rows share is ranked in
   many tasks) gives its sequence and offset by binary search in the plan.

The plan has a proven bound. Each step of the plan leaves a run less than half of its free room, so a run is
filled at most log2(capacity) times, and a length opens or splits at most three runs: at most 3 x 11 x 2,048
(67,584) rows of five numbers for 2,048 tokens. It goes to the tasks inside the function.

Cases: null text is empty: one piece, the end id alone; repeated rows are documents of their own; rows of
equal rank order are told apart by piece, start and crc, beyond that they are equal; a null id sorts first; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import array
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import map_columns, partitions, prepare

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"
#: Words and pre-tokens whose ids a worker keeps; beyond that it begins anew.
CACHE = 250_000


class WordTokenizer:
    """Ids of a text as little-endian 32-bit bytes, by a tokenizer file that drops white space and whose
    tokens never span it; so ids are looked up word by word.

    A word of Latin-1 letters and closing ASCII punctuation, for which lower case and composition are
    plain, goes straight to the tokenizer's BPE model; any other word to the whole tokenizer."""

    _plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        # Byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.alphabet = [chr(b) if b in shown else chr(next(rest)) for b in range(256)]

    def _part(self, s: str) -> bytes:
        got = self.parts.get(s)
        if got is None:
            if len(self.parts) >= CACHE:
                self.parts.clear()
            spelled = s if s.isascii() else "".join([self.alphabet[b] for b in s.encode()])
            got = self.parts[s] = array.array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return got

    def _word(self, w: str) -> bytes:
        m = self._plain(w)
        if m:
            return self._part(m[1].lower()) + (self._part(m[2]) if m[2] else b"")
        return array.array("I", self.whole.encode(w, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        ws = text.replace("\n", " ").split(" ")
        known = self.words
        ids = [known.get(w) for w in ws]
        if None in ids:
            if len(known) >= CACHE:
                known.clear()
            for i, got in enumerate(ids):
                if got is None:
                    w = ws[i]
                    got = known.get(w)
                    if got is None:
                        got = self._word(w)
                        if len(w) <= 64:
                            known[w] = got
                    ids[i] = got
        return b"".join(ids)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of every document, with the crc of their ids."""
    end = array.array("I", [end_id]).tobytes()
    step = 4 * capacity

    def run(batches):
        ids_of = tokenizer(path)
        for b in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for d, text in zip(b["doc_id"], b["text"]):
                ids = (ids_of(text) if text else b"") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at:at + step]
                    out["doc_id"].append(d)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(len(cut) // 4)
                    out["ids_crc32"].append(zlib.crc32(cut))
            yield out

    return map_columns(docs.select("doc_id", "text"), run, PIECE_SCHEMA)


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which of them some open sequence has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, at: int, n: int) -> None:
        at += self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, at_least: int) -> int | None:
        """The smallest remaining capacity of ``at_least`` or more that is there."""
        node = at_least + self.leaves
        if node >= 2 * self.leaves:
            return None
        if self.count[node]:
            return at_least
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces a sequence, offset, ranks): the piece of
    rank r is in sequence ``first + (r - first rank) // pieces``."""
    tree = CapacityTree(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}  # remaining -> runs (first sequence, sequences)
    steps: dict[int, list[tuple]] = {}
    fresh = 0

    def put(remaining: int, first: int, n: int) -> None:
        if n:
            open_.setdefault(remaining, []).append((first, n))
            tree.add(remaining, n)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, n = fresh, -(-left // each)
                fresh += n
            else:
                each = room // length
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                tree.add(room, -n)
            used = min(n, -(-left // each))
            full = min(n, left // each)
            took = min(left, used * each)
            steps.setdefault(length, []).append((rank, first, each, capacity - room, took))
            put(room - each * length, first, full)
            if used > full:
                put(room - (took - full * each) * length, first + full, 1)
            put(room, first + used, n - used)
            rank, left = rank + took, left - took
    return {k: np.array(v, dtype=np.int64) for k, v in steps.items()}


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = prepare(docs.sparkSession)
    salts = max(16, partitions(spark))
    cut = (pieces(docs, path, capacity, end_id)
           .withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
           .checkpoint())
    counts = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # At most ``capacity`` rows.
    steps = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # capacity x salts rows at most.
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (cut.withColumn("rank", F.row_number().over(own))
              .join(base, ["length", "salt"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base") - 1).alias("rank")))

    def run(batches):
        for b in batches:
            length, rank = np.array(b["length"], dtype=np.int64), np.array(b.pop("rank"), dtype=np.int64)
            seq, off = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for n in np.unique(length):
                mine, p = length == n, steps[int(n)]
                s = p[np.searchsorted(p[:, 0], rank[mine], side="right") - 1]
                within = rank[mine] - s[:, 0]
                seq[mine] = s[:, 1] + within // s[:, 2]
                off[mine] = s[:, 3] + within % s[:, 2] * n
            yield b | {"sequence_id": seq.tolist(), "offset": off.tolist()}

    return map_columns(ranked, run, PACKED_SCHEMA)
