"""Near-duplicate classes by DartMinHash signatures, banded candidates and exact verification.

**Signature.** A document is a weighted set of shingles (five words). Every (shingle, weight cell, rank cell) unit square holds
a Poisson(1) number of darts, placed by hashes alone, so all documents see the same darts. A document keeps the
darts that hit its own region (weight below the shingle's weight), up to a rank at which about
k ln k + 2k of them are expected; each dart belongs to one of k coordinates, and the earliest dart of each
coordinate is the signature. A document with an empty coordinate throws again up to twice the rank. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. The weight of a shingle is 1
(``weights="set"``, the plain Jaccard similarity that the links are verified by) or its count (``"count"``).

**Candidates.** ``bands`` of ``rows`` coordinates; 24 x 4 finds a pair of similarity 0.8 with
probability 0.999997. Documents of equal word sequences are one node before that, so a group of exact copies, however
large, has one signature in the buckets.

**Links without pairs of a group.** In each bucket every node is compared with one hub, the node with most company over
all its buckets: one comparison a row, and a large group of near copies becomes one component. Only
buckets that then still hold several components go on. Jaccard distance is a metric, so pairs whose similarities to their common hub differ by more than
0.2 need no comparison; that settles the near copies in a bucket at once. With up to ``SMALL`` nodes left, all pairs across
components are compared. The nodes of larger ones (documents that share a common passage, say) go to an exact filter on their shingles,
ordered from the rarest to the commonest among these nodes: of two sets of similarity 0.8, the larger one's first 0.2 and the smaller one's
first 0.11 of its shingles hold a common one, at places that leave room for enough others behind. So a common passage, whose
shingles come last, brings nobody together, and no pair of 0.8 is lost. The nodes that share such a shingle are the new buckets: a hub each,
then what is left across components by a join that Spark can split. No bucket is cut. Similarity is exact (intersection of shingle sets in the JVM).

**Classes.** Components by alternating large-star and small-star steps, as joins and grouped minima, each step written
as a checkpoint. A class is named by its smallest doc_id.

Cases: null or empty text (no words) is a class of its own row by row; under five words the whole text is one shingle; rows of
equal ids and texts are copies; equal ids with other texts are different documents; a null id can be in a class
(its class id is the smallest id that is not null, else null); extra columns are ignored; an empty table gives no rows.
Shingles are compared as 32 of their 64 hash bits: a chance match within a pair of 500-word texts
has probability 6e-5 and would move its similarity by 1/500.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import checkpointed, map_columns, prepare, words
from tidewatch.llm.hashing import mix, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
SMALL = 16
#: Nodes whose ids may be broadcast (16 MB of keys); beyond that they are joined by a shuffle.
BROADCAST_NODES = 400_000
SIGNATURE_SCHEMA = "doc_id long, text_id binary, node binary, keys array<long>"

_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(19)])
_U = np.uint64


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the shingles of a text's word hashes, in order; of a shorter text, one of all its words."""
    if not len(h):
        return h
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = (out + h[j:len(h) - n + 1 + j]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
    return mix(out + _U(n))


def node_of(text: str) -> bytes:
    """Identity of a text's word sequence."""
    return hashlib.blake2b(b" ".join(words(text)), digest_size=16).digest()


def _throw(elements: np.ndarray, weights: np.ndarray, rank: float, k: int) -> np.ndarray:
    """Signature from all darts of lower rank than ``rank``; 0 where a coordinate has none."""
    seeds, cell_w, cell_r = elements, None, None
    deep = max(1, math.ceil(rank))
    high = np.ceil(weights).astype(np.int64)
    if deep > 1 or high.max() > 1:
        each = high * deep
        at = np.repeat(np.arange(len(elements)), each)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        cell_w, cell_r = nth // deep, nth % deep
        weights = weights[at] - cell_w
        seeds = mix(elements[at] + (cell_w.astype(np.uint64) << _U(32)) + cell_r.astype(np.uint64) + _U(1))
    else:
        seeds = mix(elements + _U(1))
    count = np.searchsorted(_POISSON, (seeds >> _U(11)).astype(np.float64) * 2.0**-53, side="right")
    ids, ranks = [], []
    left = np.arange(len(seeds))
    for i in range(int(count.max(initial=0))):
        left = left[count[left] > i]
        dart = mix(seeds[left] + _U((i + 1) * 0xD1B54A32D192ED03 % 2**64))
        r = (dart >> _U(11)).astype(np.float64) * 2.0**-53
        if cell_r is not None:
            r = r + cell_r[left]
        hit = r < rank
        if (weights < 1).any():
            hit &= (mix(dart ^ _U(0xA0761D6478BD642F)) >> _U(11)).astype(np.float64) * 2.0**-53 < weights[left]
        ids.append(dart[hit])
        ranks.append(r[hit])
    dart, r = np.concatenate(ids or [np.zeros(0, np.uint64)]), np.concatenate(ranks or [np.zeros(0)])
    late_first = np.argsort(-r, kind="stable")
    dart = dart[late_first]
    out = np.zeros(k, dtype=np.uint64)
    out[(mix(dart ^ _U(0xE7037ED1A0B428DB)) % _U(k)).astype(np.int64)] = dart  # the earliest is written last
    return out


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The DartMinHash of a weighted set: for each of k coordinates its earliest dart."""
    rank = (k * math.log(k) + 2 * k) / float(weights.sum())
    while True:
        out = _throw(elements, weights, rank, k)
        if out.all():
            return out
        rank *= 2


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of the signature."""
    s = sig.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + s[:, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, weights: str = "set", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Identity of the text, identity of its word sequence (the node) and band keys of each row."""

    def run(batches):
        for b in batches:
            out = {"doc_id": b["doc_id"], "text_id": [], "node": [], "keys": []}
            for t in b["text"]:
                h = word_hashes(t)
                out["text_id"].append(hashlib.md5((t or "").encode()).digest())
                out["node"].append(node_of(t) if len(h) else None)
                if not len(h):
                    out["keys"].append(None)
                    continue
                e, n = np.unique(shingles(h), return_counts=True)
                w = n.astype(float) if weights == "count" else np.ones(len(e))
                out["keys"].append(band_keys(signature(e, w, bands * rows), bands, rows).tolist())
            yield out

    return map_columns(docs.select("doc_id", "text"), run, SIGNATURE_SCHEMA)


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Shingle sets (32-bit) of ``nodes`` (node, doc_id, text_id), from the texts of their rows."""
    n = nodes.count()
    side = nodes.select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text"))
    wanted = docs.select("doc_id", "text").join(F.broadcast(side) if n <= BROADCAST_NODES else side,
                                                F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def run(batches):
        for b in batches:
            out = {"node": [], "items": []}
            for t in b["text"]:
                h = word_hashes(t)
                if len(h):
                    out["node"].append(node_of(t))
                    out["items"].append(np.unique((shingles(h) >> _U(32)).astype(np.uint32)).view(np.int32).tolist())
            yield out

    return map_columns(wanted, run, "node binary, items array<int>").join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact similarity of each pair (a, b)."""
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    both = one.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("similarity"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); the root is the component's least node."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    seen = None
    while True:
        e = checkpointed(e)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
                    .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
        seen = state
        # Large star: what is greater than u goes to the least neighbour of u.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: what is not greater than u, and u itself, goes to the least of them.
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def _hubs(rows: DataFrame, seed: int) -> DataFrame:
    """The bucket rows (key, node) of buckets with two nodes or more, with their size and hub: the node with most
    company over all its buckets. Copies with edits of their own may be unlike one another, yet all like what they
    were copied from; that text has the most company."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = checkpointed(rows.join(counts, "key"))
    company = shared.groupBy("node").agg(F.sum("n").alias("w"))
    hubs = (shared.join(company, "node").groupBy("key").agg(F.max(F.struct("w", F.xxhash64("node", F.lit(seed)), "node")).alias("h"))
            .select("key", F.col("h.node").alias("hub")))
    return shared.join(hubs, "key")


def _star(held: DataFrame) -> DataFrame:
    """One pair (a, b) for each row and its hub."""
    return held.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))


def _open(held: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with their components."""
    placed = held.join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    return placed.join(several, "key")


def _unsettled(held: DataFrame, comps: DataFrame, tested: DataFrame, similarity: float) -> DataFrame:
    """The rows of open buckets that a pair of different components could still be among, with their similarity ``s`` to
    the hub. Rows of the hub's component that are too near to the hub for all rows outside it are settled."""
    near = tested.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "similarity")
    roots = comps.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    far = 1 - similarity + 1e-9
    rows = (_open(held, comps).drop("n").join(near, (F.least("node", "hub") == F.col("_a")) & (F.greatest("node", "hub") == F.col("_b")), "left")
            .withColumn("s", F.when(F.col("node") == F.col("hub"), 1.0).otherwise(F.coalesce("similarity", F.lit(1.0))))
            .drop("_a", "_b", "similarity").join(roots, "hub", "left").withColumn("hub_root", F.coalesce("hub_root", "hub")))
    outside = F.col("root") != F.col("hub_root")
    most = rows.groupBy("key").agg(F.max(F.when(outside, F.col("s"))).alias("most"))
    rows = rows.join(most, "key").where(outside | (F.col("s") <= F.col("most") + far)).drop("most", "hub_root")
    several = (rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"))
               .where("r0 <> r1").select("key", "n"))
    return rows.join(several, "key")


def _across(left: DataFrame, similarity: float) -> DataFrame:
    """Pairs of one bucket and different components that the distances to their hub do not rule out, nor, where rows
    have them, the sizes of their sets and their places in these."""
    own = [c for c in ("n_items", "place") if c in left.columns]
    x, y = (left.select("key", F.col("node").alias(p), F.col("root").alias(f"{p}_root"), F.col("s").alias(f"{p}_s"),
                        *[F.col(c).alias(f"{p}_{c}") for c in own]) for p in "ab")
    apart = F.abs(F.col("a_s") - F.col("b_s")) <= 1 - similarity + 1e-9
    pairs = x.join(y, "key").where("a_root <> b_root and a < b").where(apart)
    return (pairs.where(_possible(similarity)) if own else pairs).select("a", "b")


def _possible(similarity: float):
    """Whether two sets that share their ``place``-th item (from 0) as the first can be ``similarity`` or more."""
    na, nb, pa, pb = (F.col(c) for c in ("a_n_items", "b_n_items", "a_place", "b_place"))
    common = similarity / (1 + similarity) * (na + nb) - 1e-6
    least = F.when(na <= nb, pa).otherwise(pb) < _first(F.least(na, nb), 2 * similarity / (1 + similarity))
    return (F.least(na, nb) >= similarity * F.greatest(na, nb) - 1e-6) & least & (F.least(na - pa, nb - pb) >= common)


def _first(n, share: float):
    """How many items of a set of ``n`` must hold one of any ``share`` of them."""
    return n - F.ceil(share * n - 1e-6) + 1


def _rare_items(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, node, n_items, place): the first items of each node's set, from the rarest among ``nodes`` to the
    commonest, of which two sets of ``similarity`` share one. Items that one node alone holds only count for the places."""
    items = (sets.join(nodes.select("node").distinct(), "node", "left_semi")
             .select("node", F.size("items").alias("n_items"), F.explode("items").alias("item")))
    shared = items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    held = (items.join(shared, "item").groupBy("node", "n_items").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("l"))
            .withColumn("alone", F.col("n_items") - F.size("l")))
    first = F.slice("l", 1, F.greatest(F.lit(0), (_first(F.col("n_items"), similarity) - F.col("alone")).cast("int")))
    return (held.select("node", "n_items", "alone", F.posexplode(first).alias("at", "one"))
            .select(F.col("one.item").cast("long").alias("key"), "node", "n_items",
                    (F.col("alone") + F.col("at")).alias("place")))


def _links(sigs: DataFrame, docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, similarity) and the components they make."""
    nodes = (sigs.where("node is not null").groupBy("node")
             .agg(F.min(F.struct("doc_id", "text_id", "keys")).alias("r"))
             .select("node", "r.doc_id", "r.text_id", "r.keys"))
    held = checkpointed(_hubs(nodes.select("node", F.explode("keys").alias("key")), 0))
    wanted = checkpointed(nodes.select("node", "doc_id", "text_id").join(held.select("node").distinct(), "node", "left_semi"))
    sets = checkpointed(_sets(docs, wanted))

    def settle(tested: DataFrame) -> tuple[DataFrame, DataFrame]:
        links = tested.where(F.col("similarity") >= similarity)
        return links, checkpointed(components(links))

    def test(pairs: DataFrame, tested: DataFrame) -> DataFrame:
        new = checkpointed(pairs.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        return checkpointed(tested.unionByName(_verify(new, sets)))

    tested = checkpointed(_verify(_star(held).distinct(), sets))
    links, comps = settle(tested)
    left = checkpointed(_unsettled(held, comps, tested, similarity))
    if left.isEmpty():
        return links, comps
    tested = test(_across(left.where(F.col("n") <= SMALL), similarity), tested)
    links, comps = settle(tested)
    # Large buckets that the small ones' links have not joined.
    large = checkpointed(_open(left.where(F.col("n") > SMALL).select("key", "node"), comps).select("node").distinct())
    if large.isEmpty():
        return links, comps
    held = checkpointed(_hubs(_rare_items(large, sets, similarity), 1))
    tested = test(_star(_open(held, comps)), tested)
    comps = settle(tested)[1]
    left = checkpointed(_unsettled(held, comps, tested, similarity))
    return settle(test(_across(left, similarity), tested))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weights: str = "set", bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """``doc_id, text_id, class_id, kept`` for each row: its class and whether it stands for it (``kept`` holds
    for the rows equal to the class's first by id and text)."""
    prepare(docs.sparkSession)
    sigs = checkpointed(signatures(docs, weights, bands, rows))
    _, comps = _links(sigs, docs, similarity)
    placed = (sigs.select("doc_id", "text_id", "node").join(comps, "node", "left")
              .select("doc_id", "text_id", "node", F.coalesce("root", "node").alias("root")))
    first = (placed.where("root is not null").groupBy("root")
             .agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_id")).alias("f"))
             .select("root", "class_id", F.col("f.doc_id").alias("first_id"), F.col("f.text_id").alias("first_text")))
    return (placed.join(first, "root", "left")
            .select("doc_id", "text_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    (F.col("root").isNull() | (F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_id") == F.col("first_text")))).alias("kept")))


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, in its own columns; repeated rows of it count once."""
    cols = docs.columns
    kept = (near_duplicates(docs, similarity).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text")).distinct())
    named = docs.withColumn("_text_id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    held = named.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_id") == F.col("_text")), "left_semi")
    blank = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]")) == 0
    return (held.where(~blank).dropDuplicates(["doc_id", "_text_id"]).select(*cols)
            .unionByName(held.where(blank).select(*cols)))
