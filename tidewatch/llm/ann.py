"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

**Index.** Distinct vectors are dealt by hash into shards of about ``SHARD`` vectors. In a shard, points are inserted in
batches: a greedy beam search from the medoid over the graph so far proposes neighbours (all it expanded), and relaxed
distance pruning keeps the diverse ones: the nearest candidate p is kept, candidates c with
``ALPHA * d(p, c) <= d(point, c)`` go, and so on until ``DEGREE`` are kept. Reverse edges are added, and a node with too many is
pruned the same way. The index is a table with a row for each distinct vector: shard, ids, vector, neighbours.

**Search.** Queries, in blocks, meet every shard: a beam search of width ``BEAM`` there, then exact distances in double
precision on the original vectors; each (shard, block) sends its k best for each query, and a window takes the k best of all.

**Range.** Graphs are built and searched in single precision, centred by the median of each component and scaled by the largest
one. Vectors over ``WIDE`` times as far from the medians as half of the others would round away what tells those apart (or
be cut off from them): a shard is divided into groups without such vectors, each with a graph and start of its own, and all are searched.
A query that far from a group is searched there in double precision, by sums of squared differences.

Copies: rows with one vector are one node with its k + 1 smallest ids; no other copy can be among a query's k nearest, as
ties go to smaller ids. The ids are cut with a window limit that Spark applies before its shuffle, so a vector that a third of
all rows share costs k + 1 rows a task. Memory of a task: one shard and one block, both bounded.

Cases: vectors that are null, empty, all zero or hold a null or non-finite component take no part, nor do rows without
an id; rows equal in id and vector are one; vectors of other length are compared only among themselves; a query
with fewer candidates gets them all; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import prepare

SHARD, BLOCK = 8192, 2048
DEGREE, BUILD_BEAM, BEAM, ALPHA = 32, 64, 96, 1.2
#: Nodes expanded in one step of a search, queries searched at once.
WIDTH, BATCH = 4, 256
#: Distance from the centre, in medians of the shard's, beyond which single precision does not do.
WIDE = 16.0
#: Differences of vectors in double precision made at once (16 MB at 64 components).
CHUNK = 32_768

INDEX_SCHEMA = "dim int, shard int, node int, start int, ids array<long>, vector array<double>, near array<int>"
FOUND_SCHEMA = "query_id long, vec_id long, score double"


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, ...]:
    """The ``beam`` nearest found of each query, nearest first, and all nodes expanded on the way (-1: none), each with
    squared distances (in single precision less the query's own square). All queries step together."""
    n, m, r = len(x), len(q), graph.shape[1]
    exact = x.dtype == np.float64
    norm = None if exact else np.einsum("ij,ij->i", x, x)

    def distance(to: np.ndarray, own: np.ndarray) -> np.ndarray:
        if not exact:
            return norm[to] - 2 * np.einsum("ij,ij->i", x[to], q[own])
        out = np.empty(len(to))
        for at in range(0, len(to), CHUNK):
            some = slice(at, at + CHUNK)
            gap = x[to[some]] - q[own[some]]
            out[some] = np.einsum("ij,ij->i", gap, gap)
        return out

    ids = np.full((m, beam), -1, dtype=np.int64)
    dist = np.full((m, beam), np.inf, dtype=x.dtype)
    done = np.ones((m, beam), dtype=bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = distance(np.full(m, start), np.arange(m))
    seen = np.full((m, n), -1, dtype=np.int32)
    seen[:, start] = 0
    way, way_dist = [], []
    live = np.arange(m)
    while len(live):
        # The first WIDTH nodes of each beam that are not expanded yet.
        turn = ~done[live]
        pick = turn & (np.cumsum(turn, axis=1) <= WIDTH)
        order = np.argsort(~pick, axis=1, kind="stable")[:, :WIDTH]
        real = np.take_along_axis(pick, order, axis=1)
        nodes = np.where(real, np.take_along_axis(ids[live], order, axis=1), -1)
        full = np.full((m, WIDTH), -1, dtype=np.int64)
        full_dist = np.full((m, WIDTH), np.inf, dtype=x.dtype)
        full[live] = nodes
        full_dist[live] = np.where(real, np.take_along_axis(dist[live], order, axis=1), np.inf)
        way.append(full)
        way_dist.append(full_dist)
        done[live] |= pick
        near = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(live), WIDTH * r)
        rows = np.repeat(live, WIDTH * r).reshape(near.shape)
        col = np.broadcast_to(np.arange(WIDTH * r, dtype=np.int32), near.shape)
        new = (near >= 0) & (seen[rows, near] < 0)
        seen[rows[new], near[new]] = col[new]
        new &= seen[rows, near] == col  # of equal neighbours the last one stays
        a, b = np.nonzero(new)
        d = np.full(near.shape, np.inf, dtype=x.dtype)
        d[a, b] = distance(near[a, b], live[a])
        all_d = np.concatenate([dist[live], d], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, best, axis=1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(new, near, -1)], axis=1), best, axis=1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~new], axis=1), best, axis=1)
        live = live[~done[live].all(axis=1)]
    return ids, dist, np.concatenate(way, axis=1), np.concatenate(way_dist, axis=1)


def robust_prune(x: np.ndarray, point: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point, ``degree`` diverse nodes of its candidates (-1: none)."""
    at = x[np.maximum(cand, 0)] - x[point][:, None, :]  # from the point, so that far ones cost the near ones no digits
    d = np.square(at).sum(axis=2)
    d[(cand < 0) | (cand == point[:, None])] = np.inf
    sq = np.einsum("ijk,ijk->ij", at, at)
    between = sq[:, :, None] + sq[:, None, :] - 2 * (at @ at.transpose(0, 2, 1))
    out = np.full((len(point), degree), -1, dtype=np.int64)
    rows = np.arange(len(point))
    left = d.copy()
    for k in range(degree):
        p = left.argmin(axis=1)
        ok = np.isfinite(left[rows, p])
        if not ok.any():
            break
        out[ok, k] = cand[rows[ok], p[ok]]
        gone = alpha * alpha * np.maximum(between[rows, p], 0) <= d
        left[gone & ok[:, None]] = np.inf
        left[rows, p] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The graph (neighbours of each point, -1: none) and its starting point."""
    n = len(x)
    start = int(np.square(x - x.mean(axis=0)).sum(axis=1).argmin())
    graph = np.full((n, degree), -1, dtype=np.int64)
    if n <= degree + 1:
        for i in range(n):
            graph[i, :n - 1] = np.delete(np.arange(n), i)
        return graph, start
    order = np.random.RandomState(n).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < n:
        new = order[at:at + min(BATCH, max(8, at // 2))]
        ids, _, way, _ = beam_search(x, graph, start, x[new], beam)
        graph[new] = robust_prune(x, new, _unique_rows(np.concatenate([ids, way], axis=1), 2 * beam), degree, alpha)
        _reverse(x, graph, new, degree, alpha)
        at += len(new)
    return graph, start


def _unique_rows(ids: np.ndarray, most: int) -> np.ndarray:
    """Each row's ids without repeats, as many columns as the fullest row needs (``most`` and those expanded last)."""
    s = np.sort(ids, axis=1)
    s[:, 1:][s[:, 1:] == s[:, :-1]] = -1
    s = -np.sort(-s, axis=1)
    return s[:, :max(1, int((s >= 0).sum(axis=1).max()))]


def _reverse(x: np.ndarray, graph: np.ndarray, new: np.ndarray, degree: int, alpha: float) -> None:
    """Add the edges back to ``new`` points; prune nodes that get too many."""
    a = np.repeat(new, degree)
    b = graph[new].ravel()
    a, b = a[b >= 0], b[b >= 0]
    by = np.argsort(b, kind="stable")
    a, b = a[by], b[by]
    nodes, first, count = np.unique(b, return_index=True, return_counts=True)
    nth = np.arange(len(b)) - np.repeat(first, count)
    for at in range(0, len(nodes), BATCH):
        some = slice(at, at + BATCH)
        lo, hi = first[some][0], first[some][-1] + count[some][-1]
        extra = np.full((len(nodes[some]), int(count[some].max())), -1, dtype=np.int64)
        extra[np.repeat(np.arange(len(nodes[some])), count[some]), nth[lo:hi]] = a[lo:hi]
        cand = _unique_rows(np.concatenate([graph[nodes[some]], extra], axis=1), 0)
        fits = (cand >= 0).sum(axis=1) <= degree
        wide = np.full((len(cand), max(degree, cand.shape[1])), -1, dtype=np.int64)
        wide[:, :cand.shape[1]] = cand
        graph[nodes[some][fits]] = wide[fits][:, :degree]
        if (~fits).any():
            graph[nodes[some][~fits]] = robust_prune(x, nodes[some][~fits], cand[~fits], degree, alpha)


def _scaled(v: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``v`` centred and scaled by ``like`` so that nothing overflows, in double precision, and which rows are too far out
    for single precision."""
    mid = np.median(like, axis=0)
    gap = like - mid
    scale = float(np.abs(gap).max()) or 1.0
    usual = float(np.median(np.sqrt(np.square(gap / scale).sum(axis=1))))
    out = (v - mid) / scale
    return out, np.sqrt(np.square(out).sum(axis=1)) > WIDE * max(usual, 1e-150)


def _groups(v: np.ndarray) -> list[np.ndarray]:
    """Rows of a shard in groups of like range: no vector is too far out for its group."""
    left, out = np.arange(len(v)), []
    while len(left):
        own = left
        while (far := _scaled(v[own], v[own])[1]).any():
            own = own[~far]
        out.append(own)
        left = np.setdiff1d(left, own)
    return out


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.reset_index(drop=True)
    v = np.array(pdf["vector"].tolist(), dtype=np.float64)
    near, starts = [None] * len(v), np.zeros(len(v), dtype=np.int64)
    for own in _groups(v):
        graph, start = build(_scaled(v[own], v[own])[0].astype(np.float32))
        starts[own] = own[start]
        for i, g in zip(own, graph):
            near[i] = own[g[g >= 0]].tolist()
    return pdf.assign(node=np.arange(len(pdf)), start=starts, near=near)[
        ["dim", "shard", "node", "start", "ids", "vector", "near"]]


def _found(v: np.ndarray, near: list, start: int, q: np.ndarray, beam: int):
    """(query's place, nodes found) in one group of a shard."""
    graph = np.full((len(v), max(1, max(map(len, near)))), -1, dtype=np.int64)
    for i, g in enumerate(near):
        graph[i, :len(g)] = g
    x = _scaled(v, v)[0]
    y, far = _scaled(q, v)
    for rows, kind in ((np.flatnonzero(~far), np.float32), (np.flatnonzero(far), np.float64)):
        xk = x.astype(kind)
        for at in range(0, len(rows), BATCH):
            some = rows[at:at + BATCH]
            yield from zip(some, beam_search(xk, graph, start, y[some].astype(kind), beam)[0])


def _search_cell(k: int, beam: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if index.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        index = index.sort_values("node")
        v = np.array(index["vector"].tolist(), dtype=np.float64)
        q = np.array(queries["vector"].tolist(), dtype=np.float64)
        ids, out = index["ids"].tolist(), []
        own = queries["query_id"].tolist()
        starts, nodes = index["start"].to_numpy(), [[] for _ in q]
        for start in np.unique(starts):
            group = np.flatnonzero(starts == start)
            near = [np.searchsorted(group, g) for g in index["near"].iloc[group]]
            for i, f in _found(v[group], near, int(np.searchsorted(group, start)), q, max(beam, k + 1)):
                nodes[i].append(group[f[f >= 0]])
        for i, parts in enumerate(nodes):
            f = np.concatenate(parts)
            score = np.sqrt(np.square(v[f] - q[i]).sum(axis=1))
            near = np.argsort(score, kind="stable")
            # Nodes up to the (k+1)-th, with what ties with it.
            near = near[score[near] <= score[near[min(k, len(near) - 1)]]]
            best = sorted((score[j], one) for j in near for one in ids[f[j]] if one != own[i])[:k]
            out += [(own[i], one, s) for s, one in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return run


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda c: c != 0), F.lit(False))


def build_index(vectors: DataFrame, k: int = 10, shard: int = SHARD) -> DataFrame:
    """The index of (vec_id, vector): a row for each distinct vector, with its graph edges."""
    w = Window.partitionBy("vector").orderBy("vec_id")
    nodes = (vectors.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= k + 1)
             .groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
             .withColumn("dim", F.size("vector")).checkpoint())
    shards = max(1, -(-nodes.count() // shard))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInPandas(_build_shard, INDEX_SCHEMA)


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest found for each query (query_id, vector)."""
    blocks = max(1, -(-queries.count() // block))
    asked = queries.select("query_id", "vector", F.size("vector").alias("q_dim"),
                           F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("q_block"))
    shards = index.select(F.col("dim").alias("q_dim"), F.col("shard").alias("q_shard")).distinct()
    # The stated query set against all rows, in (shard, block) cells of bounded size.
    to_all = asked.join(shards, "q_dim")
    cells = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = (cells.groupBy("dim", "shard", "block").cogroup(to_all.groupBy("q_dim", "q_shard", "q_block"))
             .applyInPandas(_search_cell(k, beam), FOUND_SCHEMA))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def nearest(embeddings: DataFrame, k: int = 10, every: int = 100, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """The k nearest found of every row whose id is divisible by ``every``."""
    prepare(embeddings.sparkSession)
    v = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
         .where(F.col("vec_id").isNotNull() & usable(F.col("vector"))))
    index = build_index(v, k, shard).checkpoint()
    queries = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    return search(index, queries, k, beam)
