"""Retrieval: exact cosine top-k (J-15), version de-dup (W-08), incident relevance
re-ranking (R-01/R-02), technique mapping (R-03/W-07), retrieval quality (E-25).

Exact top-k with pivots: the corpus is dealt into cells, each row to the pivot (a corpus row) of the least angle; pivots number
as many as cells of ``rows_per_block`` rows, ``MAX_PIVOTS`` at most, so they and a radius each can go to every task. The angle
is a metric: a row of a cell is no nearer to a query than the query's angle to the pivot less the cell's radius.

1. Each query is scored in the cell of its nearest pivot; that gives its k-th best score so far.
2. It goes on only to the cells whose bound reaches that score, all others are skipped whole.

Neighbouring cells are packed into blocks of ``BLOCK_ROWS`` rows (a larger cell is cut by hash), and a query goes once to each block that
holds a cell it must see; the task finds those cells again and scores only them. A task loads one block and streams its queries
through in tiles of ``TILE`` scores, whatever the tables' size. With few blocks and many queries the queries of a block are
dealt to several tasks (``LANES`` in all), each with a copy of the block. Pairs are never emitted, only each block's top-k per query; ties go by (score, id) in a block and in the merge, so
the result does not depend on the cells. How much is skipped depends on the vectors: clusters prune well, vectors without structure
in many dimensions hardly at all (``cells_scored`` counts it).

A tile is scored in single precision and only finds the pairs that may reach the query's k-th score, within the bound of its rounding error;
these few are scored again in double precision, and only such scores are compared or returned.
With a ``doc_col`` all versions of a document are in one block and the version preference (W-08) is applied before ranking: without a threshold
a block scores one row a document, the preferred one, and looks at another version only for the query that is that row itself.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from tidewatch.functions.exprs import incident_score, jaccard
from tidewatch.session import checkpoint_dir, ship_package

RESULT_SCHEMA = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("corpus_id", T.StringType()),
    T.StructField("score", T.DoubleType()),
])
ARROW_RESULT = pa.schema([("query_id", pa.string()), ("corpus_id", pa.string()), ("score", pa.float64())])


def _norms(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return n


def _unit(m: np.ndarray) -> np.ndarray:
    return m / _norms(m)


def _matrix(col: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column as rows, in the precision they have."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if col.null_count or (np.diff(col.offsets.to_numpy()) != len(flat) // max(1, len(col))).any():
        raise ValueError("vectors must be present and of one length")
    return flat.reshape(len(col), -1)


def _directions(col: pa.Array) -> np.ndarray:
    return _unit(_matrix(col).astype(np.float64))


#: Pivots at most: 4,096 vectors go to each task with their radii.
MAX_PIVOTS = 4096
#: Rows to a block, and angles or pairs that a task holds at once.
BLOCK_ROWS = 100_000
SCORES = 1 << 22
#: Queries and rows to a tile of scores, which stays in the processor's cache.
TILE = (128, 4096)
#: Tasks that few blocks are dealt to at most, and queries to a task below which they are not.
LANES, LANE_QUERIES = 96, 10_000
#: Slack of an angle for rounding, and of a score.
SLACK = 1e-6
ROUNDING = 1e-9


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _slices(n: int, width: int):
    """Slices of ``n`` rows, with ``SCORES`` values of ``width`` a row at most."""
    step = max(1, SCORES // max(1, width))
    return (slice(a, a + step) for a in range(0, n, step))


def _reached(units: np.ndarray, floor: np.ndarray, pivots: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Whether a cell may hold a row that reaches the query's ``floor``."""
    reach = np.cos(np.clip(_angles(units, pivots) - radii - SLACK, 0.0, np.pi))
    reach[~units.any(axis=1)] = 0.0  # such a query has score 0 with every row
    return reach + SLACK >= floor[:, None]


class _Block:
    """One block of the corpus, its rows in the order of their cells; ``best`` scores queries in it."""

    def __init__(self, rows: pd.DataFrame, vecs: np.ndarray, k: int, threshold: float | None, exclude_self: bool, dedup: bool, preferred: str | None):
        self.k, self.threshold, self.exclude_self, self.dedup = k, threshold, exclude_self, dedup
        by = np.argsort(rows["cell"].to_numpy(), kind="stable")
        if (by[1:] < by[:-1]).any():
            rows, vecs = rows.iloc[by], vecs[by]
        self.vecs, self.norms, units = vecs, np.empty((len(vecs), 1)), np.empty(vecs.shape, np.float32)
        for part in _slices(len(vecs), vecs.shape[1]):
            m = vecs[part].astype(np.float64)
            self.norms[part] = _norms(m)
            units[part] = m / self.norms[part]
        # A score of single precision is no farther from the true one; a kept pair may err by it twice.
        self.margin = 2 * (vecs.shape[1] + 4) * 2.0 ** -24 + ROUNDING
        self.ids = rows["id"].to_numpy()
        self.order = np.empty(len(self.ids), np.int64)  # of the ids among the block's
        by = pc.array_sort_indices(pa.array([x or "" for x in self.ids], pa.string())).to_numpy()
        self.order[by] = np.arange(len(self.ids))
        self.code, known = pd.factorize(_named(self.ids))
        self.known = pd.Index(known, dtype=object)
        # The rows of each id, for the query that has it.
        self.by_code = np.argsort(self.code, kind="stable")
        self.code_at = np.searchsorted(self.code[self.by_code], np.arange(len(known) + 1))
        kept = np.flatnonzero(np.isfinite(units).all(axis=1))
        self.before = self.other = None
        if dedup:
            kept = self._versions(rows, kept, preferred)
        if not dedup or threshold is None:
            kept = kept[self._within_copies(kept)]
        self.rows = kept
        self.units = units if len(kept) == len(units) else units[kept]
        self.cells, self.cell_at = np.unique(rows["cell"].to_numpy(), return_inverse=True)

    def _versions(self, rows: pd.DataFrame, kept: np.ndarray, preferred: str | None) -> np.ndarray:
        """W-08: a query's representative of a document is the document's first row in preference order (preferred version, then higher version)
        that survives the filters. Returns the rows to score: the first ones, or with a threshold all."""
        ver = rows["ver"].to_numpy().astype(str)[kept]
        pref = (ver == preferred) if preferred is not None else np.zeros(len(ver), bool)
        doc = pd.factorize(rows["doc"].to_numpy()[kept], use_na_sentinel=False)[0]
        by = np.lexsort((-np.unique(ver, return_inverse=True)[1], ~pref, doc))
        at, doc = kept[by], doc[by]
        new = np.ones(len(at), bool)
        new[1:] = doc[1:] != doc[:-1]
        head = at[np.flatnonzero(new)]  # by document
        if self.threshold is not None:
            self.before = np.full(len(self.ids), -1)
            self.before[at[1:][~new[1:]]] = at[:-1][~new[1:]]
            return kept
        # For the query that is a document's first row: the first row of another id.
        self.other = np.full(len(self.ids), -1)
        rest = np.flatnonzero(self.code[at] != self.code[head[doc]])
        docs, i = np.unique(doc[rest], return_index=True)
        self.other[head[docs]] = at[rest[i]]
        return np.sort(head)

    def _within_copies(self, kept: np.ndarray) -> np.ndarray:
        """Of equal vectors the rows of the first k + 1 ids are enough: a query is one id at most."""
        vecs, use = self.vecs, np.ones(len(kept), bool)
        rng, mark = np.random.RandomState(1).rand(vecs.shape[1]), np.empty(len(kept))
        for part in _slices(len(kept), vecs.shape[1]):
            mark[part] = (vecs[kept[part]] * rng).sum(axis=1)
        _, group, count = np.unique(mark, return_inverse=True, return_counts=True)
        many = np.flatnonzero(count[group] > self.k + 1)
        many = many[np.lexsort((self.order[kept[many]], group[many]))]
        for g in np.split(many, np.flatnonzero(np.diff(group[many])) + 1) if len(many) else ():
            g = g[(vecs[kept[g]] == vecs[kept[g[0]]]).all(axis=1)]
            code = self.code[kept[g]]
            use[g[np.cumsum(np.r_[0, code[1:] != code[:-1]]) > self.k]] = False
        return use

    def best(self, queries: pd.DataFrame, index: tuple, first: bool, vecs: np.ndarray | None = None):
        """(query, row, score) of each query's first k rows, in frames of one slice of the queries."""
        pivots, radii = index
        vecs = np.stack(queries["vec"].to_numpy()) if vecs is None else vecs
        qid, near = queries["id"].to_numpy(), queries["cell"].to_numpy()
        floor = queries["floor"].fillna(-np.inf).to_numpy(np.float64)
        code = self.known.get_indexer(_named(qid)) if self.exclude_self else np.full(len(qid), -1)
        cell_at, step = self.cell_at[self.rows], TILE[0]
        for part in _slices(len(qid), max(len(self.cells), vecs.shape[1])):
            units = _unit(vecs[part].astype(np.float64))
            go = near[part, None] == self.cells
            if not first:
                at = self.cells >= 0
                go = ~go
                go[:, at] &= _reached(units, floor[part], pivots[self.cells[at]], radii[self.cells[at]])
                go[:, ~at] &= (floor[part] <= SLACK)[:, None]  # rows without a direction score 0
            todo = np.flatnonzero(go.any(axis=1))
            todo = todo[np.argsort(near[part][todo], kind="stable")]  # queries of one cell go on to much the same cells
            if first:
                cuts = np.r_[0, np.flatnonzero(np.diff(near[part][todo])) + 1, len(todo)]
                groups = [todo[i:min(i + step, b)] for a, b in zip(cuts[:-1], cuts[1:]) for i in range(a, b, step)]
            else:
                groups = [todo[i:i + step] for i in range(0, len(todo), step)]
            found = []
            for q in groups:
                used = go[q].any(axis=0)
                some = None if used.all() else np.flatnonzero(used[cell_at])
                f = floor[part][q].copy()
                at, row, score = self._found(units[q], f, some, code[part][q], near[part][q], first)
                found.append((part.start + q[at], row, score))
            if found:
                q, row, score = (np.concatenate(x) for x in zip(*found))
                yield pd.DataFrame({"query_id": qid[q], "corpus_id": self.ids[row], "score": score})

    def _own(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the rows that have the query's id."""
        a, n = self.code_at[code], np.where(code < 0, 0, self.code_at[code + 1] - self.code_at[code])
        q = np.repeat(np.arange(len(code)), n)
        return q, self.by_code[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]

    def _found(self, units, floor, some, code, near, first: bool):
        """(query, row, score) of the first k rows of a few queries; ``some``: the places of the rows to score."""
        small, n = units.astype(np.float32), len(self.rows) if some is None else len(some)
        if self.threshold is not None:
            floor = np.maximum(floor, self.threshold)
        own_q, own_row = self._own(code)
        got, held, buffer = [], 0, np.empty(len(units) * min(n, TILE[1]), np.float32)
        if self.other is not None:
            row = self.other[own_row]
            got.append((own_q[row >= 0], row[row >= 0]))
        for a in range(0, n, TILE[1]):
            at = slice(a, min(a + TILE[1], n)) if some is None else some[a:a + TILE[1]]
            rows = self.units[at]
            S = np.dot(small, rows.T, out=buffer[:len(small) * len(rows)].reshape(len(small), len(rows)))
            over = S >= (floor - self.margin)[:, None].astype(np.float32)
            if np.count_nonzero(over) > 8 * (self.k + 1) * len(S):
                floor = np.maximum(floor, self._raised(S, self.rows[at], own_q, own_row))
                over = S >= (floor - self.margin)[:, None].astype(np.float32)
            pair = _places(over)
            got.append((pair // len(rows), self.rows[at][pair % len(rows)]))
            held += len(pair)
            if held > SCORES // 8:
                got = [self._ranked(units, got, code, near, first)]
                floor = np.maximum(floor, self._kth(got[0][0], got[0][2], len(units)))
                got, held = [got[0][:2]], len(got[0][0])
        return self._ranked(units, got, code, near, first)

    def _raised(self, S, rows, own_q, own_row) -> np.ndarray:
        """A floor for each query from a tile's scores: the k-th of the maxima of groups of rows, all rows that the query may have."""
        if self.exclude_self:
            place = np.full(len(self.ids), -1)
            place[rows] = np.arange(len(rows))
            mine = place[own_row]
            S[own_q[mine >= 0], mine[mine >= 0]] = -np.inf
        if self.before is not None:  # a later version counts only if those before it do not
            S = np.where(self.before[rows] < 0, S, -np.inf)
        groups = min(S.shape[1], max(64, 4 * self.k))
        if groups < self.k:
            return np.full(len(S), -np.inf)
        each = S.shape[1] // groups
        top = np.ascontiguousarray(S[:, :each * groups]).reshape(len(S), each, groups).max(axis=1)
        top = np.partition(top, groups - self.k, axis=1)[:, groups - self.k].astype(np.float64)
        if self.before is not None:
            top[~(top - self.margin >= self.threshold)] = -np.inf
        return np.where(np.isnan(top), -np.inf, top)

    def _scores(self, units, q, row) -> np.ndarray:
        score = np.empty(len(q))
        for part in _slices(len(q), self.vecs.shape[1]):
            r = row[part]
            score[part] = (units[q[part]] * (self.vecs[r].astype(np.float64) / self.norms[r])).sum(axis=1)  # the same for equal rows, wherever they stand
        return score

    def _kth(self, q, score, n: int) -> np.ndarray:
        """Each query's k-th of the ranked rows, if it has so many."""
        out, last = np.full(n, -np.inf), np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == self.k - 1)
        out[q[last]] = score[last]
        return out

    def _ranked(self, units, got, code, near, first: bool):
        """Each query's first k of the pairs by (score, id), in double precision: equal scores go to the smaller ids."""
        q, row = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 2
        # The nearest cell is scored in the first round, all others in the second.
        ok = (self.cells[self.cell_at[row]] == near[q]) == first
        if self.exclude_self:
            ok &= self.code[row] != code[q]
        q, row = q[ok], row[ok]
        score = self._scores(units, q, row)
        ok = np.isfinite(score) if self.threshold is None else score >= self.threshold
        if self.before is not None:
            ok &= self._represents(units, q, row, code)
        q, row, score = q[ok], row[ok], score[ok]
        by = np.lexsort((self.order[row], -score, q))
        q, row, score = q[by], row[by], score[by]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        return q[keep], row[keep], score[keep]

    def _represents(self, units, q, row, code) -> np.ndarray:
        """Whether no earlier row of the document survives the filters."""
        ok, at = np.ones(len(q), bool), self.before[row]
        while len(i := np.flatnonzero(ok & (at >= 0))):
            live = self._scores(units, q[i], at[i]) >= self.threshold
            if self.exclude_self:
                live &= self.code[at[i]] != code[q[i]]
            ok[i[live]] = False
            at[i] = self.before[at[i]]
        return ok


def _named(ids: np.ndarray) -> np.ndarray:
    """The ids, a null one as a text that no table can hold."""
    out = np.empty(len(ids), dtype=object)
    out[:] = ["\udfff" if x is None else x for x in ids]
    return out


def _places(mask: np.ndarray) -> np.ndarray:
    """The flat places of the few that are true: found by words of eight, then by bytes."""
    flat = mask.ravel()
    words = np.flatnonzero(flat[:len(flat) // 8 * 8].view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], np.flatnonzero(flat[len(flat) // 8 * 8:]) + len(flat) // 8 * 8])


def _scored(visits: DataFrame, index: "_Index", lanes: int, first: bool, k: int, threshold, exclude_self: bool, dedup: bool, preferred) -> DataFrame:
    """Each visiting query's top-k of each block. Both sides meet sorted: a block's rows, then its queries, in batches."""
    # Several partitions a block and lane, so that few of them share one.
    n = max(int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2000, 4 * index.n_blocks * lanes))
    keys, at = ["flt", "grp", "sub", "lane"], (index.pivots, index.radii)
    rows = (index.rows.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
            .select(*keys, F.lit(0).alias("kind"), "cell", "id", "vec", "doc", "ver", F.lit(None).cast("double").alias("floor")))
    asked = visits.withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int"))
    rows = rows.unionByName(asked.select(*keys, F.lit(1).alias("kind"), "cell", "id", "vec", F.lit("").alias("doc"), F.lit("").alias("ver"), "floor"))
    rows = rows.repartition(n, *keys).sortWithinPartitions(*keys, "kind", "cell")

    def run(it):
        at_key, parts, block = None, [], None
        for batch in it:
            marks = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "kind")]
            cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                key, g = tuple(m[a] for m in marks[:-1]), batch.slice(a, b - a)
                if key != at_key:
                    at_key, parts, block = key, [], None
                vecs = _matrix(g.column("vec"))
                if marks[-1][a] == 0:
                    parts.append((g.select(["id", "cell", "doc", "ver"]).to_pandas(), vecs))
                    continue
                if parts and block is None:
                    frame, vectors = pd.concat([x for x, _ in parts], ignore_index=True), np.concatenate([x for _, x in parts])
                    parts = []
                    block = _Block(frame, vectors, k, threshold, exclude_self, dedup, preferred)
                if block is not None:
                    for out in block.best(g.select(["id", "cell", "floor"]).to_pandas(), at, first, vecs):
                        yield pa.RecordBatch.from_pandas(out, ARROW_RESULT, preserve_index=False)

    return rows.mapInArrow(run, RESULT_SCHEMA)


def _celled(c: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The rows with the ``cell`` of their nearest pivot; rows without a direction are cell -1."""
    schema = T.StructType([*c.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(it):
        for batch in it:
            for part in _slices(batch.num_rows, len(pivots)):
                rows = batch.slice(part.start, part.stop - part.start)
                units = _directions(rows.column("vec"))
                yield _with(rows, cell=np.where(~units.any(axis=1), -1, _angles(units, pivots).argmin(axis=1)).astype(np.int32))
    return c.mapInArrow(run, schema)


def _with(rows: pa.RecordBatch, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, columns.values())], [*rows.schema.names, *columns])


class _Index:
    """A corpus in cells: written ``rows`` with (cell, grp, sub), ``blocks`` (flt, grp, subs), pivots, radii and the cells' groups."""

    def __init__(self, corpus: DataFrame, rows_per_block: int, docs: bool = False):
        n = corpus.count()
        want = min(MAX_PIVOTS, max(1, math.ceil(n / rows_per_block)))
        picked = corpus.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(want).collect()
        pivots = np.stack([np.asarray(r["vec"], dtype=np.float64) for r in picked]) if picked else np.zeros((1, 1))
        self.pivots, self.empty, self.rows_per_cell = _unit(pivots), not picked, rows_per_block
        dealt = _celled(corpus, self.pivots)
        # A document's rows follow its first one.
        if docs:
            home = dealt.where("doc <> ''").groupBy("flt", "doc").agg(F.min(F.struct((F.col("cell") < 0).alias("none"), "id", "cell")).alias("h")).select("flt", "doc", F.col("h.cell").alias("home"))
            dealt = dealt.join(home, ["flt", "doc"], "left").withColumn("cell", F.coalesce("home", "cell")).drop("home")
        dealt = dealt.checkpoint()
        # One row a cell: the most rows that any filter value has in it.
        sizes = np.zeros(len(self.pivots) + 1, np.int64)
        for r in dealt.groupBy("flt", "cell").agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg(F.max("n").alias("n")).collect():
            sizes[r["cell"]] = r["n"]
        self.used, self.group = sizes > 0, self._packed(sizes)
        groups = corpus.sparkSession.createDataFrame([(c - (c == len(self.pivots)) * (c + 1), int(g)) for c, g in enumerate(self.group)], "cell int, grp int")
        dealt = dealt.join(groups, "cell")
        self.blocks = dealt.groupBy("flt", "grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("subs")).checkpoint()
        self.n_blocks = self.blocks.agg(F.sum("subs")).first()[0] or 1
        key = F.when(F.col("doc") != "", F.col("doc")).otherwise(F.col("id"))
        self.rows = dealt.join(self.blocks, ["flt", "grp"]).withColumn("sub", F.pmod(F.xxhash64(key), F.col("subs")).cast("int"))
        self.radii = self._radii(dealt)

    def _packed(self, sizes: np.ndarray) -> np.ndarray:
        """Each cell's group (the rows without a direction, last, are their own): neighbours together, up to ``BLOCK_ROWS`` rows."""
        group = np.zeros(len(sizes), np.int32)
        leaders = self.pivots[:max(1, math.ceil(int(sizes.sum()) / BLOCK_ROWS))]
        held, at = 0, 0
        for c in np.argsort(_angles(self.pivots, leaders).argmin(axis=1), kind="stable"):
            if held and held + sizes[c] > BLOCK_ROWS:
                held, at = 0, at + 1
            held, group[c] = held + sizes[c], at
        group[-1] = at + 1
        return group

    def _radii(self, dealt: DataFrame) -> np.ndarray:
        pivots = self.pivots

        def run(it):
            for batch in it:
                cell, units = batch.column("cell").to_numpy(), _directions(batch.column("vec"))
                cell, units = cell[cell >= 0], units[cell >= 0]
                if len(cell):
                    # A row without a direction has score 0 with any query, as if it were at a right angle to all.
                    a = np.where(units.any(axis=1), np.arccos(np.clip((units * pivots[cell]).sum(axis=1), -1.0, 1.0)), np.pi)
                    most = pd.DataFrame({"cell": cell, "angle": a}).groupby("cell", as_index=False).max()
                    yield pa.RecordBatch.from_pandas(most, preserve_index=False)
        top = dealt.select("cell", "vec").mapInArrow(run, "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("r")).collect()
        radii = np.zeros(len(pivots))
        for r in top:  # one row a pivot
            radii[r["cell"]] = r["r"]
        return radii

    def visits(self, queries: DataFrame, first: bool) -> DataFrame:
        """(id, vec, flt, floor, cell, cells, grp, sub): each query at the block of its nearest ``cell``, or at the blocks of all others that its
        ``floor`` does not rule out; ``cells`` is how many of them the block holds."""
        pivots, radii, used, group, empty = self.pivots, self.radii, self.used, self.group, self.empty

        def run(it):
            for batch in it:
                for part in _slices(0 if empty else batch.num_rows, 4 * len(pivots)):
                    rows = batch.slice(part.start, part.stop - part.start)
                    units = _directions(rows.column("vec"))
                    near = _angles(units, pivots).argmin(axis=1)
                    rows = _with(rows, cell=near.astype(np.int32))
                    if first:
                        yield _with(rows, cells=np.ones(len(near), np.int64), grp=group[near])
                        continue
                    floor = rows.column("floor").fill_null(-np.inf).to_numpy()
                    go = np.column_stack([_reached(units, floor, pivots, radii), floor <= SLACK]) & used
                    go[np.arange(len(near)), near] = False
                    q, cell = np.nonzero(go)
                    pair, cells = np.unique(q * np.int64(len(group)) + group[cell], return_counts=True)
                    for out in _slices(len(pair), 4 * units.shape[1]):
                        q, grp = np.divmod(pair[out], len(group))
                        yield _with(rows.take(pa.array(q)), cells=cells[out].astype(np.int64), grp=grp.astype(np.int32))

        schema = T.StructType([*queries.select("id", "vec", "flt", "floor").schema.fields, T.StructField("cell", T.IntegerType()),
                               T.StructField("cells", T.LongType()), T.StructField("grp", T.IntegerType())])
        out = queries.select("id", "vec", "flt", "floor").mapInArrow(run, schema)
        return out.join(self.blocks, ["flt", "grp"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs")


def _sides(queries, corpus, query_id, query_vec, corpus_id, corpus_vec, filter_cols, doc_col, version_col):
    fq = F.col(filter_cols[0]).cast("string") if filter_cols else F.lit("")
    fc = F.col(filter_cols[1]).cast("string") if filter_cols else F.lit("")
    # Vectors of single precision are sent as such; every score is of double precision.
    single = all(df.select(x).schema[0].dataType.simpleString() == "array<float>" for df, x in ((queries, query_vec), (corpus, corpus_vec)))
    kind = "array<float>" if single else "array<double>"
    c = corpus.select(F.col(corpus_id).cast("string").alias("id"), F.col(corpus_vec).cast(kind).alias("vec"), fc.alias("flt"),
                      (F.col(doc_col).cast("string") if doc_col else F.lit("")).alias("doc"),
                      (F.col(version_col).cast("string") if version_col else F.lit("")).alias("ver"))
    q = queries.select(F.col(query_id).cast("string").alias("id"), F.col(query_vec).cast(kind).alias("vec"), fq.alias("flt"))
    # An equality filter is part of the cell's key: pairs that differ in it never meet.
    return q.where("flt is not null"), c.where("flt is not null")


def _rounds(q: DataFrame, index: _Index, k: int, threshold, exclude_self, dedup, preferred) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The candidates of both rounds, and the visits of each."""
    lanes = max(1, min(math.ceil(q.count() / LANE_QUERIES), math.ceil(LANES / index.n_blocks)))
    one = index.visits(q.withColumn("floor", F.lit(None).cast("double")), True)
    # A query's own cell is a small part of its block; each lane more sorts and sends the block once more.
    few = min(lanes, max(math.ceil(lanes * index.rows_per_cell / BLOCK_ROWS), math.ceil(LANES / 8 / index.n_blocks)))
    near = _scored(one, index, few, True, k, threshold, exclude_self, dedup, preferred).checkpoint()
    # The k-th best score so far; with fewer, nothing is ruled out but by the threshold.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    floor = near.withColumn("_r", rank).where(F.col("_r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    base = F.lit(None).cast("double") if threshold is None else F.lit(float(threshold))
    two = index.visits(q.join(floor, "id", "left").withColumn("floor", F.coalesce("floor", base)).select("id", "vec", "flt", "floor"), False)
    return near.unionByName(_scored(two, index, lanes, False, k, threshold, exclude_self, dedup, preferred)), one, two


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "id", query_vec: str = "vec",
                corpus_id: str = "id", corpus_vec: str = "vec", filter_cols: tuple[str, str] | None = None,
                threshold: float | None = None, exclude_self: bool = False, doc_col: str | None = None,
                version_col: str | None = None, preferred_version: str | None = None, rows_per_block: int = 20000) -> DataFrame:
    """J-15 exact: for each query the ``k`` most cosine-similar corpus rows (score >= threshold,
    equal filter payload), ties broken by corpus id. Returns (query_id, corpus_id, score, rank)."""
    spark = corpus.sparkSession
    ship_package(spark)
    checkpoint_dir(spark)
    q, c = _sides(queries, corpus, query_id, query_vec, corpus_id, corpus_vec, filter_cols, doc_col, version_col)
    cand = _rounds(q, _Index(c, rows_per_block, doc_col is not None), k, threshold, exclude_self, doc_col is not None, preferred_version)[0]
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("corpus_id"))
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cells_scored(queries: DataFrame, corpus: DataFrame, k: int, *, rows_per_block: int = 20000, exclude_self: bool = False) -> DataFrame:
    """One row: queries, cells (``blocks``), the visits that scoring every cell takes, and those that the pivots leave."""
    spark = corpus.sparkSession
    ship_package(spark)
    checkpoint_dir(spark)
    q, c = _sides(queries, corpus, "id", "vec", "id", "vec", None, None, None)
    index = _Index(c, rows_per_block)
    _, one, two = _rounds(q, index, k, None, exclude_self, False, None)
    made = one.where("sub = 0").select("cells").unionByName(two.where("sub = 0").select("cells")).agg(F.sum("cells").alias("visits"))
    return (q.agg(F.count(F.lit(1)).alias("queries")).crossJoin(made).withColumn("blocks", F.lit(int(index.used.sum())).cast("bigint"))
            .select("queries", "blocks", (F.col("queries") * F.col("blocks")).alias("all_visits"), "visits"))


def relevance_rerank(hits: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 5, *,
                     default_age_days: float = 30.0) -> DataFrame:
    """R-02: vector hits -> payload (age default 30 d) -> R-01 composite -> re-ranked top-k.

    ``queries``: (query_id, tenant_id, techniques); ``corpus``: (corpus_id, tenant_id, techniques,
    age_days, rare_important)."""
    q = queries.select("query_id", F.col("tenant_id").alias("q_tenant"), F.col("techniques").alias("q_tech"))
    c = corpus.select("corpus_id", F.col("tenant_id").alias("c_tenant"), F.col("techniques").alias("c_tech"),
                      "age_days", "rare_important")
    j = hits.join(q, "query_id").join(c, "corpus_id")
    age = F.coalesce(F.col("age_days").cast("double"), F.lit(default_age_days))
    overlap = jaccard(F.col("q_tech"), F.col("c_tech"))
    j = j.withColumn("technique_overlap", overlap).withColumn(
        "composite", incident_score(F.col("score"), age, F.col("q_tenant") == F.col("c_tenant"), overlap,
                                    F.col("rare_important")))
    w = Window.partitionBy("query_id").orderBy(F.desc("composite"), F.asc("corpus_id"))
    return j.withColumn("rerank", F.row_number().over(w)).where(F.col("rerank") <= k)


def best_per_key(candidates: DataFrame, keys: list[str], score: str = "confidence") -> DataFrame:
    """W-07: highest-confidence row per key across sources (ties: source name)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc("source"))
    return candidates.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def retrieval_quality(hits: DataFrame, relevant_counts: DataFrame, relevance: Column) -> DataFrame:
    """E-25: Hit@1, Hit@3, NDCG@5 over ranked hits with binary relevance.

    ``hits`` has (query_id, rank, ...); ``relevance`` marks a hit relevant; ``relevant_counts``
    has (query_id, n_relevant) for the ideal DCG."""
    h = hits.withColumn("_rel", relevance.cast("int"))
    per_q = h.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("_rel"))).alias("hit1"),
        F.max(F.when(F.col("rank") <= 3, F.col("_rel"))).alias("hit3"),
        F.sum(F.when(F.col("rank") <= 5, F.col("_rel") / F.log2(F.col("rank") + 1))).alias("dcg"))
    ideal = relevant_counts.select("query_id", F.aggregate(
        F.sequence(F.lit(1), F.least(F.lit(5), F.greatest(F.col("n_relevant"), F.lit(1)))),
        F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / F.log2(i + 1)).alias("idcg"),
        (F.col("n_relevant") > 0).alias("_has"))
    j = per_q.join(ideal, "query_id").withColumn(
        "ndcg", F.when(F.col("_has"), F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("idcg")).otherwise(0.0))
    return j.agg(F.count(F.lit(1)).alias("queries"),
                 F.avg(F.coalesce(F.col("hit1"), F.lit(0))).alias("hit_at_1"),
                 F.avg(F.coalesce(F.col("hit3"), F.lit(0))).alias("hit_at_3"),
                 F.avg("ndcg").alias("ndcg_at_5"))


# ---------------------------------------------------------------------------
# X-03 pluggable embedding function, X-04 embedding migration
# ---------------------------------------------------------------------------

CURRENT_EMBEDDING_VERSION = "2"


def hashing_embedder(dim: int = 64):
    """X-03: a deterministic text -> unit vector function as an Arrow-batched Pandas UDF
    (feature hashing of lower-cased word tokens over the whole text). Any other
    ``pandas_udf(array<float>)`` model can be passed to ``migrate_embeddings`` instead."""
    import re as _re
    import zlib

    token = _re.compile(r"\w+", _re.UNICODE)

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim, dtype=np.float64)
            if t:
                for w in token.findall(t.lower()):
                    h = zlib.crc32(w.encode("utf-8"))
                    v[h % dim] += 1.0 if (h >> 16) & 1 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n > 0 else v).astype(np.float32))
        return pd.Series(out)
    return embed


def migrate_embeddings(points: DataFrame, embed_udf, *, target_version: str = CURRENT_EMBEDDING_VERSION,
                       model_id: str = "hashing-64", dims: int = 64, id_col: str = "id",
                       text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """X-04: re-embed every point that has no ``{id}_v{target}`` twin yet (left anti-join, so a
    re-run after a failure only does the rest: idempotent by id); rows without text are counted
    and skipped. Returns (new points to append, progress counters)."""
    ship_package(points.sparkSession)
    new_id = F.concat(F.col(id_col).cast("string"), F.lit(f"_v{target_version}"))
    src = points.where(~F.col(id_col).cast("string").endswith(f"_v{target_version}"))
    done = points.select(F.col(id_col).cast("string").alias("_nid"))
    todo = src.withColumn("_nid", new_id).join(done, "_nid", "left_anti")
    has_text = F.col(text_col).isNotNull() & (F.trim(F.col(text_col)) != "")
    migrated = (todo.where(has_text)
                .select(F.col("_nid").alias(id_col), embed_udf(F.col(text_col)).alias("vector"),
                        F.lit(model_id).alias("embedding_model_id"), F.lit(dims).alias("embedding_dimensions"),
                        F.lit(target_version).alias("embedding_version")))
    progress = todo.agg(F.count(F.lit(1)).alias("pending"), F.count_if(has_text).alias("migrated"),
                        F.count_if(~has_text).alias("skipped_no_text"))
    return migrated, progress


def token_count(text: str = "text", chars_per_token: int = 4) -> Column:
    """The tokens of a whole text, as E-26 counts them."""
    return F.floor(F.length(text) / chars_per_token).cast("bigint")


def assemble_context(candidates: DataFrame, budget_tokens: int = 4096, chars_per_token: int = 4) -> DataFrame:
    """E-26: cross-store de-duplication (best score per query and document, then store name),
    source attribution kept, and the token budget enforced by a running sum in score order:
    an item is kept while the total including it stays within the budget.

    ``candidates``: (query_id, doc_id, store, score, text), or with ``tokens`` (``token_count`` of the text, made where the
    documents are read) for the text, so that texts are not copied to every query that finds them. Windows are per query (bounded)."""
    best = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), F.asc("store"))
    d = candidates if "tokens" in candidates.columns else candidates.withColumn("tokens", token_count("text", chars_per_token))
    d = d.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == 1).drop("_r")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    d = d.withColumn("position", F.row_number().over(order)).withColumn(
        "tokens_so_far", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where(F.col("tokens_so_far") <= budget_tokens)


def embedding_text(docs: DataFrame) -> Column:
    """E-23: the text to embed, built per ``doc_type`` from its meaningful fields (lines joined by
    newlines, empty parts dropped; unknown types: space-joined string fields longer than 10 chars).
    Missing columns count as empty."""
    cols = set(docs.columns)

    def s(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in cols else F.lit("")

    def lst(c, n=None):
        if c not in cols:
            return F.lit("")
        a = F.coalesce(F.col(c), F.array().cast("array<string>"))
        return F.array_join(F.slice(a, 1, n) if n else a, ", ")

    def lines(*parts):
        return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n")
    steps = (F.transform(F.coalesce(F.col("steps"), F.array()), lambda st: F.concat(
        F.lit("Step "), st["step"].cast("string"), F.lit(": "), st["action"], F.lit(" - "), st["description"]))
        if "steps" in cols else F.array().cast("array<string>"))
    t = F.col("doc_type")
    fallback = F.array_join(F.filter(F.array(*[s(c) for c in sorted(cols) if dict(docs.dtypes)[c] == "string"]),
                                     lambda v: F.length(v) > 10), " ")
    return (F.when(t == "mitre_technique", lines(
                F.concat(F.lit("MITRE ATT&CK Technique "), s("technique_id"), F.lit(": "), s("technique_name")),
                s("description"), F.concat(F.lit("Detection: "), s("detection")),
                F.concat(F.lit("Platforms: "), lst("platforms")), F.concat(F.lit("Used by: "), lst("groups_using", 5))))
            .when(t == "mitre_group", lines(
                F.concat(F.lit("Threat Group: "), s("group_name")), F.concat(F.lit("Aliases: "), lst("aliases")),
                s("description"), F.concat(F.lit("Target sectors: "), lst("target_sectors"))))
            .when(t == "threat_intel_report", lines(
                s("title"), s("summary"), F.concat(F.lit("Threat actors: "), lst("threat_actors")),
                F.concat(F.lit("MITRE techniques: "), lst("mitre_techniques")), s("detection_guidance")))
            .when(t == "playbook", F.array_join(F.filter(F.concat(F.array(
                s("title"), F.concat(F.lit("Category: "), s("category")),
                F.concat(F.lit("MITRE techniques: "), lst("mitre_techniques"))), steps), lambda p: p != ""), "\n"))
            .when(t == "incident_memory", lines(
                F.concat(F.lit("Alert: "), s("alert_name")), s("investigation_summary"),
                F.concat(F.lit("Classification: "), s("classification")), s("lessons_learned")))
            .otherwise(fallback))
