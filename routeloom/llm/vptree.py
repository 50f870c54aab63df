"""Nearest neighbours by inner product with vantage-point trees, one for each shard.

A further coordinate, sqrt(M² - |x|²) with M the largest norm, turns the largest inner product into the smallest
Euclidean distance. Vectors are dealt to the nearest of some pivots, and large cells to several shards. A query first
searches a shard of the cell nearest to it; what it finds bounds the distance of its k-th best. Then it goes to the
other shards, but for cells whose ring around the pivot holds nothing nearer by the triangle inequality. In a shard's
tree a node keeps a vantage point and the median distance to it; a block of queries descends together, each to its
nearer side first, and sides are left out by the same inequality. `factor` scales the bound: one keeps the search
exact, above one it leaves out more.

Trees only choose candidates. Their scores are sums of products in double precision, by one formula, and vectors
that tie with the last place are all compared by vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stored

SHARD, BLOCK, LEAF = 8192, 1024, 128
PIVOTS = 1024  # cells at most: what is sent to all tasks doesn't grow with the vectors
ROWS = "dim int, vec_id long, v array<double>, cell int, far double, home int, asks boolean"
FOUND = "dim int, query_id long, query_tie long, v array<double>, cell int, sub int, ids array<long>, scores array<double>"


class Tree:
    """Over distinct vectors; of equal ones the `keep` smallest ids are held."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int, top: float | None = None):
        vectors = np.ascontiguousarray(vectors, np.float64) + 0.0  # no negative zeros
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, of = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        self.vectors = vectors[first]
        by = np.argsort(of, kind="stable")  # ids stay ascending
        self.ids = [g[:keep] for g in np.split(ids[by], np.cumsum(np.bincount(of))[:-1])]
        self.least = np.array([g[0] for g in self.ids], np.int64)
        norms = (self.vectors**2).sum(axis=1)
        self.top = max(norms.max(), top or 0.0)
        self.points = np.hstack([self.vectors, np.sqrt(np.maximum(self.top - norms, 0))[:, None]])
        self.root = self._build(np.arange(len(self.points)), np.random.default_rng(len(ids)))

    def _build(self, own: np.ndarray, rng: np.random.Generator):
        if len(own) <= LEAF:
            return own
        centre = self.points[rng.choice(own)]
        far = np.sqrt(((self.points[own] - centre) ** 2).sum(axis=1))
        median = np.median(far)
        inner = far <= median
        if inner.all():
            return own
        return centre, median, self._build(own[inner], rng), self._build(own[~inner], rng)

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(classes, inner products) of the k best distinct vectors for each query, best first; class -1: none.

        Ties go to the smaller first id. `known`: inner products that k others reach elsewhere; worse ones may be left out.
        """
        n = len(queries)
        self.exact, self.q = queries, np.hstack([queries, np.zeros((n, 1))])
        self.base = (queries**2).sum(axis=1) + self.top
        self.near = slack(self.base, queries.shape[1])
        self.blur = 1e-15 * queries.shape[1] * self.base  # of a matrix product against the one formula
        self.known = np.full(n, -np.inf) if known is None else known
        self.best, self.which = np.full((n, k), -np.inf), np.full((n, k), -1)
        self.factor = factor
        self._visit(self.root, np.arange(n))
        return self.which, self.best

    def _least(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.best[rows, -1], self.known[rows])

    def _leaf(self, own: np.ndarray, rows: np.ndarray) -> None:
        k = self.best.shape[1]
        about = self.q[rows] @ self.points[own].T
        least = self._least(rows)
        if len(own) > k:
            least = np.maximum(least, np.partition(about, len(own) - k, axis=1)[:, len(own) - k] - self.blur[rows])
        r, c = np.nonzero(about >= (least - self.blur[rows])[:, None])
        if not len(r):
            return
        scores = (self.vectors[own[c]] * self.exact[rows[r]]).sum(axis=1)
        some, of = np.unique(r, return_inverse=True)
        line = np.concatenate([np.repeat(np.arange(len(some)), k), of])
        which = np.concatenate([self.which[rows[some]].ravel(), own[c]])
        scores = np.concatenate([self.best[rows[some]].ravel(), scores])
        order = np.lexsort((self.least[which], -scores, line))
        begin = np.searchsorted(line[order], np.arange(len(some)))
        take = order[begin[:, None] + np.arange(k)]
        self.best[rows[some]], self.which[rows[some]] = scores[take], which[take]

    def _visit(self, node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if not isinstance(node, tuple):
            for own in np.split(node, range(4 * LEAF, len(node), 4 * LEAF)):
                self._leaf(own, rows)
            return
        centre, median, inner, outer = node
        d = np.sqrt(np.maximum(((self.q[rows] - centre) ** 2).sum(axis=1), 0))
        near = d <= median
        for side, first in ((inner, near), (outer, ~near)):
            self._visit(side, rows[first])
        for side, second, gap in ((inner, ~near, d - median), (outer, near, median - d)):
            some = rows[second]
            bound = np.sqrt(np.maximum(self.base[some] - 2 * self._least(some), 0))
            self._visit(side, some[gap[second] * self.factor <= bound + self.near[some]])


def slack(base: np.ndarray, dim: int) -> np.ndarray:
    """Error of a distance whose square is a difference of numbers of the size of `base`."""
    return 1e-7 * np.sqrt((dim + 1) * base)


def usable(vectors: DataFrame) -> DataFrame:
    """dim, vec_id, v (doubles) of the rows that take part: no null, zero or non-finite vectors; equal rows count once."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.where(fit).distinct().select(F.size("v").alias("dim"), "vec_id", "v")


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = b.column(0).to_numpy()
    for d in np.unique(dims):
        yield int(d), b.filter(pa.array(dims == d))


def distances(q: np.ndarray, last: np.ndarray, points: np.ndarray) -> np.ndarray:
    """From each row of `q` with the further coordinate `last` to each of `points`."""
    full = np.hstack([q, last[:, None]])
    return np.sqrt(np.maximum((full**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * full @ points.T, 0))


def dealt(rows: DataFrame, every: int, shard: int) -> tuple[DataFrame, dict, dict]:
    """(`rows` with cell, distance to its pivot, nearest cell as a query; points of pivots and largest squared norm by dim)."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = {r["dim"]: (r["n"], r["top"]) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top")).collect()}
    pivots = {}
    for d, (n, top) in sizes.items():
        wanted = min(PIVOTS, -(-n // shard))
        share = min(1 << 30, (4 * wanted + 16) * (1 << 30) // n)  # about four times as many, and every copy of one or none
        some = rows.where((F.col("dim") == d) & (F.pmod(F.xxhash64("v"), F.lit(1 << 30)) <= share)).select("v").distinct()
        drawn = [r["v"] for r in some.orderBy(F.xxhash64("v")).limit(wanted).collect()] or [rows.where(F.col("dim") == d).first()["v"]]
        x = np.array(drawn, np.float64)
        pivots[d] = np.hstack([x, np.sqrt(np.maximum(top - (x**2).sum(axis=1), 0))[:, None]]), top
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, b in by_dim(batch):
                points, top = shared.value[dim]
                x = matrix(b.column(2))
                far = distances(x, np.sqrt(np.maximum(top - (x**2).sum(axis=1), 0)), points)
                cell, home = far.argmin(axis=1), distances(x, np.zeros(len(x)), points).argmin(axis=1)
                yield pa.record_batch([*b.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(x)), cell]), pa.array(home, pa.int32()), pa.array(b.column(1).to_numpy() % every == 0)], names=[x.split()[0] for x in ROWS.split(", ")])

    return stored(rows.select("dim", "vec_id", "v").mapInArrow(assign, ROWS), "cells"), shared, sizes


def searched(shards: DataFrame, asked: DataFrame, tops: dict[int, float], k: int, factor: float) -> DataFrame:
    """Of each row of `asked` (dim, cell, sub, query_id, query_tie, v, least) the k best of its shard, as FOUND.

    A task reads a shard's vectors, then streams the queries for it by: it holds a shard and a block at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, tree = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)  # dim, cell, sub, kind
            cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                part, at = batch.slice(lo, hi - lo), tuple(keys[lo][:3].tolist())
                if at != key:
                    key, own, tree = at, [], None
                if keys[lo][3] == 0:
                    own.append((part.column(4).to_numpy(), matrix(part.column(6))))
                    continue
                if own:
                    tree, own = Tree(*map(np.concatenate, zip(*own, strict=True)), k + 1, tops[key[0]]), []
                for i in range(0, len(part), BLOCK):
                    yield answers(tree, part.slice(i, BLOCK), key, k, factor)

    both = shards.select("dim", "cell", "sub", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("tie"), "v", F.lit(0.0).alias("least"))
    both = both.union(asked.select("dim", "cell", "sub", F.lit(1), "query_id", "query_tie", "v", "least"))
    return both.repartition("dim", "cell", "sub").sortWithinPartitions("dim", "cell", "sub", "kind").mapInArrow(run, FOUND)


def answers(tree: Tree | None, part: pa.RecordBatch, key: tuple[int, int, int], k: int, factor: float) -> pa.RecordBatch:
    ids, q = part.column(4).to_numpy(), np.ascontiguousarray(matrix(part.column(6)))
    which, best = tree.search(q, k + 1, factor, part.column(7).to_numpy()) if tree else (np.full((len(q), 1), -1),) * 2
    found, scores = [], []
    for i, me in enumerate(ids.tolist()):
        hits = []
        for c, s in zip(which[i].tolist(), best[i].tolist(), strict=True):
            if c < 0:
                break
            itself = me in tree.ids[c] and (tree.vectors[c] == q[i]).all()
            hits += [(-s, v) for v in tree.ids[c].tolist() if not (itself and v == me)]
        hits = sorted(hits)[:k]
        found.append([v for _, v in hits])
        scores.append([-s for s, _ in hits])
    same = [pa.array([x] * len(ids), pa.int32()) for x in key]
    return pa.record_batch([same[0], part.column(4), part.column(5), part.column(6), same[1], same[2], pa.array(found, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], names=[x.split()[0] for x in FOUND.split(", ")])


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, factor: float = 1.0, shard: int = SHARD) -> DataFrame:
    """The k nearest others of each row whose vec_id is divisible by `every`: query_id, rank, vec_id, score.

    `vectors` has vec_id and embedding; other columns are not read. Vectors of different lengths don't meet. Rows
    equal in both count once; rows of one vec_id with different vectors are each a query and a candidate, but never
    their own. Ties go to the smaller vec_id. Null, zero and non-finite vectors take no part; without others a query
    has no rows. Norms beyond 1e150 overflow.

    All tasks get the pivots (`PIVOTS` for each length at most) and each cell's ring. A shard holds `shard` vectors,
    about, of a cell; its vectors travel twice, a query travels to the shards its bound does not leave out.
    """
    rows = stored(usable(vectors), "vectors")
    cells, shared, sizes = dealt(rows, every, shard)
    rings = cells.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()
    subs = rows.sparkSession.createDataFrame([(r["dim"], r["cell"], -(-r["n"] // shard)) for r in rings], "dim int, cell int, subs int")
    table: dict[int, dict[int, tuple]] = {}
    for r in rings:
        table.setdefault(r["dim"], {})[r["cell"]] = (r["low"], r["high"], -(-r["n"] // shard))
    tops = {d: top for d, (_, top) in sizes.items()}
    number = F.pmod(F.xxhash64("vec_id", "v"), F.col("subs")).cast("int").alias("sub")
    shards = cells.join(F.broadcast(subs), ["dim", "cell"]).select("dim", "cell", number, "vec_id", "v")
    asked = cells.where("asks").select("dim", "vec_id", "v", F.col("home").alias("cell"))
    asked = asked.join(F.broadcast(subs), ["dim", "cell"], "left").select("dim", F.coalesce("cell", F.lit(0)).alias("cell"), F.coalesce(number, F.lit(0)).alias("sub"), F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("query_tie"), "v", F.lit(float("-inf")).alias("least"))
    first = stored(searched(shards, asked, tops, k, factor), "home")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, b in by_dim(batch):
                q, scores = matrix(b.column(3)), b.column(7).to_pylist()
                points, top = shared.value[dim]
                least = np.array([s[-1] if len(s) == k else -np.inf for s in scores])
                base = (q**2).sum(axis=1) + top
                bound = np.sqrt(np.maximum(base - 2 * least, 0)) + 2 * slack(base, dim)
                far = distances(q, np.zeros(len(q)), points)
                for cell, (low, high, n) in table[dim].items():
                    go = np.nonzero(np.maximum(far[:, cell] - high, low - far[:, cell]) * factor <= bound)[0]
                    at, sub = np.repeat(go, n), np.tile(np.arange(n, dtype=np.int32), len(go))
                    new = (b.column(4).to_numpy()[at] != cell) | (b.column(5).to_numpy()[at] != sub)
                    some, sub = b.take(pa.array(at[new])), sub[new]
                    yield pa.record_batch([some.column(0), pa.array(np.full(len(sub), cell), pa.int32()), pa.array(sub), some.column(1), some.column(2), some.column(3), pa.array(least[at[new]])], names=["dim", "cell", "sub", "query_id", "query_tie", "v", "least"])

    others = first.mapInArrow(route, "dim int, cell int, sub int, query_id long, query_tie long, v array<double>, least double")
    found = stored(first.select("query_id", "query_tie", "ids", "scores").union(searched(shards, others, tops, k, factor).select("query_id", "query_tie", "ids", "scores")), "found")
    release(rows, cells, first)
    order = Window.partitionBy("query_id", "query_tie").orderBy(F.desc("score"), "vec_id")
    each = found.select("query_id", "query_tie", F.explode(F.arrays_zip("ids", "scores")).alias("f")).select("query_id", "query_tie", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
