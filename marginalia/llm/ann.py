"""Approximate nearest neighbours: stable projections in a kd-tree, verified in projected order until a chi-square test holds.

Every vector is projected to ``dims`` coordinates by a seeded Gaussian matrix. The squared projected distance of a point at
true distance d is d^2 times a chi-square variable of ``dims`` degrees of freedom. A query visits points in order of projected
distance and verifies their true distances; once the next projected distance r and the k-th best true distance d
satisfy ``P(chi2 <= r^2 / d^2) >= confidence``, a better neighbour would have to be further out than that with a chance of less than
1 - confidence, and the search ends.

The kd-tree's top is fitted on a sample of about ``fit_rows`` projected vectors and cuts the space into at most ``max_cells`` cells;
every vector is indexed. A cell is dealt to parts of about ``part_rows`` vectors, each with the rest of the tree over its own.

1. Each query searches the parts of its own cell, which gives a first k-th best distance d.
2. It then goes to those other cells alone whose box is nearer than the test allows for d, and takes d along as a bound.

Equal vectors are one point of the index with its k + 1 smallest ids, and queries of equal vectors are searched once, so a large
group of copies is linear. A task holds one part and streams the queries past it.

Distances are Euclidean in double precision on the original vectors, ties go to the smaller id. Vectors that are null, zero or
hold null or non-finite components take no part; nor do rows without an id. Vectors of unlike length have no distance: each
query meets those of its own length. A query never meets rows of its own id; rows of equal id and vector count once, and the
nearest to any of its vectors counts for an id that has several. An empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.tables import take_columns, tidy, written

LEAF, CHUNK, SEED = 64, 64, 5
DIMS, CONFIDENCE = 16, 0.95
PART_ROWS, FIT_ROWS, MAX_CELLS = 16_384, 20_000, 1024


def chi_square_quantile(p: float, dims: int) -> float:
    """x with P(chi2 with an even number dims of degrees of freedom <= x) = p, by bisection on the Poisson sum."""
    if dims % 2:
        raise ValueError("dims must be even")

    def below(x: float) -> float:
        term = total = math.exp(-x / 2)
        for k in range(1, dims // 2):
            term *= x / 2 / k
            total += term
        return 1 - total

    low, high = 0.0, 10.0 * dims + 100
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def matrix(width: int, dims: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).standard_normal((width, dims))


class Cells:
    """The top of the kd-tree: halves of a sample along its widest axis, down to ``cells`` boxes that fill the space."""

    def __init__(self, points: np.ndarray, cells: int) -> None:
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, cut, below, above; an inner node n, or cell c as -1 - c
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        dims = points.shape[1]
        self.root = self._grow(points, cells, np.full(dims, -np.inf), np.full(dims, np.inf))

    def _grow(self, points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        wide = points.max(axis=0) - points.min(axis=0) if len(points) > 1 else np.zeros(len(low))
        axis = int(np.argmax(wide)) if cells > 1 else 0
        cut = float(np.median(points[:, axis])) if cells > 1 and wide[axis] > 0 else math.inf
        below = points[:, axis] < cut if len(points) else np.zeros(0, bool)
        if cells < 2 or not below.any() or below.all():
            self.low.append(low), self.high.append(high)
            return -len(self.low)
        at = len(self.nodes)
        self.nodes.append((axis, cut, 0, 0))
        top, floor = high.copy(), low.copy()
        top[axis] = floor[axis] = cut
        self.nodes[at] = axis, cut, self._grow(points[below], cells // 2, low, top), self._grow(points[~below], cells - cells // 2, floor, high)
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.zeros(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                axis, cut, below, above = self.nodes[node]
                under = points[rows, axis] < cut
                todo += [(below, rows[under]), (above, rows[~under])]
        return out

    def within(self, point: np.ndarray, reach: float) -> np.ndarray:
        """Cells whose box is at a squared distance of reach at most."""
        gap = np.maximum(0, np.maximum(np.array(self.low) - point, point - np.array(self.high)))
        return np.flatnonzero((gap * gap).sum(axis=1) <= reach)


class Tree:
    """A kd-tree as its leaves: rows in order, and the box of each leaf."""

    def __init__(self, points: np.ndarray) -> None:
        self.order: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                self.order.append(rows)
                continue
            own = points[rows]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = len(rows) // 2
            cut = np.argpartition(own[:, axis], half)
            todo += [rows[cut[half:]], rows[cut[:half]]]
        self.low = np.array([points[r].min(axis=0) for r in self.order])
        self.high = np.array([points[r].max(axis=0) for r in self.order])

    def nearest_leaves(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by the squared distance of their boxes, with these distances."""
        gap = np.maximum(0, np.maximum(self.low - query, query - self.high))
        away = (gap * gap).sum(axis=1)
        order = np.argsort(away, kind="stable")
        return order, away[order]


class Part:
    """Vectors with their projections in a tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dims: int) -> None:
        self.ids, self.vectors = ids, vectors
        self.points = vectors @ matrix(vectors.shape[1], dims)
        self.tree = Tree(self.points)
        self.verified = 0

    def search(self, query: np.ndarray, projected: np.ndarray, own: int, k: int, limit: float, bound: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest verified for one query, none further than bound."""
        order, away = self.tree.nearest_leaves(projected)
        best_id, best = np.empty(0, np.int64), np.empty(0)
        waiting_d, waiting = np.empty(0), np.empty(0, np.int64)  # projected, in order, not yet verified
        leaf, step = 0, CHUNK
        while True:
            reach = limit * min(bound, best[-1] if len(best) == k else math.inf) ** 2
            # Open leaves until the next points to be verified are nearer than any box left.
            while leaf < len(order) and away[leaf] <= reach and (len(waiting) < step or waiting_d[step - 1] > away[leaf]):
                more = max(4, 2 * step // LEAF)
                rows = np.concatenate([self.tree.order[x] for x in order[leaf : leaf + more]])
                leaf = min(len(order), leaf + more)
                gap = self.points[rows] - projected
                d = np.concatenate([waiting_d, (gap * gap).sum(axis=1)])
                rows = np.concatenate([waiting, rows])
                by = np.argsort(d, kind="stable")
                waiting_d, waiting = d[by], rows[by]
            if not len(waiting) or waiting_d[0] > reach:
                return best_id, best
            n = min(step, int(np.searchsorted(waiting_d, reach, side="right")))
            rows, waiting, waiting_d = waiting[:n], waiting[n:], waiting_d[n:]
            step *= 2
            self.verified += n
            gap = self.vectors[rows] - query
            d = np.sqrt((gap * gap).sum(axis=1))
            stay = (self.ids[rows] != own) & (d <= bound)
            d, found = np.concatenate([best, d[stay]]), np.concatenate([best_id, self.ids[rows][stay]])
            by = np.lexsort((found, d))[:k]
            best, best_id = d[by], found[by]


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    for width in batch.column("width").unique().to_pylist():
        yield width, batch.filter(pc.equal(batch.column("width"), width))


def _met(rows: DataFrame, k: int, dims: int, limit: float) -> DataFrame:
    """(asker, found, score): the k best of each part for each query that is sent there.

    rows: width, cell, sub, kind (0 for vectors of the part, 1 for queries), id, bound, v. Sorted so that a part's vectors come before its queries.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, part = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("width", "cell", "sub", "kind")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for at, end in zip(edges, edges[1:], strict=False):
                *own, kind = keys[at].tolist()
                if own != key:
                    key, held, part = own, [], None
                some = batch.slice(at, end - at)
                ids, vectors = some.column("id").to_numpy(), _vectors(some, key[0])
                if kind == 0:
                    held.append((ids, vectors))
                    continue
                if part is None and held:
                    part = Part(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), dims)
                    held = []
                out = []
                if part is not None:
                    for q, query, projected, bound in zip(ids.tolist(), vectors, vectors @ matrix(key[0], dims), some.column("bound").to_pylist(), strict=True):
                        found, d = part.search(query, projected, q, k, limit, bound)
                        out.append((np.full(len(found), q), found, d))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(3)], names=["asker", "found", "score"])

    dealt = rows.repartition("width", "cell", "sub").sortWithinPartitions("width", "cell", "sub", "kind")
    return dealt.mapInArrow(tidy(meet), "asker long, found long, score double")


def _best(found: DataFrame, by: str, k: int, *order: str) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("int")).where(F.col("rank") <= k)


def nearest(
    table: DataFrame, k: int = 10, every: int = 100, dims: int = DIMS, confidence: float = CONFIDENCE, part_rows: int = PART_ROWS, fit_rows: int = FIT_ROWS, max_cells: int = MAX_CELLS, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for every query, a row whose id is divisible by ``every``, among all rows but those of its id."""
    v = F.col("v") if dict(table.dtypes)[vector_column] in ("array<float>", "array<double>") else F.col("v").cast("array<double>")
    own = take_columns(table, id_column, vector_column).toDF("id", "v").select(F.col("id").cast("long").alias("id"), F.size("v").alias("width"), v.alias("v"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    own = own.where(F.col("id").isNotNull() & sound)
    limit = chi_square_quantile(confidence, dims)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, some in _by_width(batch):
                points = _vectors(some, width) @ matrix(width, dims)
                yield pa.RecordBatch.from_arrays([some.column("width"), pa.array(list(points), pa.list_(pa.float64()))], names=["width", "p"])

    total = own.count()
    sample = own.where(F.pmod(F.xxhash64("id"), F.lit(max(1, total // fit_rows))) == 0).mapInArrow(tidy(project), "width int, p array<double>").toPandas()  # about fit_rows
    aim = min(max_cells, -(-total // part_rows))
    tops = {int(w): Cells(np.stack(g["p"].to_list()), max(1, aim * len(g) // len(sample))) for w, g in sample.groupby("width")}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, some in _by_width(batch):
                vectors = _vectors(some, width) + 0.0  # one zero, not two
                cell = tops[width].of(vectors @ matrix(width, dims)) if width in tops else np.zeros(len(vectors), np.int32)
                digest = [xxhash.xxh3_128_digest(x.tobytes()) for x in vectors]
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("width"), pa.array(cell), pa.array(digest, pa.binary()), some.column("v")], names=["id", "width", "cell", "digest", "v"])

    own = written(own.mapInArrow(tidy(assign), f"id long, width int, cell int, digest binary, v {dict(own.dtypes)['v']}"), "vectors")

    # Classes of equal vectors, by the smallest ids of those that have several rows; the rank is cut before the shuffle.
    several = own.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    firsts = _best(own.select("digest", "id").join(several, "digest", "left_semi").distinct(), "digest", k + 1, "id")
    shared = written(firsts.groupBy("digest").agg(F.array_sort(F.collect_list("id")).alias("ids")), "equal-vectors")
    copies = own.join(shared, "digest").where(F.col("id") == F.element_at("ids", 1)).groupBy("digest").agg(*(F.first(c).alias(c) for c in ("id", "width", "cell", "v")))
    points = own.join(shared, "digest", "left_anti").select("id", "width", "cell", "v").union(copies.select("id", "width", "cell", "v"))
    asked = own.where(F.col("id") % every == 0).select("id", "digest").distinct().join(shared, "digest", "left")
    asked = written(asked.select(F.col("id").alias("query_id"), F.coalesce(F.element_at("ids", 1), "id").alias("asker"), "ids"), "asked")
    askers = points.join(asked.select(F.col("asker").alias("id")).distinct(), "id", "left_semi")

    counts = points.groupBy("width", "cell").count().toPandas()  # at most max_cells, and one a length of vectors
    parts = {(int(r.width), int(r.cell)): -(-int(r["count"]) // part_rows) for _, r in counts.iterrows()}
    spots = own.sparkSession.createDataFrame([(w, c, n) for (w, c), n in parts.items()], "width int, cell int, subs int")
    dealt = points.join(F.broadcast(spots), ["width", "cell"]).select("width", "cell", F.pmod(F.xxhash64("id"), "subs").cast("int").alias("sub"), F.lit(0).alias("kind"), "id", F.lit(math.inf).alias("bound"), "v")
    each = F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")
    sent = lambda q: q.join(F.broadcast(spots), ["width", "cell"]).select("width", "cell", each, F.lit(1).alias("kind"), "id", "bound", "v")

    near = written(_met(dealt.union(sent(askers.withColumn("bound", F.lit(math.inf)))), k, dims, limit), "near")
    bounds = _best(near, "asker", k, "score", "found").groupBy(F.col("asker").alias("id")).agg(F.when(F.count(F.lit(1)) == k, F.max("score")).otherwise(math.inf).alias("bound"))
    further = askers.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(math.inf)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, some in _by_width(batch):
                projected = _vectors(some, width) @ matrix(width, dims)
                home, bound = some.column("cell").to_pylist(), some.column("bound").to_pylist()
                cells = [[int(c) for c in tops[width].within(p, limit * b * b) if c != h and (width, c) in parts] if width in tops else [] for p, h, b in zip(projected, home, bound, strict=True)]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("id", "width", "bound", "v")), pa.array(cells, pa.list_(pa.int32()))], names=["id", "width", "bound", "v", "cells"])

    further = further.select("id", "width", "cell", "bound", "v").mapInArrow(tidy(spread), f"id long, width int, bound double, v {dict(own.dtypes)['v']}, cells array<int>")
    further = further.select("id", "width", "bound", "v", F.explode("cells").alias("cell"))
    found = near.union(_met(dealt.union(sent(further)), k, dims, limit)) if len(parts) > 1 else near

    best = _best(found, "asker", k, "score", "found").select("asker", "found", "score")
    mates = shared.select(F.element_at("ids", 1).alias("found"), F.col("ids").alias("_ids"))
    best = best.join(mates, "found", "left").select("asker", "score", F.explode(F.coalesce("_ids", F.array("found"))).alias("vec_id"))
    others = asked.join(best, "asker").select("query_id", "vec_id", "score")
    equals = asked.select("query_id", F.explode("ids").alias("vec_id"), F.lit(0.0).alias("score"))
    every_one = others.union(equals).where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return _best(every_one, "query_id", k, "score", "vec_id").select("query_id", "rank", "vec_id", "score")
