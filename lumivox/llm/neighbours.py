"""Approximate nearest neighbours by inner product, over stable projections in kd-trees.

Largest inner products become smallest distances by one more coordinate that brings
every candidate to the same length. Gaussian projections to DIMS dimensions keep
distances up to a chi-square factor: a candidate at distance r lies within
r * sqrt(x) of the query in the projection with the probability chi2_DIMS(x). So a
search visits projected space outwards from the query, verifies what it meets with
the original vectors, and stops when the next region is farther than the distance
to the k-th best so far times the root of the CONFIDENCE quantile.

The top of the kd-tree is fitted on a bounded sample and deals all rows into cells;
each cell's task builds the tree below. Queries visit cells from the nearest outwards
in rounds of growing size; after each round the k-th best so far bounds what may
follow, and a query ends when its next cell fails the stopping test.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumivox.llm.common import cut, table

K, EVERY = 20, 20
DIMS, CONFIDENCE = 8, 0.96
#: Rows that the driver fits the top of the tree on, at most, and rows of the sample that a leaf needs.
SAMPLE, LEAF_SAMPLE = 65_536, 8
#: Rows of a cell that one task takes, rows of a bucket in it, queries that meet a cell at a time.
CELL_ROWS, BUCKET_ROWS, QUERY_ROWS = 8192, 512, 20_000
#: Leaves of the top, at most; cells that a query visits in the first round, and the factor from round to round.
LEAVES = SAMPLE // LEAF_SAMPLE
FIRST, GROWTH = 1, 4
#: Distances between queries and leaves that are held at a time.
DISTANCES = 1 << 21

log = logging.getLogger(__name__)


def chi_square_quantile(share: float, dims: int) -> float:
    """x with chi2_dims(x) = share, for an even number of dimensions."""
    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    low, high = 0.0, 1.0
    while below(high) < share:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < share else (low, mid)
    return high


@dataclass
class Tree:
    """kd-tree over projected rows: ``order`` of rows, ``cuts`` between buckets, and their boxes."""

    order: np.ndarray
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, most: int) -> Tree:
        """Halve the widest dimension at its median until buckets hold ``most`` rows."""
        stack, buckets = [np.arange(len(points))], []
        while stack:
            rows = stack.pop()
            own = points[rows]
            if len(rows) <= most:
                buckets.append(rows)
                continue
            axis = int(np.argmax(own.max(0) - own.min(0)))
            ranked = rows[np.argsort(own[:, axis], kind="stable")]
            stack += [ranked[len(rows) // 2 :], ranked[: len(rows) // 2]]
        return cls(
            np.concatenate(buckets), np.cumsum([0, *map(len, buckets)]),
            np.array([points[b].min(0) for b in buckets]), np.array([points[b].max(0) for b in buckets]),
        )


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, d] - points[:, None, d], points[:, None, d] - high[None, :, d]), 0)
        out += gap * gap
    return out


@dataclass
class Space:
    """The projection and the top of the tree: regions of projected space, by their cutting planes."""

    planes: np.ndarray  # (dims + 1, DIMS)
    length: float  # squared length that candidates are brought to
    axes: np.ndarray
    values: np.ndarray
    depth: int

    @classmethod
    def fit(cls, sample: np.ndarray, length: float, dims: int, leaves: int, seed: int) -> Space:
        planes = np.random.default_rng(seed).normal(size=(dims + 1, DIMS))
        depth = max(0, math.ceil(math.log2(max(1, min(leaves, LEAVES, len(sample) // LEAF_SAMPLE)))))
        space = cls(planes, length, np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1), depth)
        groups = [space.candidates(sample)]
        for level in range(depth):
            following = []
            for n, own in enumerate(groups):
                node = (1 << level) - 1 + n
                if len(own):
                    space.axes[node] = np.argmax(own.max(0) - own.min(0))
                    space.values[node] = np.median(own[:, space.axes[node]])
                right = own[:, space.axes[node]] > space.values[node]
                following += [own[~right], own[right]]
            groups = following
        return space

    def candidates(self, vectors: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.length - (vectors * vectors).sum(1), 0))
        return vectors @ self.planes[:-1] + last[:, None] * self.planes[-1]

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.planes[:-1]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axes[node]] > self.values[node])
        return node - ((1 << self.depth) - 1)

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest coordinates of every leaf, without end at the rim."""
        low, high = [np.full(DIMS, -np.inf)], [np.full(DIMS, np.inf)]
        for level in range(self.depth):
            lows, highs = [], []
            for n in range(1 << level):
                node = (1 << level) - 1 + n
                left_high, right_low = high[n].copy(), low[n].copy()
                left_high[self.axes[node]] = right_low[self.axes[node]] = self.values[node]
                lows += [low[n], right_low]
                highs += [left_high, high[n]]
            low, high = lows, highs
        return np.array(low), np.array(high)


def vectors_of(rows: pa.Table) -> np.ndarray:
    column = rows.column("v").combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties to the smaller id; rows come in no order."""
    if scores.shape[1] <= k:
        return scores, ids
    pick = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    worst = np.take_along_axis(scores, pick, 1).min(1)
    for r in np.flatnonzero((scores >= worst[:, None]).sum(1) > k):
        pick[r] = np.lexsort((ids[r], -scores[r]))[:k]
    return np.take_along_axis(scores, pick, 1), np.take_along_axis(ids, pick, 1)


class Search:
    """One cell's rows below the top of the tree, and the search of a block of queries there."""

    def __init__(self, space: Space, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.space, ids, vectors = space, ids[order], vectors[order]
        self.tree = Tree.of(space.candidates(vectors), BUCKET_ROWS)
        self.ids, self.vectors = ids[self.tree.order], vectors[self.tree.order]

    def run(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of each query's k best (-inf: none), outwards until the test holds.

        ``floor`` has k-th best scores known before; lower ones are of no use.
        """
        tree = self.tree
        scores = np.full((len(queries), k), -np.inf)
        ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        near = box_distances(self.space.queries(queries), tree.low, tree.high)
        order = np.argsort(near, axis=1, kind="stable")
        lengths = (queries * queries).sum(1) + self.space.length
        left = np.arange(len(queries))
        for step in range(len(tree.low)):
            bucket = order[left, step]
            kth = np.maximum(floor[left], scores[left].min(1))
            reach = np.where(np.isfinite(kth), np.maximum(lengths[left] - 2 * kth, 0) * factor, np.inf)
            left = left[near[left, bucket] <= reach]
            bucket = order[left, step]
            for b in np.unique(bucket):
                own = left[bucket == b]
                rows = slice(tree.cuts[b], tree.cuts[b + 1])
                found = queries[own] @ self.vectors[rows].T
                found[self.ids[rows][None, :] == query_ids[own][:, None]] = -np.inf
                all_ids = np.concatenate([ids[own], np.broadcast_to(self.ids[rows], found.shape)], 1)
                scores[own], ids[own] = best(np.concatenate([scores[own], found], 1), all_ids, k)
        return scores, ids


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): one finite, non-zero vector of the usual length for each id."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, confidence: float = CONFIDENCE, seed: int = 5) -> DataFrame:
    """The k candidates of largest inner product of every row whose vec_id ``every`` divides.

    Returns query_id, rank (from 1), vec_id, score. Candidates are all rows but the
    query's own; ties go to the smaller vec_id; with fewer than k candidates all are
    returned. Vectors that are null, zero, of unusual length, or hold null or
    non-finite numbers take no part, nor do null ids; rows that repeat a vec_id count
    once, with the smallest vector. No rows give no rows.

    Cells of more than CELL_ROWS rows (many equal vectors, say) are split by a hash of
    the id; where more than QUERY_ROWS queries meet a cell in a round, they do so in
    blocks, and only that cell's vectors are sent once for each block.
    """
    rows = cut(usable(vectors))
    spark = rows.sparkSession
    total, length, dims = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow() if total > SAMPLE else rows.select("v").toArrow()
    space = Space.fit(vectors_of(sample), length, dims, -(-total // CELL_ROWS), seed)
    factor = chi_square_quantile(confidence, DIMS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = vectors_of(pa.Table.from_batches([batch]))
            leaves = space.leaf(space.candidates(found)) if len(found) else np.empty(0, np.int64)
            yield batch.append_column("leaf", pa.array(leaves.astype(np.int32)))

    placed = cut(rows.mapInArrow(place, "vec_id long, v array<double>, leaf int"))
    chunks = {leaf: -(-n // CELL_ROWS) for leaf, n in sorted(placed.groupBy("leaf").count().collect())}  # at most LEAVES rows
    leaves = np.array(list(chunks))
    number = np.array(list(chunks.values()))
    first = np.cumsum(number) - number
    spread = spark.createDataFrame(list(zip(*(x.tolist() for x in (leaves, first, number)))), "leaf int, first int, number int")
    cell = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("number"))).cast("int").alias("cell")
    placed = placed.join(F.broadcast(spread), "leaf").select(cell, "vec_id", "v")
    low, high = (x[leaves] for x in space.boxes())

    def ahead(queries: DataFrame, start: int, step: int) -> DataFrame:
        """The queries whose next cells pass the stopping test, with these of their cells from ``start`` on in the order of distance."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            few = max(1, DISTANCES // len(leaves))
            for batch in batches:
                for part in (batch.slice(at, few) for at in range(0, batch.num_rows, few)):
                    found, floor = vectors_of(pa.Table.from_batches([part])), part.column("floor").to_numpy()
                    most = np.where(np.isfinite(floor), np.maximum((found * found).sum(1) + length - 2 * floor, 0) * factor, np.inf)
                    far = box_distances(space.queries(found), low, high)
                    order = np.argsort(far, axis=1, kind="stable")[:, start : start + step]
                    open_ = np.take_along_axis(far, order, 1) <= most[:, None]
                    cells = [[c for i in own[ok].tolist() for c in range(first[i], first[i] + number[i])] for own, ok in zip(order, open_)]
                    kept = pa.array([bool(x) for x in cells])
                    yield part.append_column("cells", pa.array(cells, pa.list_(pa.int32()))).filter(kept)

        return queries.mapInArrow(run, "query_id long, v array<double>, floor double, cells array<int>")

    def search(q: pa.Table, p: pa.Table) -> pa.Table:
        if not len(q) or not len(p):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])
        ids, floor = q.column("query_id").to_numpy(), q.column("floor").to_numpy()
        scores, found = Search(space, p.column("vec_id").to_numpy(), vectors_of(p)).run(ids, vectors_of(q), floor, k, factor)
        useful = np.isfinite(scores) & (scores >= floor[:, None])
        query = np.broadcast_to(ids[:, None], scores.shape)
        return pa.table([pa.array(query[useful]), pa.array(found[useful]), pa.array(scores[useful])], ["query_id", "vec_id", "score"])

    def visited(asked: DataFrame) -> DataFrame:
        """What queries find in the cells they visit this round; cells that nobody visits are not sent."""
        sent = asked.select("query_id", "v", "floor", F.explode("cells").alias("cell"))
        blocks = sent.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
        sent = sent.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
        dealt = placed.join(blocks, "cell").select("cell", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        return sent.groupBy("cell", "block").cogroup(dealt.groupBy("cell", "block")).applyInArrow(search, "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asked = cut(ahead(placed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", F.lit(float("-inf")).alias("floor")), 0, FIRST))
    best, start, step = None, 0, FIRST
    while not asked.isEmpty():
        met = visited(asked)
        log.info("cells %d to %d: visits %s", start, start + step, asked.agg(F.count("*"), F.sum(F.size("cells"))).first() if log.isEnabledFor(logging.INFO) else "")
        best = top(met if best is None else best.drop("rank").unionByName(met))
        start, step = start + step, step * GROWTH
        if start >= len(leaves):
            break
        best = cut(best)
        # a hair lower: the same product may differ in its last bit when another cell computes it
        floor = F.when(F.count("*") >= k, F.min("score") - 1e-9 * (1 + F.abs(F.min("score"))))
        known = best.groupBy("query_id").agg(floor.alias("known"))
        asked = cut(ahead(asked.select("query_id", "v").join(known, "query_id", "left").select("query_id", "v", F.coalesce("known", F.lit(float("-inf"))).alias("floor")), start, step))
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return best.select("query_id", "rank", "vec_id", "score")


def op5_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
