"""Exact top-k by inner product with a KD-tree for each shard of the candidates.

A shard is a block of rows as a task reads them; its tree splits at the median
of the component with the widest range, and every node has a tight bounding
box.  Trees are built once and stored, a row for each.  The greatest inner
product of a query with a point in a box bounds all below it.  A query visits
the leaves of a tree best first and stops where the bound falls below its k-th
score so far; that score is carried from tree to tree within a task, and each
task hands on its best k.

Queries are stored in blocks too.  Every block meets every tree of its length in
cells of so many trees and so many blocks, dealt by one shuffle; a task holds
the blocks of its cell and reads the trees one after another.

Scores are exact at any size: where a double can't hold them it bounds them,
and those that the bound can't rule out are worked out in whole numbers.

Defined results: vectors that are null, or hold a null or a component whose
256-fold isn't finite, and rows without vec_id take no part; of several vectors under one
vec_id the least counts, component by component; no row with the query's vec_id
is a candidate; vectors meet only those of their own length; ranks go by the
exact score, and a score beyond 64 bits is shown as the nearest long that has a
negative; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import ready, result, write_table
from ._vectors import QUERY_ROWS, Best, blocks, ranked, usable

LEAF = 128
#: Products and sums of doubles are exact below this.
EXACT = float(1 << 53)
#: Components from here on have no finite 256-fold.
MOST = float(np.finfo(float).max / 256)
_LONG = (1 << 63) - 1
TREES = "size int, ids binary, points binary, low binary, high binary, nodes binary"
#: Trees, and blocks of queries, of a cell.
CELL, TURN = 16, 8


def quantized(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of doubles, as doubles that hold integers."""
    return np.floor(256.0 * x)


class KdTree:
    """Median splits with tight boxes over ``points``; those of a leaf lie together."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, nodes: np.ndarray) -> None:
        """``nodes``: for each its two children, -1 for a leaf, and where its points begin and end."""
        self.ids, self.points, self.low, self.high, self.nodes = ids, points, low, high, nodes
        self.largest = np.abs(points).max(axis=1, initial=0.0)

    @staticmethod
    def build(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> KdTree:
        low, high, nodes, order = [], [], [], np.arange(len(points))
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, z, parent, side = todo.pop()
            if parent >= 0:
                nodes[parent][side] = len(nodes)
            mine = points[order[a:z]]
            low.append(mine.min(axis=0))
            high.append(mine.max(axis=0))
            nodes.append([-1, -1, a, z])
            spread = high[-1] - low[-1]
            if z - a > leaf and spread.any():
                half = (z - a) // 2
                order[a:z] = order[a:z][np.argpartition(mine[:, int(spread.argmax())], half)]
                todo += [(a, a + half, len(nodes) - 1, 0), (a + half, z, len(nodes) - 1, 1)]
        return KdTree(ids[order], points[order], np.array(low), np.array(high), np.array(nodes, np.int64))

    def bounds(self, queries: np.ndarray, floor: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Leaves, and for each query the most that an inner product in each of them can be.

        Where a box on the way down stays below the query's ``floor`` the bound is -inf.
        """
        up, down = np.maximum(queries, 0.0), np.minimum(queries, 0.0)
        size = np.abs(queries).max(axis=1, initial=0.0)
        leaves, out = [], []
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, alive = todo.pop()
            largest = max(np.abs(self.low[node]).max(initial=0.0), np.abs(self.high[node]).max(initial=0.0))
            with np.errstate(over="ignore", invalid="ignore"):
                bound = up[alive] @ self.high[node] + down[alive] @ self.low[node] + slack(size[alive], largest, queries.shape[1])
                bound = np.where(np.isnan(bound), np.inf, bound)
            keep = bound >= floor[alive]
            alive, bound = alive[keep], bound[keep]
            if not len(alive):
                continue
            if self.nodes[node, 0] >= 0:
                todo += [(int(child), alive) for child in self.nodes[node, :2]]
            else:
                column = np.full(len(queries), -np.inf)
                column[alive] = bound
                leaves.append(node)
                out.append(column)
        return leaves, np.stack(out, axis=1) if out else np.zeros((len(queries), 0))


def slack(x, y, size: int):
    """How far a product in doubles may be off for components up to x and y; 0 where it is exact."""
    with np.errstate(over="ignore"):
        product = x * y * max(1, size)
    return np.where(product < EXACT, 0.0, product * 2.0**-50)


def search(best: Best, query_ids: np.ndarray, queries: np.ndarray, tree: KdTree) -> None:
    """Put the best of one tree into ``best``, whose keys are negative scores."""
    leaves, bounds = tree.bounds(queries, -best.kth)
    order = np.argsort(-bounds, axis=1, kind="stable")
    size = np.abs(queries).max(axis=1, initial=0.0)
    active = np.arange(len(queries))
    for step in range(len(leaves)):
        column = order[active, step]
        go = (bounds[active, column] >= -best.kth[active]) & (bounds[active, column] > -np.inf)
        active, column = active[go], column[go]
        if not len(active):
            break
        by_leaf = np.argsort(column, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(column[by_leaf]) != 0])
        found = []
        for a, z in zip(starts, [*starts[1:], len(by_leaf)], strict=True):
            asking = active[by_leaf[a:z]]
            first, last = tree.nodes[leaves[column[by_leaf[a]]], 2:]
            with np.errstate(over="ignore", invalid="ignore"):
                scores = queries[asking] @ tree.points[first:last].T
                off = slack(size[asking][:, None], tree.largest[first:last], queries.shape[1])
                # what overflows isn't a number and can't be ruled out
                q, c = np.nonzero(~(scores + off < _floor(best, asking, scores - off)[:, None]))
            other = query_ids[asking[q]] != tree.ids[first + c]
            q, c = q[other], c[other]
            found.append((asking[q], _keys(scores[q, c], off[q, c], queries, asking[q], tree.points, first + c), tree.ids[first + c]))
        if any(key.dtype == object for _, key, _ in found):
            found = [(q, np.array([int(x) for x in key], object), i) for q, key, i in found]
        best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _floor(best: Best, asking: np.ndarray, least: np.ndarray) -> np.ndarray:
    """A score that the k-th of each query can't be below, given what each candidate of a leaf has at least."""
    out = -best.kth[asking]
    if least.shape[1] > best.k:
        least = np.where(np.isnan(least), -np.inf, least)
        # one more than k, as one may be the query itself
        out = np.maximum(out, -np.partition(-least, best.k, axis=1)[:, best.k])
    return out


def _keys(scores: np.ndarray, off: np.ndarray, queries: np.ndarray, q: np.ndarray, points: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Negative scores: doubles where all are exact, else whole numbers."""
    if not off.any():
        return -scores
    out = np.empty(len(scores), object)
    for i in np.flatnonzero(off == 0):
        out[i] = -int(scores[i])
    for i in np.flatnonzero(off > 0):
        out[i] = -sum(int(a) * int(b) for a, b in zip(queries[q[i]], points[c[i]], strict=True))
    return out


def _sortable(key: int) -> str:
    """Texts in the order of whole numbers that 64 bits don't hold; empty for others."""
    if abs(key) < _LONG:
        return ""
    digits = str(abs(key))
    text = f"{len(digits):05d}{digits}"
    return text if key > 0 else text.translate(str.maketrans("0123456789", "9876543210"))


def _blob(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.binary())


def build_trees(rows: DataFrame) -> DataFrame:
    """A stored row with the tree of each shard of ``rows`` (usable), and its number."""
    ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points in blocks(batches):
            tree = KdTree.build(ids, quantized(points))
            parts = (tree.ids, tree.points, tree.low, tree.high, tree.nodes)
            yield pa.RecordBatch.from_arrays([pa.array([points.shape[1]], pa.int32()), *map(_blob, parts)], names)

    names = [f.split()[0] for f in TREES.split(", ")]
    return write_table(rows.mapInArrow(run, TREES).withColumn("number", F.monotonically_increasing_id()), "trees")


def query_blocks(rows: DataFrame, size: int | None = None) -> DataFrame:
    """``rows`` (usable) in stored blocks of about ``size`` vectors of one length, as rows of a tree without nodes, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points in blocks(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array([points.shape[1]], pa.int32()), _blob(ids), _blob(quantized(points)), *[pa.array([None], pa.binary())] * 3], names)

    names, size = [f.split()[0] for f in TREES.split(", ")], size or QUERY_ROWS
    dealt = rows.repartition(max(1, -(-rows.count() // size)), "vec_id")
    return write_table(dealt.mapInArrow(run, TREES).withColumn("number", F.monotonically_increasing_id()), "queries")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], np.ndarray, np.ndarray, tuple | None]]:
    """(cell, ids, points, rest of the tree) of each row; None for a block of queries."""
    for batch in batches:
        for i in range(batch.num_rows):
            *key, ids, points, low, high, nodes = (batch.column(c)[i] for c in range(batch.num_columns))
            key = tuple(x.as_py() for x in key)
            ids = np.frombuffer(ids.as_buffer(), np.int64)
            matrix = lambda x, n: np.frombuffer(x.as_buffer(), np.float64).reshape(n, key[0])  # noqa: B023, E731
            points = matrix(points, len(ids))
            if nodes.is_valid:
                nodes = np.frombuffer(nodes.as_buffer(), np.int64).reshape(-1, 4)
                yield key, ids, points, (matrix(low, len(nodes)), matrix(high, len(nodes)), nodes)
            else:
                yield key, ids, points, None


def _meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query in its cell; a cell's queries come before its trees."""

    def best() -> Iterator[pa.RecordBatch]:
        for ids, _, mine in held:
            keys = [int(x) for x in mine.key]
            columns = [pa.array(ids[mine.query]), pa.array(mine.id), pa.array([max(-_LONG, min(_LONG, x)) for x in keys], pa.int64()), pa.array([_sortable(x) for x in keys], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "key", "exact"])

    at, held = None, []
    for key, ids, points, rest in _matrices(batches):
        if key != at:
            yield from best()
            at, held = key, []
        if rest is None:
            held.append((ids, points, Best(len(ids), k, np.float64)))
            continue
        tree = KdTree(ids, points, *rest)
        for query_ids, block, mine in held:
            search(mine, query_ids, block, tree)
    yield from best()


def top_products(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries``, rows of vec_id and embedding, against ``vectors``."""
    return result(lambda: _top(vectors, queries, k), "products")


def _top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    trees, asked = build_trees(usable(vectors, False, MOST)), query_blocks(usable(queries, False, MOST))
    sizes = trees.groupBy("size").agg(F.count("*").alias("trees")).join(asked.groupBy("size").agg(F.count("*").alias("blocks")), "size")
    turns = F.ceil(F.col("blocks") / TURN)
    wide = F.ceil(F.lit(2 * vectors.sparkSession.sparkContext.defaultParallelism) / F.col("turns"))
    sizes = sizes.withColumn("turns", turns).withColumn("cells", F.least("trees", F.greatest(F.ceil(F.col("trees") / CELL), wide)))
    plan = write_table(sizes.select("size", F.col("turns").cast("int").alias("turns"), F.col("cells").cast("int").alias("cells")), "plan")  # a row for each length
    own = lambda n: F.pmod(F.xxhash64("number"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys, rest = ["size", "cell", "turn"], ["ids", "points", "low", "high", "nodes"]
    held = trees.join(plan, "size").withColumn("cell", own("cells")).withColumn("turn", every("turns")).select(*keys, *rest)
    ask = asked.join(plan, "size").withColumn("turn", own("turns")).withColumn("cell", every("cells")).select(*keys, *rest)
    met = held.union(ask).repartition(*keys).sortWithinPartitions(*keys, F.col("nodes").isNotNull()).select(*keys, *rest)
    found = ranked(met.mapInArrow(lambda b: _meet(b, k), "query_id long, vec_id long, key long, exact string"), k, "exact")
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", (-F.col("key")).alias("score"))


def op10_kdtree(spark, sf_dir: str) -> DataFrame:
    """The contract of operator 10 over the whole of ``embeddings``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_products(vectors, vectors.filter("pmod(vec_id, 50) = 0"), 5)


#: All pairs of a query and another vector.
ORACLE = """
WITH usable AS (
  SELECT vec_id, min(embedding) AS embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM usable
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM numbered WHERE rank <= 5
"""
