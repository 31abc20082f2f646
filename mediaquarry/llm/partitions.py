"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph.  Its vertices are
divided into partitions of equal size with few edges between them: recursive
median splits along the direction of widest spread, then rounds of moves of
vertices to the partition of most of their neighbours, within a bound on size.
A small network learns the partition of a vector from the shares of its
neighbours, and so assigns a partition to every row.  Where the rows are too
many for ``PARTS`` partitions, each of these is parted again in the same way by
a network of its own, fitted on a sample of its rows.

Every row is assigned once and the index stored by partition.  A query is
routed to its most probable partitions, as many as reach ``TARGET`` recall for
a part of the sample that the networks didn't learn from, and the rows there
are ranked by exact distance.  Queries and the rows of the partitions that any
of them probes meet in one shuffle, in cells of at most about ``CELL`` rows and
``CELL`` queries, so a partition with a third of all rows is many cells.

Defined results: vectors that are null, zero or hold a null or a component that
isn't finite, and rows without vec_id take no part; of several vectors under
one vec_id the least counts, component by component; no row with the query's
vec_id is a candidate; vectors meet only those of their own length, each length
with partitions of its own; fewer different vectors than ``SMALL``, which give
no graph to speak of, are one partition, searched whole; distances beyond a double are infinite and come last, by
vec_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import picked, ready, result, write_table
from ._vectors import QUERY_ROWS, Best, arrays, blocks, ranked, usable

#: The most rows that a network is fitted on; of fewer different ones than SMALL no partitions are learnt.
SAMPLE, SMALL = 8_192, 64
#: The most partitions of one network, and rows that a partition should have.
PARTS, EACH = 64, 2_048
#: Partitions of the first level that have more rows are parted again.
LARGE = 65_536
#: Rows, and queries, that meet in a task.
CELL = 32_768
NEIGHBOURS, ROUNDS, SLACK = 10, 12, 1.1
HIDDEN, EPOCHS, STEP = 96, 30, 0.004
TARGET = 0.94


def nearest(queries: np.ndarray, points: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Positions of the k nearest points of each query, not itself if ``own``, in blocks."""
    out = []
    squares = (points**2).sum(axis=1)
    for at in range(0, len(queries), 256):
        block = queries[at : at + 256]
        d = squares - 2 * (block @ points.T)
        if own:
            d[np.arange(len(block)), np.arange(at, at + len(block))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced(points: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A partition from 0 to ``parts`` (a power of 2) for each vertex of the graph."""
    part = np.zeros(len(points), np.int64)
    for level in range(parts.bit_length() - 1):
        for p in range(1 << level):
            mine = np.flatnonzero(part == p)
            x = points[mine] - points[mine].mean(axis=0)
            direction = np.linalg.svd(x.T @ x)[0][:, 0]
            order = np.argsort(x @ direction, kind="stable")
            part[mine[order[len(mine) // 2 :]]] += 1 << level
    room = int(np.ceil(SLACK * len(points) / parts))
    for _ in range(ROUNDS):
        votes = np.zeros((len(points), parts))
        np.add.at(votes, (np.repeat(np.arange(len(points)), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(points)), best] - votes[np.arange(len(points)), part]
        sizes = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < room:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A network with one hidden layer that gives the probability of each partition."""

    def __init__(self, points: np.ndarray, shares: np.ndarray, unit: float = 1.0) -> None:
        rng = np.random.default_rng(0)
        self.parts, self.unit = shares.shape[1], unit
        points = points / unit
        self.mean, self.scale = points.mean(axis=0), points.std() + 1e-12
        sizes = [points.shape[1], HIDDEN, shares.shape[1]]
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (*self.w, *self.b)]
        t = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(points))
            for at in range(0, len(points), 256):
                rows = order[at : at + 256]
                x = (points[rows] - self.mean) / self.scale
                hidden = np.maximum(x @ self.w[0] + self.b[0], 0)
                delta = (_softmax(hidden @ self.w[1] + self.b[1]) - shares[rows]) / len(rows)
                back = (delta @ self.w[1].T) * (hidden > 0)
                t += 1
                grads = (x.T @ back, hidden.T @ delta, back.sum(axis=0), delta.sum(axis=0))
                for value, grad, (m, v) in zip((*self.w, *self.b), grads, state, strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad**2 - v)
                    value -= STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def probabilities(self, points: np.ndarray) -> np.ndarray:
        # clipped, so that vectors far beyond the sample have finite sums
        x = np.clip((points / self.unit - self.mean) / self.scale, -1e6, 1e6)
        hidden = np.maximum(x @ self.w[0] + self.b[0], 0)
        return _softmax(hidden @ self.w[1] + self.b[1])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Whole:
    """One partition, for few rows."""

    parts = 1

    def probabilities(self, points: np.ndarray) -> np.ndarray:
        return np.ones((len(points), 1))


class Index:
    """A network, those of its partitions that are parted again, and how many partitions a query probes."""

    def __init__(self, top: Router | Whole, below: dict[int, Router], probes: int = 1) -> None:
        self.top, self.below, self.probes = top, below, probes
        sizes = [below[p].parts if p in below else 1 for p in range(top.parts)]
        self.first = np.r_[0, np.cumsum(sizes)]
        self.parts = int(self.first[-1])

    def probabilities(self, points: np.ndarray) -> np.ndarray:
        """Of every partition of the lowest level."""
        top = self.top.probabilities(points)
        if not self.below:
            return top
        return np.concatenate([top[:, p : p + 1] * (self.below[p].probabilities(points) if p in self.below else 1.0) for p in range(self.top.parts)], axis=1)

    def place(self, points: np.ndarray) -> np.ndarray:
        """The partition of each point: the most probable one of the most probable partition above."""
        top = self.top.probabilities(points).argmax(axis=1)
        out = self.first[top]
        for p, router in self.below.items():
            mine = np.flatnonzero(top == p)
            if len(mine):
                out[mine] += router.probabilities(points[mine]).argmax(axis=1)
        return out

    def measured(self, points: np.ndarray, known: np.ndarray, k: int = NEIGHBOURS) -> Index:
        """The same with as many probes as find ``TARGET`` of the neighbours of ``points`` in ``known``."""
        place = self.place(known)
        route = np.argsort(-self.probabilities(points), axis=1, kind="stable")
        true = place[nearest(points, known, k, own=False)]
        rank = np.empty_like(route)
        rank[np.arange(len(points))[:, None], route] = np.arange(self.parts)
        found = np.take_along_axis(rank, true, axis=1)
        recall = np.cumsum(np.bincount(found.ravel(), minlength=self.parts)) / found.size
        return Index(self.top, self.below, int(np.argmax(recall >= TARGET)) + 1)


def split(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct points of a sample in two parts: to measure recall with, and to learn from."""
    points = np.unique(points, axis=0)
    points = points[np.random.default_rng(1).permutation(len(points))]
    asked = max(64, len(points) // 8)
    return points[:asked], points[asked:]


def router(known: np.ndarray, parts: int, k: int = NEIGHBOURS) -> Router:
    """A network for ``parts`` balanced partitions of the neighbour graph of ``known``.

    Coordinates are scaled so that squares stay finite.
    """
    scale = np.abs(known).max()
    graph = nearest(known / scale, known / scale, k, own=True)
    part = balanced(known / scale, graph, parts)
    shares = np.zeros((len(known), parts))
    np.add.at(shares, (np.repeat(np.arange(len(known)), k), part[graph].ravel()), 0.5 / k)
    shares[np.arange(len(known)), part] += 0.5
    return Router(known, shares, scale)


def partitions_for(rows: int) -> int:
    """A power of 2 that leaves about ``EACH`` rows to a partition, at most ``PARTS``."""
    return 1 << min(PARTS.bit_length() - 1, max(3, (rows // EACH).bit_length()))


def sampled(vectors: DataFrame, rows: int, sample: int) -> np.ndarray:
    """At most ``sample`` of ``rows`` vectors of one length, picked by a hash of the id."""
    share = min(1.0, 0.95 * sample / max(1, rows))
    drawn = vectors.filter(picked(share, "vec_id")).limit(sample).orderBy("vec_id").select("embedding").toArrow()
    return arrays(drawn, len(drawn.column(0)[0])) if drawn.num_rows else np.zeros((0, 1))


def fit_index(vectors: DataFrame, sample: int = SAMPLE, large: int = LARGE) -> dict[int, Index]:
    """An index for each length of ``vectors`` (a table of usable rows); a network is fitted on at most ``sample`` rows."""
    found = {}
    for r in vectors.groupBy(F.size("embedding").alias("n")).count().orderBy("n").collect():
        mine = vectors.filter(F.size("embedding") == r.n)
        points = sampled(mine, r["count"], sample)
        if len(np.unique(points, axis=0)) < SMALL:
            found[r.n] = Index(Whole(), {})
            continue
        asked, known = split(points)
        top = Index(router(known, partitions_for(r["count"])), {})
        if r["count"] > top.parts * large:
            top = Index(top.top, _below(mine, top, sample))
        found[r.n] = top.measured(asked, known)
    return found


def _below(vectors: DataFrame, top: Index, sample: int) -> dict[int, Router]:
    """Networks for the partitions of ``top``, each fitted in a task of its own on a sample of its rows."""
    placed = write_table(assigned(vectors, {top.top.mean.shape[0]: top}), "placed")
    sizes = placed.groupBy("part").agg(F.count("*").alias("m"))
    drawn = placed.join(F.broadcast(sizes), "part").filter(picked(F.least(F.lit(1.0), 0.95 * sample / F.col("m")), "vec_id"))

    def fit(group: pa.Table) -> pa.Table:
        points = arrays(group.sort_by("vec_id").slice(0, sample), top.top.mean.shape[0])
        if len(np.unique(points, axis=0)) < SMALL:
            return pa.table({"part": pa.array([], pa.int32()), "model": pa.array([], pa.binary())})
        made = router(split(points)[1], partitions_for(group.column("m")[0].as_py()))
        return pa.table({"part": group.column("part").slice(0, 1), "model": pa.array([pickle.dumps(made)], pa.binary())})

    rows = drawn.groupBy("part").applyInArrow(fit, "part int, model binary").collect()
    return {r.part: pickle.loads(r.model) for r in sorted(rows, key=lambda r: r.part)}


def assigned(vectors: DataFrame, index: dict[int, Index]) -> DataFrame:
    """(vec_id, embedding, part): the partition of every row of ``vectors`` (usable rows)."""
    spark = vectors.sparkSession
    ready(spark)
    sent = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points in blocks(batches):
            part = sent.value[points.shape[1]].place(points)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * points.shape[1]), pa.array(points.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), vectors, pa.array(part.astype(np.int32))], ["vec_id", "embedding", "part"])

    return vectors.mapInArrow(run, "vec_id long, embedding array<double>, part int")


def store(vectors: DataFrame, index: dict[int, Index]) -> DataFrame:
    """The index: every row once, in a folder for each partition, whose files are of even size."""
    rows = assigned(vectors, index).withColumn("size", F.size("embedding"))
    return write_table(rows.hint("rebalance", "part"), "index", by="part")


def routed(queries: DataFrame, index: dict[int, Index]) -> DataFrame:
    """(vec_id, embedding, part): a row for each partition that a query probes."""
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points in blocks(batches, 1024):
            mine = sent.value.get(points.shape[1])
            if mine is None:
                continue
            route = np.argsort(-mine.probabilities(points), axis=1, kind="stable")[:, : mine.probes]
            for part in route.T:
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * points.shape[1]), pa.array(points.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), vectors, pa.array(part.astype(np.int32))], ["vec_id", "embedding", "part"])

    return queries.mapInArrow(run, "vec_id long, embedding array<double>, part int").withColumn("size", F.size("embedding"))


def scan(best: Best, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
    """Put the nearest of a block of rows into ``best``."""
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (queries**2).sum(axis=1)
        for at in range(0, len(ids), 1024):
            mine = points[at : at + 1024]
            sums = (mine**2).sum(axis=1)
            rough = squares[:, None] + sums - 2 * (queries @ mine.T)
            slack = 1e-9 * (squares + sums.max(initial=0.0))
            limit = best.kth**2 + slack
            if len(mine) > best.k:
                # one more than k, as one may be the query itself
                limit = np.minimum(limit, np.partition(np.nan_to_num(rough, nan=np.inf), best.k, axis=1)[:, best.k] + slack)
            # what overflows isn't a number and can't be ruled out
            q, c = np.nonzero(~(rough > limit[:, None]))
            c += at
            other = query_ids[q] != ids[c]
            q, c = q[other], c[other]
            for a in range(0, len(q), 1 << 15):
                b, d = q[a : a + (1 << 15)], c[a : a + (1 << 15)]
                best.add(b, distances(queries[b], points[d]), ids[d])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances row by row; scaled first where a square would overflow or vanish."""
    apart = x - y
    found = np.sqrt((apart**2).sum(axis=1))
    for i in np.flatnonzero(~np.isfinite(found) | (found < 1e-150)):
        largest = np.abs(apart[i]).max(initial=0.0)
        found[i] = largest if largest in (0.0, np.inf) else largest * np.sqrt(((apart[i] / largest) ** 2).sum())
    return found


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int, cell: int = CELL, large: int = LARGE) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries``, rows of vec_id and embedding, among ``vectors``."""

    def found() -> DataFrame:
        rows = write_table(usable(vectors, True), "vectors")
        index = fit_index(rows, large=large)
        return search(store(rows, index), index, usable(queries, True), k, cell)

    return result(found, "neighbours")


def search(stored: DataFrame, index: dict[int, Index], queries: DataFrame, k: int, cell: int = CELL) -> DataFrame:
    """The k nearest of each of ``queries`` (usable rows) among the rows of its partitions in a stored index."""
    asked = write_table(routed(queries, index), "routed")
    have = stored.groupBy("part", "size").agg(F.ceil(F.count("*") / cell).cast("int").alias("cells"))
    want = asked.groupBy("part", "size").agg(F.ceil(F.count("*") / cell).cast("int").alias("turns"))
    plan = write_table(have.join(want, ["part", "size"]), "plan")  # a row for each partition
    own = F.pmod(F.xxhash64("vec_id", F.lit("cell")), F.col("cells")).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit("turn")), F.col("turns")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("turns") - 1)), F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    names = ["part", "size", "cell", "turn", "asks", "vec_id", "embedding"]
    held = stored.join(plan, ["part", "size"]).withColumns({"cell": own[0], "asks": F.lit(False)}).withColumn("turn", every[0]).select(*names)
    ask = asked.join(plan, ["part", "size"]).withColumns({"turn": own[1], "asks": F.lit(True)}).withColumn("cell", every[1]).select(*names)
    keys = ["part", "size", "cell", "turn"]
    return _ranked(held.union(ask).repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(lambda b: _meet(b, k), "query_id long, vec_id long, key double"), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return ranked(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", F.col("key").alias("score"))


def _meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query in its cell; a cell's rows come before its queries."""
    at, held = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(5)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, z in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            here, asks = tuple(keys[:4, a].tolist()), bool(keys[4, a])
            if here != at:
                at, held = here, []
            part = batch.slice(a, z - a)
            ids, vectors = part.column("vec_id").to_numpy(), arrays(part, here[1])
            if not asks:
                held.append((ids, vectors))
                continue
            for low in range(0, len(ids), QUERY_ROWS):
                mine = ids[low : low + QUERY_ROWS]
                best = Best(len(mine), k, np.float64)
                for known, points in held:
                    scan(best, mine, vectors[low : low + QUERY_ROWS], known, points)
                yield pa.RecordBatch.from_arrays([pa.array(mine[best.query]), pa.array(best.id), pa.array(best.key)], ["query_id", "vec_id", "key"])


def op3_learned_partitions(spark, sf_dir: str) -> DataFrame:
    """The contract of operator 3 over the whole of ``embeddings``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(vectors, vectors.filter("pmod(vec_id, 100) = 0"), 10)
