"""SimHash near-duplicate detection with BK-trees over shards of fingerprints.

A fingerprint holds 64 bits; two link if at most ``radius`` bits differ.  The
64 bits are cut in ``radius + 1`` blocks, so any two that link agree in at
least one of them.  Each block gives a family of shards, keyed by as many of
its first bits as leave about ``SHARD`` members to a shard.  In each shard the
fingerprints form a BK-tree, children keyed by their integer Hamming distance
to the parent, and a search follows only edges whose key is within the radius
of the query's distance.  Trees and searches of all shards in a task run level
by level as arrays.

A shard over ``FULL`` members isn't built: all members of such shards are dealt
anew by finer families, of more and narrower blocks several of which must
agree.  In the finest one a shard can't be that large.  So no block of a shard
meets another, and rows grow with the members of full shards only.

A shard's tree stays in the task that has the shard, and its members are the
queries: all trees together are as large as the corpus, so broadcasting them
would have no bound.  A task returns a star for each of its components rather
than its links.

Defined results: a null or empty text has fingerprint 0 and links like any
other; rows with the same text have the same fingerprint and component; a null
doc_id never names a component unless its whole component has none; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._components import connected_components
from ._store import ready, result, sliced, write_table

SEED = 42
RADIUS = 3
#: Fingerprints of a shard where they are spread evenly, and the most that one tree takes.
SHARD, FULL = 2_048, 16_384
#: Rows of shards that a task holds at once, and (query, node) pairs of a step of the search.
HELD, FRONTIER = 1 << 16, 1 << 20


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The unsigned 64-bit hashes of the ``words``-word shingles of ``text``, repeats included."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    view = memoryview(joined)
    spans = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(view[a:z], SEED) for a, z in spans), np.uint64, len(tokens) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of the ``words``-word shingles of ``text``."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """The columns of ``docs`` but its last, ``text``, and fp, the fingerprint as a signed long."""
    ready(docs.sparkSession)
    names = [*docs.columns[:-1], "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = np.fromiter((fingerprint(t, words) for t in batch.column(len(names) - 1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def families(radius: int, extra: int, bits: int = 64) -> list[int]:
    """Masks such that any two values within ``radius`` agree under one of them at least.

    64 bits are cut in ``radius + extra`` blocks, every ``extra`` of which make
    a mask; of each block only the first ``bits`` count.
    """
    blocks = radius + extra
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    cut = [((1 << min(z - a, bits)) - 1) << a for a, z in zip(edges, edges[1:], strict=False)]
    return list(dict.fromkeys(sum(c) for c in combinations(cut, extra)))


def ladder(n: int, radius: int, shard: int = SHARD) -> list[list[int]]:
    """Families for ``n`` fingerprints, and the finer ones for those in full shards."""
    bits = max(0, int(np.ceil(np.log2(max(1, n) / shard))))
    return [families(radius, 1, bits), *(families(radius, extra) for extra in (1, 2, 3, 5, 13) if radius + extra <= 64)]


def dealt(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(family, bits, fp): each fingerprint in its shard of each family."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    places = F.array(*(F.struct(F.lit(i).alias("family"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)))
    return fps.select("fp", F.explode(places).alias("k")).select("k.family", "k.bits", "fp")


class Forest:
    """BK-trees of many shards at once; the first member of each shard is its root.

    ``visited`` counts the nodes that searches have looked at.
    """

    def __init__(self, shard: np.ndarray, values: np.ndarray) -> None:
        """``shard`` numbers the shards from 0, sorted; ``values`` are unsigned 64-bit."""
        n = len(values)
        self.values = values
        self.visited = 0
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
        self.root = first
        parents, keys, nodes = [], [], []
        at = first[shard] if n else first
        rest = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = at[rest]
        while len(rest):
            d = np.bitwise_count(values[rest] ^ values[at]).astype(np.int64)
            slot = at * 65 + d
            _, index, back = np.unique(slot, return_index=True, return_inverse=True)
            new = rest[index]
            parents.append(at[index])
            keys.append(d[index])
            nodes.append(new)
            at = new[back]
            keep = np.ones(len(rest), bool)
            keep[index] = False
            rest, at = rest[keep], at[keep]
        self.child = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        slots = np.concatenate([p * 65 + k for p, k in zip(parents, keys, strict=True)]) if nodes else np.zeros(0, np.int64)
        order = np.argsort(slots, kind="stable")
        self.child, self.slots = self.child[order], slots[order]

    def search(self, shard: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query index, node index) at ``radius`` or less, in several parts of at most about ``FRONTIER``."""
        empty = np.zeros(0, np.int64)
        todo = [(empty, empty, empty)]  # queries, and where the children that they go on to begin and how many those are
        q, node = (np.arange(len(queries)), self.root[shard]) if len(queries) else (empty, empty)
        while True:
            if len(q):
                self.visited += len(q)
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                near = d <= radius
                if near.any():
                    yield q[near], node[near]
                low = np.searchsorted(self.slots, node * 65 + np.maximum(d - radius, 0))
                count = np.searchsorted(self.slots, node * 65 + np.minimum(d + radius, 64), side="right") - low
                on = count > 0
                todo.append((q[on], low[on], count[on]))
            if not todo:
                return
            q, low, count = todo.pop()
            total = np.cumsum(count)
            if len(q) and total[-1] > FRONTIER:
                cut = max(1, int(np.searchsorted(total, FRONTIER)))
                todo.append((q[cut:], low[cut:], count[cut:]))
                q, low, count, total = q[:cut], low[:cut], count[:cut], total[:cut]
            reach = np.repeat(low - (total - count), count) + np.arange(total[-1] if len(q) else 0)
            q, node = np.repeat(q, count), self.child[reach]


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and links a-b, the smallest node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def shard_links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, full: int = FULL) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints ``fps`` (fp), a table.

    Every component of the links at ``radius`` or less is a component of the
    rows returned; there are at most as many rows as members in all shards.
    """
    ready(fps.sparkSession)
    found = None
    steps = ladder(fps.count(), radius, shard)
    for level, masks in enumerate(steps):
        n = fps.count()
        keyed = dealt(fps, masks)
        last = level == len(steps) - 1
        dense = None if last else write_table(keyed.groupBy("family", "bits").count().filter(F.col("count") > full).select("family", "bits"), "dense")
        more = dense is not None and not dense.isEmpty()
        if more:
            fps = write_table(keyed.join(dense, ["family", "bits"], "left_semi").select("fp").distinct(), "members")
            keyed = keyed.join(dense, ["family", "bits"], "left_anti")
        links = _linked(keyed, n * len(masks), radius)
        found = links if found is None else found.union(links)
        if not more:
            break
    return found


def _linked(keyed: DataFrame, rows: int, radius: int) -> DataFrame:
    """The stars of all shards of ``keyed``; searches cost more than their bytes tell, so tasks are cut by rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= HELD:
                whole = pa.Table.from_batches(held)
                cut = last_shard(whole)
                if cut:
                    yield from link(whole.slice(0, cut), radius)
                held = whole.slice(cut).to_batches()
                count = whole.num_rows - cut
        if count:
            yield from link(pa.Table.from_batches(held), radius)

    parts = max(keyed.sparkSession.sparkContext.defaultParallelism, -(-rows // (2 * HELD)))
    return keyed.repartition(parts, "family", "bits").sortWithinPartitions("family", "bits", "fp").mapInArrow(run, "a long, b long")


def _changes(table: pa.Table) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for name in ("family", "bits"):
        x = table.column(name).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return change


def last_shard(table: pa.Table) -> int:
    """Where the last shard, which may go on, begins."""
    return int(np.flatnonzero(_changes(table))[-1])


def link(table: pa.Table, radius: int) -> Iterator[pa.RecordBatch]:
    """A star for each component of whole shards."""
    shard = np.cumsum(_changes(table)) - 1
    fp = table.column("fp").to_numpy().view(np.uint64)
    # a root that is no extreme of the order, as it would be with the rows sorted
    mixed = np.lexsort((fp * np.uint64(0x9E3779B97F4A7C15), shard))
    shard, fp = shard[mixed], fp[mixed]
    values, number = np.unique(fp, return_inverse=True)
    several = np.bincount(shard)[shard] > 1
    shard, fp, number = np.unique(shard[several], return_inverse=True)[1], fp[several], number[several]
    forest = Forest(shard, fp)
    label = np.arange(len(values))
    for q, node in forest.search(shard, fp, radius):
        a, b = number[q], number[node]
        other = label[a] != label[b]
        if other.any():
            label = stars(len(values), np.r_[np.arange(len(values)), a[other]], np.r_[label, b[other]])
    signed = values.view(np.int64)
    moved = np.flatnonzero(label != np.arange(len(values)))
    yield pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[label[moved]])], ["a", "b"])


def classes(marked: DataFrame, radius: int = RADIUS, shard: int = SHARD, full: int = FULL) -> DataFrame:
    """``marked`` (a table with doc_id and fp) with component_id.

    A fingerprint with very many rows, as of the empty text, is one row of what
    they are joined with, which adaptive execution broadcasts or splits by.
    """
    distinct = write_table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = write_table(shard_links(distinct.select("fp"), radius, shard, full).distinct(), "links")
    roots = connected_components(links)
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    rooted = write_table(rooted, "rooted")
    names = write_table(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = write_table(rooted.join(names, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the smallest doc_id reachable."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def found():
        marked = write_table(fingerprints(narrow, words), "fingerprints")
        return classes(marked, radius).select("doc_id", "fp", "component_id")

    return result(found, "classes")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract of operator 8 over the whole of ``documents``."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
