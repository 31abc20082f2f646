"""One document of each group of near copies: SimHash with BK-trees at the similarity of ``ALIKE`` on word shingles.

Sets of ``WORDS``-word shingles with a Jaccard similarity of 0.8 have
fingerprints some 10 of 64 bits apart, so ``RADIUS`` is wide, and no choice of
equal bits would hold such a pair together.  Shards are therefore named by
minima of the shingles: a set has ``BANDS`` shards, each named by ``DEEP``
minima under hashes of its own, and two sets of similarity s miss each other in
all of them with probability (1 - s**DEEP)**BANDS, 7e-5 at 0.8.  Within a shard
candidates are pairs of fingerprints within the radius, found by BK-trees.
The radius loses another 1e-4 or so of the pairs at 0.8, more of those of very
few shingles.

Every link is confirmed on the whole sets (64-bit hashes), and whatever isn't
confirmed counts for nothing.  Equal sets are reduced to one node first.

1. Roots: each node is compared with the root of a shard's tree, the same root
   in as many of its shards as have it.  This links most of a large group in
   one pair a node.
2. Trees: in shards that still hold nodes of several components, those outside
   the largest one search the tree, first for one candidate each, then, with
   the components that this gave, for all.  A parity sketch of 1,024 bits
   bounds the symmetric difference of two sets from below and rules out most
   pairs that the radius lets through, never one that is similar.

Shards of more than ``FULL`` members are cut in cells of so many tree members
and so many that search.

Defined results: a text of fewer words than a shingle is one shingle, and texts
without words are copies of each other; among rows of the smallest doc_id of a
component any one stays, the others go; nulls come last; columns other than
doc_id and text are kept as they are; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import merged
from ._store import ready, sliced, write_table
from .simhash import FULL, HELD, SEED, Forest, majority

WORDS, RADIUS = 5, 22
#: The least similarity, as a fraction.
ALIKE = (4, 5)
BANDS, DEEP = 18, 4
SKETCH = 1_024
#: Pairs whose sketches are compared at once.
PAIRS = 1 << 15
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 20
_MIX, _HALF = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32)
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(SEED + 1).integers(1 << 64, size=256, dtype=np.uint64)
_FACTORS = np.random.default_rng(SEED).integers(1 << 62, size=(BANDS * DEEP, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of an odd number and of its inverse, to 64 bits."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up, self.down


_POWERS = _Powers()


def hashed_grams(data: np.ndarray, ends: np.ndarray, words: int) -> np.ndarray:
    """A 64-bit hash of each ``words`` consecutive words; ``data`` are the bytes of all words, each followed by a space at ``ends``.

    A hash is a polynomial of the bytes (each given a random number) to 64 bits,
    mixed; sums over the whole text give those of all its stretches.
    """
    first, last = np.r_[0, ends[:-1] + 1][: len(ends) - words + 1], ends[words - 1 :]
    found, at = np.zeros(len(first), np.uint64), 0
    while at < len(first):
        low = int(first[at])
        to = max(at + 1, int(np.searchsorted(last, low + BLOCK)))
        high = int(last[to - 1])
        up, down = _POWERS.to(high - low + 1)
        sums = np.r_[np.uint64(0), np.cumsum(_BYTES[data[low:high]] * up[: high - low])]
        a, z = first[at:to] - low, last[at:to] - low
        found[at:to] = (sums[z] - sums[a]) * down[a]
        at = to
    for _ in range(2):
        found ^= found >> _HALF
        found *= _MIX
    return found ^ (found >> _HALF)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the ``words``-word shingles of ``text``, sorted and distinct."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(tokens) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    return np.unique(hashed_grams(data, ends, min(words, len(ends))))


def minima(found: np.ndarray) -> list[int]:
    """A hash for each band of ``DEEP`` minima; none for an empty set."""
    if not len(found):
        return []
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for i in range(0, len(found), 512):
        mixed = _FACTORS * found[i : i + 512]
        mixed ^= mixed >> _HALF
        np.minimum(least, mixed.min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(part.tobytes(), k) - (1 << 63) for k, part in enumerate(least.reshape(BANDS, DEEP))]


def sketch(found: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of shingles falls on i, so two sketches differ in at most as many bits as the sets in members."""
    odd = np.bincount((found >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _over(rows: DataFrame, make, schema: str) -> DataFrame:
    """Rows of ``schema`` with the node, first column of ``rows``, and what ``make`` gives for its text, the second."""
    ready(rows.sparkSession)
    types = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [make(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([m[k] for m in made], kinds[k]) for k in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    kind = {"binary": pa.binary(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    names, kinds = types.names, [kind[f.dataType.simpleString()] for f in types.fields[1:]]
    return rows.mapInArrow(run, types)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """Those of ``pairs`` (a, b, a table) whose texts have the similarity, by their whole sets."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    rows = texts.join(asked, "node", "left_semi").select("node", "text")
    sets = write_table(_over(rows, lambda t: (shingles(t, words).view(np.int64).tolist(),), "node long, s array<long>"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("sum"))
    return write_table(both.filter(F.col("c") * ALIKE[1] >= (F.col("sum") - F.col("c")) * ALIKE[0]).select("a", "b"), "confirmed")


def _close(n: str, m: str):
    return F.least(n, m) * ALIKE[1] >= F.greatest(n, m) * ALIKE[0]


def _shards(nodes: DataFrame) -> DataFrame:
    """(band, node, n, fp, top): the members of every shard that has several; top is the root of its tree."""
    banded = nodes.select("node", "n", "fp", F.explode("bands").alias("band"))
    tops = banded.groupBy("band").agg(F.min("node").alias("top"), F.count("*").alias("k")).filter("k > 1").select("band", "top")
    return write_table(banded.join(write_table(tops, "tops"), "band"), "banded")


def _roots(banded: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): each node with one root of its shards that its fingerprint, size and sketch allow."""
    tops = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("fp").alias("other"))
    pairs = banded.filter("node <> top").select(F.col("node").alias("a"), F.col("top").alias("b"), "n", "fp").distinct().join(tops, "b")
    near = _close("n", "m") & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS)
    pairs = write_table(pairs.filter(near).select("a", "b", (F.col("n") + F.col("m")).alias("both")), "pairs")
    words = F.transform(F.sequence(F.lit(0), F.lit(SKETCH // 64 - 1)), lambda i: F.conv(F.hex(F.substring("sketch", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    marks = nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "node", "left_semi").select("node", words.alias("w"))
    marks = write_table(marks, "marks")
    both = pairs.join(marks.select(F.col("node").alias("a"), F.col("w").alias("x")), "a").join(marks.select(F.col("node").alias("b"), F.col("w").alias("y")), "b")
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    possible = both.filter(apart * sum(ALIKE) <= F.col("both") * (ALIKE[1] - ALIKE[0]))
    return possible.groupBy("a").agg(F.min("b").alias("b"))


def _searched(banded: DataFrame, nodes: DataFrame, roots: DataFrame, full: int, one: bool) -> DataFrame:
    """(a, b): pairs of a shard that have different ``roots`` and may be similar; at most one for each a and shard if ``one``."""
    banded = write_table(banded.join(roots, "node").select("band", "node", "n", "fp", "root"), "placed")
    shares = banded.groupBy("band", "root").agg(F.count("*").alias("c"))
    shards = shares.groupBy("band").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("k")).filter("k > 1")
    cells = F.ceil(F.col("m") / full).cast("int"), F.ceil((F.col("m") - F.col("top.c")) / full).cast("int")
    shards = write_table(shards.select("band", F.col("top.root").alias("top"), cells[0].alias("trees"), cells[1].alias("askers")), "shards")
    members = banded.join(shards, "band").join(nodes.select("node", "sketch"), "node")
    asks = F.col("root") != F.col("top")
    tree, part = F.pmod(F.xxhash64("node", F.lit("tree")), "trees").cast("int"), F.pmod(F.xxhash64("node"), "askers").cast("int")
    grown = F.transform(F.sequence(F.lit(0), F.col("askers") - 1), lambda p: F.struct(tree.alias("tree"), p.alias("part"), F.lit(True).alias("grows"), (asks & (p == part)).alias("asks")))
    asked = F.transform(F.sequence(F.lit(0), F.col("trees") - 1), lambda t: F.struct(t.alias("tree"), part.alias("part"), F.lit(False).alias("grows"), F.lit(True).alias("asks")))
    cell = F.explode(F.when(asks, F.concat(grown, F.filter(asked, lambda c: c.tree != tree))).otherwise(grown)).alias("cell")
    rows = members.select("band", cell, "node", "root", "n", "fp", "sketch").select("band", "cell.*", "node", "root", "n", "fp", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= HELD:
                whole = pa.Table.from_batches(held)
                cut = int(np.flatnonzero(_starts(whole))[-1])
                if cut:
                    yield from candidates(whole.slice(0, cut), one)
                held, count = whole.slice(cut).to_batches(), whole.num_rows - cut
        if count:
            yield from candidates(pa.Table.from_batches(held), one)

    keys = ["band", "tree", "part"]
    pairs = rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _starts(table: pa.Table) -> np.ndarray:
    """Whether each row is the first of its cell."""
    start = np.zeros(table.num_rows, bool)
    start[:1] = True
    for name in ("band", "tree", "part"):
        x = table.column(name).to_numpy()
        start[1:] |= x[1:] != x[:-1]
    return start


def candidates(table: pa.Table, one: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of whole cells by BK-trees of their fingerprints."""
    cell = np.cumsum(_starts(table)) - 1
    node, root, n = (table.column(c).to_numpy() for c in ("node", "root", "n"))
    fp = table.column("fp").to_numpy().view(np.uint64)
    marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
    grows, asks = (table.column(c).to_numpy() for c in ("grows", "asks"))
    inside = np.flatnonzero(grows)
    inside = inside[np.lexsort((fp[inside], cell[inside]))]
    # members of one cell with one fingerprint are one node of its tree
    first = np.r_[True, (cell[inside][1:] != cell[inside][:-1]) | (fp[inside][1:] != fp[inside][:-1])] if len(inside) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    size = np.diff(np.r_[begin, len(inside)])
    has = np.zeros(cell[-1] + 1, bool)
    has[cell[inside]] = True
    place = np.cumsum(has) - 1
    forest = Forest(place[cell[inside[begin]]], fp[inside[begin]])
    asking = np.flatnonzero(asks)
    asking = asking[has[cell[asking]]]
    best: dict[int, tuple[int, int]] = {}
    for q, at in forest.search(place[cell[asking]], fp[asking], RADIUS):
        total = np.cumsum(size[at])
        for low in range(0, int(total[-1]), PAIRS):
            some = np.arange(low, min(low + PAIRS, int(total[-1])))
            k = np.searchsorted(total, some, side="right")
            x, y = asking[q[k]], inside[begin[at[k]] + some - (total[k] - size[at[k]])]
            keep = (root[x] != root[y]) & (np.minimum(n[x], n[y]) * ALIKE[1] >= np.maximum(n[x], n[y]) * ALIKE[0])
            x, y = x[keep], y[keep]
            apart = np.bitwise_count(marks[x] ^ marks[y]).sum(axis=1, dtype=np.int64)
            keep = apart * sum(ALIKE) <= (n[x] + n[y]) * (ALIKE[1] - ALIKE[0])
            x, y, apart = x[keep], y[keep], apart[keep]
            if not one:
                yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], ["a", "b"])
                continue
            order = np.lexsort((node[y], apart, x))
            order = order[np.r_[True, x[order][1:] != x[order][:-1]]] if len(order) else order
            for i in order:
                new = int(apart[i]), int(node[y[i]])
                if new < best.get(int(x[i]), (SKETCH + 1, 0)):
                    best[int(x[i])] = new
    if best:
        yield pa.RecordBatch.from_arrays([pa.array(node[list(best)]), pa.array([b for _, b in best.values()], pa.int64())], ["a", "b"])


def near_copies(texts: DataFrame, nodes: DataFrame, words: int = WORDS, full: int = FULL) -> DataFrame:
    """(node, root): the smallest node of the component of all similar pairs that meet in a shard.

    ``texts`` (node, text) and ``nodes`` (node, n, fp, bands, sketch), no two of
    them with equal sets, are tables.
    """
    banded = _shards(nodes)
    roots = merged(nodes.select("node", F.col("node").alias("root")), confirmed(write_table(_roots(banded, nodes), "pairs"), texts, words))
    for one in (True, False):
        pairs = write_table(_searched(banded, nodes, roots, full, one), "pairs")
        if pairs.isEmpty():  # whoever has candidates has one
            break
        roots = merged(roots, confirmed(pairs, texts, words))
    return roots


def distinct_documents(docs: DataFrame, words: int = WORDS, full: int = FULL) -> DataFrame:
    """One row of each component of near copies in ``docs``, with all its columns: that with the smallest doc_id."""
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = write_table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(row).alias("node"), F.col("text").cast("string").alias("text"))

    def mark(text):
        found = shingles(text, words)
        return xxhash.xxh3_128_digest(found.tobytes()), len(found), int(np.uint64(majority(found)).view(np.int64)), minima(found), sketch(found)

    marked = write_table(_over(texts, mark, "node long, key binary, n long, fp long, bands array<long>, sketch binary"), "marked")
    ids = numbered.select(F.col(row).alias("node"), F.col("doc_id").cast("long").alias("id"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "node")
    groups = marked.join(ids, "node").groupBy("key").agg(F.min(order).alias("first"), *(F.any_value(c).alias(c) for c in ("n", "fp", "bands", "sketch")))
    groups = write_table(groups.select(F.col("first.node").alias("node"), "first", "n", "fp", "bands", "sketch"), "groups")
    roots = near_copies(texts, groups.drop("first"), words, full)
    found = groups.select("node", "first").join(roots, "node").groupBy("root").agg(F.min("first").alias("first"))
    kept = write_table(found.select(F.col("first.node").alias(row)), "kept")
    return numbered.join(kept, row, "left_semi").drop(row)
