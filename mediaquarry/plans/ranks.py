"""Pages far down an order, without sorting what comes before them.

A count tree holds how many rows lie in each block of ids, and in each block of
blocks; a walk from its root finds the block of any offset.  Where no tree is
stored, histograms of the order's columns narrow a table down to the rows about
the page.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A node has 2**BITS children; a block, the lowest node stored, 2**BITS ids.
BITS, LEVELS = 16, 3
#: Buckets of a histogram, and rows that are few enough to be sorted.
BUCKETS, FEW = 4_096, 1 << 16


def count_tree(ids: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(level, key, n): how many rows have their id in each node, a key being the id without its last ``level * bits`` bits.

    Trees add up: rows of the same node count together, so one of new rows is
    appended to that of the others.
    """
    blocks = ids.groupBy(F.shiftright(F.col(column).cast("long"), bits).alias("key")).agg(F.count("*").alias("n"))
    nodes = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("level"), F.shiftright("key", bits * k).alias("key")) for k in range(LEVELS))))
    return blocks.select(nodes.alias("node"), "n").groupBy("node.level", "node.key").agg(F.sum("n").alias("n"))


def tree_size(tree: DataFrame) -> int:
    """How many rows a tree counts."""
    return tree.filter(F.col("level") == LEVELS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def block_of(tree: DataFrame, place: int, bits: int = BITS) -> tuple[int, int] | None:
    """(key, before): the block that holds the row at ``place``, counted from the largest id, and how many rows come before it.

    Reads the children of one node at each level; none beyond the last row.
    """
    key, before = None, 0
    for level in range(LEVELS, 0, -1):
        nodes = tree.filter(F.col("level") == level)
        if key is not None:
            nodes = nodes.filter(F.col("key").between(key << bits, (key << bits) + (1 << bits) - 1))
        rows = sorted(((r.key, r.n) for r in nodes.groupBy("key").agg(F.sum("n").alias("n")).collect()), reverse=True)
        upto = list(accumulate((n for _, n in rows), initial=before))
        at = bisect_right(upto, place) - 1
        if at >= len(rows):
            return None
        key, before = rows[at][0], upto[at]
    return key, before


def id_page(tree: DataFrame, offset: int, size: int, bits: int = BITS) -> tuple[int, int, int] | None:
    """(least id, largest id, skip): ids between which the page lies, of blocks about it, and how many of their rows come before it.

    The largest ids come first.  None where no row is left at ``offset``.
    """
    offset = max(0, offset)
    first = block_of(tree, offset, bits)
    if first is None or size < 1:
        return None
    last = block_of(tree, min(offset + size, tree_size(tree)) - 1, bits)
    return last[0] << bits, (first[0] << bits) + (1 << bits) - 1, offset - first[1]


def _sorted_page(df: DataFrame, order: list[tuple[str, bool]], offset: int, size: int) -> DataFrame:
    return df.orderBy(*(F.asc(c) if up else F.desc(c) for c, up in order)).offset(offset).limit(size)


def page_at(df: DataFrame, order: list[tuple[str, bool]], offset: int, size: int, few: int = FEW) -> DataFrame:
    """The rows from ``offset`` on in the total order of numeric columns without nulls, each ascending or not.

    ``df`` should be stored: each histogram reads it again.  A page's first row
    lies in one bucket, which is narrowed down to ``few`` rows or to equal
    values; rows of the page beyond that bucket are the first of what follows.
    """
    offset, after = max(0, offset), []
    for name, up in order:
        while True:
            low, high, n = df.agg(F.min(name), F.max(name), F.count("*")).first()
            if low == high and n > few:
                break  # the next column decides
            if n <= few or not math.isfinite(BUCKETS / (high - low)):
                return _joined_page(df, after, order, offset, size)
            bucket = _bucket(F.col(name), low, high)
            rows = sorted(((r.bucket, r.n) for r in df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect()), reverse=not up)
            upto = list(accumulate((n for _, n in rows), initial=0))
            at = min(bisect_right(upto, offset), len(rows)) - 1
            if upto[at + 1] < offset + size and at + 1 < len(rows):
                beyond = bucket > rows[at][0] if up else bucket < rows[at][0]
                after.append(_sorted_page(df.filter(beyond), order, 0, size))
            df, offset = df.filter(bucket == rows[at][0]), offset - upto[at]
    return _joined_page(df, after, order, offset, size)


def _joined_page(df: DataFrame, after: list[DataFrame], order: list[tuple[str, bool]], offset: int, size: int) -> DataFrame:
    """The page that begins in ``df`` and goes on in what follows, of which the nearest was found last."""
    page = _sorted_page(df, order, offset, size)
    return _sorted_page(reduce(DataFrame.union, reversed(after), page), order, 0, size) if after else page


def _bucket(x: Column, low: float, high: float) -> Column:
    """The bucket of values from ``low`` to ``high``; it never falls where they rise."""
    return F.least(F.lit(BUCKETS - 1), F.floor((x - F.lit(low)).cast("double") * (BUCKETS / (high - low)))).cast("int")
