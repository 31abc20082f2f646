"""Batches of similar length, in buckets that need the least padding.

The exact histogram of all lengths reaches the driver: a corpus of T tokens has
at most sqrt(2 T) different lengths.  Dynamic programming over it finds the
bucket boundaries with the least padding in all; the split before a boundary
moves only up as the boundary does, so each round is a divide and conquer.
Within a bucket rows are numbered without gaps in the order of length, of the
columns named by the caller and of a hash of the row, and each run of
``budget // bucket_len`` rows, at least one, is a batch.  Numbers come from
ranges of that order and their sizes, so no task holds more than a range, and
the result doesn't depend on how the input is stored.

Defined results: a null or empty text has one token, its end; an item longer
than the budget is a batch of its own; a null doc_id is an item like any other
and comes first, repeated rows are separate items; an empty table gives an
empty result; columns other than doc_id and text (or those that the caller
names) are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import result, write_table

BUCKETS, BUDGET = 12, 32_768
#: Rows of a range of the order.
RANGE = 100_000


def word_tokens(text: Column) -> Column:
    """Words of a text (parted by the white space of ASCII) and one end."""
    return (F.size(F.split(F.coalesce(text, F.lit("")), r"[^ \t\n\x0B\f\r]+")) - 1 + 1).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Positions of the longest length of each bucket, at most ``buckets`` of them, with the least padding.

    Lengths are distinct and in order.  Where splits are equally good the first
    counts, and fewer buckets before more.
    """
    n = len(lengths)
    if not n:
        return []
    before = np.r_[0, np.cumsum(counts)]
    # items padded to their bucket's length, in all: the sum of lengths is the same for every choice
    best = lengths * before[1:]
    back = []
    for _ in range(1, min(buckets, n)):
        cost, split = _cut(best, lengths, before)
        better = cost < best
        back.append(np.where(better, split, -1))
        best = np.where(better, cost, best)
    ends, j = [n - 1], n - 1
    for split in reversed(back):
        if split[j] >= 0:
            j = int(split[j])
            ends.append(j)
    return ends[::-1]


def _cut(best: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j > 0 the least ``best[i]`` and cost of one more bucket of what lies after i, with the first such i < j."""
    n = len(best)
    cost, split = best.copy(), np.full(n, -1)
    first, last, low, high = (np.array([x]) for x in (1, n - 1, 0, n - 2))
    while len(first):
        j = (first + last) // 2
        size = np.minimum(high, j - 1) - low + 1
        start = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(j)), size)
        i = np.arange(size.sum()) - start[owner] + low[owner]
        tried = best[i] + lengths[j[owner]] * (before[j[owner] + 1] - before[i + 1])
        least = np.minimum.reduceat(tried, start)
        at = np.flatnonzero(tried == least[owner])
        at = at[np.r_[True, owner[at][1:] != owner[at][:-1]]]
        cost[j], split[j] = least, i[at]
        first, last, low, high = (np.r_[a, b] for a, b in ((first, j + 1), (j - 1, last), (low, i[at]), (i[at], high)))
        some = first <= last
        first, last, low, high = first[some], last[some], low[some], high[some]
    return cost, split


def pack(items: DataFrame, length: str = "n_tokens", order: tuple[str, ...] = (), buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``items`` with bucket, bucket_len, batch (from 0 within the bucket) and slot (within the batch).

    Rows of one length come in the order of the columns ``order``; columns of
    these names are replaced.
    """
    names = [c for c in items.columns if c not in ("bucket", "bucket_len", "batch", "slot")]
    own = "_"
    while any(c.startswith(own) for c in items.columns):
        own += "_"
    size, row, mark, part, number, start = (own + x for x in ("size", "row", "mark", "part", "number", "start"))
    hashed = F.xxhash64(*(c for c, kind in items.dtypes if c in names and "map<" not in kind and "variant" not in kind))
    kept = items.select(*names, F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(1)), F.lit(1)).alias(size), hashed.alias(mark), F.monotonically_increasing_id().alias(row))
    kept = write_table(kept, "items")
    histogram = kept.groupBy(F.col(size).alias("length")).agg(F.count("*").alias("n")).orderBy("length").toPandas()
    lengths, counts = histogram.length.to_numpy(np.int64), histogram.n.to_numpy(np.int64)
    ends = boundaries(lengths, counts, buckets)
    before = np.r_[0, np.cumsum(counts)]
    bucket, bucket_len, offset = F.lit(0), F.lit(0), F.lit(0)
    for k, (first, last) in reversed(list(enumerate(zip([-1, *ends], ends, strict=False)))):
        here = F.col(size) <= int(lengths[last])
        bucket, bucket_len, offset = (F.when(here, F.lit(v)).otherwise(x) for v, x in ((k, bucket), (int(lengths[last]), bucket_len), (int(before[first + 1]), offset)))
    keys = [size, *order, mark, row]
    ranged = kept.repartitionByRange(int(-(-before[-1] // RANGE)) or 1, *keys).withColumn(part, F.spark_partition_id())
    ranged = write_table(ranged, "ranges")
    sizes = ranged.groupBy(part).agg(F.count("*").alias("n"))  # a row for each range
    starts = write_table(sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(start)), "starts")
    numbered = ranged.withColumn(number, F.row_number().over(Window.partitionBy(part).orderBy(*keys)) - 1).join(starts, part)
    rank = F.col(start) + F.col(number) - offset
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(bucket_len, F.lit(1)))).cast("long")
    return numbered.select(*names, bucket.cast("int").alias("bucket"), bucket_len.cast("long").alias("bucket_len"), F.floor(rank / room).cast("long").alias("batch"), (rank % room).cast("int").alias("slot"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens (words and one end) and its place for each row of ``docs``."""
    items = docs.select(F.col("doc_id").cast("long"), word_tokens(F.col("text").cast("string")).alias("n_tokens"))
    return result(lambda: pack(items, order=("doc_id",)), "packed")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Batches of the whole of ``documents``."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    rounds = ", ".join(
        f"""r{k} AS (
  SELECT j, min({{'cost': cost, 'more': more, 'i': i, 'ends': ends}}) AS s FROM (
    SELECT j, s.cost AS cost, 0 AS more, 0 AS i, s.ends AS ends FROM r{k - 1}
    UNION ALL
    SELECT b.j, a.s.cost + b.length * (b.upto - c.upto), 1, a.j, list_append(a.s.ends, b.length)
    FROM r{k - 1} a JOIN lengths c ON c.j = a.j JOIN lengths b ON b.j > a.j
  ) GROUP BY j
)"""
        for k in range(2, BUCKETS + 1)
    )
    return rf"""
WITH items AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	
]+')) + 1 AS BIGINT) AS n_tokens FROM documents
), lengths AS (
  SELECT n_tokens AS length, row_number() OVER (ORDER BY n_tokens) AS j, CAST(sum(count(*)) OVER (ORDER BY n_tokens) AS BIGINT) AS upto
  FROM items GROUP BY n_tokens
), r1 AS (
  SELECT j, {{'cost': length * upto, 'more': 0, 'i': CAST(0 AS BIGINT), 'ends': [length]}} AS s FROM lengths
), {rounds}, ends AS (
  SELECT unnest(s.ends) AS bucket_len, generate_subscripts(s.ends, 1) - 1 AS bucket FROM r{BUCKETS} WHERE j = (SELECT max(j) FROM lengths)
), placed AS (
  SELECT i.doc_id, i.n_tokens, (SELECT min(bucket_len) FROM ends WHERE bucket_len >= i.n_tokens) AS bucket_len FROM items i
), numbered AS (
  SELECT p.*, e.bucket, row_number() OVER (PARTITION BY e.bucket ORDER BY n_tokens, doc_id) - 1 AS rank, greatest(1, {BUDGET} // p.bucket_len) AS room
  FROM placed p JOIN ends e ON e.bucket_len = p.bucket_len
)
SELECT doc_id, n_tokens, CAST(bucket AS INTEGER) AS bucket, bucket_len, CAST(rank // room AS BIGINT) AS batch, CAST(rank % room AS INTEGER) AS slot FROM numbered
"""


#: The boundaries by dynamic programming over all pairs of lengths, and the numbers in their buckets.
ORACLE = _oracle()
