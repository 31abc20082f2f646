"""Reading vectors in blocks, and the best k of many candidates for each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import write_table

#: Rows of a block of candidates, and of one of queries.
ROWS, QUERY_ROWS = 8_192, 8_192


def usable(df: DataFrame, nonzero: bool, most: float = float("inf")) -> DataFrame:
    """(vec_id, embedding as doubles) whose components are all below ``most`` in size, perhaps not all zero.

    One row for each vec_id: of several vectors the least, component by component.
    """
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < most))
    if nonzero:
        good &= F.exists(x, lambda v: v != 0)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(good, F.lit(False)))
    # ids alone tell which are there more than once; the other vectors are neither sorted nor shuffled
    again = write_table(rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id"), "again")
    least = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return rows.join(again, "vec_id", "left_anti").unionByName(least)


def arrays(batch: pa.RecordBatch | pa.Table, size: int) -> np.ndarray:
    """The column embedding as a matrix; all its rows have ``size`` components."""
    column = batch.column("embedding")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def blocks(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of up to about ``rows`` rows (vec_id, embedding), those of one length together."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
        ids = batch.column(0).to_numpy()
        vectors = batch.column(1)
        sizes = np.diff(vectors.offsets.to_numpy())
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            mine = held.setdefault(int(size), [])
            mine.append((ids[at], flat.reshape(len(at), size)))
            if sum(len(i) for i, _ in mine) >= rows:
                yield np.concatenate([i for i, _ in mine]), np.concatenate([v for _, v in mine])
                held[int(size)] = []
    for mine in held.values():
        if mine:
            yield np.concatenate([i for i, _ in mine]), np.concatenate([v for _, v in mine])


class Best:
    """For each of n queries the k smallest (key, id), ids distinct by construction."""

    def __init__(self, n: int, k: int, dtype: type) -> None:
        self.k = k
        self.query = np.zeros(0, np.int64)
        #: Doubles, or whole numbers of any size once any such is added.
        self.key = np.zeros(0, dtype)
        self.id = np.zeros(0, np.int64)
        #: The largest key that can still enter.
        self.kth = np.full(n, np.inf)

    def add(self, query: np.ndarray, key: np.ndarray, id_: np.ndarray) -> None:
        if not len(query):
            return
        if key.dtype == object != self.key.dtype:
            self.key = np.array([int(x) for x in self.key], object)
        elif self.key.dtype == object != key.dtype:
            key = np.array([int(x) for x in key], object)
        query, key, id_ = np.r_[self.query, query], np.r_[self.key, key], np.r_[self.id, id_]
        order = np.lexsort((id_, key, query))
        query, key, id_ = query[order], key[order], id_[order]
        start = np.r_[True, query[1:] != query[:-1]]
        place = np.arange(len(query)) - np.flatnonzero(start)[np.cumsum(start) - 1]
        keep = place < self.k
        last = place == self.k - 1
        self.kth[query[last]] = [_up(x) for x in key[last]] if key.dtype == object else key[last]
        self.query, self.key, self.id = query[keep], key[keep], id_[keep]


def _up(x: int) -> float:
    """A double that isn't less than ``x``."""
    try:
        return float(np.nextafter(float(x), np.inf))
    except OverflowError:
        return np.inf if x > 0 else -np.finfo(float).max


def ranked(found: DataFrame, k: int, *order: str) -> DataFrame:
    """``found`` with rank: the k first rows of each query_id in the order of key, of further columns, and of vec_id."""
    window = Window.partitionBy("query_id").orderBy("key", *order, "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
