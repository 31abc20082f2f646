"""Tables in the folder that the cluster shares, and small Arrow batches.

A table that only one result needs is written within :func:`scratch` and goes
when the block ends; the others go with the driver.
"""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import fresh, remove, ship

_REMOVE: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table in the shared folder; what is there goes with the driver, or with :func:`scratch`."""
    path = fresh(spark, name)
    _REMOVE.append((spark, path))
    return path


#: Options of Parquet for tables with rows of some MB: row groups of 4 MB or one row; by default at least a hundred rows are in a page.
LARGE_ROWS = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


def write_table(df: DataFrame, name: str, by: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, perhaps in a folder for each value of ``by``, and read it back.

    This cuts the lineage; the files outlive lost executors.  ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = (df.write.partitionBy(by) if by else df.write).options(**(options or {}))
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables written in this block are removed at its end."""
    before = len(_REMOVE)
    try:
        yield
    finally:
        mine = _REMOVE[before:]
        del _REMOVE[before:]
        for spark, path in mine:
            remove(spark, path)


@atexit.register
def _clean() -> None:
    for spark, path in _REMOVE:
        remove(spark, path)


def result(make, name: str) -> DataFrame:
    """The frame that ``make`` gives, as a table; what ``make`` writes on the way is removed."""
    with scratch():
        df = make()
        spark, path = df.sparkSession, fresh(df.sparkSession, name)
        df.write.parquet(path)
    _REMOVE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``.

    Spark bounds the bytes of its batches; these bound the Python objects that
    a worker makes of them at once.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def picked(share: float | Column, *columns: str) -> Column:
    """Whether a row belongs to a sample of about this share of all rows, by a hash of its columns to 62 bits, so of any number of rows."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit("sample")), 2) < (F.lit(share) * float(1 << 62)).cast("long")


def ready(spark: SparkSession) -> None:
    """Send this package to the executors, once."""
    ship(spark)
