"""One value kept between sessions: where a playlist stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def index_of(text: Column) -> Column:
    """The stored number, 0 for what isn't one."""
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(0))


def clamped(index: Column, length: Column) -> Column:
    """An index within a list: negative ones become 0, null beyond the end (nothing changes)."""
    return F.when(index < length, F.greatest(F.lit(0), index))


def write_index(spark: SparkSession, path: str, index: int) -> None:
    spark.createDataFrame([(str(index),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(index): one row, also where nothing was ever written or it can't be read."""
    try:
        rows = spark.read.text(path)
    except Exception:  # a missing file counts as 0, as any other failure does
        rows = spark.createDataFrame([], "value string")
    return rows.agg(F.coalesce(F.first(index_of(F.col("value"))), F.lit(0)).alias("index"))
