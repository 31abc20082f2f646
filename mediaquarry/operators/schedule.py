"""Which download comes next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from . import browse
from .sync import pending


def queue(requests: DataFrame) -> DataFrame:
    """(category, rank): the category asked for last comes first, from 0.

    ``requests`` has seq and category; empty ones and the entry for all don't
    count.  Categories are few, so they may be ranked in one task.
    """
    asked = requests.filter((F.coalesce(F.col("category"), F.lit("")) != "") & (F.col("category") != browse.ALL))
    last = asked.groupBy("category").agg(F.max("seq").alias("seq"))
    return numbered(last, [], "seq", True, "n").select("category", (F.col("n") - 1).cast("int").alias("rank"))


def _waiting(posts: DataFrame, categories: DataFrame, ranks: DataFrame) -> DataFrame:
    named = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return pending(posts).select("video_id", "category_id").join(named, "category_id", "left").join(ranks, "category", "left")


def _place() -> list[Column]:
    return [F.col("rank").asc_nulls_last(), F.desc("video_id")]


def next_target(posts: DataFrame, categories: DataFrame, ranks: DataFrame) -> DataFrame:
    """(video_id, target): of the first queued category with work, else of all, the newest; no row without work."""
    rows = _waiting(posts, categories, ranks).orderBy(*_place()).limit(1)
    return rows.select("video_id", F.when(F.col("rank").isNotNull(), F.col("category")).otherwise("Global").alias("target"))


def download_order(posts: DataFrame, categories: DataFrame, ranks: DataFrame) -> DataFrame:
    """(video_id, place): the order in which all downloads come if nothing more is asked for."""
    rows = _waiting(posts, categories, ranks).withColumn("rank", F.coalesce(F.col("rank"), F.lit((1 << 31) - 1)))
    local = numbered(rows.select("video_id", "rank"), ["rank"], "video_id", True, "n")
    sizes = rows.groupBy("rank").agg(F.count("*").alias("size"))
    # a row for each queued category and one for the rest
    larger = sizes.select(F.col("rank").alias("other"), F.col("size").alias("others"))
    before = sizes.join(larger, F.col("other") < F.col("rank"), "left").groupBy("rank").agg(F.coalesce(F.sum("others"), F.lit(0)).alias("before"))
    return local.join(before, "rank").select("video_id", (F.col("before") + F.col("n")).alias("place"))


def queue_left(ranks: DataFrame, posts: DataFrame, categories: DataFrame) -> DataFrame:
    """The queue without categories that have no work."""
    named = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    busy = pending(posts).select("category_id").join(named, "category_id").select("category")
    return ranks.join(busy, "category", "left_semi")
