"""Pages, playlists and menus of a catalog.

Dimension tables are joined without hints: adaptive execution broadcasts them
where their size at run time allows it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import ranks
from ..sources.tables import Catalog

PAGE = 30
ALL = "All Categories"


def playable() -> Column:
    """Only the path counts: a post whose status is an error may still have a file."""
    return F.col("local_video_path").isNotNull()


def named(catalog: Catalog) -> DataFrame:
    """Playable posts with the names of creator and category."""
    posts = catalog.posts.filter(playable())
    creators = catalog.creators.select(F.col("id").alias("creator_id"), F.col("username").alias("creator"))
    categories = catalog.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return posts.join(creators, "creator_id").join(categories, "category_id")


def explore_record() -> list[Column]:
    return [
        F.col("video_id").alias("id"), F.col("creator"), F.col("category"), X.thousands(F.col("likes")).alias("likes"),
        F.col("caption"), X.base_name(F.col("local_video_path")).alias("filename"),
    ]


def page(df: DataFrame, order: list[Column], offset: int, size: int = PAGE) -> DataFrame:
    """One page in a total order; a negative offset counts as 0."""
    return df.orderBy(*order).offset(max(0, offset)).limit(size)


def browse(catalog: Catalog, offset: int = 0, size: int = PAGE) -> DataFrame:
    """Playable posts, newest first.

    The page is cut among ids alone; only its posts are read whole and meet the
    names, which every post has.  For an offset far down see :func:`browse_deep`.
    """
    ids = page(catalog.posts.filter(playable()).select("video_id"), [F.desc("video_id")], offset, size)
    return _records(catalog, catalog.posts.join(ids, "video_id", "left_semi"))


def _records(catalog: Catalog, posts: DataFrame) -> DataFrame:
    rows = named(replace(catalog, posts=posts))
    return rows.orderBy(F.desc("video_id")).select(*explore_record())


def page_tree(posts: DataFrame) -> DataFrame:
    """The count tree of playable posts, for :func:`browse_deep`; that of newly playable ones is appended to it."""
    return ranks.count_tree(posts.filter(playable()), "video_id")


def browse_deep(catalog: Catalog, tree: DataFrame, offset: int, size: int = PAGE) -> DataFrame:
    """The same page as :func:`browse` gives, from a stored count tree of the playable posts.

    Whatever the offset, it reads the nodes above two blocks of ids and the
    posts between the two, so it sorts no more than two blocks and a page.
    """
    found = ranks.id_page(tree, offset, size)
    if found is None:
        return _records(catalog, catalog.posts.filter(F.lit(False)))
    low, high, skip = found
    posts = catalog.posts.filter(F.col("video_id").between(low, high))
    ids = page(posts.filter(playable()).select("video_id"), [F.desc("video_id")], skip, size)
    return _records(catalog, posts.join(ids, "video_id", "left_semi"))


def has_more(rows: int, size: int = PAGE) -> bool:
    """Whether a page of so many rows can have another after it."""
    return rows == size


def playlist(catalog: Catalog, category: str | None = None) -> DataFrame:
    """All playable posts of a category, or of all, newest first."""
    rows = named(catalog)
    if category and category != ALL:
        rows = rows.filter(F.col("category") == category)
    return rows.orderBy(F.desc("video_id")).select(
        F.col("creator").alias("username"), F.col("category").alias("name"), "likes", "caption", X.base_name(F.col("local_video_path")).alias("filename"), F.col("video_id").alias("id")
    )


def category_names(catalog: Catalog) -> DataFrame:
    """(position, name): all categories that any post has, by name, after the entry for all."""
    used = catalog.categories.join(catalog.posts.select("category_id"), F.col("id") == F.col("category_id"), "left_semi")
    spark = catalog.posts.sparkSession
    first = spark.range(1).select(F.lit(0).alias("position"), F.lit(ALL).alias("name"))
    both = first.unionByName(used.select(F.lit(1).alias("position"), "name").distinct())
    return both.orderBy("position", "name")


def menu(names: DataFrame, queue: DataFrame) -> DataFrame:
    """(place, name, label): queued categories by rank, then the others as they came.

    ``names`` has position and name; ``queue`` category and rank from 0.
    """
    ranks = queue.select(F.col("category").alias("name"), "rank")
    label = F.when(F.col("rank").isNotNull(), (F.col("rank") + 1).cast("string")).otherwise("")
    rows = names.join(ranks, "name", "left")
    return rows.orderBy(F.col("rank").asc_nulls_last(), "position", "name").select("name", label.alias("label"), F.col("rank").cast("int").alias("rank"))


def ui_rows(records: DataFrame) -> DataFrame:
    """Explore records as shown: handle and teaser."""
    return records.select("id", X.handle(F.col("creator")).alias("creator"), "category", "likes", X.teaser(F.col("caption")).alias("caption"))
