"""Incremental upkeep of a catalog from a source of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import numbered, preceding, running
from ..sources.tables import ERROR, HARVESTED, METADATA_ONLY, Catalog
from . import captions

CHUNK = 200


def latest_id(messages: DataFrame) -> int:
    """The largest id of the source, 0 for none."""
    return messages.agg(F.max("id")).first()[0] or 0


def missing_ids(present: DataFrame, latest: int) -> DataFrame:
    """(id): what is absent of 1 to ``latest``; deleted ids stay missing for ever."""
    spark = present.sparkSession
    return spark.range(1, latest + 1).join(present.select(F.col("video_id").alias("id")), "id", "left_anti")


def missing_ranges(present: DataFrame, latest: int) -> DataFrame:
    """(first, last): what is absent of 1 to ``latest``, as the stretches between ids that are present.

    Its cost is that of the ids present, however far apart they are.
    """
    spark = present.sparkSession
    ids = present.select(F.col("video_id").alias("id")).filter(F.col("id").between(1, latest)).distinct()
    end = spark.range(1).select(F.lit(latest + 1).cast("long").alias("id"))
    gaps = preceding(ids.union(end), "id", "before").select((F.coalesce("before", F.lit(0)) + 1).alias("first"), (F.col("id") - 1).alias("last"))
    return gaps.filter("first <= last")


def range_chunks(ranges: DataFrame, size: int = CHUNK) -> DataFrame:
    """(first, last, chunk_of_last, chunk_of_first): the chunks that the ids of each range fall in, as :func:`chunked` numbers them.

    Largest ids come first, so a range's last id has the smallest chunk.
    """
    rows = ranges.select("first", "last", (-F.col("last")).alias("_order"), (F.col("last") - F.col("first") + 1).alias("_n"), F.lit(0).alias("_all"))
    rows = running(rows, "_all", "_order", "_n")
    return rows.select("first", "last", F.expr(f"(total - _n) div {size}").alias("chunk_of_last"), F.expr(f"(total - 1) div {size}").alias("chunk_of_first"))


def chunked(ids: DataFrame, size: int = CHUNK) -> DataFrame:
    """(id, chunk): largest ids first, ``size`` to a chunk, from 0."""
    return numbered(ids, [], "id", True, "n").select("id", F.floor((F.col("n") - 1) / size).cast("long").alias("chunk"))


def first_wins(existing: DataFrame, incoming: DataFrame, key: str, order: list) -> DataFrame:
    """Rows of ``incoming`` whose key is new, the first in ``order`` of each key.

    The pick is an aggregate, so a key of very many rows is reduced before it
    is shuffled.
    """
    names = incoming.columns
    first = incoming.groupBy(key).agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"v_{c}") for c in names if c != key])).alias("first"))
    rows = first.select(*[F.col(c) if c == key else F.col(f"first.v_{c}").alias(c) for c in names])
    return rows.join(existing.select(key), key, "left_anti")


def new_names(known: DataFrame, seen: DataFrame, name: str) -> DataFrame:
    """(id, ``name``) for names that ``known`` lacks.

    ``seen`` has the name and the message id.  Messages come largest id first,
    so names are numbered by their largest message id, after the largest id in
    use; names found again use no number.
    """
    firsts = seen.groupBy(name).agg(F.max("id").alias("seen")).join(known.select(name), name, "left_anti")
    # names that share a message id can't be: a message has one name of a kind
    used = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("used"))
    return numbered(firsts, [], "seen", True, "n").crossJoin(used).select((F.col("used") + F.col("n")).alias("id"), name)


def synced(catalog: Catalog, messages: DataFrame) -> tuple[Catalog, DataFrame]:
    """The catalog after all of ``messages``, and the rows held back for a like count that can't be read.

    A post that is known stays as it was; docs grows by exactly the new posts
    and is never changed afterwards.
    """
    rows, held = captions.parsed_or_held(messages)
    categories = catalog.categories.unionByName(new_names(catalog.categories, rows.select(F.col("category").alias("name"), "id"), "name"))
    creators = catalog.creators.unionByName(new_names(catalog.creators, rows.select(F.col("creator").alias("username"), "id"), "username"))
    fresh = first_wins(catalog.posts, rows.withColumnRenamed("id", "video_id"), "video_id", [F.col("category"), F.col("creator"), F.col("likes"), F.col("caption")])
    posts = (
        fresh.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category")
        .join(creators.select(F.col("id").alias("creator_id"), F.col("username").alias("creator")), "creator")
        .select("video_id", "category_id", "creator_id", "likes", "caption", F.lit(None).cast("string").alias("local_video_path"), F.lit(METADATA_ONLY).alias("status"))
    )
    docs = fresh.select("video_id", "caption", "creator", "category")
    return Catalog(categories, creators, catalog.posts.unionByName(posts), catalog.docs.unionByName(docs)), held


def with_outcomes(posts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``posts`` after download outcomes (video_id, seq, ok, path).

    The outcome with the largest seq decides: success sets path and status, a
    failure the status alone, and keeps a path that an earlier success set.
    """
    paths = F.max(F.when(F.col("ok"), F.struct("seq", "path"))).alias("done")
    last = outcomes.groupBy("video_id").agg(F.max(F.struct("seq", "ok")).alias("last"), paths)
    rows = posts.join(last, "video_id", "left")
    status = F.when(F.col("last").isNull(), F.col("status")).when(F.col("last.ok"), HARVESTED).otherwise(ERROR)
    path = F.coalesce("done.path", "local_video_path")
    return rows.select(*[{"status": status, "local_video_path": path}.get(c, F.col(c)).alias(c) for c in posts.columns])


def pending(posts: DataFrame) -> DataFrame:
    """Posts that wait for their download; an error is final."""
    return posts.filter(F.col("status") == METADATA_ONLY)
