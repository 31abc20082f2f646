"""A catalog and its search index that grow by batches of messages and of outcomes.

A batch reads of the catalog what it needs to tell new from known: names, and
the ids between its own least and largest.  It writes one segment, with its
posts, docs, postings and statistics; nothing that was stored before is written
again.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import ranks
from ..sources import storage
from ..sources.segments import Segments, Table, added_up
from ..sources.tables import METADATA_ONLY, Catalog
from . import browse, captions, sync
from .search import Index, build, dictionary

TABLES = {
    "categories": Table("id LONG, name STRING", ("id",)),
    "creators": Table("id LONG, username STRING", ("id",)),
    "posts": Table("video_id LONG, category_id LONG, creator_id LONG, likes LONG, caption STRING, local_video_path STRING, status STRING", ("video_id",)),
    "docs": Table("video_id LONG, caption STRING, creator STRING, category STRING", ("video_id",)),
    "postings": Table("token STRING, video_id LONG, col STRING, pos INT", ("token", "video_id")),
    "terms": Table("token STRING, col STRING, df LONG, cf LONG", ("token", "col")),
    "lengths": Table("video_id LONG, n_tokens LONG", ("video_id",)),
    "totals": Table("n_docs LONG, n_tokens LONG", ()),
    "outcomes": Table("video_id LONG, seq LONG, ok BOOLEAN, path STRING", ("video_id",)),
    "pages": Table("level INT, key LONG, n LONG", ("level", "key")),
    "held": Table("id LONG, category STRING, creator STRING, likes LONG, caption STRING", ()),
}


class CatalogStore(Segments):
    """A catalog in a folder."""

    def __init__(self, spark: SparkSession, path: str, **settings: int) -> None:
        super().__init__(spark, path, TABLES, **settings)

    def catalog(self) -> Catalog:
        """The catalog after all batches."""
        m = self.manifest()
        bare = Catalog(*(self.read(name, m) for name in ("categories", "creators", "posts", "docs")))
        return replace(bare, posts=sync.with_outcomes(bare.posts, self.read("outcomes", m))) if any("outcomes" in s["rows"] for s in m["segments"]) else bare

    def index(self) -> Index:
        """The search index over all segments; their statistics add up."""
        m = self.manifest()
        return Index(self.read("postings", m), self.read("lengths", m), added_up(self.read("totals", m), []), terms=added_up(self.read("terms", m), ["token", "col"]))

    def pages(self) -> DataFrame:
        """The count tree of playable posts, for deep pages."""
        return self.read("pages")

    def sync(self, batch: int, messages: DataFrame) -> bool:
        """Add the posts of a batch of messages that are new; False for a batch that was added before.

        Posts, names and docs are those that :func:`sync.synced` gives.
        """
        return self.append("messages", batch, lambda segment: self._synced(segment, messages))

    def _synced(self, segment: str, messages: DataFrame) -> dict[str, DataFrame]:
        m, scratch = self.manifest(), storage.fresh(self.spark, "batch")
        try:
            captions.parsed(messages.filter(captions.is_media())).write.parquet(scratch)  # a batch's input is read once
            parsed = self.spark.read.schema(TABLES["held"].schema).parquet(scratch)
            rows = parsed.filter("likes IS NOT NULL").withColumnRenamed("id", "video_id")
            low, high = rows.agg(F.min("video_id"), F.max("video_id")).first()
            out = {"held": self.write(segment, "held", parsed.filter("likes IS NULL"))}
            if low is None:
                return out
            names = {}
            for table, column, name in (("categories", "category", "name"), ("creators", "creator", "username")):
                old = self.read(table, m)
                out[table] = self.write(segment, table, sync.new_names(old, rows.select(F.col("video_id").alias("id"), F.col(column).alias(name)), name))
                names[column] = old.unionByName(out[table]).select(F.col("id").alias(f"{column}_id"), F.col(name).alias(column))
            near = self.read("posts", m).filter(F.col("video_id").between(low, high))
            fresh = sync.first_wins(near, rows, "video_id", [F.col("category"), F.col("creator"), F.col("likes"), F.col("caption")])
            posts = fresh.join(names["category"], "category").join(names["creator"], "creator")
            out["posts"] = self.write(segment, "posts", posts.withColumns({"local_video_path": F.lit(None).cast("string"), "status": F.lit(METADATA_ONLY)}))
            added = out["posts"].join(names["category"], "category_id").join(names["creator"], "creator_id")
            out["docs"] = self.write(segment, "docs", added)
            index = build(out["docs"])
            out["lengths"] = self.write(segment, "lengths", index.lengths)
            out["postings"] = self.write(segment, "postings", index.postings)
            out["terms"] = self.write(segment, "terms", dictionary(out["postings"]))
            totals = out["lengths"].agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
            out["totals"] = self.write(segment, "totals", totals.filter("n_docs > 0"))
            return out
        finally:
            storage.remove(self.spark, scratch)

    def record(self, batch: int, outcomes: DataFrame) -> bool:
        """Add download outcomes (video_id, seq, ok, path), a success with its path; False for a batch that was added before.

        An outcome of a post that isn't there changes nothing, also later on.
        """

        def fill(segment: str) -> dict[str, DataFrame]:
            before = self.catalog().posts
            out = {"outcomes": self.write(segment, "outcomes", outcomes.join(before.select("video_id"), "video_id", "left_semi"))}
            done = out["outcomes"].filter("ok").select("video_id").distinct()
            waiting = before.filter(~browse.playable()).select("video_id").join(done, "video_id", "left_semi")
            out["pages"] = self.write(segment, "pages", ranks.count_tree(waiting, "video_id"))
            return out

        return self.append("outcomes", batch, fill)
