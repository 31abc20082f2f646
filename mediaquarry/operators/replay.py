"""The scheduler while requests come in: what each download fetched.

Time is counted in downloads.  Until one of the requested categories runs out,
the latest request of those with work decides.  So a phase takes the stretches
of downloads between such requests, running totals of their lengths tell which
category runs out first, and that ends it.  Where none has work, the newest
posts go until a category with work is asked for.  There are at most two phases
for each category with work, however many posts, requests and downloads there
are; the driver knows a few numbers for each category, and each phase's
stretches are written and read by tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.numbering import numbered, preceding, running
from .sync import pending

#: The key of posts without a category; they come only when no request has work.
NO_CATEGORY = -1
SPANS = "c long, f long, length long, before long"
REST = "video_id long, c long, place long"
#: A block takes 2**BITS posts of a category.
BITS = 16


def _timeline(requests: DataFrame, fetches: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(seq, c, f): requests with the number of downloads before them, and downloads (null c) with their own number, up to ``most``."""
    asked = requests.filter("seq IS NOT NULL").join(ids.select("c", "category"), "category").select("seq", "c", F.lit(0).alias("step"))
    taken = fetches.filter("seq IS NOT NULL").select("seq", F.lit(None).cast("long").alias("c"), F.lit(1).alias("step"))
    steps = running(asked.union(taken).withColumn("all", F.lit(0)), "all", "seq", "step")
    return steps.select("seq", "c", F.col("total").alias("f")).filter(F.col("f") <= most)


def _spans(asked: DataFrame, left: DataFrame, now: int, stop: int) -> DataFrame:
    """(c, f, length, total, left, taken): stretches of downloads after the f-th, with running totals, if no category ran out."""
    last = asked.join(left, "c", "left_semi").filter(F.col("f") < stop).groupBy(F.greatest("f", F.lit(now)).alias("f")).agg(F.max_by("c", "seq").alias("c"))
    spans = preceding(last.withColumn("back", -F.col("f")), "back", "after")
    spans = spans.select("c", "f", (F.coalesce(-F.col("after"), F.lit(stop)) - F.col("f")).alias("length"))
    return running(spans, "c", "f", "length").select("c", "f", "length", "total").join(left, "c")


def _found(waiting: DataFrame, spans: DataFrame, bits: int = BITS) -> DataFrame:
    """(video_id, c, place): posts that lie in a stretch of their category, by blocks of posts."""
    posts = waiting.select("c", F.shiftright(F.col("n") - 1, bits).alias("block"), (F.col("n") - 1).alias("at"), "video_id", F.lit(None).cast(SPANS_TYPE).alias("span"))
    blocks = F.explode(F.sequence(F.shiftright("before", bits), F.shiftright(F.col("before") + F.col("length") - 1, bits)))
    marks = spans.withColumn("block", blocks)
    at = F.greatest("before", F.shiftleft("block", bits))
    marks = marks.select("c", "block", at.alias("at"), F.lit(None).cast("long").alias("video_id"), F.struct("before", "length", "f").alias("span"))
    order = Window.partitionBy("c", "block").orderBy("at", F.col("video_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    rows = posts.union(marks).withColumn("span", F.last("span", True).over(order)).filter("video_id IS NOT NULL")
    beyond = F.col("at") - F.col("span.before")
    return rows.filter(beyond < F.col("span.length")).select("video_id", "c", (F.col("span.f") + beyond + 1).alias("place"))


SPANS_TYPE = "struct<before: long, length: long, f: long>"


def replay(posts: DataFrame, categories: DataFrame, requests: DataFrame, fetches: DataFrame, path: str) -> DataFrame:
    """(seq, place, video_id, target): the post that each download took.

    ``requests`` has seq and category, ``fetches`` the seq of each moment at
    which the downloader was free; seq holds distinct integers over both.  The
    category asked for last goes first, of those that still have work; without
    one the newest of all posts goes, and target is Global.  place counts from
    1.  Moments after the last waiting post have no row.

    Requests of null, empty, unknown or finished categories decide nothing; rows
    without seq are left out.  Posts whose category is null or unknown go as the
    rest does.  Tables of the run are written below ``path``, which must be
    unused.  Categories are few: they, and nothing else, pass the driver.
    """
    spark = posts.sparkSession

    def stored(df: DataFrame, name: str, mode: str = "error") -> DataFrame:
        df.write.mode(mode).parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    ids = categories.select(F.col("id").cast("long").alias("c"), F.col("name").alias("category"))
    waiting = pending(posts).select(F.col("video_id").cast("long").alias("video_id"), F.coalesce(F.col("category_id").cast("long"), F.lit(NO_CATEGORY)).alias("c"))
    waiting = stored(numbered(waiting, ["c"], "video_id", True, "n"), "waiting")
    size = {r["c"]: r["count"] for r in waiting.groupBy("c").count().collect()}
    sized = spark.createDataFrame(list(size.items()), "c long, size long")
    timeline = _timeline(requests, fetches, ids.join(sized, "c", "left_semi"), sum(size.values()))
    timeline = stored(timeline.repartitionByRange("f", "seq"), "timeline")
    asked, taken = timeline.filter("c IS NOT NULL"), timeline.filter("c IS NULL").select("seq", F.col("f").alias("place"))
    end = taken.agg(F.max("place")).first()[0] or 0
    first = {r["c"]: r["f"] for r in asked.groupBy("c").agg(F.min("f").alias("f")).collect()}

    spans = stored(spark.createDataFrame([], SPANS), "spans")
    rest = stored(spark.createDataFrame([], REST), "rest")
    left, now = dict(size), 0
    while now < end:
        open_ = [c for c in left if left[c]]
        stop = min([first.get(c, end) for c in open_], default=end)
        if stop <= now:
            stop = end
            state = spark.createDataFrame([(c, left[c], size[c] - left[c]) for c in open_], "c long, left long, taken long")
            rows = _spans(asked, state, now, stop).persist()
            before = F.col("total") - F.col("length")
            out = rows.filter((F.col("total") >= F.col("left")) & (before < F.col("left"))).agg(F.min(F.col("f") + F.col("left") - before)).first()[0]
            stop = stop if out is None else min(stop, out)
            rows_cut = rows.filter(F.col("f") < stop)
            length = F.least("length", F.lit(stop) - F.col("f"))
            stored(rows_cut.select("c", "f", length.alias("length"), (F.col("taken") + before).alias("before")), "spans", "append")
            gone = rows_cut.groupBy("c").agg(F.sum(length).alias("n")).collect()
            rows.unpersist()
        else:
            # each category still open gave its newest posts first, so what it has left are its posts from a number on
            state = spark.createDataFrame([(c, size[c] - left[c]) for c in open_], "c long, taken long")
            rows = numbered(waiting.join(state, "c").filter("n > taken").select("video_id", "c"), [], "video_id", True, "g").filter(F.col("g") <= stop - now)
            rest = stored(rows.select("video_id", "c", (F.col("g") + now).alias("place")), "rest", "append")
            gone = rest.filter(F.col("place") > now).groupBy("c").agg(F.count("*").alias("n")).collect()
        for r in gone:
            left[r["c"]] -= r["n"]
        now = stop
    spans, rest = spark.read.schema(SPANS).parquet(f"{path}/spans"), spark.read.schema(REST).parquet(f"{path}/rest")
    found = _found(waiting, spans).join(ids, "c").select("video_id", "place", F.col("category").alias("target"))
    found = found.union(rest.select("video_id", "place", F.lit("Global")))
    return found.join(taken, "place").select("seq", "place", "video_id", "target")
