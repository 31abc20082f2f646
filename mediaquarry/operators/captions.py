"""Messages with structured captions as rows of posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def is_media() -> Column:
    """Whether a message (empty, has_video, mime) carries a video."""
    video = F.coalesce(F.col("has_video"), F.lit(False)) | F.coalesce(F.contains("mime", F.lit("video")), F.lit(False))
    return ~F.coalesce(F.col("empty"), F.lit(False)) & video


def parsed(messages: DataFrame) -> DataFrame:
    """(id, category, creator, likes, caption) of each message; likes are null where the count has no digit.

    A label with nothing behind it takes the next line, and a link right after
    the caption label is taken for the caption.
    """
    text = F.coalesce(F.col("caption"), F.lit(""))
    return messages.select(
        "id",
        X.labelled(text, X.CATEGORY_LABEL).alias("category"),
        X.labelled(text, X.CREATOR_LABEL).alias("creator"),
        X.like_count(text).alias("likes"),
        X.caption_body(text).alias("caption"),
    )


def parsed_or_held(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Media messages that could be parsed, and those whose like count couldn't be read."""
    rows = parsed(messages.filter(is_media()))
    return rows.filter(F.col("likes").isNotNull()), rows.filter(F.col("likes").isNull())


def read_counts(messages: DataFrame) -> DataFrame:
    """(n_rows, n_held): how many media messages there are, and how many of them were held back."""
    rows = parsed(messages.filter(is_media()))
    return rows.agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("likes").isNull(), 1)).alias("n_held"))


def route(codec: Column) -> Column:
    """Whether a video of this codec has to be transcoded or only remuxed."""
    # Codecs that browsers play.
    playable = ("h264", "av1", "hevc", "h265")
    name = X.first_line(F.coalesce(codec, F.lit("")))
    return F.when((name != "") & ~name.isin(*playable), "transcode").otherwise("remux")


def admitted(free_bytes: Column, least_gib: float = 5.0) -> Column:
    """Whether a download may start with this much free space."""
    return free_bytes / F.lit(1024.0**3) >= least_gib
