"""Tables of a folder, and the views that stand for a media catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

CATEGORIES = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
CREATORS = T.StructType([T.StructField("id", T.LongType()), T.StructField("username", T.StringType())])
POSTS = T.StructType(
    [
        T.StructField("video_id", T.LongType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("creator_id", T.LongType()),
        T.StructField("likes", T.LongType()),
        T.StructField("caption", T.StringType()),
        T.StructField("local_video_path", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)
MESSAGES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("empty", T.BooleanType()),
        T.StructField("has_video", T.BooleanType()),
        T.StructField("mime", T.StringType()),
        T.StructField("caption", T.StringType()),
    ]
)
METADATA_ONLY, HARVESTED, ERROR = "Metadata_Only", "Harvested", "Error"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def message_files(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Messages dropped as JSON files, as a batch or as a stream of so many files at a time."""
    reader = spark.readStream if stream else spark.read
    if stream and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.schema(MESSAGES).json(path)


def blob_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as path, size and content; the content is read only where it is used."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), "content")


def blob(files: DataFrame, name: str) -> DataFrame:
    """The file of this name: no row where it is missing."""
    return files.filter(X.base_name(F.col("path")) == name)


@dataclass(frozen=True)
class Catalog:
    """The tables of a catalog; docs is the denormalised copy that search reads."""

    categories: DataFrame
    creators: DataFrame
    posts: DataFrame
    docs: DataFrame

    def write(self, path: str) -> None:
        """Store all tables in a folder that is new; posts and docs in the order of their ids, so that a range of ids reads few row groups."""
        for name in ("categories", "creators"):
            getattr(self, name).write.parquet(f"{path}/{name}")
        for name in ("posts", "docs"):
            getattr(self, name).repartitionByRange("video_id").sortWithinPartitions("video_id").write.parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Catalog:
        return Catalog(*(spark.read.parquet(f"{path}/{name}") for name in ("categories", "creators", "posts", "docs")))


def caption_of(category: Column, creator: Column, likes: Column, body: Column) -> Column:
    """A structured caption."""
    return F.concat(
        F.lit(X.CATEGORY_LABEL + " "), category, F.lit(f"\n{X.CREATOR_LABEL} "), creator, F.lit(f"\n{X.LIKES_LABEL} "), X.thousands(likes),
        F.lit(f"\n{X.CAPTION_LABEL}\n"), body, F.lit(f"\n{X.LINK_LABEL} none"),
    )


def sample_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as captioned messages."""
    d = table(spark, folder, "documents")
    caption = caption_of(F.col("lang"), F.col("source"), F.col("n_chars"), F.col("text"))
    return d.select((F.col("doc_id") + 1).alias("id"), F.lit(False).alias("empty"), F.lit(True).alias("has_video"), F.lit(None).cast("string").alias("mime"), caption.alias("caption"))


def sample_catalog(spark: SparkSession, folder: str) -> Catalog:
    """Documents and labels as a catalog of posts.

    A labelled document has a file; toxic 1 stands for a failure after the
    download.  Names get ids in the order of their largest message id.
    """
    d, labels = table(spark, folder, "documents"), table(spark, folder, "labels")

    def ids(name: str, out: str) -> DataFrame:
        from ..plans.numbering import numbered

        seen = d.groupBy(F.col(name).alias(out)).agg(F.max(F.col("doc_id") + 1).alias("seen"))
        return numbered(seen, [], "seen", True, "id").select("id", out)

    categories, creators = ids("lang", "name"), ids("source", "username")
    rows = d.select((F.col("doc_id") + 1).alias("video_id"), "doc_id", "lang", "source", F.col("n_chars").alias("likes"), F.col("text").alias("caption"))
    rows = rows.join(labels.select("doc_id", "toxic"), "doc_id", "left")
    posts = (
        rows.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("lang")), "lang")
        .join(creators.select(F.col("id").alias("creator_id"), F.col("username").alias("source")), "source")
        .select(
            "video_id", "category_id", "creator_id", "likes", "caption",
            F.when(F.col("toxic").isNotNull(), F.concat(F.lit("/lake/videos/"), X.video_file(F.col("video_id")))).alias("local_video_path"),
            F.when(F.col("toxic").isNull(), METADATA_ONLY).when(F.col("toxic") == 0, HARVESTED).otherwise(ERROR).alias("status"),
        )
    )
    docs = d.select((F.col("doc_id") + 1).alias("video_id"), F.col("text").alias("caption"), F.col("source").alias("creator"), F.col("lang").alias("category"))
    return Catalog(categories, creators, posts, docs)
