"""The inverted index of a catalog's docs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.text import search_tokens
from .parse import COLUMNS

#: Postings of a stored file.
FILE_ROWS = 1 << 21


@dataclass(frozen=True)
class Index:
    """postings (token, video_id, col, pos), lengths (video_id, n_tokens) of every doc, and totals, the one row of their statistics.

    A stored index has a dictionary too: terms (token, col, df, cf), of each
    token of a column the docs that hold it and its places.  One that was built
    has docs, the texts that it comes from.
    """

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame
    columns: tuple[str, ...] = COLUMNS
    terms: DataFrame | None = None
    docs: DataFrame | None = None

    def write(self, path: str, rows: int = FILE_ROWS) -> None:
        """Store the index with postings in the order of tokens and docs, about ``rows`` of them to a file.

        A search reads few row groups; a token of very many docs is many files.
        """
        self.lengths.write.parquet(f"{path}/lengths")
        _totals(self.lengths.sparkSession.read.parquet(f"{path}/lengths")).coalesce(1).write.parquet(f"{path}/totals")
        total = self.lengths.sparkSession.read.parquet(f"{path}/totals").first()["n_tokens"]
        self.postings.repartitionByRange(max(1, -(-total // rows)), "token", "video_id").sortWithinPartitions("token", "video_id").write.parquet(f"{path}/postings")
        terms = dictionary(self.lengths.sparkSession.read.parquet(f"{path}/postings"))
        terms.repartitionByRange("token").sortWithinPartitions("token", "col").write.parquet(f"{path}/terms")

    @staticmethod
    def read(spark, path: str, columns: tuple[str, ...] = COLUMNS) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "totals")), columns, spark.read.parquet(f"{path}/terms"))


def build(docs: DataFrame, columns: tuple[str, ...] = COLUMNS) -> Index:
    """The index of docs (video_id and ``columns``)."""
    tokens = {c: tokens_of(c) for c in columns}
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), t.alias("tokens")) for c, t in tokens.items())))
    postings = docs.select("video_id", each.alias("x")).select("video_id", "x.col", F.posexplode("x.tokens").alias("pos", "token"))
    lengths = docs.select("video_id", reduce(lambda a, b: a + b, (F.size(t) for t in tokens.values())).alias("n_tokens"))
    return Index(postings.select("token", "video_id", "col", "pos"), lengths, _totals(lengths), columns, docs=docs)


def tokens_of(column: str) -> Column:
    """The tokens of a doc's column."""
    return search_tokens(F.coalesce(F.col(column), F.lit("")))


def dictionary(postings: DataFrame) -> DataFrame:
    """(token, col, df, cf); those of two sets of docs add up.

    Places are counted by doc first, so a token of all docs is dealt by its docs.
    """
    by_doc = postings.groupBy("token", "col", "video_id").agg(F.count("*").alias("tf"))
    return by_doc.groupBy("token", "col").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _totals(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"))


def statistics(index: Index) -> DataFrame:
    """(n_docs, n_tokens) over all docs."""
    return index.totals
