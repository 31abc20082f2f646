"""Queues, gates and log filters as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import joblog
from ..operators.increments import CatalogStore
from ..operators.sync import synced
from ..sources.tables import Catalog


def job_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Jobs pushed as JSON lines into files of a folder."""
    lines = spark.readStream.text(path)
    return lines.select(F.from_json("value", schema).alias("job")).select("job.*")


def gated(jobs: DataFrame, key: str) -> DataFrame:
    """The first job of each key for ever: state grows with the number of keys, as the set does."""
    return jobs.dropDuplicates([key])


def dispatched(jobs: DataFrame) -> DataFrame:
    """Jobs that have a loader; delivery is at least once, where a destructive pop would lose work."""
    return joblog.dispatched(jobs)


def shown_lines(lines: DataFrame, prefix: str, is_engine: bool) -> DataFrame:
    """Log lines as shown."""
    keep, text = joblog.shown(F.col("line"), F.lit(prefix), F.lit(is_engine))
    return lines.filter(keep).select(text.alias("line"))


def push(jobs: DataFrame, path: str, checkpoint: str, names: list[str]) -> StreamingQuery:
    """Append jobs to a queue folder as JSON lines, until no input is left."""
    rows = jobs.select(F.to_json(F.struct(*names)).alias("value"))
    return rows.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_stream(messages: DataFrame, load: Callable[[], Catalog], store: Callable[[Catalog, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Bring a catalog up to date with each micro-batch of messages.

    ``load`` reads the catalog as it is, ``store`` writes the new one whole and
    the rows held back.  ``store`` gets the batch's number and has to leave a
    batch alone that it has stored before.
    """

    def batch(rows: DataFrame, number: int) -> None:
        catalog, held = synced(load(), rows)
        store(catalog, held, number)

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_increments(messages: DataFrame, store: CatalogStore, checkpoint: str) -> StreamingQuery:
    """Add each micro-batch of messages to a stored catalog as a segment, and merge segments when they become many.

    A micro-batch that comes again after a failure changes nothing, and a batch
    writes no more than it adds, but for merges.
    """

    def batch(rows: DataFrame, number: int) -> None:
        store.sync(number, rows)
        store.merge()

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
