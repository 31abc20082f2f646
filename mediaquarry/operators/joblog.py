"""Replay and audit of queues from a log of commands (seq, op, key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import running

PUSH, POP, ADD = "RPUSH", "LPOP", "SADD"
# The models that have a loader, and the order in which they are queued.
MODELS = ("yolo", "whisper", "dinov2", "siglip", "clip", "raft", "easyocr")
VISION_JOB = "msg_id BIGINT, path STRING"
MODEL_JOB = "model_name STRING"


def _replayed(log: DataFrame) -> DataFrame:
    """Pushes and pops with depth, the queue length after each, pushed, how many pushes there were up to it, and vain, whether a pop found nothing.

    Steps add up to S; pops in vain are as many as the least S fell below 0,
    and a pop is one where S falls below 0 and all that it was before.
    """
    step = F.when(F.col("op") == PUSH, 1).otherwise(-1)
    rows = running(log.filter(F.col("op").isin(PUSH, POP)).select("seq", "key", "op", "value", step.alias("step")), "key", "seq", "step")
    floor = F.least(F.lit(0).cast("long"), F.col("earlier"))
    depth = F.col("total") - F.least(floor, F.col("total"))
    pushed = ((F.col("number") + 1 + F.col("total")) / 2).cast("long")
    return rows.select("seq", "key", "op", "value", depth.alias("depth"), pushed.alias("pushed"), (F.col("total") < floor).alias("vain"))


def depths(log: DataFrame) -> DataFrame:
    """(seq, key, op, depth): queue length after each push or pop; a pop of an empty queue changes nothing."""
    return _replayed(log).select("seq", "key", "op", "depth")


def final_depths(log: DataFrame) -> DataFrame:
    """(key, pushed, popped, depth) of each queue."""
    last = depths(log).groupBy("key").agg(F.count(F.when(F.col("op") == PUSH, 1)).alias("pushed"), F.max(F.struct("seq", "depth")).alias("last"))
    return last.select("key", "pushed", (F.col("pushed") - F.col("last.depth")).alias("popped"), F.col("last.depth").alias("depth"))


def matched(log: DataFrame) -> DataFrame:
    """(key, n, pushed_at, popped_at, value): each push with the pop that took it, null if none did."""
    rows = _replayed(log)
    pushes = rows.filter(F.col("op") == PUSH).select("key", F.col("pushed").alias("n"), F.col("seq").alias("pushed_at"), "value")
    pops = rows.filter((F.col("op") == POP) & ~F.col("vain")).select("key", (F.col("pushed") - F.col("depth")).alias("n"), F.col("seq").alias("popped_at"))
    return pushes.join(pops, ["key", "n"], "left").select("key", "n", "pushed_at", "popped_at", "value")


def members(log: DataFrame) -> DataFrame:
    """(key, value): the final contents of sets."""
    return log.filter(F.col("op") == ADD).select("key", "value").distinct()


def ungated(pushes: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """Pushes whose ``key`` was never added to the set that should gate them."""
    return pushes.join(added.select(key).distinct(), key, "left_anti")


def gate(jobs: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first job of each key: what a push gated by a set lets through."""
    names = jobs.columns
    first = jobs.groupBy(key).agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"v_{c}") for c in names if c != key])).alias("first"))
    return first.select(*[F.col(c) if c == key else F.col(f"first.v_{c}").alias(c) for c in names])


def decoded(log: DataFrame, schema: str) -> DataFrame:
    """Payloads as columns beside key and seq; what isn't JSON gives nulls."""
    return log.filter(F.col("op") == PUSH).select("seq", "key", F.from_json("value", schema).alias("job")).select("seq", "key", "job.*")


def encoded(jobs: DataFrame, names: list[str]) -> Column:
    return F.to_json(F.struct(*names))


def dispatched(jobs: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """Jobs for which a loader exists, with the line that reports them; others are passed over."""
    return jobs.filter(F.col("model_name").isin(*models)).withColumn("report", F.concat(F.upper("model_name"), F.lit(" loaded")))


def shown(line: Column, prefix: Column, is_engine: Column) -> tuple[Column, Column]:
    """Whether a log line is shown, and how; progress lines of the engine are left out."""
    noise = is_engine & (F.contains(line, F.lit("Loading weights:")) | F.contains(line, F.lit("%|")))
    return ~noise, F.concat(prefix, F.lit(" "), line)
