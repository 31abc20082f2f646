"""Numbers and running totals over a whole table, without one task that sorts it.

Rows are cut in blocks of an integer column, blocks in groups of blocks; the
totals of what comes before give each its start.  However sparse the integers
are, a task has at most ``2**BITS`` rows of a block or ``2**UPPER`` blocks of a
group, and no plan depends on how many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A block takes 2**BITS integers, a group of blocks 2**UPPER blocks.
BITS, UPPER = 16, 24


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out &= left[c].eqNullSafe(right[f"{c}_"])
    return out


def _joined(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Each row of ``left`` with the one of ``right`` that has the same ``names``, nulls included."""
    right = right.withColumnsRenamed({c: f"{c}_" for c in names})
    return left.join(right, _same(left, right, names)).drop(*(f"{c}_" for c in names))


def numbered(df: DataFrame, by: list[str], order: str, descending: bool, name: str, bits: int = BITS, upper: int = UPPER) -> DataFrame:
    """``df`` with a number from 1 in the order of ``order`` (distinct integers within ``by``)."""
    way = F.desc if descending else F.asc
    keys = [f"_by{i}" for i in range(len(by))]
    blocked = df.withColumns({k: F.col(c) for k, c in zip(keys, by, strict=True)} | {"_block": F.shiftright(F.col(order).cast("long"), bits)})
    blocks = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_n")).withColumn("_group", F.shiftright("_block", upper))
    groups = blocks.groupBy(*keys, "_group").agg(F.sum("_n").alias("_all"))
    groups = groups.withColumn("_first", F.sum("_all").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(way("_group"))) - F.col("_all")).drop("_all")
    blocks = blocks.withColumn("_start", F.sum("_n").over(Window.partitionBy(*keys, "_group").orderBy(way("_block"))) - F.col("_n")).drop("_n")
    starts = _joined(blocks, groups, [*keys, "_group"]).select(*keys, "_block", (F.col("_first") + F.col("_start")).alias("_start"))
    local = blocked.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(way(order))))
    return _joined(local, starts, [*keys, "_block"]).withColumn(name, F.col("_start") + F.col("_local")).select(*df.columns, name)


def _totals(rows: DataFrame, part: list[str], order: str, step: str, low: str, count: str) -> DataFrame:
    """``rows`` with sums of ``step`` and ``count`` before each row, and the least that the running sum had before it.

    ``low`` is the least running sum within a row, from its own start.
    """
    before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_b", F.coalesce(F.sum(step).over(before), F.lit(0).cast("long"))).withColumn("_c", F.coalesce(F.sum(count).over(before), F.lit(0).cast("long")))
    return rows.withColumn("_l", F.min(F.col("_b") + F.col(low)).over(before))


def running(df: DataFrame, by: str, order: str, step: str, bits: int = BITS, upper: int = UPPER) -> DataFrame:
    """``df`` with total, the running sum of ``step`` in the order of ``order``, and of the rows before: number, how many, and earlier, the least total.

    ``by`` holds no nulls and ``order`` distinct integers within it; earlier is
    null in a first row.
    """
    blocked = df.withColumns({"_block": F.shiftright(F.col(order).cast("long"), bits), "_low": F.col(step).cast("long"), "_count": F.lit(1).cast("long"), "_step": F.col(step).cast("long")})
    local = _totals(blocked, [by, "_block"], order, "_step", "_low", "_count")
    least = F.min(F.col("_b") + F.col("_low")).alias("_low")
    blocks = local.groupBy(by, "_block").agg(least, F.sum("_count").alias("_count"), F.sum("_step").alias("_step")).withColumn("_group", F.shiftright("_block", upper))
    blocks = _totals(blocks, [by, "_group"], "_block", "_step", "_low", "_count")
    groups = blocks.groupBy(by, "_group").agg(least, F.sum("_count").alias("_count"), F.sum("_step").alias("_step"))
    groups = _totals(groups, [by], "_group", "_step", "_low", "_count").select(by, "_group", F.col("_b").alias("_gb"), F.col("_c").alias("_gc"), F.col("_l").alias("_gl"))
    starts = blocks.join(groups, [by, "_group"]).select(
        by, "_block", (F.col("_gb") + F.col("_b")).alias("_sb"), (F.col("_gc") + F.col("_c")).alias("_sc"), F.least("_gl", F.col("_gb") + F.col("_l")).alias("_sl")
    )
    total = F.col("_sb") + F.col("_b") + F.col("_step")
    rows = local.join(starts, [by, "_block"])
    return rows.select(*df.columns, total.alias("total"), (F.col("_sc") + F.col("_c")).alias("number"), F.least("_sl", F.col("_sb") + F.col("_l")).alias("earlier"))


def preceding(df: DataFrame, order: str, name: str, bits: int = BITS, upper: int = UPPER) -> DataFrame:
    """``df`` with the next smaller value of ``order`` (distinct integers), null for the least."""
    value = F.col(order).cast("long")
    blocked = df.withColumn("_block", F.shiftright(value, bits))
    blocks = blocked.groupBy("_block").agg(F.max(value).alias("_most")).withColumn("_group", F.shiftright("_block", upper))
    groups = blocks.groupBy("_group").agg(F.max("_most").alias("_most"))
    groups = groups.select("_group", F.lag("_most").over(Window.orderBy("_group")).alias("_far"))  # a row for each 2**(bits + upper) integers
    blocks = blocks.withColumn("_near", F.lag("_most").over(Window.partitionBy("_group").orderBy("_block")))
    starts = blocks.join(groups, "_group").select("_block", F.coalesce("_near", "_far").alias("_before"))
    local = blocked.withColumn("_local", F.lag(value).over(Window.partitionBy("_block").orderBy(order)))
    return local.join(starts, "_block").select(*df.columns, F.coalesce("_local", "_before").alias(name))
