"""Connected components by alternating stars, with the edges kept in shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import result, write_table


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: link a node's neighbours (the larger, or the smaller and itself) to its smallest."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.join(least, "a")
    if larger:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); root is the smallest node of its component.

    Each round is a large-star and a small-star step.  Nothing but a row count
    and a checksum reaches the driver.  Where no round changes the edges, they
    are stars about the roots.
    """
    edges = write_table(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not state.n or state == before:
            break
        before = state
        edges = result(lambda edges=edges: _stars(write_table(_stars(edges, True), "large"), False), "small")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root), a table, after further links (a, b), a table, between its nodes.

    Only components that a link joins are worked on: links are moved to their
    roots first.
    """
    if links.isEmpty():
        return roots
    ends = [roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_")) for end in ("a", "b")]
    moved = links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
    found = connected_components(moved).select(F.col("node").alias("root"), F.col("root").alias("new"))
    return write_table(roots.join(found, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "merged")
