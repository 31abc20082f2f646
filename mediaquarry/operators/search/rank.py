"""BM25 over the phrases of a query, in one pass over the postings that it names.

All phrases become rows (phrase, doc, how often); one aggregate by doc holds
them against the tree of the query and adds up the score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.text import may_fold_to
from ...plans import ranks
from ...sources.tables import Catalog
from .. import browse
from .index import Index, statistics, tokens_of
from .parse import Node, Phrase, parse

# Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Places of a phrase's rarest token that are sent to all tasks, some 30 bytes each.
FEW_PLACES = 1 << 18


def _places(index: Index, phrase: Phrase) -> DataFrame:
    """(video_id, col, pos): where the phrase begins.

    With a dictionary the tokens are joined from the rarest on: where its places
    are few enough to be sent to all tasks, those of the others, however many,
    are read and not shuffled.
    """
    last = len(phrase.tokens) - 1

    def token(i: int, rows: DataFrame) -> DataFrame:
        match = F.col("token").startswith(phrase.tokens[i]) if i == last and phrase.prefix else F.col("token") == phrase.tokens[i]
        return rows.filter(F.col("col").isin(*phrase.columns) & match)

    def places(i: int) -> DataFrame:
        found = token(i, index.postings)
        if i == 0 and phrase.initial:
            found = found.filter("pos = 0")
        return found.select("video_id", "col", (F.col("pos") - i).alias("pos"))

    order, few = list(range(last + 1)), False
    if last and index.terms is not None:
        counts = reduce(DataFrame.union, (token(i, index.terms).agg(F.lit(i).alias("i"), F.coalesce(F.sum("cf"), F.lit(0)).alias("n")) for i in order)).collect()
        order = [r.i for r in sorted(counts, key=lambda r: (r.n, r.i))]
        few = min(r.n for r in counts) <= FEW_PLACES
    rare, *others = (places(i) for i in order)
    return reduce(lambda a, b: b.join(F.broadcast(a) if few else a, ["video_id", "col", "pos"]), others, rare)


def _close(index: Index, phrase: Phrase) -> DataFrame:
    """(video_id, col, pos): places of the phrase in a clump of its NEAR group.

    A clump ends with the begin of its last phrase; every phrase of the group
    begins at or before there, no farther than its own length and the distance.
    Both tests look at the nearest place on one side, in one pass over the
    places of the group in order.
    """
    group, distance = phrase.near
    rows = reduce(DataFrame.union, (_places(index, p).select("video_id", "col", "pos", F.lit(i).alias("member")) for i, p in enumerate(group)))
    order = Window.partitionBy("video_id", "col").orderBy("pos")
    upto, onward = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(0, Window.unboundedFollowing)
    reach = [len(p.tokens) + distance for p in group]
    nearest = [F.max(F.when(F.col("member") == i, F.col("pos"))).over(upto) for i in range(len(group))]
    ends = reduce(lambda a, b: a & b, (F.coalesce(F.col("pos") - n <= r, F.lit(False)) for n, r in zip(nearest, reach, strict=True)))
    rows = rows.withColumn("end", F.when(ends, F.col("pos")))
    mine = group.index(phrase.alone())
    return rows.withColumn("end", F.min("end").over(onward)).filter((F.col("member") == mine) & (F.col("end") - F.col("pos") <= reach[mine])).select("video_id", "col", "pos").distinct()


def _instances(index: Index, phrase: Phrase) -> DataFrame:
    """(video_id, tf): docs that hold the phrase, and how often."""
    return (_close if phrase.near else _places)(index, phrase).groupBy("video_id").agg(F.count("*").alias("tf"))


def plain(phrase: Phrase) -> bool:
    """Whether it is one token or prefix, wherever it stands."""
    return len(phrase.tokens) == 1 and not phrase.initial and phrase.near is None


def in_texts(index: Index, phrases: list[Phrase], given: list[Phrase] | None = None) -> DataFrame:
    """(video_id, length, tf0, tf1...): docs that hold one of the plain ``phrases``, how many tokens they have and how often they hold each of ``given``.

    Reads the texts and no postings; those that hold none of the letters aren't
    parted into tokens, the others once: a filter doesn't pass the generator.
    """
    may = reduce(lambda a, b: a | b, (may_fold_to(F.col(c), p.tokens[0]) for p in phrases for c in p.columns))
    docs = index.docs.filter(may).select("video_id", *(tokens_of(c).alias(f"_{i}") for i, c in enumerate(index.columns)))

    def tf(p: Phrase) -> Column:
        mine = (lambda t: t.startswith(p.tokens[0])) if p.prefix else (lambda t: t == p.tokens[0])
        return reduce(lambda a, b: a + b, (F.size(F.filter(f"_{index.columns.index(c)}", mine)) for c in p.columns))

    length = reduce(lambda a, b: a + b, (F.size(f"_{i}") for i in range(len(index.columns))))
    rows = docs.select("video_id", F.inline(F.array(F.struct(length.alias("length"), *(tf(p).alias(f"tf{i}") for i, p in enumerate(given or phrases))))))
    return rows.filter(reduce(lambda a, b: a | b, (F.col(f"tf{(given or phrases).index(p)}") > 0 for p in phrases)))


def _holds(node: Node, number: dict[Phrase, int]) -> Column:
    if node.phrase is not None:
        return F.col(f"tf{number[node.phrase]}") > 0 if node.phrase.tokens and node.phrase.columns else F.lit(False)
    first, *others = (_holds(p, number) for p in node.parts)
    if node.kind == "NOT":
        return first & ~others[0]
    return reduce((lambda a, b: a & b) if node.kind == "AND" else (lambda a, b: a | b), others, first)


def norm(length: Column) -> Column:
    """What a doc's length adds to the divisor of a term; needs n_docs and n_tokens_all."""
    return K1 * (1 - B + B * length / (F.col("n_tokens_all") / F.col("n_docs")))


def idf(df: Column) -> Column:
    """The weight of a phrase that ``df`` docs hold; needs n_docs."""
    x = F.log((F.col("n_docs") - df + 0.5) / (df + 0.5))
    return F.when(x <= 0, LEAST_IDF).otherwise(x)


def hits(index: Index, query: str) -> DataFrame:
    """(video_id, rank): the docs that answer ``query``; the best have the least rank.

    Raises InvalidSearchQuery for a query that can't be read.
    """
    return hits_of(index, parse(query, index.columns))


def hits_of(index: Index, tree: Node, counts: dict[Phrase, int] | None = None) -> DataFrame:
    """The docs of ``index`` that answer a query that was read; ``counts``: how many docs hold each phrase that is scored, if that is known."""
    scored = tree.phrases()
    # docs that hold a phrase of a NEAR group count wherever it stands
    number = {p: i for i, p in enumerate(dict.fromkeys([*scored, *tree.refused(), *(p.alone() for p in scored)]))}
    usable = [(p, i) for p, i in number.items() if p.tokens and p.columns]
    if not usable:
        return index.lengths.select("video_id", F.lit(0.0).alias("rank")).limit(0)  # nothing to look for
    if counts is not None and index.docs is not None and len(usable) == len(number) and all(plain(p) for p in number):
        rows = in_texts(index, list(counts), list(number)).filter(_holds(tree, number))  # an answer holds a phrase that is scored
    else:
        found = reduce(DataFrame.union, (_instances(index, p).select(F.lit(i).alias("phrase"), "video_id", "tf") for p, i in usable))
        by_doc = found.groupBy("video_id").agg(*(F.coalesce(F.sum(F.when(F.col("phrase") == i, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for _, i in usable))
        rows = by_doc.filter(_holds(tree, number)).join(index.lengths.withColumnRenamed("n_tokens", "length"), "video_id")
    # what the cross joins below add has one row
    rows = rows.crossJoin(statistics(index).select("n_docs", F.col("n_tokens").alias("n_tokens_all")))
    if counts is None:
        rows = rows.crossJoin(by_doc.agg(*(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for _, i in usable)))

    def term(p: Phrase) -> Column:
        df, tf = F.col(f"df{number[p.alone()]}") if counts is None else F.lit(counts[p]), F.col(f"tf{number[p]}")
        return idf(df) * (tf * (K1 + 1)) / (tf + norm(F.col("length")))

    terms = [term(p) for p in scored if p.tokens and p.columns]
    return rows.select("video_id", (-reduce(lambda a, b: a + b, terms)).alias("rank"))


def ranked(catalog: Catalog, index: Index, query: str) -> DataFrame:
    """(video_id, rank): the playable posts that answer ``query``, in no order."""
    playable = catalog.posts.filter(browse.playable())
    return hits(index, query).join(playable.select("video_id"), "video_id", "left_semi")


def explore(catalog: Catalog, index: Index | None, query: str = "", offset: int = 0, size: int = browse.PAGE) -> DataFrame:
    """A page of playable posts: by rank for a query, newest first for a blank one, which needs no index.

    Creator and category of a search come from the index's copy of the doc,
    those of a blank query from the catalog.  Ties go to the smaller id.  The
    page is cut among ids and ranks; only its rows meet posts and docs.  For an
    offset far down see :func:`explore_deep`.
    """
    if not query.strip():
        return browse.browse(catalog, offset, size)
    return _records(catalog, browse.page(ranked(catalog, index, query), page_order(), offset, size))


def explore_deep(catalog: Catalog, found: DataFrame, offset: int, size: int = browse.PAGE, few: int = ranks.FEW) -> DataFrame:
    """The same page as :func:`explore` gives, of hits that :func:`ranked` found and that are stored.

    Histograms of their ranks, then of ids among equal ranks, lead to the page,
    so what comes before it is counted but never sorted.
    """
    return _records(catalog, ranks.page_at(found, [("rank", True), ("video_id", True)], offset, size, few))


def page_order() -> list[Column]:
    return [F.asc("rank"), F.asc("video_id")]


def _records(catalog: Catalog, top: DataFrame) -> DataFrame:
    """A page is sent to all tasks, so that posts and docs are read and not shuffled."""
    posts = catalog.posts.filter(browse.playable()).select("video_id", "likes", "local_video_path")
    rows = catalog.docs.join(F.broadcast(posts.join(F.broadcast(top), "video_id")), "video_id")
    return rows.orderBy(*page_order()).select(*browse.explore_record(), "rank")
