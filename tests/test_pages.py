import random

import pytest
from pyspark.sql import functions as F

from mediaquarry.operators import browse, search
from mediaquarry.plans import queries, ranks
from mediaquarry.sources.tables import CATEGORIES, CREATORS, Catalog

FOLDER = "/root/testdata/sf0.001"


def test_offsets_of_a_tree(spark):
    """Every offset, over dense, sparse and negative ids, in trees of few bits that are made of two parts."""
    rng = random.Random(5)
    ids = sorted({*range(100, 180), *rng.sample(range(-5000, 5000), 60), (1 << 40) + 3, (1 << 40) + 9, 1 << 61, -(1 << 62)}, reverse=True)
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    tree = ranks.count_tree(df.filter("id % 2 = 0"), "id", bits=3).union(ranks.count_tree(df.filter("id % 2 <> 0"), "id", bits=3)).cache()
    # three levels of 3 bits leave many nodes at the top; all are read
    assert ranks.tree_size(tree) == len(ids)
    for offset in [*range(0, len(ids), 13), len(ids) - 1]:
        low, high, skip = ranks.id_page(tree, offset, 7, bits=3)
        between = [i for i in ids if low <= i <= high]
        assert between[skip : skip + 7] == ids[offset : offset + 7] and len(between) <= 7 + 16
    assert ranks.id_page(tree, len(ids), 7, bits=3) is None
    assert ranks.id_page(tree, -4, 7, bits=3)[2] == 0
    assert ranks.id_page(tree.limit(0), 0, 7, bits=3) is None


@pytest.mark.parametrize("few", [1, 10, 10_000])
def test_pages_by_histograms(spark, monkeypatch, few):
    """Every page of values with many ties, large gaps and both directions."""
    monkeypatch.setattr(ranks, "BUCKETS", 8)
    rng = random.Random(6)
    rows = [(rng.choice((-1.5, -1.5, 0.0, 1e-9, 3.25, 1e12, rng.random())), i) for i in range(120)]
    df = spark.createDataFrame(rows, "x double, id long").cache()
    for up, key in ((True, lambda r: (r[0], -r[1])), (False, lambda r: (-r[0], r[1]))):
        want = sorted(rows, key=key)
        order = [("x", up), ("id", not up)]
        for offset in (0, 17, 55, 90, 118, 120, 500):
            got = [tuple(r) for r in ranks.page_at(df, order, offset, 25, few).collect()]
            assert got == want[offset : offset + 25]
    assert ranks.page_at(df.limit(0), [("x", True)], 3, 5, few).count() == 0


def test_deep_pages_add_up(spark):
    catalog = queries._catalog(spark, FOLDER)
    tree = browse.page_tree(catalog.posts).cache()
    every = [r.id for r in browse.playlist(catalog).collect()]
    assert ranks.tree_size(tree) == len(every)
    pages = [r.id for offset in range(0, len(every), 30) for r in browse.browse_deep(catalog, tree, offset).collect()]
    assert pages == every
    assert browse.browse_deep(catalog, tree, len(every)).count() == 0
    index = queries._index(spark, FOLDER, catalog)
    found = search.ranked(catalog, index, "th").cache()
    for offset in (0, 40, 90):
        assert search.explore_deep(catalog, found, offset, few=5).collect() == search.explore(catalog, index, "th", offset).collect()


def test_a_deep_page_reads_a_block(spark, tmp_path, capsys):
    """At 90 % of 300,000 posts the plan takes a block of ids from the scan, and sorts no more than that."""
    rows = spark.range(1, 300_001).select(F.col("id").alias("video_id"), F.lit(1).cast("long").alias("category_id"), F.lit(1).cast("long").alias("creator_id"), F.col("id").alias("likes"),
                                          F.lit("c").alias("caption"), F.concat(F.lit("/v/"), "id").alias("local_video_path"), F.lit("x").alias("status"))
    catalog = Catalog(spark.createDataFrame([(1, "k")], CATEGORIES), spark.createDataFrame([(1, "u")], CREATORS), rows, rows.select("video_id", "caption"))
    catalog.write(str(tmp_path / "c"))
    stored = Catalog.read(spark, str(tmp_path / "c"))
    tree = browse.page_tree(stored.posts).cache()
    page = browse.browse_deep(stored, tree, 270_000)
    assert [r.id for r in page.collect()] == list(range(30_000, 29_970, -1))
    page.explain()
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(video_id,0), LessThanOrEqual(video_id,65535)" in plan
    limits = [int(x.split(",")[0].rstrip(")")) for x in plan.split("TakeOrderedAndProject(limit=")[1:]]
    assert limits and max(limits) <= 2 * (1 << ranks.BITS) + 30


def test_a_blank_query_needs_no_index(spark, capsys):
    queries.search_blank(spark, FOLDER).explain()
    assert "postings" not in capsys.readouterr().out


def test_a_token_of_all_docs_is_many_files(spark, tmp_path):
    docs = spark.range(20_000).select(F.col("id").alias("video_id"), F.lit("the same words").alias("caption"), F.lit("u").alias("creator"), F.lit("k").alias("category"))
    search.build(docs).write(str(tmp_path / "index"), rows=4_000)
    files = spark.read.parquet(str(tmp_path / "index/postings")).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.countDistinct("token").alias("tokens")).collect()
    assert sum(r.n for r in files) == 100_000 and max(r.n for r in files) < 8_000 and len(files) >= 20
    assert search.hits(search.Index.read(spark, str(tmp_path / "index")), '"the same" wor').count() == 20_000
