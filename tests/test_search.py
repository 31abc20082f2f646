import sqlite3

import pytest

from mediaquarry.operators import search
from mediaquarry.sources.tables import CATEGORIES, CREATORS, Catalog

DOCS = [
    (1, "hello world dance", "foo_bar", "Dance"), (2, "dancing in the rain", "alice", "Music"), (3, "Élan vital", "bob", "Dance"), (4, "nothing here", "dancer", "Art"),
    (5, "rain rain dance dance", "zed", "Art"), *[(i, f"filler text number {i}", "ui", "Misc") for i in range(6, 20)],
]
COLUMNS = ("a", "b", "k")


@pytest.fixture(scope="module")
def index(spark):
    return search.build(spark.createDataFrame(DOCS, "video_id long, a string, b string, k string"), COLUMNS)


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE s USING fts5(video_id UNINDEXED, a, b, k)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?, ?)", DOCS)
    return con


QUERIES = [
    "danc", "rain danc", "elan", "foo_bar", "k:dance", "dance OR music", "dance NOT rain", "world hello", '"rain rain" dance', "a:rain danc", "filler", "5", "\U0001f600", "danc ",
    "a + b", "rain + rain", "^rain danc", "{a k}:danc", "-a:danc", "(rain OR hello) AND danc", "dance AND rain NOT music", "hello AND dance OR alice", "a:(rain OR hello) OR zed", "and", "dance and", '"in the" ra', 'the "rain', "hello \U0001f600 dan",
    "dance dance", "k:(dance) OR k:art",
    "NEAR(rain dance) da", "NEAR(dance rain, 0) d", "NEAR(rain dance, 1) AND dance", 'NEAR("rain rain" danc*, 3) OR world', "k:NEAR(dance art) d", "NEAR(hello world dance, 0) da", "NEAR(hello dance, 0) OR hel",
    "dance NOT NEAR(rain dance, 1) d", "NEAR(rain) dance", "NEAR(rain rain) dance", "NEAR(\U0001f600 rain) dan", "NEAR(dance in, 2) OR NEAR(filler number, 1) OR fi", "(NEAR(in rain, 1) OR hello) AND d", "NEAR() a", "NEAR(a b, x) c", "NEAR(^a b) c", "NEAR(a b c", "near(a b) c",
    'NEAR("text number" filler, 5) fil',
]


@pytest.mark.parametrize("query", QUERIES)
def test_ranks_as_the_full_text_engine_does(index, fts, query):
    try:
        want = {i: r for i, r in fts.execute("SELECT video_id, rank FROM s WHERE s MATCH ?", (query + "*",))}
    except sqlite3.OperationalError:
        with pytest.raises(search.InvalidSearchQuery):
            search.hits(index, query)
        return
    got = {r.video_id: r["rank"] for r in search.hits(index, query).collect()}
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("query", ["foo-bar", "@bob", "it's", "c++", "a.b", "AND", "dance AND", "NOT rain", "x,y", "(dance)", "zz:dance", "dance OR", "(a OR b) c", "*", "NEAR(a b)", "FAR(a b) c"])
def test_unreadable_queries_raise(index, query):
    with pytest.raises(search.InvalidSearchQuery):
        search.hits(index, query)


def test_only_playable_posts_are_found_but_all_docs_count(spark):
    docs = spark.createDataFrame([(1, "red cat", "u", "k"), (2, "red dog", "u", "k"), (3, "blue dog", "v", "k")], "video_id long, caption string, creator string, category string")
    posts = spark.createDataFrame([(1, 1, 1, 1000, "x", "/p/video_1.mp4", "Error"), (2, 1, 1, 5, "y", None, "Harvested")], "video_id long, category_id long, creator_id long, likes long, caption string, local_video_path string, status string")
    catalog = Catalog(spark.createDataFrame([(1, "now")], CATEGORIES), spark.createDataFrame([(1, "me")], CREATORS), posts, docs)
    found = search.explore(catalog, search.build(docs), "red", -5).collect()
    assert [(r.id, r.creator, r.likes, r.caption, r.filename) for r in found] == [(1, "u", "1,000", "red cat", "video_1.mp4")]
    blank = search.explore(catalog, search.build(docs), "  ").collect()
    assert [(r.id, r.creator, r.category, r.caption) for r in blank] == [(1, "me", "now", "x")]


def test_a_stored_index_gives_the_same(spark, index, tmp_path):
    index.write(str(tmp_path / "index"))
    again = search.Index.read(spark, str(tmp_path / "index"), COLUMNS)
    assert sorted(search.hits(again, "rain danc").collect()) == sorted(search.hits(index, "rain danc").collect())


def test_phrases_begin_with_their_rarest_token(spark, tmp_path, capsys, monkeypatch):
    """A word of all docs is read and joined where it is; the same docs are found when nothing is broadcast."""
    from mediaquarry.operators.search import rank

    docs = spark.range(3000).selectExpr("id AS video_id", "concat('the ', if(id % 500 = 7, 'rare', 'usual'), ' thing of the many things') AS a", "'x' AS b", "'k' AS k")
    plain = search.build(docs, COLUMNS)
    plain.write(str(tmp_path / "index"))
    stored = search.Index.read(spark, str(tmp_path / "index"), COLUMNS)
    assert {(r.token, r.col): (r.df, r.cf) for r in stored.terms.collect()}["the", "a"] == (3000, 6000)
    for query in ('"the rare thing" th', '"of the" man', '"the rare"'):
        want = sorted(map(tuple, search.hits(plain, query).collect()))
        assert sorted(map(tuple, search.hits(stored, query).collect())) == want and len(want) in (6, 3000)
    rank._places(stored, rank.parse('"the rare" + th', COLUMNS).phrases()[0]).explain()
    plan = capsys.readouterr().out
    assert plan.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in plan
    monkeypatch.setattr(rank, "FEW_PLACES", 0)
    assert search.hits(stored, '"the rare thing" th').count() == 6


def test_prefix_reaches_the_scan(spark, index, tmp_path, capsys):
    index.write(str(tmp_path / "index"))
    search.hits(search.Index.read(spark, str(tmp_path / "index"), COLUMNS), "danc").explain()
    assert "StringStartsWith(token,danc)" in capsys.readouterr().out


def test_the_page_is_cut_before_it_meets_the_docs(spark, capsys):
    from mediaquarry.plans import queries

    search.explore(catalog := queries._catalog(spark, "/root/testdata/sf0.001"), queries._index(spark, "/root/testdata/sf0.001", catalog), "th").explain()
    plan = capsys.readouterr().out
    lines = plan.split("\n")
    begins = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    (cut,) = (i for i, x in enumerate(lines) if "TakeOrderedAndProject(limit=30" in x)
    end = next((i for i in range(cut + 1, len(lines)) if begins[i] <= begins[cut]), len(lines))
    scans = [(cut < i < end, x.split("Batched")[0]) for i, x in enumerate(lines) if "FileScan" in x]
    assert sum(inside for inside, _ in scans) >= 4 and not any(inside and ("caption#" in x or "likes#" in x) for inside, x in scans)
    assert any("caption#" in x for _, x in scans)


def test_near_groups_of_random_texts(spark):
    """Clumps, their ranks and counts as the full-text engine has them.

    Under OR that engine also counts places of a group that has no clump in the
    doc; here the docs and, where groups alone decide, the ranks are compared.
    """
    import random

    rng = random.Random(12)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 40))), " ".join(rng.choice("abc") for _ in range(4)), "k") for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE s USING fts5(video_id UNINDEXED, a, b, k)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?, ?)", docs)
    index = search.build(spark.createDataFrame(docs, "video_id long, a string, b string, k string"), COLUMNS)
    for query in ("NEAR(a b) a", "NEAR(a b c, 2) b", "NEAR(a a, 1) c", 'NEAR("a b" c "d e", 4) AND h', 'h NOT NEAR("a b" c, 2) g', "a:NEAR(a b, 1) AND b:NEAR(c a, 0) AND a", "b NOT NEAR(a h, 3) b", "NEAR(a b c d, 3) OR xx"):
        want = {i: r for i, r in con.execute("SELECT video_id, rank FROM s WHERE s MATCH ?", (query + "*",))}
        got = {r.video_id: r["rank"] for r in search.hits(index, query).collect()}
        assert got == pytest.approx(want, abs=1e-9), query
    for query in ("a:NEAR(a b, 1) OR b:NEAR(c a, 0) OR zz", "NEAR(g h, 0) OR NEAR(c d, 0) OR gg", 'NEAR("a b" c "d e", 4) OR h'):
        want = {i for (i,) in con.execute("SELECT video_id FROM s WHERE s MATCH ?", (query + "*",))}
        assert {r.video_id for r in search.hits(index, query).collect()} == want, query


def test_pages_from_bounds_of_blocks(spark, tmp_path):
    """The page of all hits from few blocks, for every shape of query, with ties, posts that don't play and pages beyond the first."""
    import random

    from mediaquarry.operators.search import bounds

    rng = random.Random(5)
    words = ["the", "then", "theory", "themes", "theme", "cat", "dog", "rain", "sun", "of"]
    docs = [(i, " ".join(rng.choices(words, [9, 4, 2, 1, 1, 5, 3, 2, 1, 8], k=rng.randint(1, 40))), rng.choice(["ann", "bob", "the"]), rng.choice(["art", "music"])) for i in range(1, 2001)]
    # a few blocks have the docs in which a frequent token is most frequent
    docs += [(i, "the the the sun" if i % 2 else "rain the the", "ann", "art") for i in range(4001, 4060)]
    posts = [(i, 1, 1, 5, "y", f"/p/video_{i}.mp4" if i % 7 else None, "Harvested") for i, *_ in docs]
    frame = spark.createDataFrame(docs, "video_id long, caption string, creator string, category string")
    catalog = Catalog(spark.createDataFrame([(1, "now")], CATEGORIES), spark.createDataFrame([(1, "me")], CREATORS), spark.createDataFrame(posts, "video_id long, category_id long, creator_id long, likes long, caption string, local_video_path string, status string"), frame)
    search.build(frame).write(str(tmp_path / "index"))
    index = search.Index.read(spark, str(tmp_path / "index"))
    search.write_bounds(index, str(tmp_path / "bounds"), 4)
    stored = spark.read.parquet(str(tmp_path / "bounds")).cache()
    for query, offset in [("the", 0), ("the", 30), ("them", 0), ("sun AND the", 0), ("the OR ra", 10), ("of NOT cat NOT the", 0), ("creator:the OR caption:su", 0), ("cat zzz", 0), ('"the cat" do', 0), ("^the", 0), ("the", 5000), ("{caption creator}:the", 0), ("\U0001f600", 0), ("the OR the", 0)]:
        want = search.explore(catalog, index, query, offset).collect()
        got = search.explore_top(catalog, index, stored, query, offset, bits=4).collect()
        assert [r.id for r in got] == [r.id for r in want] and [r["rank"] for r in got] == pytest.approx([r["rank"] for r in want]), query
    every = frame.selectExpr("video_id >> 4 AS block").distinct().count()
    found, blocks = bounds.candidates(catalog, index, stored, "the", 10, 4, first=8)
    assert blocks.count() < every / 4 and found.count() < search.hits(index, "the").count() / 4
    # blocks that are too many to be named are joined
    some = spark.range(0, 100).selectExpr("id AS block")
    for named in (10, 1000):
        assert bounds.within(index, some, 4, named).lengths.count() == sum(i < 1600 for i, *_ in docs)


def test_bounds_of_no_docs(spark):
    empty = search.build(spark.createDataFrame([], "video_id long, caption string, creator string, category string"))
    assert search.block_bounds(empty).count() == 0


MARKED = ["the", "th\u00e9", "e\u0301t", "the\u0301me", "\u00c9t\u00c9", "a1", "\U0001f600", "x", "thence", "-", "th-e", "\u4e2d\u6587", "them"]


def test_bounds_and_pages_from_texts(spark, tmp_path):
    """Bounds from texts and from stored postings are what each doc gives, and pages from texts are those of the stored index."""
    import random

    from mediaquarry.functions.text import fold_text
    from mediaquarry.operators.search import bounds

    rng = random.Random(3)
    docs = [(i, None if i % 50 == 3 else " ".join(rng.choices(MARKED, k=rng.randint(0, 12))), rng.choice(["ann", "the", ""]), "art") for i in rng.sample(range(1, 400), 300)]
    frame = spark.createDataFrame(docs, "video_id long, caption string, creator string, category string")
    built = search.build(frame)
    built.write(str(tmp_path / "index"))
    stored = search.Index.read(spark, str(tmp_path / "index"))
    want = {}
    for i, *texts in docs:
        found = [(col, t) for col, text in zip(search.parse("a").phrases()[0].columns, texts, strict=True) for t in fold_text(text or "")]
        tf = {}
        for col, t in found:
            for key in (t, *(t[:n] + "*" for n in range(4) if len(t) >= n)):
                for c in (col, "*"):
                    tf[key, c] = tf.get((key, c), 0) + 1
        for (key, c), n in tf.items():
            want.setdefault((key, c, i >> 4), []).append((n, len(found)))
    want = {k: (len(x), sum(n for n, _ in x), sorted({p for p in x if not any(q != p and q[0] >= p[0] and q[1] <= p[1] for q in x)})) for k, x in want.items()}
    for index in (built, stored):
        rows = search.block_bounds(index, 4).collect()
        assert {(r.key, r["col"], r.block): (r.df, r.cf, [tuple(p) for p in r.pairs]) for r in rows} == want and len(rows) == len(want)
    search.write_bounds(built, str(tmp_path / "bounds"), 4)
    blocks = spark.read.parquet(str(tmp_path / "bounds")).cache()
    counted = search.counted(built, blocks)
    assert counted.totals.collect() == stored.totals.collect()
    posts = spark.createDataFrame([(i, 1, 1, 5, "y", f"/p/{i}" if i % 7 else None, "Harvested") for i, *_ in docs], "video_id long, category_id long, creator_id long, likes long, caption string, local_video_path string, status string")
    catalog = Catalog(spark.createDataFrame([(1, "now")], CATEGORIES), spark.createDataFrame([(1, "me")], CREATORS), posts, frame)
    for query in ("th", "theme OR a1 AND them", "et the NOT creator:ann", '"a1 the" OR the', 'et NOT "x the" the', "{caption creator}:the"):
        found, _ = bounds.candidates(catalog, counted, blocks, query, 10, 4, first=2)
        got, best = ([(r.video_id, round(r["rank"], 12)) for r in rows.orderBy("rank", "video_id").limit(10).collect()] for rows in (found, search.ranked(catalog, stored, query)))
        assert got == best, query


def test_blocks_are_counted_whole():
    """However the batches are cut, each block is in one part."""
    import pyarrow as pa

    from mediaquarry.operators.search import bounds

    block, tokens = [1, 1, 1, 2, 5, 5, 6, 6, 6], [["a", "b"], [], ["c"], ["a"] * 5, ["d"], ["d"], ["e"], [], ["f"]]
    for cuts in ([0, 9], [0, 2, 9], [0, 3, 4, 9], [0, 0, 1, 5, 7, 9], list(range(10))):
        for most in (1, 3, 4, 100):
            batches = [pa.RecordBatch.from_arrays([pa.array(block[a:b], pa.int64()), pa.array(tokens[a:b], pa.list_(pa.string()))], ["block", "_0"]) for a, b in zip(cuts, cuts[1:], strict=False)]
            parts = [p.block.tolist() for p in bounds._whole_blocks(iter(batches), most)]
            assert sum(parts, []) == block and all(a[-1] != b[0] for a, b in zip(parts, parts[1:], strict=False))
            assert len(parts) == {1: 4, 3: 3, 4: 2, 100: 1}[most]


def test_letters_are_found_through_marks(spark):
    from pyspark.sql import functions as F

    from mediaquarry.functions import text as X

    words = spark.createDataFrame([(w,) for w in [*MARKED, "I\u0307x", "e\u0300\u0301t", "\u00d6l", "ol", "t h e", "", "TH\u00c9ME"]], "w string")
    for token in ("the", "et", "ol", "ix", "\u4e2d", "a1"):
        assert words.filter(X.may_fold_to(F.col("w"), token) != X.folded(F.col("w")).contains(token)).collect() == []


def test_texts_are_parted_once(spark, capsys):
    from mediaquarry.operators.search import rank

    built = search.build(spark.createDataFrame([(1, "x")], "video_id long, caption string").selectExpr("video_id", "caption", "caption AS creator", "caption AS category"))
    rank.in_texts(built, search.parse("worthless OR mente").phrases()).explain()
    plan = capsys.readouterr().out
    assert "rlike" in plan.lower() and plan.count("regexp_extract_all(") == 3  # once for each column


@pytest.mark.parametrize("name", ["search_top", "term_blocks", "search_top_or", "search_top_multi"])
def test_a_query_by_blocks_stores_bounds_and_no_texts(spark, tmp_path, name):
    import shutil

    from mediaquarry.plans import queries

    for table in ("documents", "labels"):
        shutil.copy(f"/root/testdata/sf0.001/{table}.parquet", tmp_path)
    assert queries.QUERIES[name](spark, str(tmp_path)).limit(1).collect()
    assert {kind for _, d, kind in queries._STORED if d == str(tmp_path)} <= {"bounds", "posts"}
