import pytest
from pyspark.sql import functions as F

from mediaquarry.operators import browse, search, sync
from mediaquarry.operators.increments import CatalogStore
from mediaquarry.plans import ranks
from mediaquarry.sources import storage
from mediaquarry.sources.tables import CATEGORIES, CREATORS, POSTS, Catalog, caption_of, message_files
from mediaquarry.streaming import jobs

DOCS = "video_id long, caption string, creator string, category string"


def messages(spark, ids, body="text"):
    rows = spark.createDataFrame([(i, f"k{i % 3}", f"u{i % 7}", i, f"{body} number {i} of many") for i in ids], "id long, category string, creator string, likes long, body string")
    return rows.select("id", F.lit(False).alias("empty"), F.lit(True).alias("has_video"), F.lit(None).cast("string").alias("mime"), caption_of(*map(F.col, ("category", "creator", "likes", "body"))).alias("caption"))


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    return CatalogStore(spark, tmp_path.as_uri(), fan=3)


def test_batches_give_what_whole_rewrites_give(spark, store):
    """Posts, names, docs and search results equal those of a catalog that is made anew each time, whatever is merged."""
    whole = Catalog(spark.createDataFrame([], CATEGORIES), spark.createDataFrame([], CREATORS), spark.createDataFrame([], POSTS), spark.createDataFrame([], DOCS))
    assert store.catalog().posts.count() == 0 and store.merge() == 0
    for number, ids in enumerate(([5, 9, 2], [], [9, 11, 3, 1])):
        batch = messages(spark, ids, f"batch{number}")
        assert store.sync(number, batch)
        assert not store.sync(number, messages(spark, [77]))
        whole, _ = sync.synced(whole, batch)
        # cut what the whole catalog is made of
        whole = Catalog(*(spark.createDataFrame(df.collect(), df.schema) for df in (whole.categories, whole.creators, whole.posts, whole.docs)))
        if number == 2:
            store.merge()
        mine = store.catalog()
        for name in ("categories", "creators", "posts", "docs"):
            assert rows_of(getattr(mine, name).select(*getattr(whole, name).columns)) == rows_of(getattr(whole, name))
    for query in ("numb", "batch0 OR batch2", '"number 9" of'):
        got, want = (rows_of(search.hits(i, query)) for i in (store.index(), search.build(whole.docs)))
        assert [r[0] for r in got] == [r[0] for r in want] and [r[1] for r in got] == pytest.approx([r[1] for r in want])
    assert store.manifest()["batches"] == {"messages": 2}


def test_outcomes_and_deep_pages(spark, store):
    store.sync(0, messages(spark, range(1, 101)))
    outcome = lambda rows: spark.createDataFrame(rows, "video_id long, seq long, ok boolean, path string")
    assert store.record(0, outcome([(i, 1, True, f"/p/{i}") for i in range(1, 81)] + [(900, 1, True, "/p/900")]))
    assert store.record(1, outcome([(7, 2, False, None), (90, 2, True, "/p/90"), (8, 3, True, "/q/8")]))
    assert not store.record(1, outcome([(95, 2, True, "/p/95")]))
    store.sync(1, messages(spark, [900]))
    catalog, tree = store.catalog(), store.pages()
    posts = {r.video_id: (r.status, r.local_video_path) for r in catalog.posts.collect()}
    assert posts[7] == ("Error", "/p/7") and posts[8] == ("Harvested", "/q/8") and posts[95] == ("Metadata_Only", None) == posts[900]
    assert ranks.tree_size(tree) == 81
    assert [r.id for offset in (0, 30, 60) for r in browse.browse_deep(catalog, tree, offset).collect()] == [r.id for r in browse.playlist(catalog).collect()]


def test_a_small_batch_writes_little(spark, store):
    store.sync(0, messages(spark, range(1, 20_001), " ".join(f"w{i}" for i in range(30))))
    before = storage.folder_bytes(spark, store.path)
    store.sync(1, messages(spark, range(20_001, 20_201), " ".join(f"w{i}" for i in range(30))))
    added = storage.folder_bytes(spark, store.path) - before
    assert 0 < added < 0.05 * before
    store.sync(1, messages(spark, range(30_000, 30_010)))
    assert storage.folder_bytes(spark, store.path) == before + added and store.catalog().posts.count() == 20_200


def test_merges_keep_few_segments_and_what_readers_hold(spark, store):
    for number in range(5):
        store.sync(number, messages(spark, range(10 * number + 1, 10 * number + 9)))
        held = store.catalog().posts
        n = store.merge()
        assert n <= 4 and held.count() == 8 * (number + 1) == store.catalog().posts.count()
    assert len([n for n in storage.listed(spark, store.path) if n.startswith("segment")]) <= n + 3


def test_what_a_failed_batch_left_counts_for_nothing(spark, store):
    store.sync(0, messages(spark, [1, 2]))
    with pytest.raises(ZeroDivisionError):
        store.append("messages", 1, lambda segment: (store._synced(segment, messages(spark, [3])), 1 / 0)[0])
    assert store.catalog().posts.count() == 2
    assert store.sync(1, messages(spark, [3])) and store.catalog().posts.count() == 3
    with pytest.raises(FileExistsError):
        storage.publish_text(spark, f"{store.path}/manifests/{store.manifest()['version']:012d}.json", "{}")


def test_a_stream_of_batches(spark, store, tmp_path):
    folder = tmp_path / "in"
    messages(spark, range(1, 9)).coalesce(1).write.json(str(folder))
    for ids in (range(5, 12), range(11, 14)):
        jobs.sync_increments(message_files(spark, str(folder), True, 1), store, str(tmp_path / "check")).awaitTermination()
        messages(spark, ids).coalesce(1).write.mode("append").json(str(folder))
    jobs.sync_increments(message_files(spark, str(folder), True, 1), store, str(tmp_path / "check")).awaitTermination()
    assert sorted(r.video_id for r in store.catalog().posts.collect()) == list(range(1, 14))
    assert {r.id for r in search.explore(store.catalog(), store.index(), "many").collect()} == set()  # none is playable yet
    assert search.hits(store.index(), "many").count() == 13
