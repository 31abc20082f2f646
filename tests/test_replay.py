import random

from mediaquarry.operators import replay
from mediaquarry.sources import storage, tables

POSTS, REQUESTS = "video_id long, category_id long, status string, extra int", "seq long, category string"


def loop(posts, names, requests, fetches):
    """The scheduler as a loop over its log."""
    queue, out = [], []
    waiting = {v: c for v, c, status in posts if status == tables.METADATA_ONLY}
    known = {name: c for c, name in names}
    for seq, name in sorted([r for r in requests if r[0] is not None] + [(s, False) for s in fetches], key=lambda x: x[0]):
        if name is not False:
            if name and name != "All Categories":
                queue = [name, *(q for q in queue if q != name)]
            continue
        if not waiting:
            queue = []
            continue
        target, video = "Global", None
        for q in queue:
            mine = [v for v, c in waiting.items() if q in known and c == known[q]]
            if mine:
                target, video = q, max(mine)
                break
        if video is None:
            queue, video = [], max(waiting)
        del waiting[video]
        out.append((seq, len(out) + 1, video, target))
    return out


def run(spark, posts, names, requests, fetches):
    df = replay.replay(
        spark.createDataFrame([(*p, 1) for p in posts], POSTS), spark.createDataFrame(names, "id long, name string"),
        spark.createDataFrame(requests, REQUESTS), spark.createDataFrame([(s,) for s in fetches], "seq long"), storage.for_session(spark, "replay"),
    )
    assert df.columns == ["seq", "place", "video_id", "target"]
    return sorted(tuple(r) for r in df.collect())


def test_equal_to_a_loop(spark):
    """Random logs: late first requests, requests in a row, categories that run out, more downloads than posts and fewer."""
    for seed, (n_posts, n_steps, share, late) in enumerate([(60, 200, 0.3, 0), (150, 120, 0.2, 30), (40, 90, 0.1, 10)]):
        rng = random.Random(seed)
        names = [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
        ids = rng.sample(range(1, 1 << 20), n_posts)
        posts = [(v, rng.choice((1, 1, 1, 2, 2, 3, 4, None, 9)), rng.choice((tables.METADATA_ONLY,) * 4 + (tables.ERROR,))) for v in ids]
        requests, fetches = [], []
        for seq in rng.sample(range(1 << 40), n_steps):
            if rng.random() < share:
                requests.append((seq, rng.choice(("a", "b", "c", "", None, "All Categories", "nobody"))))
            else:
                fetches.append(seq)
        start = sorted(fetches)[min(late, len(fetches) - 1)]
        requests = [r for r in requests if r[0] > start] + [(None, "a")]
        want = loop(posts, names, requests, fetches)
        assert {"Global"} < {w[3] for w in want}
        assert run(spark, posts, names, requests, fetches) == want


def test_blocks_of_posts(spark):
    """A stretch over many blocks, and many stretches in a block, place the same posts."""
    waiting = spark.createDataFrame([(100 - n, 1, n) for n in range(1, 41)], "video_id long, c long, n long")
    spans = spark.createDataFrame([(1, 0, 3, 0), (1, 10, 1, 3), (1, 20, 21, 4), (1, 60, 5, 30)], replay.SPANS)
    want = {(100 - n, n if n <= 3 else 11 if n == 4 else n + 16 if n <= 25 else n + 30) for n in range(1, 41) if n <= 25 or 31 <= n <= 35}
    for bits in (1, 3, 16):
        assert {(r["video_id"], r["place"]) for r in replay._found(waiting, spans, bits).collect()} == want


def test_nothing_to_do(spark):
    one = [(7, 1, tables.METADATA_ONLY)]
    assert run(spark, one, [(1, "a")], [(1, "a")], []) == []
    assert run(spark, [], [(1, "a")], [(1, "a")], [2]) == []
    assert run(spark, one, [], [(1, "a")], [2, 3]) == [(2, 1, 7, "Global")]
