import pathlib
import random
import subprocess
import sys
from collections import deque

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from mediaquarry.operators import browse, joblog, schedule, sync
from mediaquarry.plans import oracle, queries
from mediaquarry.plans.numbering import numbered, preceding, running
from mediaquarry.sources import appendlog
from mediaquarry.sources.tables import CATEGORIES, CREATORS, ERROR, HARVESTED, METADATA_ONLY, POSTS, Catalog, blob, blob_files, caption_of, message_files

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def comparable(columns, rows):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, FOLDER)
    want = tables.execute(oracle.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert comparable(df.columns, df.collect()) == comparable(columns, want.fetchall())


def test_the_entry_point(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert not oracle.ORACLES.keys() - __spark_entry__.queries().keys()


def test_pages_add_up(spark):
    catalog = queries._catalog(spark, FOLDER)
    every = [r.id for r in browse.playlist(catalog).collect()]
    pages = []
    while len(found := browse.browse(catalog, len(pages)).collect()):
        pages += [r.id for r in found]
        if not browse.has_more(len(found)):
            break
    assert pages == every
    assert [r.id for r in browse.browse(catalog, -5).collect()] == every[:30]


@pytest.mark.parametrize("upper", [2, 24])
def test_numbers_cross_blocks(spark, upper):
    rng = random.Random(1)
    ids = rng.sample(range(-500, 5000), 700) + [rng.randrange(-(1 << 63), 1 << 63) for _ in range(100)] + [(1 << 63) - 1, -(1 << 63)]
    rows = [(i, "ab"[i % 2] if i % 7 else None) for i in ids]
    df = spark.createDataFrame(rows, "id long, k string")
    got = {(r.k, r.id): r.n for r in numbered(df, ["k"], "id", True, "n", bits=6, upper=upper).collect()}
    for k in ("a", "b", None):
        mine = sorted((i for i, x in rows if x == k), reverse=True)
        assert [got[k, i] for i in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("upper", [2, 24])
def test_running_minimum_crosses_blocks(spark, upper):
    rng = random.Random(2)
    steps = [(i if i < 300 else i << 40, rng.choice("xy"), rng.choice((-1, 1))) for i in range(400)]
    got = {r.i: (r.total, r.number, r.earlier) for r in running(spark.createDataFrame(steps, "i long, k string, s int"), "k", "i", "s", bits=4, upper=upper).collect()}
    for k in "xy":
        total, n, least = 0, 0, None
        for i, x, s in steps:
            if x == k:
                total += s
                assert got[i] == (total, n, least)
                n, least = n + 1, total if least is None else min(least, total)


def framed(commands):
    out = []
    for parts in commands:
        out.append(f"*{len(parts)}\r\n" + "".join(f"${len(p.encode())}\r\n{p}\r\n" for p in parts))
    return "".join(out)


def test_replay_of_a_log(spark, tmp_path):
    """A log of the shape that is known: 310 commands, 28 jobs in and out, 180 of 208 pushes left, 73 gated."""
    log = [("SELECT", "0")]
    for _ in range(4):
        log += [("RPUSH", "QUEUE_MODELS", f'{{"model_name": "{m}"}}') for m in joblog.MODELS]
        log += [("LPOP", "QUEUE_MODELS")] * 7
    for i in range(180):
        n = 471 + 4 * i
        if i >= 107:
            log.append(("SADD", "SEEN", str(n)))
        log.append(("RPUSH", "QUEUE_VISION", f'{{"msg_id": {n}, "path": "/v/video_{n}.mp4"}}'))
    (tmp_path / "log.aof").write_bytes(framed(log).encode())
    rows = appendlog.commands(spark, str(tmp_path / "log.aof"))
    assert {r.op: r["count"] for r in rows.groupBy("op").count().collect()} == {"SELECT": 1, "RPUSH": 208, "LPOP": 28, "SADD": 73}
    assert {r.key: (r.pushed, r.popped, r.depth) for r in joblog.final_depths(rows).collect()} == {"QUEUE_MODELS": (28, 28, 0), "QUEUE_VISION": (180, 0, 180)}
    jobs = joblog.decoded(rows.filter("key = 'QUEUE_VISION'"), joblog.VISION_JOB)
    assert jobs.agg(F.countDistinct("msg_id"), F.min("msg_id"), F.max("msg_id")).first()[:] == (180, 471, 471 + 4 * 179)
    added = joblog.members(rows).select(F.col("value").cast("long").alias("msg_id"))
    assert added.count() == 73 and joblog.ungated(jobs, added, "msg_id").count() == 107
    assert joblog.dispatched(joblog.decoded(rows, joblog.MODEL_JOB)).count() == 28


def test_values_with_line_ends_and_frames(spark, tmp_path):
    """Parts are read by their lengths: no value is cut or taken for a command."""
    log = [("RPUSH", "q", v) for v in ("a\r\nb", "x\r\n*1\r\n$4\r\nPING\r\n", "", "*3\r\n", "\u00e4\U0001f600", "$5\r\nRPUSH")] + [("PING",), ("set", "k", "v", "more")]
    data = framed(log).encode()
    (tmp_path / "whole.aof").write_bytes(b"#TS:1\r\n" + data)
    (tmp_path / "cut.aof").write_bytes(data[:-3])
    (tmp_path / "empty.aof").write_bytes(b"")
    got = {}
    for r in appendlog.commands(spark, str(tmp_path / "*.aof")).collect():
        got.setdefault(r.file.rsplit("/", 1)[-1], []).append((r.seq, r.op, r.key, r.value))
    want = [(i, op.upper(), *([*rest, None, None][:2])) for i, (op, *rest) in enumerate(log, 1)]
    assert got["whole.aof"] == want and got["cut.aof"] == want[:-1] and "empty.aof" not in got
    (tmp_path / "bad.log").write_bytes(data + b"junk\r\n")
    with pytest.raises(Exception, match="no command at byte"):
        appendlog.commands(spark, str(tmp_path / "bad.log")).collect()


def test_the_entry_point_without_the_subpackage(tmp_path):
    """A library that only the training-data queries need may be missing."""
    code = "import sys; sys.modules['ahocorasick'] = None; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = pathlib.Path(__spark_entry__.__file__).parent
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=120)
    assert out.stdout.split() == [str(len(queries.QUERIES)), str(len(oracle.ORACLES))], out.stderr


def test_depths_and_matches_of_random_logs(spark):
    rng = random.Random(3)
    log = [(i, rng.choice(("RPUSH", "LPOP", "LPOP", "SADD")), rng.choice("pq"), str(i)) for i in range(300)]
    df = spark.createDataFrame(log, "seq long, op string, key string, value string")
    got = {r.seq: r.depth for r in joblog.depths(df).collect()}
    taken = {(r.key, r.pushed_at): r.popped_at for r in joblog.matched(df).collect()}
    queues = {"p": deque(), "q": deque()}
    want = {}
    for seq, op, key, _ in log:
        if op == "RPUSH":
            queues[key].append(seq)
            want[key, seq] = None
        elif op == "LPOP" and queues[key]:
            want[key, queues[key].popleft()] = seq
        if op != "SADD":
            assert got[seq] == len(queues[key])
    assert taken == want


def empty_catalog(spark):
    return Catalog(spark.createDataFrame([], CATEGORIES), spark.createDataFrame([], CREATORS), spark.createDataFrame([], POSTS), spark.createDataFrame([], "video_id long, caption string, creator string, category string"))


def messages(spark, rows):
    df = spark.createDataFrame(rows, "id long, category string, creator string, likes long, body string")
    return df.select("id", F.lit(False).alias("empty"), F.lit(True).alias("has_video"), F.lit(None).cast("string").alias("mime"), caption_of(*map(F.col, ("category", "creator", "likes", "body"))).alias("caption"))


def test_sync_keeps_what_is_known(spark):
    one, held = sync.synced(empty_catalog(spark), messages(spark, [(5, "b", "u", 3, "five"), (9, "a", "u", 1, "nine"), (7, "b", "w", 2, "seven"), (7, "b", "w", 2, "seven")]))
    assert held.count() == 0
    assert {r.name: r.id for r in one.categories.collect()} == {"a": 1, "b": 2}
    assert {r.username: r.id for r in one.creators.collect()} == {"u": 1, "w": 2}
    two, _ = sync.synced(one, messages(spark, [(5, "z", "u", 99, "changed"), (11, "c", "w", 4, "eleven")]))
    posts = {r.video_id: (r.category_id, r.likes, r.caption, r.status, r.local_video_path) for r in two.posts.collect()}
    assert posts[5] == (2, 3, "five", METADATA_ONLY, None) and posts[11][1:3] == (4, "eleven") and len(posts) == 4
    names = {r.name: r.id for r in two.categories.collect()}
    assert names["a"] == 1 and names["b"] == 2 and names["z"] == 4 and names["c"] == 3
    assert sorted(r.video_id for r in two.docs.collect()) == [5, 7, 9, 11]


def test_missing_and_present_make_up_all_ids(spark):
    present = spark.createDataFrame([(i,) for i in (2, 3, 7, 1000)], "video_id long")
    missing = [r.id for r in sync.missing_ids(present, 1000).collect()]
    assert sorted([*missing, 2, 3, 7, 1000]) == list(range(1, 1001))
    chunks = {r.id: r.chunk for r in sync.chunked(sync.missing_ids(present, 1000)).collect()}
    for n, i in enumerate(sorted(missing, reverse=True)):
        assert chunks[i] == n // 200


@pytest.mark.parametrize("upper", [2, 24])
def test_preceding_values_cross_blocks(spark, upper):
    rng = random.Random(7)
    ids = sorted({*rng.sample(range(-300, 2000), 400), *(rng.randrange(-(1 << 60), 1 << 60) for _ in range(60))})
    df = spark.createDataFrame([(i, str(i)) for i in ids], "id long, k string")
    got = {r.id: r.p for r in preceding(df, "id", "p", bits=4, upper=upper).collect()}
    assert got == dict(zip(ids, [None, *ids[:-1]], strict=True))


def test_ranges_are_the_missing_ids(spark):
    present = spark.createDataFrame([(i,) for i in (2, 3, 7, 7, 640, 900, 5000, -4)], "video_id long")
    for latest in (1000, 900, 1, 0):
        chunks = {r.id: r.chunk for r in sync.chunked(sync.missing_ids(present, latest)).collect()}
        rows = sync.range_chunks(sync.missing_ranges(present, latest)).collect()
        assert sorted(i for r in rows for i in range(r.first, r.last + 1)) == sorted(chunks)
        assert all((r.chunk_of_first, r.chunk_of_last) == (chunks[r.first], chunks[r.last]) for r in rows)
    far = sync.range_chunks(sync.missing_ranges(present, 10**12)).orderBy("first").collect()
    assert (far[-1].first, far[-1].last, far[-1].chunk_of_last) == (5001, 10**12, 0) and sum(r.last - r.first + 1 for r in far) == 10**12 - 6


def test_outcomes(spark):
    posts = spark.createDataFrame([(i, 1, 1, 0, "", None, METADATA_ONLY) for i in range(1, 5)], POSTS)
    outcomes = spark.createDataFrame([(1, 1, True, "/p/1"), (2, 1, False, None), (3, 1, True, "/p/3"), (3, 2, False, None)], "video_id long, seq long, ok boolean, path string")
    got = {r.video_id: (r.status, r.local_video_path) for r in sync.with_outcomes(posts, outcomes).collect()}
    assert got == {1: (HARVESTED, "/p/1"), 2: (ERROR, None), 3: (ERROR, "/p/3"), 4: (METADATA_ONLY, None)}


def test_the_order_of_downloads_is_that_of_the_loop(spark):
    rng = random.Random(4)
    categories = spark.createDataFrame([(i, f"c{i}") for i in range(6)], CATEGORIES)
    posts = [(i, rng.randrange(6), 1, 0, "", None, rng.choice((METADATA_ONLY, METADATA_ONLY, HARVESTED))) for i in range(1, 80)]
    asked = [(1, "c4"), (2, "c1"), (3, "none"), (4, "c4"), (5, ""), (6, browse.ALL), (7, None)]
    ranks = schedule.queue(spark.createDataFrame(asked, "seq int, category string"))
    queue: list[str] = []
    for _, c in asked:
        if c and c != browse.ALL:
            queue = [c, *(x for x in queue if x != c)]
    assert {r.category: r["rank"] for r in ranks.collect()} == {c: i for i, c in enumerate(queue)}
    waiting = sorted(((v, f"c{c}") for v, c, *_, s in posts if s == METADATA_ONLY), reverse=True)
    want = []
    while waiting:
        pick = next((w for q in queue for w in waiting if w[1] == q), waiting[0])
        waiting.remove(pick)
        want.append(pick[0])
    df = spark.createDataFrame(posts, POSTS)
    assert [r.video_id for r in schedule.download_order(df, categories, ranks).orderBy("place").collect()] == want
    assert schedule.next_target(df, categories, ranks).first().video_id == want[0]
    assert schedule.next_target(df.limit(0), categories, ranks).count() == 0


def test_files_as_blobs_and_messages(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "video_1.mp4").write_bytes(b"abc")
    files = blob_files(spark, str(tmp_path / "v"))
    assert bytes(blob(files, "video_1.mp4").first().content) == b"abc" and blob(files, "video_2.mp4").count() == 0
    (tmp_path / "m.json").write_text('{"id": 3, "empty": false, "has_video": true, "caption": "x"}\n')
    assert message_files(spark, str(tmp_path / "m.json")).first().id == 3
