import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediaquarry.sources import appendlog, ranged


def framed(commands):
    return b"".join(b"*%d\r\n" % len(parts) + b"".join(b"$%d\r\n%s\r\n" % (len(p), p) for p in parts) for parts in commands)


def asked(spark, rows):
    return spark.createDataFrame(rows, "path string, header string, who int")


def test_a_range_far_into_a_large_file(spark, tmp_path):
    """3 GB into a sparse file of 4 GB, in pieces; a worker's Arrow memory stays below 64 MB."""
    large = tmp_path / "large.bin"
    with large.open("wb") as f:
        f.truncate(4 << 30)
        f.seek(3 << 30)
        f.write(b"here it is")
    found = ranged.ranges(asked(spark, [(large.as_uri(), f"bytes={(3 << 30) - 2}-{(3 << 30) + 9}", 1), (large.as_uri(), f"bytes={(4 << 30) - 3}-", 2), ((tmp_path / "none").as_uri(), "bytes=0-5", 3)]))
    assert sorted((r.who, r.piece, r.offset, bytes(r.content)) for r in found.collect()) == [(1, 0, (3 << 30) - 2, b"\0\0here it is"), (2, 0, (4 << 30) - 3, b"\0\0\0")]
    sizes = ranged.ranges(asked(spark, [(large.as_uri(), f"bytes={1 << 30}-{(1 << 30) + (33 << 20)}", 1)])).select("piece", F.octet_length("content").alias("n"))
    assert sorted(map(tuple, sizes.collect())) == [*((i, 2 << 20) for i in range(16)), (16, (1 << 20) + 1)]
    pieces = pa.RecordBatch.from_pydict({"path": [large.as_uri()] * 100, "offset": [(3 << 30) + i * (2 << 20) for i in range(100)], "bytes": [2 << 20] * 100})
    before = pa.default_memory_pool().max_memory()
    assert sum(len(b.column("content")[0].as_py()) for b in ranged.read_pieces(iter([pieces]))) == 200 << 20
    assert pa.default_memory_pool().max_memory() - before < 64 << 20


def test_ranges_as_slices(spark, tmp_path):
    data = bytes(random.Random(1).randrange(256) for _ in range(5000))
    (tmp_path / "f").write_bytes(data)
    headers = [None, "", "bytes=0-", "bytes=10-19", "bytes=4990-9999", "bytes=5000-", "bytes=7-3", "items=1-2", "bytes=99999999999999999999-"]
    rows = ranged.ranges(asked(spark, [(str(tmp_path / "f"), h, i) for i, h in enumerate(headers)]), piece=700).orderBy("who", "piece").collect()
    got = {}
    for r in rows:
        assert r.size == 5000 and bytes(r.content) == data[r.offset : r.offset + len(r.content)] and 0 < len(r.content) <= 700
        got[r.who] = got.get(r.who, b"") + bytes(r.content)
    assert got == {0: data, 1: data, 2: data, 3: data[10:20], 4: data[4990:], 7: data}


def log_of(rng, n):
    values = [b"x", b"", b"a\r\nb", b"*1\r\n$4\r\nPING", b"*1\r\n$4\r\nPING\r\n", b"\r\n*2\r\n$1\r\na\r\n$1\r\nb\r\n*1\r\n$4\r\nPING", b"*3\r\n", b"$5\r\nRPUSH", "ü😀".encode(), b"\xff\xfe", b"#note\n*1\r\n", b"y" * 900]
    return [[b"rpush", b"q%d" % (i % 3), rng.choice(values)] if rng.random() < 0.9 else [rng.choice((b"PING", b"*1"))] for i in range(n)]


@pytest.mark.parametrize("split", [333, 5000])
def test_a_file_of_many_splits(spark, tmp_path, split, monkeypatch):
    """The splits of a file whose values hold commands and line ends give the commands that one task reads."""
    monkeypatch.setattr(appendlog.Frames.__init__, "__defaults__", (64,))
    rng = random.Random(split)
    log = log_of(rng, 150)
    data = framed(log[:80]) + b"#TS:17\r\n#TS:18\r\n" + framed(log[80:])
    (tmp_path / "a.aof").write_bytes(data)
    (tmp_path / "b.aof").write_bytes(data[:-5])
    want = [(i, c[0].decode().upper(), *[p.decode("utf-8", "replace") for p in c[1:3]], *[None] * (3 - len(c))) for i, c in enumerate(log, 1)]
    got = {}
    for r in appendlog.commands(spark, str(tmp_path / "*.aof"), split).orderBy("file", "seq").collect():
        got.setdefault(r.file[-5], []).append((r.seq, r.op, r.key, r.value))
    assert got["a"] == want and got["b"] == want[:-1]
    found = appendlog.splits(spark, str(tmp_path / "a.aof"), split)
    assert len(found) > 2 and [s for _, s, *_ in found] == sorted({s for _, s, *_ in found})
    assert appendlog.commands(spark, str(tmp_path / "a.aof"), split).rdd.getNumPartitions() == len(found)


def test_one_split_is_as_many(spark, tmp_path):
    (tmp_path / "a.aof").write_bytes(framed(log_of(random.Random(8), 400)))
    rows = [sorted(map(tuple, appendlog.commands(spark, str(tmp_path / "a.aof"), n).collect())) for n in (1 << 30, 1000)]
    assert rows[0] == rows[1] and len(rows[0]) == 400


def test_a_broken_file_raises(spark, tmp_path):
    data = framed(log_of(random.Random(9), 100))
    (tmp_path / "bad.aof").write_bytes(data + b"junk\r\n" + data)
    with pytest.raises(Exception, match=f"no command at byte {len(data)}"):
        appendlog.commands(spark, str(tmp_path / "bad.aof"), 500).collect()
