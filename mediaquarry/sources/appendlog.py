"""The append-only log of a key-value server, in its length-prefixed framing, and lines of process output.

Where a command begins depends on all before it, so a file is cut at any byte
and the cuts are mended:

1. Each split tries the places in it that look like the begin of a command,
   until the commands from one of them on follow each other to the split's end.
   A value may hold what looks like a command, so this is a guess.
2. The first split of a file begins at byte 0, which is certain; the others
   have to begin where the one before ends.  A guess that doesn't is dropped and
   its split read anew from the right place.  This takes a few numbers of each
   split.
3. Splits with certain begins are read in parallel; commands are numbered by the
   counts of the splits before.

Only the buffer of a split and the values of a batch are in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .ranged import opened

#: Commands of a batch that a task hands on, and bytes of their values.
BATCH, BATCH_BYTES = 4_096, 16 << 20
#: Bytes of a split, and of a read.
SPLIT, READ = 64 << 20, 1 << 20


class Frames:
    """Commands of a file, from a byte on."""

    def __init__(self, path: str, read: int = READ) -> None:
        self.path, self.file, self.read = path, opened(path), read
        self.size = self.file.size()
        self.begin, self.data = 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes at ``at``; longer reads bypass the buffer."""
        if n > self.read:
            return self.file.read_at(min(n, max(0, self.size - at)), at)
        if not (self.begin <= at and at + n <= self.begin + len(self.data)):
            self.begin, self.data = at, self.file.read_at(max(0, min(self.read, self.size - at)), at)
        return self.data[at - self.begin : at - self.begin + n]

    def line(self, at: int, sign: bytes) -> tuple[int, int] | None:
        """The number on the line at ``at`` and where the next begins, or None where the file ends before."""
        head = self.bytes(at, 24)
        end = head.find(b"\r\n")
        if end < 0 and at + len(head) == self.size and (not head or head[:1] == sign and (head[1:].rstrip(b"\r").isdigit() or head[1:] in (b"", b"\r"))):
            return None
        if end < 0 or head[:1] != sign or not head[1:end].isdigit():
            raise ValueError(f"{self.path}: no command at byte {at}")
        return int(head[1:end]), at + end + 2

    def past_notes(self, at: int) -> int:
        """The first byte from ``at`` on that isn't in a note, a line between commands."""
        while self.bytes(at, 1) == b"#":
            while (cut := self.bytes(at, 256).find(b"\n")) < 0 and at < self.size:
                at += 256
            at = min(self.size, at + cut + 1)
        return at

    def command(self, at: int, values: bool) -> tuple[list[bytes], int] | None:
        """The parts of the command at ``at``, without ``values`` none of them, and where it ends; None where the file cuts it off."""
        if (head := self.line(at, b"*")) is None:
            return None
        count, at = head
        parts = []
        for _ in range(count):
            if (head := self.line(at, b"$")) is None or head[1] + head[0] + 2 > self.size:
                return None
            if values:
                parts.append(self.bytes(head[1], head[0]))
            at = head[1] + head[0] + 2
            if self.bytes(at - 2, 2) != b"\r\n":
                raise ValueError(f"{self.path}: no line end at byte {at - 2}")
        return parts, at

    def walk(self, at: int, end: int) -> tuple[int, int]:
        """(place, n): where the first command at or beyond ``end`` begins, and how many begin from ``at`` to there."""
        n, at = 0, self.past_notes(at)
        while at < min(end, self.size):
            found = self.command(at, False)
            if found is None:
                return self.size, n
            at, n = self.past_notes(found[1]), n + 1
        return at, n

    def guess(self, begin: int, end: int) -> tuple[int, int, int] | None:
        """(start, place, n) for the first place in a split from which commands follow each other to its end."""
        at = begin
        while at < end:
            data = self.bytes(at, min(self.read, end - at))
            k = data.find(b"*")
            while k >= 0:
                if at + k == 0 or self.bytes(at + k - 1, 1) == b"\n":
                    try:
                        return at + k, *self.walk(at + k, end)
                    except ValueError:
                        pass
                k = data.find(b"*", k + 1)
            at += len(data)
        return None


_SURVEY = "path string, split int, start long, place long, n long"


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A guess for each split (path, split, first, last), or what follows from its start where that is known."""
    for batch in batches:
        for r in batch.to_pylist():
            frames = Frames(r["path"])
            found = frames.guess(r["first"], r["last"]) if r["start"] is None else (r["start"], *frames.walk(r["start"], r["last"]))
            start, place, n = found or (None, None, None)
            yield pa.RecordBatch.from_pylist([{"path": r["path"], "split": r["split"], "start": start, "place": place, "n": n}], _schema(_SURVEY))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def splits(spark: SparkSession, path: str, size: int = SPLIT) -> list[tuple[str, int, int, int]]:
    """(path, start, end, before): where the commands of each split begin, where the split ends, and how many commands come before.

    A few numbers for each ``size`` bytes are on the driver.
    """
    storage.ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    cut = files.select("path", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("split", "_k"))
    asked = cut.select("path", "split", (F.col("_k") * size).alias("first"), F.least(F.col("length"), (F.col("_k") + 1) * size).alias("last"), F.when(F.col("_k") == 0, F.lit(0).cast("long")).alias("start"))
    spread = asked.repartition(max(1, spark.sparkContext.defaultParallelism), "path", "split")
    guesses = {(r.path, r.split): (r.start, r.place, r.n) for r in spread.mapInArrow(_surveyed, _SURVEY).collect()}
    ends = {(r.path, r.split): r.last for r in asked.select("path", "split", "last").collect()}
    out, place, before = [], 0, 0
    for (file, split), last in sorted(ends.items()):
        if split == 0:
            place = before = 0
        if place >= last:
            continue  # a command of the splits before goes on beyond this one
        start, end, n = guesses[file, split]
        if start != place and split:
            again = spark.createDataFrame([(file, split, place, last, place)], "path string, split int, first long, last long, start long")
            _, end, n = again.mapInArrow(_surveyed, _SURVEY).select("start", "place", "n").first()
        out.append((file, place, last, before))
        place, before = end, before + n
    return out


def commands(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(file, seq, op, key, value): the commands of each log file, in order, numbered from 1.

    Parts are taken by their lengths, so a value may hold anything, line ends
    and what looks like a command too.  A command that the end of the file cuts
    off is left out, as a server does when it starts; bytes that aren't UTF-8
    are replaced; a file that breaks the framing elsewhere raises.
    """
    found = splits(spark, path, split)
    rows = spark.createDataFrame(found, "file string, start long, last long, before long").repartition(max(1, len(found)), "file", "start")
    schema = _schema("file string, seq long, op string, key string, value string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                frames, held, size = Frames(r["file"]), [], 0
                at, seq = frames.past_notes(r["start"]), r["before"]
                while at < min(r["last"], frames.size) and (command := frames.command(at, True)) is not None:
                    parts, at = command[0], frames.past_notes(command[1])
                    seq += 1
                    op, key, value = ([p.decode("utf-8", "replace") for p in parts[:3]] + [None] * 3)[:3]
                    held.append((r["file"], seq, op and op.upper(), key, value))
                    size += sum(map(len, parts))
                    if len(held) == BATCH or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*held, strict=True)), strict=True)), schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*held, strict=True)), strict=True)), schema)

    return rows.mapInArrow(run, "file string, seq long, op string, key string, value string")


def log_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Lines of process output."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path).withColumnRenamed("value", "line")
