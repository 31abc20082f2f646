"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item; an item of fewer
words is one window.  Hashes of k words (k is half a window) are taken at every
word, and of each window the least one is kept as its fingerprint, the rightmost
of equal ones.  The choice depends on the words of the window alone, so a
document that holds a window anywhere has the same fingerprint at the same
place: every shared stretch of a window's length is guaranteed to be found.

1. Benchmark: each window with its fingerprint, its place in the window and the
   items that hold it.  The fingerprints set bits in a filter of ``BITS`` bits,
   whatever their number; Spark aggregates it, so it has a fixed size.
2. Documents: one pass keeps the selected positions whose fingerprint is in the
   filter.  Each of them is extended to both sides, to the windows that selected
   it, and these are named by a 128-bit hash of their words.
3. A join on fingerprint and extension decides; the filter only saves rows.
   Windows of the benchmark are distinct there, so a document's window has at
   most one partner however many items or documents share it.  Both sides are
   dealt by a salt as well, so a passage of very many documents is spread.
4. Hits are merged by document to stretches of words.  Windows that the same
   items hold name them by one hash, which meets its items once for a document,
   so copies of an item cost a row each and not one for each window.

The filter's size doesn't depend on the data; a benchmark of many more windows
than bits fills it, and then all selected positions meet in the join.

Defined results: a null or empty text has no words; rows with the same doc_id
are documents of their own, each with its result; a null doc_id stays null; items
with the same item_id count as one, and one that is null marks words but is
neither counted nor listed; without items, or documents, nothing is hit or the
result is empty; other columns are ignored.  A text is worked on as a whole, by
one task; what is kept of it between words is bounded by its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import ready, sliced, write_table
from .copies import hashed_grams

WINDOW = 10
#: Bits of the filter, as a power of two: 2**26 bits are 8 MB.
BITS = 26
SALTS = 32
#: ASCII upper case becomes lower case; of ASCII only letters and digits belong to words.
_WORDS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
_HIT = "array<struct<first:int,length:int,fp:long,a:long,b:long>>"


def words_of(text: str | None) -> bytes:
    """The lower-cased words of ``text``, each followed by a space."""
    found = (text or "").encode().translate(_WORDS).split()
    return b" ".join(found) + b" " if found else b""


def fingerprints(words: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, least, place) of a text: the byte after each word, and of each window of ``length`` words its fingerprint and the word where that begins."""
    data = np.frombuffer(words, np.uint8)
    ends = np.flatnonzero(data == 32)
    if len(ends) < length:
        return ends, np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = (length + 1) // 2
    grams = hashed_grams(data, ends, k).view(np.int64)
    least, place = grams[: len(ends) - length + 1].copy(), np.arange(len(ends) - length + 1)
    for i in range(1, length - k + 1):
        other = grams[i : i + len(least)]
        lower = other <= least
        least[lower] = other[lower]
        place[lower] = np.flatnonzero(lower) + i
    return ends, least, place


def extensions(words: bytes, ends: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit hashes of the windows of ``length`` words that begin at the words ``first``, as two arrays of longs."""
    view, digest = memoryview(words), xxhash.xxh3_128_digest
    begins, stops = np.where(first > 0, ends[first - 1] + 1, 0), ends[first + length - 1]
    joined = b"".join([digest(view[a:z]) for a, z in zip(begins.tolist(), stops.tolist(), strict=True)])
    return tuple(np.frombuffer(joined, "<i8").reshape(-1, 2).T)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(length, fp, a, b, items): the distinct windows of all items, with the ids of those that hold them, in order."""
    ready(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                length = min(window, words.count(b" "))
                if length:
                    ends, least, _ = fingerprints(words, length)
                    a, b = extensions(words, ends, np.arange(len(least)), length)
                    columns = [pa.array([item] * len(least), pa.int64()), pa.array(np.full(len(least), length, np.int32)), pa.array(least), pa.array(a), pa.array(b)]
                    yield pa.RecordBatch.from_arrays(columns, ["item_id", "length", "fp", "a", "b"])

    found = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, length int, fp long, a long, b long")
    return found.groupBy("length", "fp", "a", "b").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def _filter(windows: DataFrame) -> np.ndarray:
    """The bits that fingerprints set, at most ``2**BITS`` of them."""
    bits = windows.select(F.shiftrightunsigned("fp", 64 - BITS).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    found = words.toArrow()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits.view(np.uint64)


def _candidates(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, n_words, found): for each document its windows whose fingerprint is in the filter."""
    spark = docs.sparkSession
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # at most WINDOW of them
    sent = spark.sparkContext.broadcast(_filter(windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in sliced(batches):
            counts, sizes, parts = [], [], [[np.zeros(0, np.int64)] * 5]
            for text in batch.column(1).to_pylist():
                words, hits = words_of(text), 0
                for length in lengths:
                    ends, least, _ = fingerprints(words, length)
                    bit = least.view(np.uint64) >> np.uint64(64 - BITS)
                    first = np.flatnonzero((bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
                    parts.append([first, np.full(len(first), length), least[first], *extensions(words, ends, first, length)])
                    hits += len(first)
                counts.append(words.count(b" "))
                sizes.append(hits)
            columns = [pa.array(np.concatenate(c)).cast(f.type) for c, f in zip(zip(*parts, strict=True), kind, strict=True)]
            found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), found], ["doc_id", "n_words", "found"])

    kind = pa.struct([("first", pa.int32()), ("length", pa.int32()), ("fp", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, n_words long, found {_HIT}")


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): a row for each row of ``docs`` (doc_id, text).

    items are the ids of the items that have a window in the document, spans the
    hit stretches (first word, word after the last), in order and apart; spans
    is null without a hit, items without an id.
    """
    windows = item_windows(items, window).withColumn("owners", F.when(F.size("items") > 0, F.md5(F.array_join("items", ",").cast("binary"))))
    windows = write_table(windows, "benchmark")
    # a row's number is settled by writing the table
    base = write_table(_candidates(docs, windows).withColumn("row", F.monotonically_increasing_id()), "candidates")
    salt, all_salts = F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    keys = ["length", "fp", "a", "b"]
    hits = base.select("row", F.explode("found").alias("w")).select("row", "w.*", salt).join(windows.select(*keys, "owners", all_salts), [*keys, "salt"])
    hits = hits.select("row", "first", (F.col("first") + F.col("length")).alias("end"), "owners")
    so_far = Window.partitionBy("row").orderBy("first")
    begins = F.col("first") > F.max("end").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.withColumn("new", F.coalesce(begins.cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("row", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.collect_set("owners").alias("owners"))
    spans = spans.groupBy("row").agg(F.sum(F.col("end") - F.col("first")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("owners"))).alias("owners"))
    groups = windows.select("owners", "items").filter("owners IS NOT NULL").dropDuplicates(["owners"]).select("owners", "items", all_salts)
    named = spans.select("row", F.explode("owners").alias("owners")).withColumn("salt", salt).join(groups, ["owners", "salt"])
    named = named.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    found = base.select("row", "doc_id", "n_words").join(spans.drop("owners").join(named, "row", "left"), "row", "left")
    return found.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "items", "spans")


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract of operator 12 over the whole of ``documents`` and ``benchmark``."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    found = contaminated(docs, items)
    ids = F.coalesce(F.array_sort(F.transform("items", lambda x: x.cast("string"))), F.array().cast("array<string>"))
    digest = F.sha2(F.array_join(ids, ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH texts AS (
  SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents UNION ALL SELECT 1, item_id, row_number() OVER (), coalesce(text, '') FROM benchmark
), words AS (
  SELECT kind, id, row, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), items AS (
  SELECT id, w, least(10, len(w)) AS length FROM words WHERE kind = 1 AND len(w) > 0
), parts AS (
  SELECT id, length, w, unnest(range(len(w) - length + 1)) AS first FROM items
), windows AS (
  SELECT DISTINCT length, array_to_string(w[first + 1:first + length], ' ') AS body, id FROM parts
), spans AS (
  SELECT row, w, length, unnest(range(len(w) - length + 1)) AS first FROM words, (SELECT DISTINCT length FROM items) WHERE kind = 0 AND len(w) >= length
), hits AS (
  SELECT s.row, s.first, s.length, v.id FROM spans s JOIN windows v ON v.length = s.length AND v.body = array_to_string(s.w[s.first + 1:s.first + s.length], ' ')
), covered AS (
  SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(first, first + length)) AS place FROM hits) GROUP BY row
), named AS (
  SELECT row, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT row, CAST(id AS VARCHAR) AS name FROM hits WHERE id IS NOT NULL) GROUP BY row
)
SELECT d.id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN covered c ON c.row = d.row LEFT JOIN named n ON n.row = d.row WHERE d.kind = 0
"""
