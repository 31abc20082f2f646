"""Removal of repeated runs of lines, by winnowing.

A window begins at a line and takes the fewest lines that reach ``min_words``
words.  Of each window the least line hash is selected as a fingerprint, with
its position, so two texts that share a whole window share a fingerprint.
Each selected position counts once; fingerprints that occur in one position
only are left out, with their windows.  A line has two windows, one that begins
at it and one that ends at it, as far as each has the words of a run.  Of what
shares a fingerprint, windows with equal lines match, and matches that overlap
or touch make up a run, however long.  So positions decide what is compared, and
whole windows, which are stored with their position, what is equal; matches
aren't extended line by line beyond them.

So a line goes if and only if it lies in a stretch of lines of ``min_words``
words or more that occurs earlier.  (In the longest such stretch a line lies
either in a window to the right of its own beginning or, where fewer words are
left, in the window to the left of the end.)  Earlier means a smaller doc_id,
or an earlier line of the text; in one text a window is later only beyond the
lines of its first occurrence.  Groups are reduced to their first member, never
to pairs, so a passage in a third of all texts costs no more than any other.

Lines are parted by line feeds and compared whole, without white space at
either end; words are parted by the white space of ASCII.

Only DataFrame functions are used.

Defined results: a null text stays null and an empty one empty; a text all of
whose lines go becomes empty; lines without a word are in no comparison and go
only between two deleted lines of a window; rows with the same doc_id and text
count as one document and get the same result; a null doc_id comes after all
others; an empty table gives an empty one; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import write_table

MIN_WORDS = 50
_LAST = (1 << 63) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, th, text): id without nulls, th a hash of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, first, last, anchor, place, c1, c2): a row for each window of ``docs``, to the right or to the left of a line.

    anchor is the least line hash, place the line that has it (the rightmost),
    and c1, c2 are hashes of the window's lines.  A window to the left is left
    out where one to the right has the same lines.
    """
    rows = _keyed(docs).filter("text <> ''").withColumn("u", F.monotonically_increasing_id())
    line = F.regexp_replace("line", r"\A[ \t\x0B\f\r]+|[ \t\x0B\f\r]+\z", "")
    lines = rows.select("u", "id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", line).filter("line <> ''")
    lines = lines.select("u", "id", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), F.size(F.split("line", r"[ \t\x0B\f\r]+")).cast("long").alias("words"))
    whole = Window.partitionBy("u").orderBy("pos")
    lines = lines.withColumn("upto", F.sum("words").over(whole)).withColumn("before", F.col("upto") - F.col("words"))
    right = Window.partitionBy("u").orderBy("before").rangeBetween(0, min_words - 1)
    left = Window.partitionBy("u").orderBy("upto").rangeBetween(1 - min_words, 0)

    def window(over: Window):
        least = F.min(F.struct("h1", (-F.col("pos")).alias("p"))).over(over)
        content = F.collect_list(F.struct("h1", "h2")).over(over)
        return F.struct(F.min("pos").over(over).alias("first"), F.max("pos").over(over).alias("last"), F.sum("words").over(over).alias("total"), least.alias("least"), content.alias("content"))

    found = lines.select("id", "th", "words", window(right).alias("right"), window(left).alias("left"))
    reaches = F.col("right.total") >= min_words, F.col("left.total") - F.col("words") >= min_words
    found = found.select("id", "th", F.explode(F.filter(F.array(F.when(reaches[0], F.col("right")), F.when(reaches[1], F.col("left"))), lambda w: w.isNotNull())).alias("w")).select("id", "th", "w.*")
    return found.select("id", "th", "first", "last", F.col("least.h1").alias("anchor"), (-F.col("least.p")).alias("place"), F.xxhash64("content.h1").alias("c1"), F.xxhash64("content.h2").alias("c2"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, starts, ends): the lines to delete of each text that has any, in order and apart."""
    found = write_table(windows(docs, min_words), "windows")
    selected = found.select("anchor", F.struct("id", "th", "place").alias("place"))
    shared = selected.groupBy("anchor").agg(F.min("place").alias("a"), F.max("place").alias("b")).filter("a <> b").select("anchor")
    joined = write_table(found.join(write_table(shared, "anchors"), "anchor", "left_semi"), "joined")
    start = F.struct("id", "th", "first", "last")
    firsts = joined.groupBy("anchor", "c1", "c2").agg(F.min(start).alias("a"), F.max(start).alias("b")).filter("a <> b").select("anchor", "c1", "c2", "a")
    matched = joined.join(write_table(firsts, "firsts"), ["anchor", "c1", "c2"])
    same = (F.col("id") == F.col("a.id")) & (F.col("th") == F.col("a.th"))
    later = matched.filter((~same & (F.struct("id", "th") > F.struct("a.id", "a.th"))) | (same & (F.col("first") > F.col("a.last"))))
    later = later.groupBy("id", "th", "first").agg(F.max("last").alias("last"))
    so_far = Window.partitionBy("id", "th").orderBy("first")
    ends = F.max("last").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.withColumn("new", F.coalesce((F.col("first") > ends + 1).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(so_far)).groupBy("id", "th", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    runs = runs.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("r"))
    return write_table(runs.select("id", "th", F.col("r.first").alias("starts"), F.col("r.last").alias("ends")), "runs")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` without its later repeated runs: text replaced, and the counts of lines before and of those removed added.

    Columns with the names of the counts are replaced.  ``docs`` is read twice.
    """
    runs = repeated_runs(docs, min_words)
    key, other = "id", "th"
    while key in docs.columns or other in docs.columns:
        key, other = key + "_", other + "_"
    runs = runs.select(F.col("id").alias(key), F.col("th").alias(other), F.struct("starts", "ends").alias(f"{key}{other}"))
    runs_name = f"{key}{other}"
    text = F.col("text").cast("string")
    rows = docs.drop(*counts).withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(other, F.xxhash64(text))
    rows = rows.join(runs.hint("merge"), [key, other], "left")  # runs grow with the input, so at no size by broadcast
    lines, starts, ends = F.split(text, "\n"), F.col(f"{runs_name}.starts"), F.col(f"{runs_name}.ends")

    def kept(k):
        begin = F.coalesce(F.get(ends, k - 1), F.lit(-1)) + 1
        end = F.coalesce(F.get(starts, k), F.size(lines))
        return F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0)))

    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), kept)), "\n")
    removed = F.aggregate(F.zip_with(starts, ends, lambda a, b: b - a + 1), F.lit(0), lambda x, y: x + y)
    some = F.col(runs_name).isNotNull()
    rows = rows.withColumn(counts[0], F.when(text.isNull() | (text == ""), 0).otherwise(F.size(lines)).cast("long"))
    rows = rows.withColumn(counts[1], F.when(some, removed).otherwise(0).cast("long"))
    rows = rows.withColumn("text", F.when(some, left).otherwise(text))
    return rows.select(*[c for c in docs.columns if c not in counts], *counts)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars (code points left) and text_md5 of the text left."""
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


#: Deletes what lies in a window whose lines are those of an earlier one, compared as text.
ORACLE = r"""
WITH split_lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos,
         unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text <> ''
), trimmed AS (
  SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM split_lines
), counted AS (
  SELECT doc_id, pos, t, len(regexp_split_to_array(t, '[ \t\x0B\f\r]+')) AS words FROM trimmed WHERE t <> ''
), placed AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) - words AS before, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM counted
), spans AS (
  SELECT doc_id, pos AS first, max(pos) OVER w AS last, sum(words) OVER w AS total, list(t) OVER w AS content
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER w AS first, pos AS last, sum(words) OVER w AS total, list(t) OVER w AS content
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), full_spans AS (
  SELECT DISTINCT doc_id, first, last, array_to_string(content, chr(10)) AS body FROM spans WHERE total >= 50
), ranked AS (
  SELECT *, first_value(doc_id) OVER g AS doc_a, first_value(last) OVER g AS last_a
  FROM full_spans WINDOW g AS (PARTITION BY body ORDER BY doc_id, first)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM ranked
  WHERE doc_id > doc_a OR first > last_a
), lefts AS (
  SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.pos) FILTER (WHERE g.pos IS NULL) AS body,
         count(*) AS n_lines, count(g.pos) AS n_removed
  FROM split_lines s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.pos = g.pos GROUP BY s.doc_id
)
SELECT d.doc_id, CAST(coalesce(l.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(l.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(length(CASE WHEN l.doc_id IS NULL THEN d.text ELSE coalesce(l.body, '') END) AS BIGINT) AS n_chars,
       md5(CASE WHEN l.doc_id IS NULL THEN d.text ELSE coalesce(l.body, '') END) AS text_md5
FROM documents d LEFT JOIN lefts l ON d.doc_id = l.doc_id
"""
