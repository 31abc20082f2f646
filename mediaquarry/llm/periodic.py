"""Runs of words that repeat with a period, by the longest previous factors of a text.

A run is a stretch of words of smallest period q, of q times ``TIMES`` words or
more and of ``LEAST`` at the fewest, that no neighbouring word extends.  All
texts of a slice are worked on together, as arrays of word numbers that differ
from text to text, so no comparison leaves its text:

1. Suffix array by doubling: ranks of stretches of 1, 2, 4... words, of which
   only stretches that still have an equal are sorted anew.  The ranks are kept,
   and tell the common extension of any two places, to the right and to the
   left, in a step for each level.
2. LCP and longest previous factor: of all suffixes with a smaller place, the
   nearest one on either side of the suffix array has the longest common prefix;
   these neighbours are found for all suffixes at once, by following pointers.
3. Blocks: a text is cut at each place in blocks of the longest previous factor
   (or one new word).
4. A run touches the begin of a block, or lies inside of one.  Of those that
   touch one, some touch the begin x of the block that holds their end, and then
   the part after x is no longer than this block, the part before it shorter
   than the block before plus a period (else that block would be longer).  So
   with TIMES = t, t - 1 periods are fewer words than both blocks, and extending
   each such period to both sides of x finds them all.
5. A run strictly inside of a block is a copy of one inside of its earlier
   occurrence.  Runs are kept by their begins, so a block takes those of its
   source in order, its own copies among them where the two overlap.

Longest factors of fewer than LEAST - 1 words in the case of one word, of
(TIMES - 1) periods otherwise, can't belong to a run, so texts that have no
longer ones have none.

Defined results: a null or empty text has no words and no runs; rows are worked
on one by one, so repeated rows get the same result and nothing hangs on ids; an
empty table gives an empty one; other columns stay, but those with the name of a
result are replaced.  A text is worked on whole, by one task: in the worst case,
a long text that is periodic as a whole, it takes four bytes a word for each
doubling of its length, besides some 100 bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import ready, sliced

LEAST, TIMES = 6, 4
#: Words of a slice, unless a single text has more.
SLICE = 1 << 17
Run = tuple[int, int, int]
Words = list[bytes]


class Suffixes:
    """Ranks of the stretches of 2**level words of all texts, and the suffix array."""

    def __init__(self, words: np.ndarray, ends: np.ndarray) -> None:
        """``words``: word numbers that differ between texts; ``ends``: of each word, where its text ends."""
        n = len(words)
        order = np.argsort(words, kind="stable")
        rank, again = self._ranked(order, words[order], np.zeros(n, np.int64))
        full = np.empty(n, np.int32)
        full[order] = rank
        #: Of each level: a rank for every place, and the places whose stretch has an equal, in order.
        self.levels, active, size = [(full, np.sort(order[again]))], order[again], 1
        while len(active):
            # a text's end comes before any word
            follows = active + size
            key = full[active].astype(np.int64) * (n + 1)
            inside = np.flatnonzero(follows < ends[active])
            key[inside] += full[follows[inside]].astype(np.int64) + 1
            by = np.argsort(key, kind="stable")
            active, key = active[by], key[by]
            old = full[active].astype(np.int64)
            rank, again = self._ranked(active, key, old)
            full = full.copy()
            full[active] = rank
            active, size = active[again], size * 2
            self.levels.append((full, np.sort(active)))
        self.array = np.empty(n, np.int64)
        self.array[full] = np.arange(n)

    @staticmethod
    def _ranked(order: np.ndarray, key: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks in the order of ``key``, a group of equals by its first slot; and which have an equal."""
        n = len(order)
        slot = np.arange(n)
        new_group = np.r_[True, old[1:] != old[:-1]] if n else np.zeros(0, bool)
        slot = old + slot - np.maximum.accumulate(np.where(new_group, slot, 0))
        new_key = np.r_[True, key[1:] != key[:-1]] if n else np.zeros(0, bool)
        rank = slot[np.maximum.accumulate(np.where(new_key, np.arange(n), 0))]
        return rank, ~(new_key & np.r_[new_key[1:], True]) if n else new_key

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from places ``a`` and ``b`` (less than the number of words) on are equal."""
        out = np.zeros(len(a), np.int64)
        rows = np.arange(len(a))
        n = len(self.array)
        tops = self._tops()
        for level in range(len(self.levels) - 1, -1, -1):
            full = self.levels[level][0]
            at = rows[tops[a] >= level]
            x, y = a[at] + out[at], b[at] + out[at]
            fits = np.flatnonzero((x < n) & (y < n))
            at, x, y = at[fits], x[fits], y[fits]
            out[at[full[x] == full[y]]] += 1 << level
        return out

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words up to and with places ``a`` and ``b`` are equal; a place may be -1."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            full, size = self.levels[level][0], 1 << level
            x, y = a - out - size + 1, b - out - size + 1
            at = np.flatnonzero((x >= 0) & (y >= 0))
            out[at[full[x[at]] == full[y[at]]]] += size
        return out

    def _tops(self) -> np.ndarray:
        """The highest level at which each place has an equal, -1 for none."""
        if not hasattr(self, "_top"):
            self._top = np.full(len(self.array), -1, np.int8)
            for level, (_, active) in enumerate(self.levels):
                self._top[active] = level
        return self._top

    def previous(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each place, the length of the longest stretch from it on that begins earlier too, and where; 0 and -1 for none."""
        n = len(self.array)
        active = self._tops() >= 0
        sa = self.array[active[self.array]]  # the others have no equal word
        length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for way in (-1, 1):
            # sentinels -1 and len(sa) count as smaller than all
            value = np.r_[-1, sa, -1]
            to = np.arange(1, len(sa) + 1) + way
            open_ = np.arange(len(sa))
            while len(open_):
                open_ = open_[value[to[open_]] > sa[open_]]
                to[open_] = to[to[open_] - 1]
            found = value[to]
            at = np.flatnonzero(found >= 0)
            common = self.right(sa[at], found[at])
            better = common > length[sa[at]]
            length[sa[at[better]]] = common[better]
            source[sa[at[better]]] = found[at[better]]
        return length, source


def _blocks(length: np.ndarray, begin: int, end: int) -> list[int]:
    """The begins of the blocks of a text, and its end."""
    steps, at, out = np.maximum(length[begin:end], 1).tolist(), 0, []
    while at < end - begin:
        out.append(begin + at)
        at += steps[at]
    return [*out, end]


def _touching(suffixes: Suffixes, blocks: np.ndarray, begins: np.ndarray, least: int, times: int) -> np.ndarray:
    """(begin, end, period) of all runs that touch the begin of a block of one of the texts, or its end, as rows.

    ``blocks`` are block begins and text ends in order, ``begins`` the begin of
    each one's text.
    """
    same = begins[1:] == begins[:-1]
    before = np.where(np.r_[False, same], np.diff(blocks, prepend=0), 0)
    after = np.where(np.r_[same, False], np.diff(blocks, append=0), 0)
    ends = _text_ends(blocks, same)
    most = (before + after) // (times - 1)
    x = np.repeat(blocks, most)
    low, high = np.repeat(begins, most), np.repeat(ends, most)
    p = np.arange(len(x)) - np.repeat(np.cumsum(most) - most, most) + 1
    full = suffixes.levels[0][0]
    n = len(full)
    found = []
    for a, b in ((x, x + p), (x - p, x)):  # a period to the right of x, and one to the left
        ok = (a >= low) & (b <= high)
        word = lambda i: full[np.clip(i, 0, n - 1)]
        ok &= ((b < high) & (word(a) == word(b))) | ((a > low) & (word(a - 1) == word(b - 1)))
        at = np.flatnonzero(ok)
        a, b, q = a[at], b[at], p[at]
        right, inner = np.zeros(len(at), np.int64), np.flatnonzero(b < n)
        right[inner] = suffixes.right(a[inner], b[inner])
        left = suffixes.left(a - 1, b - 1)
        found.append(np.c_[a - left, b + right, q])
    runs = np.concatenate(found)
    size = runs[:, 1] - runs[:, 0]
    runs = runs[size >= np.maximum(least, times * runs[:, 2])]
    runs = runs[np.lexsort(runs.T[[2, 1, 0]])]
    # of equal stretches the smallest period is first, and theirs is a multiple of it
    return runs[np.r_[True, (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)]] if len(runs) else runs


def _text_ends(blocks: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of each block begin, the end of its text: the last of its group."""
    last = np.flatnonzero(np.r_[~same, True])
    return np.repeat(blocks[last], np.diff(np.r_[-1, last]))


def _copied(runs: list[Run], blocks: list[int], source: np.ndarray) -> list[Run]:
    """``runs`` of a text, in order, with those inside of blocks, in order too.

    A run that touches a block's begin is there already; a copy has both
    neighbours in its block, so it ends where the earlier one does.
    """
    kept = sorted(runs)
    shortest = min(e - s for s, e, _ in kept)
    for x, y in zip(blocks, blocks[1:], strict=False):
        if y - x < shortest + 2:
            continue
        back = x - int(source[x])
        k = bisect_right(kept, (x - back, y, 0))
        while k < len(kept) and kept[k][0] + back < y:
            s, e, q = kept[k]
            if s + back > x and e + back < y:
                insort(kept, (s + back, e + back, q))
            k += 1
    return kept


def runs_of(texts: list[Words], least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """(begin, end, period) of all runs of each text, by begin and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(sizes)
    numbers: dict[bytes, int] = {}
    flat = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], np.int64)
    out: list[list[Run]] = [[] for _ in texts]
    if not len(flat):
        return out
    suffixes = Suffixes(flat + np.repeat(np.arange(len(texts)) * len(numbers), sizes), np.repeat(stops, sizes))
    length, source = suffixes.previous()
    enough = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    longest = np.maximum.reduceat(np.r_[length, 0], np.minimum(stops - sizes, len(length)))
    chosen = np.flatnonzero((sizes > 0) & (longest >= enough)).tolist()
    if not chosen:
        return out
    blocks = [_blocks(length, int(stops[i] - sizes[i]), int(stops[i])) for i in chosen]
    begins = np.repeat([b[0] for b in blocks], [len(b) for b in blocks])
    found = _touching(suffixes, np.concatenate([np.array(b) for b in blocks]), begins, least, times)
    row = np.searchsorted(stops, found[:, 0], "right").tolist()
    by_text: dict[int, list[Run]] = {}
    for i, run in zip(row, map(tuple, found.tolist()), strict=True):
        by_text.setdefault(i, []).append(run)
    for i, cut in zip(chosen, blocks, strict=True):
        if i in by_text:
            base = cut[0]
            out[i] = [(s - base, e - base, q) for s, e, q in _copied(by_text[i], cut, source)]
    return out


def collapsed(words: Words, runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    spans = np.array(runs)
    np.add.at(change, spans[:, 0] + spans[:, 2], 1)
    np.add.at(change, spans[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


RESULTS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))),
        T.StructField("collapsed", T.StringType()),
    ]
)
_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def _slices(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Rows (.., words) in lists of ``size`` words or so."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[-1])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, rewrite: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period) by start and period, and collapsed, the text without repeats.

    ``rewrite`` gives the words to work on, from doc_id and the words of the text.
    """
    ready(docs.sparkSession)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    kept = [c for c in docs.columns if c not in RESULTS.names]
    key, text = kept.index("doc_id"), kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = batch.column(key).to_pylist()
            rows = ((i, (t or "").encode().split()) for i, t in zip(ids, batch.column(text).to_pylist(), strict=True))
            words = ((w if rewrite is None else rewrite(i, w),) for i, w in rows)
            counts, found, left = [], [], []
            for part in _slices(words, SLICE):
                texts = [w for (w,) in part]
                for w, runs in zip(texts, runs_of(texts, least, times), strict=True):
                    counts.append(len(w))
                    found.append([{"start": s, "length": e - s, "period": q} for s, e, q in runs])
                    left.append(collapsed(w, runs).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(found, _RUNS), pa.array(left, pa.string())], [*kept, *RESULTS.names])

    return docs.select(*kept).mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *RESULTS.fields]))


def planted(doc_id: int | None, words: Words) -> Words:
    """The words of a text; in one of ten, chosen by a hash of its id, a stretch of them repeats to the end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The contract of operator 13 over the whole of ``documents``."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), rewrite=planted)
    # a run is a multiple of its period by more than another exactly if the cross products say so
    greater = lambda r, best: (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(greater(r, best), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.expr("best.length * 1000 div best.period")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def digest(runs: list[Run]) -> str:
    """The digest of runs (begin, end, period) as the query gives it."""
    return hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()).hexdigest()
