"""Fill-in-middle: texts cut in prefix, middle and suffix, and put in another order.

A token is a stretch of ASCII letters or any other single code point.  The kernel
takes all rows of an Arrow batch at once, on their UTF-8 buffer, in blocks of
``BLOCK`` bytes: a table gives the class of each byte, adjacent bytes whether a
token begins there, and cumulative sums, less those at the begin of a row, the
tokens before a byte.  ``searchsorted`` on the sums finds the cuts of all rows
together.  Only bytes are compared, no text becomes a Python string, and besides
the batch and its output memory is bounded by the block.

The cuts follow from a hash of the row's id, so a row is cut alike wherever and
whenever it is read.

Defined results: a null text counts as empty; an empty text, or one that holds a
marker, stays plain; a null id is hashed as an empty one; rows with the same id
and text get the same result; a very long text is cut block by block; an empty
table gives an empty one; other columns stay as they are, but those with the
name of a result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import ready

BLOCK = 1 << 21
PLAIN, PSM, SPM = "plain", "psm", "spm"
_FORMS = np.array([PLAIN, PSM, SPM])
_P, _S, _M = b"<P>", b"<S>", b"<M>"
#: Of a byte: 0 inside of a code point, 1 begin of one, 2 letter.
_KIND = np.ones(256, np.uint8)
_KIND[0x80:0xC0] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 2
RESULTS = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


class Tokens:
    """Token begins of all texts of a buffer; text r lies in bytes ``offsets[r]`` to ``offsets[r + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self.first = offsets[:-1][np.diff(offsets) > 0]
        before = self._sums(self.offsets, letters=True)
        self.base, self.n = before[:-1], np.diff(before)

    def _blocks(self, letters: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(byte, sums): how many tokens, or code points, begin in a block from that byte to each of its bytes."""
        low, high = (int(self.offsets[0]), int(self.offsets[-1])) if len(self.offsets) else (0, 0)
        for at in range(low, high, BLOCK):
            kind = _KIND[self.data[at : min(at + BLOCK, high)]]
            begins = kind > 0
            if letters:
                same = kind == 2
                begins[1:] &= ~(same[1:] & same[:-1])
                if at > low and same[0] and _KIND[self.data[at - 1]] == 2:
                    begins[0] = False
                a, z = np.searchsorted(self.first, (at, at + len(kind)))
                begins[self.first[a:z] - at] = True
            yield at, np.cumsum(begins, dtype=np.int32)

    def _sums(self, places: np.ndarray, letters: bool) -> np.ndarray:
        """What begins before each of the bytes ``places``, which ascend."""
        out, total, done = np.zeros(len(places), np.int64), 0, 0
        for at, sums in self._blocks(letters):
            to = int(np.searchsorted(places, at + len(sums), "right"))
            here = places[done:to] - at
            out[done:to] = total + np.where(here > 0, sums[here - 1], 0)
            total, done = total + int(sums[-1]), to
        return out

    def cuts(self, number: np.ndarray) -> np.ndarray:
        """The byte at which token ``number`` of each row's text begins; the end of the text beyond its last.  Columns ascend."""
        wanted = (self.base[:, None] + number).ravel() + 1
        ends = (number >= self.n[:, None]).ravel()
        out = np.repeat(self.offsets[1:], number.shape[1])
        where = np.flatnonzero(~ends)
        wanted, done, total = wanted[where], 0, 0
        for at, sums in self._blocks(letters=True):
            to = int(np.searchsorted(wanted, total + int(sums[-1]), "right"))
            out[where[done:to]] = at + np.searchsorted(sums, wanted[done:to] - total)
            total, done = total + int(sums[-1]), to
        return out.reshape(number.shape)

    def chars(self, places: np.ndarray) -> np.ndarray:
        """Code points between the columns of ``places``, bytes that ascend by row and column."""
        return np.diff(self._sums(places.ravel(), letters=False).reshape(places.shape), axis=1)

    def marked(self) -> np.ndarray:
        """Whether each text holds a marker."""
        found, high = np.zeros(len(self.n), bool), int(self.offsets[-1]) if len(self.offsets) else 0
        for at in range(0, high, BLOCK):
            data = self.data[at : min(at + BLOCK + 2, high)]
            i = np.flatnonzero(data[:-2] == ord("<")) if len(data) > 2 else np.zeros(0, np.int64)
            i = at + i[(data[i + 2] == ord(">")) & np.isin(data[i + 1], list(b"PSM"))]
            row = np.searchsorted(self.offsets, i, "right") - 1
            found[row[self.offsets[row + 1] >= i + 3]] = True
        return found


def draws(ids: list[int | None], seed: int) -> np.ndarray:
    """Four numbers of 32 bits for each id, from a hash of the seed and the id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").astype(np.int64).reshape(-1, 4)


def transformed(texts: pa.Array, ids: list[int | None], seed: int, whole: int, swapped: int) -> dict[str, pa.Array]:
    """The results for all rows of a batch."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    rows = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, rows + 1, texts.offset * 8) if rows else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    tokens, h = Tokens(data, offsets), draws(ids, seed)
    at = tokens.cuts(np.sort(h[:, :2] % (tokens.n[:, None] + 1), axis=1))
    plain = (tokens.n == 0) | tokens.marked() | (h[:, 2] % 100 >= whole)
    form = np.where(plain, 0, np.where(h[:, 3] % 100 < swapped, 2, 1))
    chars = tokens.chars(np.c_[offsets[:-1], at])
    view, pieces = memoryview(data), []
    for kind, a, b, c, z in zip(form.tolist(), offsets[:-1].tolist(), at[:, 0].tolist(), at[:, 1].tolist(), offsets[1:].tolist(), strict=True):
        pieces += (view[a:z],) if kind == 0 else (_P, view[a:b], _S, view[c:z], _M, view[b:c]) if kind == 1 else (_S, view[c:z], _P, view[a:b], _M, view[b:c])
    ends = np.r_[0, np.cumsum(np.diff(offsets) + 9 * (form > 0))]
    output = pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(pieces))])
    return {
        "n": pa.array(tokens.n), "form": pa.array(_FORMS[form]), "prefix_chars": pa.array(chars[:, 0], mask=plain), "middle_chars": pa.array(chars[:, 1], mask=plain), "output": output.cast(pa.string()),
    }


def fill_in_middle(docs: DataFrame, seed: int = 1, whole: int = 90, swapped: int = 20) -> DataFrame:
    """``docs`` with n (tokens), form, prefix_chars, middle_chars (code points, null if plain) and output, the text in its new order.

    Of 100 rows ``100 - whole`` stay plain, and of 100 others ``swapped`` have
    their suffix first (spm), the others their prefix (psm).
    """
    ready(docs.sparkSession)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    kept = [c for c in docs.columns if c not in RESULTS]
    fields = [docs.schema[c] for c in kept]
    columns, key, text = docs.select(*kept), kept.index("doc_id"), kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = transformed(batch.column(text), batch.column(key).to_pylist(), seed, whole, swapped)
            yield pa.RecordBatch.from_arrays([*batch.columns, *found.values()], [*kept, *found])

    return columns.mapInArrow(run, T.StructType([*fields, *(T.StructField(k, t) for k, t in RESULTS.items())]))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of; pieces hold no marker, so each marker is found where it was put."""
    part = F.split(output, "<[PSM]>", -1)
    psm = F.concat(part[1], part[3], part[2])
    return F.when(form == PSM, psm).when(form == SPM, F.concat(part[2], part[3], part[1])).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """The contract of operator 11 over the whole of ``documents``."""
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, tokens, len(tokens) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(tokens) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(tokens) + 1) AS y,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS kept, CAST('0x' || h[25:32] AS BIGINT) % 100 AS swapped FROM cut
), parts AS (
  SELECT *, array_to_string(tokens[1:least(x, y)], '') AS p, array_to_string(tokens[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(tokens[greatest(x, y) + 1:], '') AS s,
         CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR kept >= 90 THEN 'plain' WHEN swapped < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN regexp_replace(output, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', '\1\3\2')
       ELSE regexp_replace(output, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', '\2\3\1') END) AS restored_sha256 FROM made
"""
