"""Byte ranges of stored files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a piece of a streamed range.
PIECE = 2 * 1024 * 1024
#: Positions from here on count as this one: far beyond any file, and sums of two stay within 64 bits.
FARTHEST = 1 << 62
_RANGE = r"bytes=(\d+)-(\d*)"


def _position(digits: Column) -> Column:
    """The number, null where there is none; one without a 64-bit value is the farthest."""
    far = F.lit(FARTHEST).cast("long")
    return F.when(digits != "", F.least(F.coalesce(digits.try_cast("long"), far), far))


def range_bounds(header: Column, size: Column) -> tuple[Column, Column]:
    """First and last byte asked for; the whole file where the header can't be read. Not clamped to the size."""
    first = F.coalesce(_position(F.regexp_extract(header, _RANGE, 1)), F.lit(0).cast("long"))
    last = F.coalesce(_position(F.regexp_extract(header, _RANGE, 2)), size.cast("long") - 1)
    return first, last


def sent(first: Column, last: Column, size: Column) -> Column:
    """How many bytes of a range the file has: none for a range that begins behind its end."""
    return F.greatest(F.least(last + 1, size.cast("long")) - first, F.lit(0).cast("long"))


def byte_slice(content: Column, first: Column, last: Column) -> Column:
    """The bytes from ``first`` to ``last``; what lies beyond the file isn't there."""
    size = F.octet_length(content).cast("long")
    return F.substring(content, (F.least(first, size) + 1).cast("int"), sent(first, last, size).cast("int"))


def content_range(first: Column, last: Column, size: Column) -> Column:
    return F.concat(F.lit("bytes "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("/"), size.cast("string"))


def piece_count(length: Column, piece: int = PIECE) -> Column:
    """How many pieces a range of ``length`` bytes has."""
    return F.when(length > 0, F.call_function("div", length - 1, F.lit(piece).cast("long")) + 1).otherwise(F.lit(0).cast("long"))


def piece_offsets(length: Column, piece: int = PIECE) -> Column:
    """Where the pieces of ``length`` bytes that are sent begin."""
    return F.when(length > 0, F.transform(F.sequence(F.lit(0).cast("long"), piece_count(length, piece) - 1), lambda i: i * piece)).otherwise(F.array().cast("array<bigint>"))
