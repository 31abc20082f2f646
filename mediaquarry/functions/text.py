"""Column functions over captions, paths and other short texts.

Patterns are Java's with ``(?Ud)``: white space and digits of all scripts, and
only a line feed ends a line.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels of a structured caption.
CATEGORY_LABEL = "\U0001f4c1 Category:"
CREATOR_LABEL = "\U0001f464 Creator:"
LIKES_LABEL = "❤️ Likes:"
CAPTION_LABEL = "\U0001f4dd Caption:"
LINK_LABEL = "\U0001f517 Link:"
UNKNOWN = "Unknown"

#: First code points of the blocks of ten decimal digits that a like count may use.
DIGIT_BLOCKS = tuple(cp for cp in range(0x80, 0x10000) if unicodedata.decimal(chr(cp), None) == 0)


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, r"(?Ud)^\s+|\s+\z", "")


def captured_or(x: Column, pattern: str, default: str) -> Column:
    """The first group of the first match, stripped, or ``default`` where nothing matches."""
    return F.when(x.rlike(pattern), strip(F.regexp_extract(x, pattern, 1))).otherwise(default)


def labelled(x: Column, label: str) -> Column:
    """What follows ``label``, to the end of its line; white space in between may hold line feeds."""
    return captured_or(x, rf"(?Ud){label}\s*(.+)", UNKNOWN)


def _digits(x: Column) -> Column:
    source = "".join(chr(b + i) for b in DIGIT_BLOCKS for i in range(10))
    return F.translate(x, source, "0123456789" * len(DIGIT_BLOCKS))


def like_count(x: Column) -> Column:
    """The number after the label of likes, 0 without one, null if it has no digit or passes 64 bits."""
    pattern = rf"(?Ud){LIKES_LABEL}\s*([\d,]+)"
    found = F.regexp_replace(_digits(F.regexp_extract(x, pattern, 1)), ",", "")
    return F.when(x.rlike(pattern), found.try_cast("long")).otherwise(F.lit(0).cast("long"))


def caption_body(x: Column) -> Column:
    """The lines after the caption label, up to the link label or the end."""
    return strip(F.regexp_extract(x, rf"(?sUd){CAPTION_LABEL}\n(.*?)(?=\n{LINK_LABEL}|\n?\z)", 1))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def base_name(path: Column) -> Column:
    """What follows the last slash; empty for null."""
    return F.coalesce(F.substring_index(path, "/", -1), F.lit(""))


def video_file(video_id: Column) -> Column:
    return F.concat(F.lit("video_"), video_id.cast("string"), F.lit(".mp4"))


def handle(name: Column) -> Column:
    return F.concat(F.lit("@"), name)


def teaser(caption: Column, size: int = 60) -> Column:
    """The first characters, always followed by dots."""
    return F.concat(F.substring(caption, 1, size), F.lit("..."))


def short(x: Column, size: int = 50) -> Column:
    return F.substring(x, 1, size)


def play_time(seconds: Column) -> Column:
    """Minutes and seconds as m:ss; 0:00 for what isn't a number."""
    shown = F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad(F.floor(seconds % 60).cast("string"), 2, "0"))
    return F.when(seconds.isNull() | F.isnan(seconds), "0:00").otherwise(shown)


def progress(at: Column, duration: Column) -> Column:
    """Percent played, with two decimals; null without a duration."""
    return F.when(duration > 0, F.format_string("%.2f", at / duration * 100))


def gibibytes(n: Column) -> Column:
    return F.round(n / F.lit(1024.0**3), 1)


def first_line(x: Column) -> Column:
    """The first line of a tool's output, in lower case."""
    return F.lower(F.substring_index(strip(x), "\n", 1))


def tunnel_url(line: Column) -> Column:
    """The first https address in a log line, or null."""
    return F.nullif(F.regexp_extract(line, r"(https://[A-Za-z0-9.-]+)", 1), F.lit(""))


def clock_prefix(line: Column, at: Column) -> Column:
    """A log line behind its wall-clock time."""
    return F.concat(F.lit("["), F.date_format(at, "HH:mm:ss"), F.lit("] "), line)


def _single_marks() -> tuple[str, str]:
    """Latin letters with one mark, and their base letters."""
    pairs = []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() and unicodedata.combining(parts[1]):
            pairs.append((chr(cp), parts[0].lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BASE = _single_marks()


def folded(x: Column) -> Column:
    """Lower case, without the mark of letters that have one."""
    plain = F.octet_length(x) == F.char_length(x)
    return F.when(plain, F.lower(x)).otherwise(F.regexp_replace(F.translate(F.lower(x), _MARKED, _BASE), "[̀-ͯ]", ""))


def search_tokens(x: Column) -> Column:
    """The folded runs of letters, digits and private characters."""
    return F.regexp_extract_all(folded(x), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def may_fold_to(x: Column, token: str) -> Column:
    """Whether the folded text has the letters of ``token`` anywhere, by a pattern over the text as it is; plain ASCII has them as they are."""
    marked = {c: "".join(a for a, b in zip(_MARKED, _BASE, strict=True) if b == c) for c in token}
    pattern = "[̀-ͯ]*".join(f"[{c}{marked[c]}]" for c in token)
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x).contains(token)).otherwise(F.lower(x).rlike(pattern))


def fold_text(x: str) -> list[str]:
    """:func:`search_tokens` of one text."""
    plain = x.lower().translate(dict(zip(map(ord, _MARKED), _BASE, strict=True)))
    out, run = [], []
    for c in [*(c for c in plain if not "̀" <= c <= "ͯ"), " "]:
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return out
