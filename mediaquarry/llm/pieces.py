"""Token counts at every prefix, and SentencePiece encoding and decoding by prefix tables.

A BPE encoding is unique and its prefixes are encodings of prefixes, so each
prefix of a text has one last token.  An automaton over the vocabulary gives
the tokens that end at a position; the right one is that which is compatible
with the last token of the prefix before it, where a pair is compatible if the
merges turn its text into just these two tokens.  The table of last tokens
gives the count at every prefix by one addition a position, and the ids are
read off it backwards.

No piece spans certain pairs of characters (a letter and the space after it).
Texts are cut there, and the tables of the words that come about are kept in a
cache of bounded size; a word that isn't in it is worked out anew.

Defined results: a null text is the empty text, with no tokens; a null doc_id
stays null; repeated rows give repeated results; an empty table gives an empty
one; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import ready, sliced

SPACE = "▁"
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6
#: Words of which a worker keeps the tables, and the longest of them.
CACHED, CACHED_CHARS = 500_000, 48


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The numbered fields of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        else:
            size = {5: 4, 1: 8}[kind]
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class PieceModel:
    """A SentencePiece BPE model with the identity normalizer and byte fallback."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for number, value in _fields(model):
            if number == 1:
                own = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                self.pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0])
                self.kinds.append(own[3])
            elif number == 2:
                trainer = dict(_fields(value))
                if trainer.get(3) != 2 or not trainer.get(35):
                    raise ValueError("not a BPE model with byte fallback")
            elif number == 3:
                rule = dict(_fields(value))
                if rule.get(2) or not rule.get(3, 1) or rule.get(4, 1) or not rule.get(5, 1):
                    raise ValueError("only identity normalization with a dummy prefix is supported")
        if {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("user-defined or unused pieces are not supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.cut = self._cuts()

    def _cuts(self) -> re.Pattern:
        """Matches a word: between two matches no piece can lie.

        A word is spaces, then signs, then letters (and what no piece holds),
        and ends before the next space, and before a sign that no piece has
        after a letter.  After the others (``glue``) it goes on to the next
        space.  A ``lone`` character is in no piece with another.
        """
        inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(a != SPACE and b == SPACE for a, b in inside):
            raise ValueError("a piece holds a space after another character")
        known = {c for pair in inside for c in pair}
        signs = {c for c in {*map(chr, range(128)), *known} - {SPACE} if not c.isalpha()}
        glue = {b for a, b in inside if b in signs and a not in signs and a != SPACE}
        lone, glue, signs = ("".join(map(re.escape, sorted(x))) for x in (signs - known, glue, signs & known))
        after = f"(?:[{glue}][^{SPACE}{lone}]*)?" if glue else ""
        return re.compile(f"[{lone}]|{SPACE}*[{signs}]*[^{SPACE}{signs}{lone}]*{after}")

    def merged(self, text: str) -> list[str]:
        """The merges as defined: the best-scored adjacent pair, leftmost first; for short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` can follow ``before``; an id under 0 is the start or a character without a piece."""
        if before < 0:
            if (known := self.alone.get(token)) is None:
                known = self.alone[token] = len(self.merged(self.pieces[token])) == 1
            return known
        key = before << 32 | token
        if (known := self.compatible.get(key)) is None:
            a, b = self.pieces[before], self.pieces[token]
            known = self.merged(a + b) == [a, b]
            if len(self.compatible) < 1 << 20:
                self.compatible[key] = known
        return known

    def table(self, word: str) -> tuple[list[int], list[int]]:
        """For each prefix, the last token (-1: start, under -1: a character in bytes) and the count."""
        last, count = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        done = 0
        fits = self.fits
        for end, (token, size) in self.automaton.iter(word):
            end += 1
            while done < end - 1:  # characters without a piece
                done += 1
                last[done], count[done] = -2, count[done - 1] + len(word[done - 1].encode())
            if done < end and fits(last[end - size], token):
                last[end], count[end] = token, count[end - size] + 1
                done = end
        while done < len(word):
            done += 1
            last[done], count[done] = -2, count[done - 1] + len(word[done - 1].encode())
        return last, count

    def word_ids(self, word: str) -> list[int]:
        last, _ = self.table(word)
        out, at = [], len(word)
        while at:
            token = last[at]
            if token >= 0:
                out.append(token)
                at -= len(self.pieces[token])
            else:
                at -= 1
                out += [self.byte_ids[b] for b in reversed(word[at].encode())]
        return out[::-1]

    def words(self, text: str) -> list[str]:
        """The pieces of work for the whole of ``text``; some may be empty."""
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in self.word_ids(w)]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that aren't UTF-8 become U+FFFD, one each."""
        out, held = [], bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.kinds[i] == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i >= 0:
                kind = self.kinds[i]
                piece = self.pieces[i] if kind == NORMAL else " ⁇ " if kind == UNKNOWN else ""
                first = not out and piece.startswith(SPACE)
                out.append(piece[first:].replace(SPACE, " "))
        return "".join(out)


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        return data[: e.start].decode() + "�" + _utf8(data[e.start + 1 :])


class PrefixCounts:
    """Exact token counts of every prefix of a text, by prefix length in code points."""

    def __init__(self, model: PieceModel, text: str) -> None:
        self.counts = [0]
        lead = len(SPACE)
        for word in model.words(text):
            before = self.counts[-1]
            self.counts += [before + c for c in model.table(word)[1][1:]]
        self.counts = self.counts[:1] + self.counts[1 + lead :] if text else self.counts

    def total(self) -> int:
        return self.counts[-1]

    def longest_within(self, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens."""
        return next(i for i in range(len(self.counts) - 1, -1, -1) if self.counts[i] <= budget)


class _Counts(dict):
    """Tokens of a word; of a kept one, without working it out again."""

    def __init__(self, model: PieceModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> int:
        n = self.model.table(word)[1][-1]
        if len(self) < CACHED and len(word) <= CACHED_CHARS:
            self[word] = n
        return n


class _Ids(dict):
    """Ids of a word: their number, their decimal form and the decoded text."""

    def __init__(self, model: PieceModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> tuple[int, str, str]:
        ids = self.model.word_ids(word)
        pad = [self.model.byte_ids[0x30]]  # so that a space at the front stays
        found = len(ids), ",".join(map(str, ids)), self.model.decode(pad + ids)[1:] if ids else ""
        if len(self) < CACHED and len(word) <= CACHED_CHARS:
            self[word] = found
        return found


_LOADED: dict[bytes, PieceModel] = {}
_KEPT: dict[tuple[type, bytes], dict] = {}


def load(model: bytes) -> PieceModel:
    """The model of these bytes, made once in a process."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = PieceModel(model)
    return _LOADED[key]


def _kept(kind: type, model: bytes) -> dict:
    key = kind, hashlib.sha256(model).digest()
    if key not in _KEPT:
        _KEPT[key] = kind(load(model))
    return _KEPT[key]


def count_text(cache: _Counts, text: str, budget: int) -> tuple[int, int]:
    """Tokens of ``text``, and code points of its longest prefix within ``budget`` tokens."""
    words = cache.model.words(text)
    sizes = list(map(cache.__getitem__, words))
    total = sum(sizes)
    if total <= budget:
        return total, len(text)
    chars = before = 0
    for word, after in zip(words, accumulate(sizes), strict=True):
        if after > budget:
            counts = cache.model.table(word)[1]
            return total, max(0, chars - 1 + next(i for i in range(len(word), -1, -1) if before + counts[i] <= budget))
        chars, before = chars + len(word), after
    raise AssertionError("a count above the budget has a word that passes it")


def token_counts(docs: DataFrame, model: bytes, budget: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and fit_chars, the code points of the longest prefix within ``budget`` tokens."""
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _kept(_Counts, sent.value)
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [count_text(cache, t, budget) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())], ["doc_id", "n_bytes", "n_tokens", "fit_chars"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, fit_chars long")


def round_trip(docs: DataFrame, model: bytes, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text, or without ``with_ids`` the SHA-256 of both."""
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _kept(_Ids, sent.value)
        for batch in sliced(batches):
            counts, ids, texts = [], [], []
            for text in batch.column(1).to_pylist():
                found = [x for x in map(cache.__getitem__, cache.model.words(text or "")) if x[0]]
                counts.append(sum([n for n, _, _ in found]))
                joined, decoded = ",".join([i for _, i, _ in found]), "".join([d for _, _, d in found])
                decoded = decoded[decoded[:1] == " " :]
                ids.append(joined if with_ids else hashlib.sha256(joined.encode()).hexdigest())
                texts.append(decoded if with_ids else hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names)

    names = ["doc_id", "n_tokens", *(("ids", "decoded") if with_ids else ("ids_sha256", "decoded_sha256"))]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, n_tokens long, {names[2]} string, {names[3]} string")


def _model(path: str | None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op1_token_counts(spark, sf_dir: str, model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """The contract of operator 1 over the whole of ``documents``."""
    found = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), _model(model_path), limit)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


def op6_sentencepiece(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """The contract of operator 6 over the whole of ``documents``."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), _model(model_path))
