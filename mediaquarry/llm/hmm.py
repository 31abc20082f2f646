"""A hidden Markov language model, trained by Baum-Welch over all training documents.

Tokens are words (lower-cased in A-Z, parted by the white space of ASCII) and an
end for each document.  A state emits classes: each frequent word and the end
are classes of their own, other words share a class by the hash of their
ending.  A word is frequent from a count that grows with the square root of the
training tokens (:func:`frequent_from`), so that more words have a class of
their own the larger the input is, up to ``own_words``.  Within a class of n
tokens and v words of the training documents a word seen c times has
probability (c + 1) / (n + v + 1), so that unseen words have a share.  The
probability of a document is the sum over all state sequences, by the forward
recursion scaled at each step.

Documents become chunks of some hundred thousand tokens with their own
vocabulary.  Counts are added up by word, with partial sums in each task, so a
word found everywhere is no hot group; counts of words that are frequent go to
the chunks with the model, those of the others meet their documents by a join,
in which a word has fewer rows than a frequent one has tokens; what they add to
a document's scores are sums.  Every Baum-Welch round adds
expected counts over the training documents of all chunks, by class.  The start
comes from all of them too: one pass counts the pairs of neighbouring tokens by
``COARSE`` groups of classes (the most frequent words, other words by their
ending, the end), and ``FIRST_ROUNDS`` rounds fit transitions and emissions to
these counts, in which a group's classes share what it emits by their counts.
Only the counts of pairs and the model, whose sizes are bounded, come to the
driver.

The scores depend on the documents, not on how rows are stored, but for the
order in which doubles are added.

Defined results: a null or empty text is one token, the end; a null doc_id
belongs to the training documents; repeated rows are separate documents; an
empty table gives an empty result; without training documents all classes are
equally likely; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import LARGE_ROWS, ready, result, sliced, write_table
from .toxicity import held_out

#: The most words with a class of their own, the count that makes one, and training tokens from which that count grows.
OWN_WORDS, SEEN, SEEN_AT = 1 << 20, 16, 1 << 21
STATES, ENDINGS, ENDING = 8, 4_096, 3
#: Tokens of a chunk, and of the documents of it that are worked on at once.
CHUNK, GROUP = 400_000, 100_000
#: Tokens whose forward rows are held at once, and bytes of a text that are parted into words at once.
STRETCH, PIECE = 1 << 17, 1 << 20
#: Positions from one scaling of forward rows to the next; a probability of 1e-30 at each of them is far from underflow.
SCALED = 8
FIRST_ROUNDS, ROUNDS = 200, 2
#: Groups of classes whose pairs are counted for the first model, and tokens whose pairs are added at once.
COARSE, FIRST_TOKENS = 512, 400_000
#: Counts that the overall class distribution, and even transitions, weigh in the model.
EMISSION_PRIOR, TRANSITION_PRIOR = 500.0, 1.0

_WHITE = re.compile(rb"[\x20\x09-\x0d]")

CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, sizes binary, tokens binary, words binary, endings binary, counts binary, n_words long, n_train long"


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def pieces_of(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, of about ``PIECE`` bytes at a time; it is parted at white space."""
    at = 0
    while at < len(data):
        cut = _WHITE.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as runs of bytes, which compress better, after the number of runs: as many as the largest takes."""
    runs = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([runs]) + x.astype("<u4").view(np.uint8).reshape(-1, 4).T[:runs].tobytes()


def _numbers(data: bytes) -> np.ndarray:
    runs = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    whole = np.zeros((runs.shape[1], 4), np.uint8)
    whole[:, : data[0]] = runs.T
    return whole.view("<u4").ravel().astype(np.int64)


class _Local(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def chunk_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Chunks of rows (u, doc_id, held, text); a document is never split."""
    names = [f.split()[0] for f in CHUNKS.split(", ")]
    local, first, ids, held, parts, total = _Local(), None, [], [], [], 0

    def out() -> pa.RecordBatch:
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        sizes = np.array([len(p) for p in parts], np.int64)
        train = np.repeat(~np.array(held, bool), sizes)
        counts = np.bincount(tokens[train], minlength=len(local))
        endings = np.fromiter(map(ending_class, local), "<u2", len(local))
        n_train = int(train.sum()) + held.count(False)
        columns = [[first], [ids], [held], [_planes(sizes)], [_planes(tokens)], [b" ".join(local)], [endings.tobytes()], [_planes(counts)], [len(local)], [n_train]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 5, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for u, doc_id, apart, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = (text or "").encode().lower()
            pieces = [data.split()] if len(data) <= PIECE else None
            n = sum(map(len, pieces or pieces_of(data)))
            if ids and total + n > size:
                yield out()
                local, first, ids, held, parts, total = _Local(), None, [], [], [], 0
            first = u if first is None else first
            ids.append(doc_id)
            held.append(apart)
            numbers = [np.fromiter(map(local.__getitem__, words), np.int64, len(words)) for words in pieces or pieces_of(data)]
            parts.append(np.concatenate([*numbers, np.zeros(0, np.int64)]))
            total += n
    if ids:
        yield out()


def stored_chunks(rows: DataFrame) -> DataFrame:
    """The chunks of rows (u, doc_id, held, text) as a table.

    A chunk is a few MB in one row.  Parquet's and so Spark's buffers hold the
    rows of a row group at once; by default that is all chunks of a task.
    """
    return write_table(rows.mapInArrow(lambda b: chunk_rows(sliced(b), CHUNK), CHUNKS), "chunks", options=LARGE_ROWS)


def _words(blob: bytes) -> list[bytes]:
    return blob.split(b" ") if blob else []


def ending_class(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word[-ENDING:]) % ENDINGS


class Classes:
    """The class of a word: its place among the frequent ones, or by its ending."""

    def __init__(self, frequent: list[bytes]) -> None:
        self.number = {w: i for i, w in enumerate(frequent)}
        self.n = len(frequent)
        self.end = self.n + ENDINGS
        self.size = self.end + 1

    def coarse(self) -> np.ndarray:
        """The group of each class: the first words, in their order, are groups of their own, and so is the end, the last."""
        own = min(self.n, COARSE // 2)
        endings = np.r_[np.fromiter(map(ending_class, self.number), np.int64, self.n), np.arange(ENDINGS)]
        groups = np.append(own + endings % (COARSE - 1 - own), COARSE - 1)
        groups[:own] = np.arange(own)
        return groups

    def of(self, words: list[bytes], endings: np.ndarray | None = None) -> np.ndarray:
        """``endings``: the words' classes by ending, if they are known."""
        endings = np.fromiter(map(ending_class, words), np.int64, len(words)) if endings is None else endings
        known = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        return np.where(known < 0, self.n + endings.astype(np.int64), known)


class Chunk:
    """The documents of a chunk, longest first, with the end of each, by position."""

    def __init__(self, row: dict, classes: Classes) -> None:
        sizes = _numbers(row["sizes"])
        self.held = np.array(row["held"], bool)
        self.doc_ids = row["doc_ids"]
        self.words = _words(row["words"])
        self.word_class = classes.of(self.words, np.frombuffer(row["endings"], "<u2"))
        self.tokens = _numbers(row["tokens"])
        self.sizes, self.end = sizes, classes.end
        self.starts = np.r_[0, np.cumsum(sizes)[:-1]]

    def groups(self, docs: np.ndarray) -> list[np.ndarray]:
        """``docs``, longest first, in groups of about ``GROUP`` tokens."""
        if not len(docs):
            return []
        docs = docs[np.argsort(-self.sizes[docs], kind="stable")]
        number = (np.cumsum(self.sizes[docs] + 1) - 1) // GROUP
        return np.split(docs, np.flatnonzero(np.diff(number)) + 1)

    def narrowed(self) -> np.ndarray:
        """The classes that occur, in order; from now on a class is its place among them."""
        seen = np.zeros(self.end + 1, bool)
        seen[self.word_class] = seen[self.end] = True
        present = np.flatnonzero(seen)
        self.word_class, self.end = (np.cumsum(seen) - 1)[self.word_class], len(present) - 1
        return present

    def training(self) -> np.ndarray:
        """The classes of the training documents' tokens, one document after the other, each with its end."""
        train = ~self.held
        return np.insert(self.word_class[self.tokens[np.repeat(train, self.sizes)]], np.cumsum(self.sizes[train]), self.end)

    def sequences(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some documents: their order, how many go on at each position, and classes by position then document."""
        if len(docs) == 1:
            start, n = self.starts[docs[0]], self.sizes[docs[0]]
            return docs, np.ones(n + 1, np.int64), np.append(self.word_class[self.tokens[start : start + n]], self.end)
        order = docs[np.argsort(-self.sizes[docs], kind="stable")]
        lengths = self.sizes[order] + 1
        going = len(order) - np.searchsorted(lengths[::-1], np.arange(lengths[0] if len(order) else 0), side="right")
        rows, sizes = np.r_[0, np.cumsum(going)], self.sizes[order]
        doc = np.repeat(np.arange(len(order)), sizes)
        position = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        classes = np.full(rows[-1], self.end)
        # at a position the documents that go on come in their order
        classes[rows[position] + doc] = self.word_class[self.tokens[self.starts[order][doc] + position]]
        return order, going, classes


class Model:
    """Start, transition and emission probabilities; emissions by class, then state."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    def scores(self, going: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the sequences, in their order."""
        total = np.zeros(going[0] if len(going) else 0)
        at = 0
        state = None
        for i, n in enumerate(going.tolist()):
            seen = self.emit.take(classes[at : at + n], axis=0)
            if state is None:
                state = self.start * seen
            else:
                if n < len(state):
                    total[n : len(state)] += np.log(state[n:].sum(axis=1))
                state = state[:n] @ self.move
                state *= seen
            if i % SCALED == SCALED - 1:
                scale = state.sum(axis=1)
                state /= scale[:, None]
                total[:n] += np.log(scale)
            at += n
        if state is not None:
            total[: len(state)] += np.log(state.sum(axis=1))
        return total

    def _forward(self, state: np.ndarray | None, first: int, going: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the positions from ``first`` on, after ``state`` of the one before: the forward rows, scaled now and then, and the emissions by the same scales."""
        seen = self.emit.take(classes, axis=0)
        ahead = np.empty_like(seen)
        at = 0
        for i, n in enumerate(going.tolist(), first):
            here, emitted = ahead[at : at + n], seen[at : at + n]
            if state is None:
                here[:] = self.start
            else:
                np.matmul(state[:n], self.move, out=here)
            here *= emitted
            if i % SCALED == SCALED - 1:
                scale = here.sum(axis=1, keepdims=True)
                here /= scale
                emitted /= scale
            state = here
            at += n
        return ahead, seen

    def counts(self, going: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Expected counts over the sequences: starts, transitions and, in parts, emissions of the classes that occur.

        The way ahead keeps the row before each stretch of about ``STRETCH``
        tokens; the way back finds the rows of one stretch anew, so memory
        beside the classes is bounded for a sequence of any length.  The way
        back begins with one over the sum of a sequence's last forward row, so
        that products of both ways are probabilities.
        """
        states = len(self.start)
        rows = np.r_[0, np.cumsum(going)]
        firsts = np.flatnonzero(np.diff(rows[:-1] // STRETCH, prepend=-1))
        spans = list(zip(firsts.tolist(), [*firsts[1:].tolist(), len(going)], strict=True)) if len(firsts) else []
        before, state, made = [], None, None
        for first, end in spans:
            before.append(state)
            made = self._forward(state, first, going[first:end], classes[rows[first] : rows[end]])
            state = made[0][rows[end - 1] - rows[first] :].copy()
        started, moved, emitted = np.zeros(states), np.zeros((states, states)), []
        back, turned = np.ones((0, states)), np.ascontiguousarray(self.move.T)
        for (first, end), state in zip(reversed(spans), reversed(before), strict=True):
            some, seen = going[first:end], classes[rows[first] : rows[end]]
            ahead, into = made or self._forward(state, first, some, seen)
            made = None
            weighed = np.empty_like(into)
            at, sizes = len(into) - some[-1], some.tolist()
            weighed[at : at + len(back)] = back
            more = len(back)
            for i in range(len(sizes) - 1, -1, -1):
                n = sizes[i]
                if more < n:
                    weighed[at + more : at + n] = 1 / ahead[at + more : at + n].sum(axis=1, keepdims=True)
                here = into[at : at + n]
                here *= weighed[at : at + n]
                if i:
                    at -= sizes[i - 1]
                    np.matmul(here, turned, out=weighed[at : at + n])
                else:
                    back = here @ turned
                more = n
            if state is not None:
                moved += state[: some[0]].T @ into[: some[0]]
            source = np.arange(some[0], len(into)) - np.repeat(some[:-1], some[1:])
            for at in range(0, len(source), 1 << 15):
                part = source[at : at + (1 << 15)]
                moved += ahead.take(part, axis=0).T @ into[some[0] + at : some[0] + at + len(part)]
            ahead *= weighed
            if state is None:
                started = ahead[: some[0]].sum(axis=0)
            present = np.flatnonzero(np.bincount(seen))
            place = np.empty(present[-1] + 1, np.int64)
            place[present] = np.arange(len(present))
            place = place[seen]
            emitted.append((present, np.stack([np.bincount(place, weights=ahead[:, s], minlength=len(present)) for s in range(states)], axis=1)))
        return started, moved * self.move, emitted

    def expected(self, going: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same counts with those of emissions for every class."""
        started, moved, parts = self.counts(going, classes)
        emitted = np.zeros(self.emit.shape)
        for present, n in parts:
            emitted[present] += n
        return started, moved, emitted


def estimated(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    """The model of expected counts, with shares for what was never seen."""
    states, classes = len(start), len(emit)
    overall = (emit.sum(axis=1) + 1) / (emit.sum() + classes)
    shared = emit + EMISSION_PRIOR * overall[:, None]
    return Model((start + 1) / (start.sum() + states), (move + TRANSITION_PRIOR) / (move.sum(axis=1, keepdims=True) + TRANSITION_PRIOR * states), shared / shared.sum(axis=0))


def first_model(pairs: np.ndarray, groups: np.ndarray, weights: np.ndarray, states: int, rounds: int) -> Model:
    """A model fitted to ``pairs``, how often a group follows another in a ring of each document; ``groups`` and ``weights`` are by class.

    Begun with emissions that differ at random.  A pair's probability is a sum
    over pairs of states, and each round divides its count among them.
    """
    n, rng = pairs.sum(), np.random.default_rng(0)
    if not n:
        return Model(np.full(states, 1 / states), np.full((states, states), 1 / states), np.full((len(groups), states), 1 / len(groups)))
    emit = rng.gamma(2.0, size=(len(pairs), states)) * pairs.sum(axis=1)[:, None]
    emit /= emit.sum(axis=0)
    both = (np.full((states, states), 0.9 / states) + 0.1 * np.eye(states)) / states
    for _ in range(rounds):
        chance = emit @ both @ emit.T
        ratio = np.divide(pairs, chance, out=np.zeros_like(chance), where=(pairs > 0) & (chance > 0))
        shared = emit * (ratio @ (emit @ both.T) + ratio.T @ (emit @ both))
        both *= emit.T @ ratio @ emit
        both /= both.sum()
        emit = shared / np.maximum(shared.sum(axis=0), np.finfo(float).tiny)
    share = both.sum(axis=1)
    end = emit[-1] * share
    start = end / end.sum() @ (both / np.maximum(share[:, None], np.finfo(float).tiny)) * pairs[-1].sum()
    whole = np.bincount(groups, weights=weights, minlength=len(pairs))
    return estimated(start, both * n, (emit * share * n)[groups] * (weights / whole[groups])[:, None])


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _added(chunks: DataFrame, add, rows: int, columns: int) -> np.ndarray:
    """The sum over all chunks of what ``add`` adds to a table for each, of ``rows`` by ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in _rows(batch):
                total = np.zeros((rows, columns)) if total is None else total
                add(row, total)
        if total is not None:
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(total[at, s]) for s in range(columns))], names)

    names = ["at", *(f"s{s}" for s in range(columns))]
    parts = chunks.select("doc_ids", "held", "sizes", "tokens", "words", "endings").mapInArrow(run, "at int, " + ", ".join(f"{n} double" for n in names[1:]))
    sums = parts.groupBy("at").agg(*(F.sum(n).alias(n) for n in names[1:])).toArrow()
    total = np.zeros((rows, columns))
    total[sums.column("at").to_numpy()] = np.stack([sums.column(n).to_numpy() for n in names[1:]], axis=1) if sums.num_rows else 0
    return total


def pair_counts(chunks: DataFrame, classes, groups: np.ndarray) -> np.ndarray:
    """How often, over the training documents of all chunks, a group follows another; a document's first token follows an end."""
    sent = chunks.sparkSession.sparkContext.broadcast(groups)

    def add(row: dict, total: np.ndarray) -> None:
        seen = sent.value[Chunk(row, classes.value).training()]
        flat = total.reshape(-1)
        before = COARSE - 1
        for at in range(0, len(seen), FIRST_TOKENS):
            part = seen[at : at + FIRST_TOKENS]
            flat += np.bincount(np.r_[before, part[:-1]] * COARSE + part, minlength=len(flat))
            before = part[-1]

    return _added(chunks, add, COARSE * COARSE // 8, 8).reshape(COARSE, COARSE)


def one_round(chunks: DataFrame, classes, model: Model, size: int) -> Model:
    """Baum-Welch counts over the training documents of all chunks, added by class."""
    sent = chunks.sparkSession.sparkContext.broadcast(model)
    states = len(model.start)

    def add(row: dict, total: np.ndarray) -> None:
        chunk = Chunk(row, classes.value)
        present = chunk.narrowed()
        own = Model(sent.value.start, sent.value.move, sent.value.emit[present])
        for docs in chunk.groups(np.flatnonzero(~chunk.held)):
            _, going, observed = chunk.sequences(docs)
            started, moved, emitted = own.counts(going, observed)
            total[0] += started
            total[1 : 1 + states] += moved
            for found, n in emitted:
                total[1 + states + present[found]] += n

    total = _added(chunks, add, 1 + states + size, states)
    return estimated(total[0], total[1 : 1 + states], total[1 + states :])


def frequent_from(tokens: int) -> float:
    """The count from which a word is frequent."""
    return SEEN * max(1.0, tokens / SEEN_AT) ** 0.5


def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs in the training documents of all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                counts = _numbers(row["counts"])
                words = pa.array(_words(row["words"]), pa.binary())
                yield pa.RecordBatch.from_arrays([words, pa.array(counts)], ["word", "n"]).filter(pa.array(counts > 0))

    found = chunks.select("words", "counts").mapInArrow(run, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def rare_sums(chunks: DataFrame, counts: DataFrame, classes) -> DataFrame:
    """(u, logs, known): for each document, over its tokens with a count but no class of their own, the sum of log10(count + 1) and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                words, tokens, sizes = _words(row["words"]), _numbers(row["tokens"]), _numbers(row["sizes"])
                rare = ~np.fromiter(map(classes.value.number.__contains__, words), bool, len(words))
                doc = np.repeat(np.arange(len(sizes)), sizes)[rare[tokens]] if len(tokens) else tokens
                pairs, n = np.unique(doc * max(1, len(words)) + tokens[rare[tokens]] if len(tokens) else tokens, return_counts=True)
                doc, word = np.divmod(pairs, max(1, len(words)))
                found = pa.array(words, pa.binary()).take(pa.array(word))
                yield pa.RecordBatch.from_arrays([found, pa.array(row["chunk"] + doc, pa.int64()), pa.array(n.astype(np.int32))], ["word", "u", "m"])

    found = chunks.select("chunk", "sizes", "tokens", "words").mapInArrow(run, "word binary, u long, m int")
    return found.join(counts, "word").groupBy("u").agg(F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("logs"), F.sum("m").alias("known"))


def document_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, parts: int = 7, rest: int = 2, own_words: int = OWN_WORDS) -> DataFrame:
    """The contract's columns for each row of ``docs``; those whose id leaves ``rest`` are held out."""
    ready(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("u"), F.col("doc_id").cast("long"), held_out(F.col("doc_id"), parts, rest).alias("held"), F.col("text").cast("string"))
    return result(lambda: _scored(rows, states, rounds, own_words), "scores")


def _scored(rows: DataFrame, states: int, rounds: int, own_words: int) -> DataFrame:
    spark = rows.sparkSession
    chunks = stored_chunks(rows)
    size = chunks.agg(F.sum("n_train").alias("n"), F.count("*").alias("chunks"), F.sum(F.size(F.filter("held", lambda h: ~h))).alias("docs")).first()
    n_train, n_docs = size.n or 0, size.docs or 0
    counts = write_table(word_counts(chunks), "counts")
    distinct = counts.count() + (n_docs > 0)
    frequent = counts.filter(F.col("n") >= frequent_from(n_train)).orderBy(F.desc("n"), "word").limit(own_words).toArrow()
    own_classes = Classes([bytes(w) for w in frequent.column("word").to_pylist()])
    own_counts = frequent.column("n").to_numpy().astype(np.int64)
    classes = spark.sparkContext.broadcast(own_classes)
    room = _room(counts, classes)
    groups = own_classes.coarse()
    model = first_model(pair_counts(chunks, classes, groups), groups, np.r_[own_counts, room, n_docs], states, FIRST_ROUNDS)
    if n_docs:
        for _ in range(rounds):
            model = one_round(chunks, classes, model, own_classes.size)
    sent = spark.sparkContext.broadcast((model, np.log10(room), np.log10(own_counts + 1.0)))
    end_count, ten, whole = n_docs, np.log(10.0), np.log10(n_train + 1.0 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, room, own = sent.value
        for batch in batches:
            for row in _rows(batch):
                chunk = Chunk(row, classes.value)
                group, docs = chunk.word_class - classes.value.n, len(chunk.sizes)
                present = chunk.narrowed()
                narrow = Model(model.start, model.move, model.emit[present])
                doc = np.repeat(np.arange(docs), chunk.sizes)
                add = lambda x, doc=doc, chunk=chunk, docs=docs: np.bincount(doc, weights=x[chunk.tokens], minlength=docs)
                frequent = group < 0
                counted = np.zeros(len(group))
                counted[frequent] = own[group[frequent] + classes.value.n]
                score = np.zeros(docs)
                for some in chunk.groups(np.arange(docs)):
                    order, going, observed = chunk.sequences(some)
                    score[order] = narrow.scores(going, observed) / ten
                score -= add(np.where(frequent, 0.0, room[np.maximum(group, 0)]))
                # the end is a token of every document
                base = add(counted) + np.log10(end_count + 1.0) - (chunk.sizes + 1) * whole
                known = add(frequent.astype(float)).astype(np.int64) + (end_count > 0)
                columns = [pa.array(row["chunk"] + np.arange(docs)), pa.array(chunk.doc_ids, pa.int64()), pa.array(chunk.held), pa.array(chunk.sizes + 1), pa.array(known), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["u", "doc_id", "held_out", "n_tokens", "n_own", "base", "part"]
    scored = chunks.drop("counts", "n_words", "n_train").mapInArrow(run, "u long, doc_id long, held_out boolean, n_tokens long, n_own long, base double, part double")
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0)).cast("long")
    return scored.join(rare_sums(chunks, counts, classes), "u", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_own") + more).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("part") + logs).alias("score")
    )


def _room(counts: DataFrame, classes) -> np.ndarray:
    """For each ending its tokens, its words and one, without the words that have a class of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = classes.value.number
        tokens, kinds = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
        for batch in batches:
            n = batch.column(1).to_numpy()
            words = batch.column(0).to_pylist()
            rare = np.fromiter((w not in known for w in words), bool, len(words))
            group = np.fromiter((ending_class(w) for w, r in zip(words, rare, strict=True) if r), np.int64, int(rare.sum()))
            np.add.at(tokens, group, n[rare])
            np.add.at(kinds, group, 1)
        at = np.flatnonzero(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(tokens[at] + kinds[at])], ["g", "n"])

    room = np.ones(ENDINGS)
    for r in counts.select("word", "n").mapInArrow(run, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        room[r.g] += r.n
    return room


def op4_hmm(spark, sf_dir: str) -> DataFrame:
    """The contract of operator 4 over the whole of ``documents``."""
    return document_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
