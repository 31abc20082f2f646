"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams.

A text's features are the hashes of its words and of their first bytes, of
word pairs and of pairs with one word between them, each once.  FTRL-proximal keeps a rate for each coordinate
and an L1 term that leaves the weights of uninformative ones at exactly zero,
so the model is the few weights that differ from zero, at most ``2**BITS``,
and can be broadcast.

The model is fitted on a bounded sample of the labelled rows (``SAMPLE`` rows
whose texts have at most ``SAMPLE_CHARS`` code points, in the order of a hash of
the id, as many as have ``SAMPLE_FEATURES`` features in all); every row is
scored over its whole text.  Each third of the sample is also
scored by a model of the other two; the logit that best parts the labels there
(F with precision counted double) becomes the score ``THRESHOLD``.

Defined results: a null or empty text has no features and gets the score of
the bias; rows with a null doc_id are scored and count as not held out; labels
that are null, not 0 or 1, or of unknown documents are not used; of several
labels or texts of one id the largest label and the least text count; without
labels every score is 0.5; an empty table gives an empty result; other columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import picked, ready, sliced

BITS = 20
SAMPLE, SAMPLE_CHARS, SAMPLE_FEATURES = 12_000, 40_000, 1 << 26
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.3, 1.0, 3.0, 0.5
FOLDS = 3
#: Bytes of a word that stand for its stem.
STEMS = (5, 7)
THRESHOLD = 0.7
#: Word hashes that a worker keeps.
CACHED = 250_000
_SPACES = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


class _Words(dict):
    """The row of ``table`` with the hashes of a word and of its stems; the last rows are for words that aren't kept."""

    def __init__(self) -> None:
        super().__init__()
        self.table = np.zeros((CACHED + 1024, 1 + len(STEMS)), np.uint64)
        self.spare = CACHED

    def __missing__(self, word: bytes) -> int:
        digest = xxhash.xxh64_intdigest
        at = len(self)
        if at < CACHED:
            self[word] = at
        else:
            at = self.spare
            self.spare += 1
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table[CACHED:])])
        self.table[at] = (digest(word), *(digest(word[:n], n) for n in STEMS))
        return at

    def hashes(self, words: list[bytes]) -> np.ndarray:
        self.spare = CACHED
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        found = self.table[at].T
        if len(self.table) > CACHED + (1 << 20):
            self.table = self.table[: CACHED + 1024].copy()
        return found


_WORDS = _Words()


def features(text: str | None) -> np.ndarray:
    """Hashed features of a text, from 0 to 2**BITS, perhaps repeated."""
    h, *stems = _WORDS.hashes((text or "").encode().lower().translate(_SPACES).split())
    shift, odd, other = np.uint64(64 - BITS), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    pairs = (h[:-1] * odd + h[1:]) * other
    skips = (h[:-2] * other + h[2:]) * odd
    return (np.concatenate([h, *stems, pairs, skips]) >> shift).astype(np.int32)


class Ftrl:
    """FTRL-proximal logistic regression; the last coordinate is the bias, which L1 spares."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.bias = size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == self.bias, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, self.bias)
        w = self.weights(at)
        g = _sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def learn(rows: list[tuple[np.ndarray, int]], chosen: np.ndarray) -> np.ndarray:
    """All weights, the bias last, after ``EPOCHS`` over the chosen rows."""
    model = Ftrl(1 << BITS)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(chosen):
            model.learn(*rows[i])
    return model.weights(np.arange((1 << BITS) + 1))


def parting(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit between two rows that best parts the labels; 0 without both labels."""
    if len(np.unique(labels)) < 2:
        return 0.0
    order = np.argsort(-logits, kind="stable")
    logits, hits = logits[order], np.cumsum(labels[order])
    f = 1.25 * hits / (0.25 * hits[-1] + np.arange(1, len(hits) + 1))
    f[:-1][logits[:-1] == logits[1:]] = -1.0
    at = int(np.argmax(f))
    return float(logits[at] if at == len(f) - 1 else (logits[at] + logits[at + 1]) / 2)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -60.0), 60.0))))


def held_out(doc_id: Column, parts: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == rest, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that aren't zero, learnt from ``labels`` (doc_id, toxic)."""
    ready(docs.sparkSession)
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, 0.98 * sample / max(1, usable.count()))
    chosen = usable.filter(picked(share, "doc_id")).limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [np.unique(features(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "at"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            at = batch.column(2)
            for i, y in enumerate(batch.column(1).to_pylist()):
                found = at[i].values.to_numpy().copy()
                size += len(found)
                if size <= SAMPLE_FEATURES:
                    rows.append((found, y))
        if not rows:
            return
        number, logits = np.arange(len(rows)), np.zeros(len(rows))
        for fold in range(FOLDS):
            w = learn(rows, number[number % FOLDS != fold])
            for i in number[fold::FOLDS]:
                logits[i] = w[rows[i][0]].sum() + w[-1]
        w = learn(rows, number)
        w[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - parting(logits, np.array([y for _, y in rows]))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], ["at", "w"])

    found = rows.select("doc_id", "toxic", "text").mapInArrow(extract, "doc_id long, toxic int, at array<int>")
    found = found.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(train, "at int, w double").toArrow()
    return found.column("at").to_numpy(), found.column("w").to_numpy()


_DENSE: dict[bytes, np.ndarray] = {}


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], name: str = "score") -> DataFrame:
    """All rows of ``docs`` with a column ``name``; a column of that name is replaced."""
    spark = docs.sparkSession
    ready(spark)
    sent = spark.sparkContext.broadcast((model[0].tobytes(), model[1].tobytes()))
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = sent.value[0] + sent.value[1]
        if key not in _DENSE:
            _DENSE.clear()
            _DENSE[key] = np.zeros((1 << BITS) + 1)
            _DENSE[key][np.frombuffer(sent.value[0], np.int32)] = np.frombuffer(sent.value[1])
        w = _DENSE[key]
        used = w != 0
        for batch in sliced(batches):
            scores = []
            for text in batch.column(at).to_pylist():
                f = features(text)
                scores.append(_sigmoid(w[np.unique(f[used[f]])].sum() + w[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def learnt(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The model of the contract: from rows that aren't held out."""
    return fit(docs, labels.filter(~held_out(F.col("doc_id"), 3, 1)))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with the same columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return score(docs, learnt(docs, labels), name).filter(F.col(name) < THRESHOLD).drop(name)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract of operator 2 over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    found = score(docs, learnt(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
