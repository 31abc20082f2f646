import collections
import math
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mediaquarry.llm import hmm


def chunk_of(texts, classes, held=None):
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(held or [False] * n), pa.array(texts)], ["u", "doc_id", "held", "text"])
    (row,) = hmm.chunk_rows(iter([batch]), 10**9)
    return hmm.Chunk(row.to_pylist()[0], classes)


@pytest.fixture
def small():
    classes = hmm.Classes([b"a", b"b", b"c"])
    rng = np.random.default_rng(0)
    emit = rng.random((classes.size, 3))
    model = hmm.Model(np.array([0.5, 0.3, 0.2]), np.array([[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.3, 0.3, 0.4]]), emit / emit.sum(axis=0))
    texts = ["a b", "", "c a zzz b", "b"]
    return classes, model, chunk_of(texts, classes), texts


def test_scores_are_sums_over_all_paths(small):
    classes, model, chunk, texts = small
    order, going, observed = chunk.sequences(np.arange(len(texts)))
    got = dict(zip(order.tolist(), model.scores(going, observed).tolist(), strict=True))
    for d, text in enumerate(texts):
        seq = [*classes.of(hmm.tokens_of(text)).tolist(), classes.end]
        total = 0.0
        for path in product(range(3), repeat=len(seq)):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for i in range(1, len(seq)):
                p *= model.move[path[i - 1], path[i]] * model.emit[seq[i], path[i]]
            total += p
        assert got[d] == pytest.approx(math.log(total))


def test_expected_counts_are_those_of_all_paths(small):
    classes, model, chunk, texts = small
    _, going, observed = chunk.sequences(np.arange(len(texts)))
    start, move, emit = model.expected(going, observed)
    want = np.zeros(3), np.zeros((3, 3)), np.zeros((classes.size, 3))
    for text in texts:
        seq = [*classes.of(hmm.tokens_of(text)).tolist(), classes.end]
        paths = []
        for path in product(range(3), repeat=len(seq)):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for i in range(1, len(seq)):
                p *= model.move[path[i - 1], path[i]] * model.emit[seq[i], path[i]]
            paths.append((p, path))
        total = sum(p for p, _ in paths)
        for p, path in paths:
            want[0][path[0]] += p / total
            for i, s in enumerate(path):
                want[2][seq[i], s] += p / total
                if i:
                    want[1][path[i - 1], s] += p / total
    assert start == pytest.approx(want[0], rel=1e-4) and move == pytest.approx(want[1], rel=1e-4) and emit == pytest.approx(want[2], rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("stretch", [1, 2, 5, 1 << 17])
def test_counts_by_stretches(small, monkeypatch, stretch):
    """Forward rows that are found anew give the same counts."""
    classes, model, chunk, texts = small
    _, going, observed = chunk.sequences(np.arange(len(texts)))
    want = model.expected(going, observed)
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    for got, x in zip(model.expected(going, observed), want, strict=True):
        assert got == pytest.approx(x)
    alone = [model.expected(*chunk.sequences(np.array([d]))[1:]) for d in range(len(texts))]
    for i, x in enumerate(want):
        assert sum(a[i] for a in alone) == pytest.approx(x)


def test_texts_parted_at_white_space(monkeypatch):
    monkeypatch.setattr(hmm, "PIECE", 7)
    classes = hmm.Classes([])
    texts = ["a bb  ccc\tdddddddddddd e\x0bf a\u00a0b " * 3, "x", None, " ", "\n" * 30, "long" * 9]
    chunk = chunk_of(texts, classes)
    assert [[chunk.words[t] for t in chunk.tokens[s : s + n]] for s, n in zip(chunk.starts, chunk.sizes, strict=True)] == [hmm.tokens_of(t) for t in texts]


def test_a_long_document_and_many_classes_are_counted_in_bounded_memory():
    """Two million tokens under 2**20 own words: beside the classes only some stretches are held, and no table of counts of all classes."""
    import tracemalloc

    rng = np.random.default_rng(0)
    size, n = (1 << 20) + hmm.ENDINGS + 1, 2_000_000
    emit = rng.random((size, 2))
    model = hmm.Model(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), emit / emit.sum(axis=0))
    observed, going = rng.integers(0, 5_000, n), np.ones(n, np.int64)
    tracemalloc.start()
    started, moved, emitted = model.counts(going, observed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * n / 2 and max(len(p) for p, _ in emitted) <= 5_000
    assert started.sum() == pytest.approx(1) and moved.sum() == pytest.approx(n - 1) and sum(x.sum() for _, x in emitted) == pytest.approx(n)


def test_numbers_survive():
    x = np.array([0, 1, 255, 256, 70_000, (1 << 32) - 1])
    assert hmm._numbers(hmm._planes(x)).tolist() == x.tolist() and len(hmm._numbers(hmm._planes(x[:0]))) == 0


def test_chunks_are_stored_in_small_row_groups(spark, monkeypatch):
    """A reader holds a row group's rows at once: some MB, not all chunks of a task."""
    monkeypatch.setattr(hmm, "CHUNK", 1)
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(120_000)), lambda i: F.concat(F.lit("w"), i * 8 + F.col("u"))))
    rows = spark.range(8, numPartitions=1).withColumnRenamed("id", "u").select("u", F.col("u").alias("doc_id"), F.lit(False).alias("held"), text.alias("text"))
    chunks = hmm.stored_chunks(rows)
    (file,) = chunks.inputFiles()
    stored = pq.ParquetFile(file.removeprefix("file:").replace("///", "/")).metadata
    sizes = [stored.row_group(i).total_byte_size for i in range(stored.num_row_groups)]
    assert sum(sizes) > 9_000_000 and max(sizes) < 5_000_000
    found = {r.chunk: (r.n_words, r.n_train, hmm._numbers(r.counts).tolist()) for r in chunks.collect()}
    assert found == dict.fromkeys(range(8), (120_001, 120_002, [1] * 120_001))


def test_numbers_take_the_bytes_that_they_need():
    for most, runs in ((0, 1), (255, 1), (256, 2), (94_000, 3), ((1 << 32) - 1, 4)):
        x = np.array([0, 7 % (most + 1), most] * 100)
        assert hmm._numbers(hmm._planes(x)).tolist() == x.tolist() and len(hmm._planes(x)) == 1 + runs * len(x)


def check_base(docs, rows):
    counts, tokens = collections.Counter(), {}
    for i, text in docs:
        words = [*(text or "").encode().lower().split(), None]
        tokens.setdefault(i, []).append(words)
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        base = [(len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + 1 * (v + 1))) for x in w)) for w in tokens[r.doc_id]]
        assert any((r.n_tokens, r.n_known) == b[:2] and r.base_score == pytest.approx(b[2], abs=1e-7) for b in base)
        assert r.train_tokens == n and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_the_layout_of_the_input_is_of_no_account(spark, monkeypatch):
    """Equal scores for other files and chunks, to the rounding of sums."""
    monkeypatch.setattr(hmm, "FIRST_TOKENS", 9_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
    one = {r.doc_id: r.score for r in hmm.document_scores(docs.coalesce(1)).collect()}
    monkeypatch.setattr(hmm, "CHUNK", 3_000)
    five = {r.doc_id: r.score for r in hmm.document_scores(docs.repartition(5)).collect()}
    assert one == pytest.approx(five, abs=1e-6)


@pytest.mark.parametrize("tokens", [3, 400_000])
def test_the_start_counts_pairs_of_all_training_documents(spark, monkeypatch, tokens):
    """Of every training document, long ones too, whatever is added at once; none is left to a sample."""
    monkeypatch.setattr(hmm, "COARSE", 16)
    monkeypatch.setattr(hmm, "FIRST_TOKENS", tokens)
    texts = ["a b a", None, "", "b c " * 25_000, *(f"a w{i} b" for i in range(40))]
    held = [i % 5 == 4 for i in range(len(texts))]
    df = spark.createDataFrame([(i, i, h, t) for i, (h, t) in enumerate(zip(held, texts, strict=True))], "u long, doc_id long, held boolean, text string").repartition(3)
    chunks = df.mapInArrow(lambda b: hmm.chunk_rows(b, 100), hmm.CHUNKS)
    classes = hmm.Classes([b"b", b"a", b"c"])
    groups = classes.coarse()
    got = hmm.pair_counts(chunks, spark.sparkContext.broadcast(classes), groups)
    want = np.zeros((16, 16))
    for h, text in zip(held, texts, strict=True):
        seen = [15, *groups[classes.of(hmm.tokens_of(text))].tolist(), 15]
        for pair in zip(seen, seen[1:], strict=False) if not h else ():
            want[pair] += 1
    assert (got == want).all() and want.sum() > 40_000


def test_the_start_fits_its_pairs():
    """More rounds fit counts of pairs better, and its parts are probabilities."""
    rng = np.random.default_rng(0)
    classes = hmm.Classes([b"w%d" % i for i in range(20)])
    groups = classes.coarse()
    pairs = rng.poisson(5, (hmm.COARSE, hmm.COARSE)) * (np.add.outer(np.arange(hmm.COARSE), np.arange(hmm.COARSE)) % 2)
    fits = []
    for rounds in (1, 5, 50):
        m = hmm.first_model(pairs, groups, np.ones(classes.size), 3, rounds)
        for x in (m.start[None], m.move, m.emit.T):
            assert (x > 0).all() and x.sum(axis=1) == pytest.approx(1)
        coarse = np.stack([np.bincount(groups, weights=m.emit[:, s], minlength=hmm.COARSE) for s in range(3)], axis=1)
        share = np.linalg.matrix_power(m.move, 200)[0]
        fits.append((pairs * np.log(np.maximum(coarse @ (share[:, None] * m.move) @ coarse.T, 1e-300))).sum())
    assert fits == sorted(fits)


def test_scaling_now_and_then_loses_nothing(small, monkeypatch):
    """Long sequences of rare classes: the scores and counts of scaling at each position."""
    classes, model, _, _ = small
    model = hmm.Model(model.start, model.move, model.emit * 1e-25)
    chunk = chunk_of(["a b zzz c " * 50, "b a", "c " * 7, ""], classes)
    _, going, observed = chunk.sequences(np.arange(4))
    got = model.scores(going, observed), model.expected(going, observed)
    monkeypatch.setattr(hmm, "SCALED", 1)
    assert got[0] == pytest.approx(model.scores(going, observed), rel=1e-12)
    for x, y in zip(got[1], model.expected(going, observed), strict=True):
        assert x == pytest.approx(y) and np.isfinite(x).all()


def test_more_words_have_a_class_of_their_own_the_larger_the_input():
    assert hmm.frequent_from(10) == hmm.frequent_from(hmm.SEEN_AT) == hmm.SEEN
    assert [n / hmm.frequent_from(n) for n in (10**7, 10**9, 10**12)] == sorted(n / hmm.frequent_from(n) for n in (10**7, 10**9, 10**12))


def test_whole_table_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(hmm, "CHUNK", 3_000)
    monkeypatch.setattr(hmm, "GROUP", 700)
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = hmm.op4_hmm(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    check_base(docs, rows)
    for held in (True, False):
        mine = [r for r in rows if r.held_out == held]
        assert sum(r.score for r in mine) > sum(r.base_score for r in mine)


def test_rounds_raise_the_likelihood(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    totals = [sum(r.score for r in hmm.document_scores(docs, rounds=n).collect() if not r.held_out) for n in (0, 3)]
    assert totals[1] > totals[0]


def test_probabilities_add_up_to_one(spark):
    """All texts of up to two words over the training words, and what is left, make up less than one."""
    rows = [(0, "x y"), (1, "y"), (3, "x"), (4, "z z")]
    words = ["x", "y", "z", "unseen"]
    texts = ["", *words, *(f"{a} {b}" for a in words for b in words)]
    held = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 == 2][: len(texts)]
    df = spark.createDataFrame(rows + list(zip(held, texts, strict=True)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in hmm.document_scores(df).collect()}
    total = sum(10 ** got[i] for i in held)
    assert 0 < total < 1 + 1e-9


def test_odd_documents(spark, odd_docs):
    rows = hmm.document_scores(odd_docs).collect()
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert len(rows) == len(docs) and all(math.isfinite(r.score) for r in rows)
    check_base(docs, rows)
    assert hmm.document_scores(odd_docs.limit(0)).count() == 0
