import random

import public_tokenizers
import pytest
import sentencepiece

from mediaquarry.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", "▁", " ", "  ", "\n", "\t", ".", ",", "é", "日", "本", "😀", "́", "ing", " and", "1", "2023", "​", "<s>", "<0x0A>", "\x00", "//", "http://", "'s", "(", ")", "A", "\r\n", "    ", "=", "﻿", "»,", "ﬁ"]


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return pieces.load(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(9)
    return ["", " ", "  ", "\n", "▁▁a", " " * 50, "a" * 700, "日本語 text", *("".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40))) for _ in range(1500))]


def test_ids_and_text_are_the_library_s(model, library):
    for t in texts():
        ids = library.encode(t)
        assert model.encode(t) == ids, t
        assert model.decode(ids) == library.decode(ids), t


def test_decoding_of_any_ids(model, library):
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.choice((rng.randrange(3, 300), rng.randrange(300, 32000))) for _ in range(rng.randint(1, 12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_counts_at_every_prefix(model, library):
    for t in texts()[:250]:
        counts = pieces.PrefixCounts(model, t)
        assert counts.counts == [len(library.encode(t[:i])) for i in range(len(t) + 1)]
        for budget in (0, 1, 5, 1000):
            assert counts.longest_within(budget) == max(i for i, c in enumerate(counts.counts) if c <= budget)
            assert pieces.count_text(pieces._Counts(model), t, budget) == (counts.total(), counts.longest_within(budget))


def test_odd_documents(spark, odd_docs, model, library):
    raw = pieces._model(PATH)
    by = {r.doc_id: r.text for r in odd_docs.collect()}
    rows = pieces.token_counts(odd_docs, raw, 100).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.doc_id not in (3, None):
            text = by[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text)))
    found = pieces.round_trip(odd_docs, raw, with_ids=True).collect()
    for r in found:
        if r.doc_id not in (3, None):
            ids = library.encode(by[r.doc_id] or "")
            assert r.ids == ",".join(map(str, ids)) and r.decoded == library.decode(ids) and r.n_tokens == len(ids)
    assert pieces.token_counts(odd_docs.limit(0), raw, 100).count() == 0 == pieces.round_trip(odd_docs.limit(0), raw).count()


def test_whole_table_against_the_library(spark, library):
    import hashlib

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in pieces.op1_token_counts(spark, folder).collect():
        assert r.n_tokens == len(library.encode(docs[r.doc_id])) and r.over_limit == (r.n_tokens > 4096)
    for r in pieces.op6_sentencepiece(spark, folder).collect():
        ids = library.encode(docs[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
