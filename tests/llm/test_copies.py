import random

import numpy as np
import pytest

import corpus_pipeline
from mediaquarry.llm import copies


def sets(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """The smallest ids of the components of all pairs with a Jaccard similarity of 0.8 or more."""
    docs = sorted(docs)
    found = [sets(t) for _, t in docs]
    roots = list(range(len(docs)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and len(a & b) * 5 >= len(a | b) * 4:
                x, y = find(i), find(j)
                roots[max(x, y)] = min(x, y)
    return sorted(docs[r][0] for r in {find(i) for i in range(len(docs))})


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_stage_finds_near_copies_beyond_three_bits(spark):
    """The near-duplicate stage of the pipeline, on copies with 0 to 5 words changed and on chains of copies."""
    rng = random.Random(5)
    texts = [None, "", " \n", "one two", "One  TWO", "a b c d e", "a b c d e f"]
    for _ in range(60):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((12, 40, 150)))]
        texts += [edited(rng, base, rng.randrange(6)) for _ in range(rng.choice((1, 2, 6)))]
        chain = base
        for _ in range(3):
            chain = edited(rng, chain, 2).split()
            texts.append(" ".join(chain))
    ids = rng.sample(range(10**6), len(texts))
    docs = list(zip(ids, texts, strict=True))
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    got = stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    want = brute(docs)
    assert sorted(r.doc_id for r in got.collect()) == want and len(want) < len(docs) - 50


@pytest.mark.parametrize("full", [4, 16_384])
def test_trees_alone_find_every_pair(spark, monkeypatch, full):
    """Without the roots of step 1 the result is the same, also with shards cut in cells."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(1)
    rows += [(10**6 + i, edited(rng, t.split(), 1 + len(t.split()) // 60)) for i, (_, t) in enumerate(rows) if t and len(t.split()) > 20]
    monkeypatch.setattr(copies, "_roots", lambda banded, nodes: nodes.select(nodes.node.alias("a"), nodes.node.alias("b")).limit(0))
    got = copies.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string"), full=full)
    assert sorted(r.doc_id for r in got.collect()) == brute(rows)


def test_sketches_never_rule_out_a_similar_pair():
    rng = random.Random(2)
    for _ in range(300):
        whole = np.array([rng.getrandbits(64) for _ in range(rng.randrange(1, 3000))], np.uint64)
        a, b = (np.unique(whole[np.array([rng.random() < 0.9 for _ in whole])]) for _ in range(2))
        x, y = (np.frombuffer(copies.sketch(s), np.uint8) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_shingles_hash_alike_only_if_equal(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"{rng.choice('ab')}{rng.randrange(4)}" for _ in range(n)) for n in (0, 1, 3, 5, 6, 400, 3000)] + ["x" * 5000 + " y z", "  A b\tA\x0bB a b a b  "]
    want, seen = {}, {}
    for text in texts:
        found = copies.shingles(text)
        assert len(found) == len(sets(text))
        for gram in sets(text):
            assert want.setdefault(gram, copies.shingles(gram.decode()).item()) in found
    for gram, h in want.items():
        assert seen.setdefault(h, gram) == gram
    whole = [copies.shingles(t).tolist() for t in texts]
    monkeypatch.setattr(copies, "BLOCK", 50)
    assert [copies.shingles(t).tolist() for t in texts] == whole
