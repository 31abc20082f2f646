import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mediaquarry.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(3, 40))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(("Awful", "nasty.", "foul,")))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_weights_follow_the_recursion():
    """One coordinate and the bias, by the update rule written out."""
    model = toxicity.Ftrl(4)
    z, n = {2: 0.0, 4: 0.0}, {2: 0.0, 4: 0.0}
    for label in (1, 1, 0, 1, 1, 1, 0) * 5:
        w = {}
        for i in z:
            l1 = 0.0 if i == 4 else toxicity.L1
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in z:
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
            z[i] += g - s * w[i]
            n[i] += g * g
        model.learn(np.array([2]), label)
    assert model.z[[2, 4]] == pytest.approx([z[2], z[4]]) and model.n[[2, 4]] == pytest.approx([n[2], n[4]])
    assert not model.z[[0, 1, 3]].any()


def test_features():
    def found(text):
        return sorted(set(toxicity.features(text).tolist()))

    assert found("Some words, here!") == found("some\nWORDS here") != found("words some here")
    assert found(None) == found("") == found(" .. ") == []
    assert set(found("a b")) < set(found("a b c"))


def test_words_that_are_not_kept(monkeypatch):
    texts = [" ".join(f"word{(i * 7 + j * j) % 5000}" for j in range(3000)) for i in range(3)]
    want = [toxicity.features(t).tolist() for t in texts]
    monkeypatch.setattr(toxicity, "CACHED", 50)
    monkeypatch.setattr(toxicity, "_WORDS", toxicity._Words())
    assert [toxicity.features(t).tolist() for t in texts] == want and len(toxicity._WORDS) == 50


def test_parting():
    assert 0.3 < toxicity.parting(np.array([0.1, 0.9, 0.2, 0.8, 0.3]), np.array([0, 1, 0, 1, 0])) < 0.8
    assert toxicity.parting(np.array([0.1, 0.9]), np.array([1, 1])) == 0.0
    assert toxicity.parting(np.zeros(0), np.zeros(0)) == 0.0


def test_held_out_rows_are_told_apart(spark):
    rows = corpus(3000, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learnt(docs, labels)).collect()}
    apart = [(got[i] >= toxicity.THRESHOLD, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == y for p, y in apart) / len(apart) > 0.98
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and 0.7 < kept.count() / len(rows) < 0.8


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = corpus(400, 2)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.learnt(docs, labels), toxicity.learnt(docs, other)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_odd_documents_and_labels(spark, odd_docs):
    labels = spark.createDataFrame([(0, 1), (3, 0), (3, 1), (5, None), (None, 1), (99, 1), (6, 7), (4, 0)], "doc_id long, toxic int")
    rows = toxicity.score(odd_docs, toxicity.fit(odd_docs, labels), "score").collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.clean(odd_docs, labels).columns == odd_docs.columns
    none = toxicity.score(odd_docs, toxicity.fit(odd_docs, labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.5}
    assert toxicity.score(odd_docs.limit(0), toxicity.fit(odd_docs.limit(0), labels)).count() == 0


def plain_features(text):
    """All features of a text as numbers, one by one."""
    words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "")).encode().lower().split()
    h, whole, odd, other = [xxhash.xxh64_intdigest(w) for w in words], 1 << 64, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    found = h + [xxhash.xxh64_intdigest(w[:n], n) for n in (5, 7) for w in words]
    found += [(a * odd + b) * other % whole for a, b in zip(h, h[1:])] + [(a * other + b) * odd % whole for a, b in zip(h, h[2:])]
    return sorted({x >> 44 for x in found})


def plain_ftrl(rows, chosen):
    """Weights by the recursion over dictionaries, all features of all rows."""
    z, n, bias = {}, {}, -1

    def weight(i):
        l1 = 0.0 if i == bias else 3.0
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((1.0 + math.sqrt(n[i])) / 0.3 + 0.5)

    for epoch in range(4):
        for k in np.random.default_rng(epoch).permutation(chosen):
            at, label = [*rows[k][0], bias], rows[k][1]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in at:
                m = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(m + g * g) - math.sqrt(m)) / 0.3 * w[i]
                n[i] = m + g * g
    return {i: w for i in z if (w := weight(i))}


def test_scores_of_a_whole_table_as_brute_force(spark):
    """Model, folds, threshold and scores of the contract from dictionaries and all thresholds."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").collect() if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and len(r.text) <= 40_000]
    rows = [(plain_features(texts[i]), labels[i]) for i in order]
    logit = lambda w, f: sum(w.get(i, 0.0) for i in f) + w.get(-1, 0.0)
    apart = {}
    for fold in range(3):
        w = plain_ftrl(rows, np.array([k for k in range(len(rows)) if k % 3 != fold]))
        apart |= {k: logit(w, rows[k][0]) for k in range(fold, len(rows), 3)}
    cuts = sorted(set(apart.values()), reverse=True)
    best = max(cuts, key=lambda c: 1.25 * sum(rows[k][1] for k in apart if apart[k] >= c) / (0.25 * sum(y for _, y in rows) + sum(v >= c for v in apart.values())))
    below = [v for v in cuts if v < best]
    w = plain_ftrl(rows, np.arange(len(rows)))
    shift = math.log(0.7 / 0.3) - ((best + below[0]) / 2 if below else best)
    got = {r.doc_id: r.score for r in toxicity.op2_toxicity(spark, folder).collect()}
    assert got == pytest.approx({i: 1 / (1 + math.exp(-logit(w, plain_features(t)) - shift)) for i, t in texts.items()}, abs=1e-9)


def test_contract(spark):
    folder = "/root/testdata/sf0.01"
    rows = toxicity.op2_toxicity(spark, folder).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    toxic = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 1]
    clean = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 0]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.85
