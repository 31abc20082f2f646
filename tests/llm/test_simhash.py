import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mediaquarry.llm import _components, copies, simhash


def plain(text):
    """The fingerprint by its definition."""
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, radius=3):
    roots = list(range(len(values)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                roots[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "a b c d", "É à\x0bZ  z a b a b a b", "a b c a b c a b c d", "x\xa0y z w", "  w  " * 200])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_fingerprint_is_spark_s_hash(spark):
    assert simhash.fingerprint("The cat sat") == spark.range(1).select(F.xxhash64(F.lit("the cat sat"))).first()[0] % (1 << 64)


def clusters(rng, n):
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice((1, 1, 1, 5, 60))):
            out.append(base)
            base ^= sum(1 << b for b in {rng.randrange(64) for _ in range(rng.choice((0, 1, 2, 3, 4, 5)))})
    return out[:n]


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_forest_finds_all_within_the_radius(radius):
    rng = random.Random(radius)
    values = np.array(clusters(rng, 400), np.uint64)
    shard = np.sort(np.array([rng.randrange(7) for _ in values]))
    shard = np.unique(shard, return_inverse=True)[1]
    forest = simhash.Forest(shard, values)
    got = sorted((int(q), int(n)) for a, b in forest.search(shard, values, radius) for q, n in zip(a, b, strict=True))
    want = sorted((i, j) for i in range(400) for j in range(400) if shard[i] == shard[j] and (int(values[i]) ^ int(values[j])).bit_count() <= radius)
    assert got == want


@pytest.mark.parametrize(("radius", "n"), [(0, 10), (3, 10), (3, 1 << 25), (3, 1 << 40), (16, 1 << 30)])
def test_pairs_within_the_radius_share_a_shard(radius, n):
    rng = random.Random(n)
    for masks in simhash.ladder(n, radius)[:4]:
        for _ in range(500):
            flips = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(flips & m == 0 for m in masks)
    assert radius != 3 or min(m.bit_count() for m in simhash.ladder(n, 3)[-1]) >= 50


def test_trees_follow_few_edges():
    values = np.random.default_rng(0).integers(1 << 62, size=2 * simhash.SHARD, dtype=np.uint64)
    forest = simhash.Forest(np.repeat([0, 1], simhash.SHARD), values)
    assert sum(len(q) for q, _ in forest.search(np.repeat([0, 1], simhash.SHARD), values, 3)) == len(values)
    assert forest.visited < 0.1 * len(values) * simhash.SHARD


@pytest.mark.parametrize(("shard", "full"), [(4, 6), (64, 128), (2048, 16384)])
def test_classes_as_brute_force(spark, shard, full):
    """Also where shards are full, so that their members are dealt anew by finer families."""
    rng = random.Random(3)
    values = clusters(rng, 500) + [0, 0, 1]
    ids = rng.sample(range(5000), len(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    marked = spark.createDataFrame(list(zip(ids, signed, strict=True)), "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.classes(marked, 3, shard, full).collect()}
    roots = components(values)
    least = {r: min(i for i, x in zip(ids, roots, strict=True) if x == r) for r in set(roots)}
    assert got == {i: least[r] for i, r in zip(ids, roots, strict=True)}


def test_long_chains_become_one_component(spark):
    order = list(range(300))
    random.Random(0).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(199)] + [(order[i], order[200]) for i in range(201, 300)]
    got = {r.node: r.root for r in _components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    a, b = min(order[:200]), min(order[200:])
    assert got == {x: a if i < 200 else b for i, x in enumerate(order)}


def test_odd_documents(spark, odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    empty = [r for r in rows if r.fp == 0]
    assert len(empty) == 3 and {r.component_id for r in empty} == {0}
    assert {r.component_id for r in rows if r.doc_id == 4} == {3}
    kept = copies.distinct_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in kept.collect()) == [(0, ""), (3, "anoth"), (3, "one t"), (5, "word0"), (6, "Ünï ç"), (7, "xxxxx"), (8, "a\nb\n\n")]
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0 == copies.distinct_documents(odd_docs.limit(0)).count()


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    roots = components([f for _, f in docs])
    want = {d: (f"{f:016x}", docs[r][0]) for (d, f), r in zip(docs, roots, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash(spark, folder).collect()} == want
