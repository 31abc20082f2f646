import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from mediaquarry.llm import periodic


def brute(words, least=periodic.LEAST, times=periodic.TIMES):
    """(begin, end, period) of all runs: every stretch that keeps a period and can't be extended, with its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e, q) for (s, e), q in found.items())


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[:-q])


def random_texts(seed, count):
    rng = random.Random(seed)
    texts = []
    for _ in range(count):
        letters, out = [b"a", b"b", b"c", b"d"][: rng.randint(1, 4)], []
        for _ in range(rng.randint(0, 8)):
            part = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
            kind = rng.random()
            if kind < 0.5:
                out += part * rng.randint(1, 7)
            elif kind < 0.8 and out:
                a = rng.randrange(len(out))
                out += out[a : a + rng.randint(1, 40)]
            else:
                out += part
        texts.append(out)
    return texts


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (1, 2), (5, 3), (30, 4)])
def test_as_brute_force(least, times):
    texts = random_texts(times, 400)
    got = periodic.runs_of(texts, least, times)
    for words, runs in zip(texts, got, strict=True):
        assert runs == brute(words, least, times)
        assert all(smallest_period(words[s:e]) == q for s, e, q in runs)
    assert sum(map(len, got)) > 300 or least == 30


def test_one_text_alone_and_among_others():
    texts = random_texts(9, 60)
    assert [periodic.runs_of([t])[0] for t in texts] == periodic.runs_of(texts)
    assert periodic.runs_of([]) == [] and periodic.runs_of([[], []]) == [[], []]


def test_factors_by_their_definition():
    """Suffix array, common extensions and longest previous factors."""
    for words in random_texts(4, 40):
        numbers = np.array([ord(w) for w in words], np.int64)
        n = len(words)
        if not n:
            continue
        s = periodic.Suffixes(numbers, np.full(n, n))
        assert s.array.tolist() == sorted(range(n), key=lambda i: words[i:])
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(words[a:], words[b:], strict=False)) if x != y), n - max(a, b))  # noqa: E731, B023
        pairs = np.array([(i, j) for i in range(n) for j in range(n) if i != j][:500]).reshape(-1, 2)
        assert s.right(pairs[:, 0], pairs[:, 1]).tolist() == [common(i, j) for i, j in pairs.tolist()]
        length, source = s.previous()
        want = [max([common(j, i) for j in range(i)], default=0) for i in range(n)]
        assert length.tolist() == want
        assert all(common(int(source[i]), i) == want[i] for i in range(n) if want[i])


def test_long_texts_have_as_many_levels_as_they_need():
    words = [b"x", b"y", b"z"] * 20_000 + [b"end"]
    assert periodic.runs_of([words]) == [[(0, 60_000, 3)]]
    assert periodic.runs_of([[b"a"] * 50_000]) == [[(0, 50_000, 1)]]
    assert periodic.collapsed(words, [(0, 60_000, 3)]) == b"x y z end"


def expected(doc_id, text):
    """The columns of the query, from the brute force."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = max(runs, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(runs), *top, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_query_as_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = sorted(map(tuple, periodic.op13_periodic_runs(spark, folder).collect()))
    want = sorted(expected(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    assert got == want and sum(r[1] > 0 for r in got) > 5


def test_odd_documents(spark, odd_docs):
    docs = odd_docs.withColumnRenamed("score", "runs").withColumnRenamed("fp", "rewrite")
    rows = periodic.periodic_runs(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        words = (r.text or "").encode().split()
        runs = [(x.start, x.start + x.length, x.period) for x in r.runs]
        assert r.n_words == len(words) and (len(words) > 5000 or runs == brute(words))
        assert r.collapsed == periodic.collapsed(words, runs).decode()
    assert periodic.periodic_runs(docs).columns == [c for c in docs.columns if c != "runs"] + periodic.RESULTS.names
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
