import hashlib
import random
import re

import duckdb
import numpy as np
from mediaquarry.llm import decontaminate as D

_UPPER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_UPPER))


def brute(text, items, window):
    """(n_words, spans of hit words, ids of items): every window of every item is looked for at every word."""
    words, hit, found = split(text), set(), set()
    for item, body in items:
        w = split(body)
        length = min(window, len(w))
        for i in range(len(w) - length + 1 if length else 0):
            for j in range(len(words) - length + 1):
                if words[j : j + length] == w[i : i + length]:
                    hit |= set(range(j, j + length))
                    found.add(item)
    return len(words), hit, found - {None}


def run(spark, docs, items, window=D.WINDOW):
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = []
    for r in D.contaminated(*frames, window).collect():
        spans = [(s["first"], s["end"]) for s in r.spans or []]
        assert all(a < b for a, b in spans) and all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
        covered = {i for a, b in spans for i in range(a, b)}
        assert r.n_hit == len(covered)
        out.append((r.doc_id, r.n_words, tuple(sorted(covered)), tuple(sorted(r["items"] or []))))
    return out


def expected(docs, items, window=D.WINDOW):
    out = []
    for d, t in docs:
        n, hit, found = brute(t, items, window)
        out.append((d, n, tuple(sorted(hit)), tuple(sorted(found))))
    return out


def test_as_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "C1", "naïve", "日本", "x9"]
    passage = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(passage(rng.choice((0, 1, 3, 5, 6, 9, 20))))) for i in range(25)]
    items += [(7, items[3][1]), (40, items[3][1]), (None, " ".join(passage(6))), (50, None)]
    docs = []
    for i in range(120):
        body = passage(rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            part = split(rng.choice(items)[1])
            a = rng.randint(0, len(part))
            at = rng.randint(0, len(body))
            body[at:at] = part[a : a + rng.randint(0, 12)]
        docs.append((i, rng.choice((" ", ", ", "-\n")).join(body)))
    docs += [(None, docs[0][1]), (5, docs[5][1]), (5, docs[5][1])]
    got, want = run(spark, docs, items, 5), expected(docs, items, 5)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(bool(h) for *_, h, _ in want) > 50


def test_every_shared_window_has_its_fingerprint():
    """The fingerprint of a window doesn't depend on what stands around it, also with ties."""
    rng = random.Random(1)
    for length in range(1, 12):
        window = [rng.choice("ab") for _ in range(length)]
        _, own, place = D.fingerprints(D.words_of(" ".join(window)), length)
        before, after = ([rng.choice("abc") for _ in range(20)] for _ in range(2))
        _, least, at = D.fingerprints(D.words_of(" ".join([*before, *window, *after])), length)
        assert least[20] == own[0] and at[20] == place[0] + 20
        # one position in each window's k-grams is kept
        assert (np.diff(at) >= 0).all() or length > 1


def test_winnowing_keeps_few_positions():
    rng = random.Random(2)
    _, _, place = D.fingerprints(D.words_of(" ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000))), 10)
    assert len(np.unique(place)) < 0.32 * 20_000


def test_filter_doesn_t_decide(spark, monkeypatch):
    """With a filter of 64 bits everything gets through, and the join still decides."""
    docs = [(i, f"x{i} " + " ".join(f"w{j}" for j in range(i, i + 15))) for i in range(40)]
    items = [(1, " ".join(f"w{j}" for j in range(10, 25))), (2, "lonely words")]
    want = sorted(map(repr, expected(docs, items)))
    assert sorted(map(repr, run(spark, docs, items))) == want
    monkeypatch.setattr(D, "BITS", 6)
    assert sorted(map(repr, run(spark, docs, items))) == want


def test_odd_documents(spark, odd_docs):
    items = spark.createDataFrame([(1, "one two three four"), (1, "six seven eight"), (2, None), (3, " \t"), (None, "word5 word6"), (4, "Ünï çødé"), (5, "ünï ÇØDÉ")], "item_id long, text string")
    rows = D.contaminated(odd_docs, items).collect()
    pairs = [(r.item_id, r.text) for r in items.collect()]
    want = []
    for r in odd_docs.collect():
        n, hit, found = brute(r.text, pairs, D.WINDOW)
        want.append((r.doc_id, n, len(hit), sorted(found)))
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_hit, sorted(r["items"] or [])) for r in rows))) == sorted(map(repr, want))
    assert D.contaminated(odd_docs.limit(0), items).count() == 0
    assert D.contaminated(odd_docs, items.limit(0)).filter("n_hit > 0 OR items IS NOT NULL").count() == 0


def test_passage_of_many_documents_and_items(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.range(3000).selectExpr("id AS doc_id", f"concat('own ', id, ' {passage} end') AS text")
    items = spark.range(300).selectExpr("id AS item_id", f"concat('{passage} x', id) AS text")
    got = D.contaminated(docs, items).groupBy("n_hit", F_size("items")).count().collect()
    assert [tuple(r) for r in got] == [(60, 300, 3000)]


def F_size(name):
    from pyspark.sql import functions as F

    return F.size(name)


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS FROM '{folder}/{name}.parquet'")
    rows = con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({D.ORACLE})").fetchall()
    got = D.op12_decontamination(spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(rows) and any(r.contaminated for r in got)
    assert {r.items_sha256 for r in got if not r.contaminated} == {hashlib.sha256(b"").hexdigest()}
