import hashlib
import random
import re

from mediaquarry.llm import lines


def brute(docs, least):
    """What is left of each (id, text): a line goes if it lies in a stretch of ``least`` words or more that occurs earlier.

    All stretches of all documents are compared as lists of lines.  In one text
    a stretch of the fewest lines is later beyond the lines of its first occurrence.
    """
    keyed = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0, d[2]))
    first, gone, texts = {}, {}, []
    for number, doc in enumerate(keyed):
        stripped = [r.strip(" \t\x0b\x0c\r") for r in (doc[1] or "").split("\n")]
        at = [i for i, r in enumerate(stripped) if r]
        words = [len(re.split(r"[ \t\x0b\x0c\r]+", stripped[i])) for i in at]
        texts.append((stripped, at))
        for k in range(len(at)):
            for m in range(k, len(at)):
                total = sum(words[k : m + 1])
                if total >= least:
                    # of longer stretches every line lies in one without a line too many at either end
                    if total - words[k] < least or total - words[m] < least:
                        body = tuple(stripped[i] for i in at[k : m + 1])
                        if body not in first:
                            first[body] = number, at[m]
                        elif first[body][0] < number or at[k] > first[body][1]:
                            gone.setdefault(number, set()).update(range(at[k], at[m] + 1))
                    else:
                        break
    out = {}
    for number, doc in enumerate(keyed):
        rows = (doc[1] or "").split("\n")
        cut = gone.get(number, set())
        out[doc] = (doc[1] if not cut else "\n".join(r for i, r in enumerate(rows) if i not in cut), len(cut))
    return out


def run(spark, docs, least):
    df = spark.createDataFrame([(d, t) for d, t in docs], "doc_id long, text string")
    return [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.without_repeats(df, least).collect()]


def hashed(spark, docs):
    """The hash that orders texts under one id."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", "text", F.xxhash64("text").alias("h"))
    return [(r.doc_id, r.text, r.h) for r in df.collect()]


def test_as_brute_force(spark):
    rng = random.Random(7)
    pool = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice((1, 2, 3, 6)))) for _ in range(25)]
    passage = [rng.choice(pool) for _ in range(8)]
    docs = []
    for i in range(150):
        rows = [rng.choice(pool) for _ in range(rng.randint(0, 14))]
        if rng.random() < 0.5:
            at, a = rng.randint(0, len(rows)), rng.randint(0, 4)
            rows[at:at] = passage[a : rng.randint(a, 8)]
        if rng.random() < 0.3:
            rows.insert(rng.randint(0, len(rows)), rng.choice(("", "  ", "\t", "w1 w2 \u2028", " \x85 w3\r", "\u2028")))
        docs.append((i, "\n".join(rows)))
    docs += [(500, "\n".join(["a b c"] * 30)), (None, docs[3][1]), (501, docs[3][1]), (501, docs[3][1]), (501, docs[4][1])]
    want = brute(hashed(spark, docs), 9)
    got = run(spark, docs, 9)
    assert len(got) == len(docs) and sum(n for *_, n in got) > 100
    by = {(d, t): v for (d, t, _), v in want.items()}
    assert sorted(map(repr, ((d, t, n) for d, t, _, n in got))) == sorted(map(repr, ((d, *by[d, t]) for d, t in docs)))


def test_long_line_is_a_window_of_its_own(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    got = {d: t for d, t, *_ in run(spark, [(1, f"own one\n{passage}\nend"), (2, f"{passage}\nother"), (3, f"x\n  {passage} "), (4, "short\nshort\nshort")], 50)}
    assert got == {1: f"own one\n{passage}\nend", 2: "other", 3: "x", 4: "short\nshort\nshort"}


def test_odd_documents(spark, odd_docs):
    got = lines.without_repeats(odd_docs)
    assert got.columns == [c for c in odd_docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    assert {r.text for r in rows if r.doc_id in (0, 1)} == {None, ""}
    assert lines.without_repeats(odd_docs.limit(0)).count() == 0


def test_runs_are_extended_to_their_ends(spark):
    """Lines of 60 and 45 words, of 45 and 60, and of 30, 30 and 10 go whole; so do the short last lines of a copy."""
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    runs = [[line("a", 60), line("b", 45)], [line("c", 45), line("d", 60)], [line("e", 30), line("f", 30), line("g", 10)], [line("h", 70), "one", "two three"]]
    docs = [(i, "\n".join([f"own {i}", *rows, f"end {i}"])) for i, rows in enumerate(runs)]
    docs += [(10 + i, "\n".join([f"other {i}", *rows, f"last {i}"])) for i, rows in enumerate(runs)]
    assert {d: t for d, t, *_ in run(spark, docs, 50)} == {**dict(docs[:4]), **{10 + i: f"other {i}\nlast {i}" for i in range(4)}}


def test_no_python_in_any_plan(spark, monkeypatch, capsys):
    """Every table on the way is written from a plan without Python; writing cuts it off the next."""
    write = lines.write_table

    def shown(df, name):
        df.explain()
        return write(df, name)

    monkeypatch.setattr(lines, "write_table", shown)
    lines.op5_line_dedup(spark, "/root/testdata/sf0.001").explain()
    out = capsys.readouterr().out
    assert out.count("Physical Plan") == 6 and not re.search("Python|Pandas|Arrow", out)


def test_md5_column(spark):
    rows = lines.op5_line_dedup(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        if not r.n_removed:
            assert r.text_md5 == hashlib.md5(texts[r.doc_id].encode()).hexdigest()
