import hashlib
import re

import duckdb
import pyarrow as pa
import pytest
from mediaquarry.llm import infill


def brute(doc_id, text, seed=1):
    """n, form, prefix_chars, middle_chars and output, by slices of lists of tokens."""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [None, "", "a", "é", "<", "ab<P>cd", "<S", "x<M", "a b\nc  d", "Zürich 日本語 😀 wörd!", "abc" * 50, "\0\x7f~Zz[`{@", "a<S" * 9, "<P", ">", "1<M>2", "tail😀", "The end.\n"]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, infill.BLOCK])
def test_as_brute_force_whatever_the_block(monkeypatch, block):
    monkeypatch.setattr(infill, "BLOCK", block)
    ids = [*range(len(TEXTS) * 30 - 1), None]
    texts = TEXTS * 30
    column = pa.array(["skipped", *texts], pa.string())[1:]
    found = infill.transformed(column, ids, 1, 90, 20)
    got = list(zip(*(found[k].to_pylist() for k in ("n", "form", "prefix_chars", "middle_chars", "output")), strict=True))
    assert got == [brute(i, t) for i, t in zip(ids, texts, strict=True)]
    assert {r[1] for r in got} == {"plain", "psm", "spm"}


def test_odd_documents(spark, odd_docs):
    docs = odd_docs.withColumnRenamed("score", "form")
    rows = infill.fill_in_middle(docs).withColumn("back", infill.restored(infill.F.col("output"), infill.F.col("form"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert infill.fill_in_middle(docs).columns == [c for c in docs.columns if c not in infill.RESULTS] + [*infill.RESULTS]
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_a_text_of_many_blocks(spark):
    text = "Wörter und words, " * 300_000
    (row,) = infill.fill_in_middle(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == brute(1, text)


def test_restores_markers_next_to_pieces(spark):
    """Pieces that end or begin with parts of a marker."""
    docs = [(i, t) for i, t in enumerate(["<" * 9, "<P" * 7, "S>" * 7, "<<S", "M>P>"] * 20)]
    rows = infill.fill_in_middle(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows.filter(infill.restored(infill.F.col("output"), infill.F.col("form")) != infill.F.col("text")).count() == 0


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet'")
    rows = con.execute(f"SELECT doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 FROM ({infill.ORACLE})").fetchall()
    assert sorted(map(tuple, infill.op11_fill_in_middle(spark, folder).collect())) == sorted(rows)
