import corpus_pipeline
from mediaquarry.llm import lines, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_stages_against_their_definitions(spark):
    from tests.llm.test_copies import brute as brute_copies
    from tests.llm.test_lines import brute, hashed

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    clean = stages["toxicity"](spark, docs, FOLDER).cache()
    scores = {r.doc_id: r.predicted for r in toxicity.op2_toxicity(spark, FOLDER).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {i for i, p in scores.items() if not p}

    cut = stages["line_dedup"](spark, clean, FOLDER).cache()
    want = {d[0]: v[0] for d, v in brute(hashed(spark, [(r.doc_id, r.text) for r in clean.collect()]), lines.MIN_WORDS).items()}
    assert cut.columns == columns and {r.doc_id: r.text for r in cut.collect()} == want
    changed = {r.doc_id: r.text for r in clean.collect()}
    assert all(r.n_chars == len(r.text) for r in cut.collect() if changed[r.doc_id] != r.text)

    single = stages["simhash"](spark, cut, FOLDER).cache()
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == brute_copies([(r.doc_id, r.text) for r in cut.collect()])

    packed = stages["packing"](spark, single, FOLDER).collect()
    assert sorted(r.doc_id for r in packed) == sorted(r.doc_id for r in single.collect())
    run = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in run) == sorted(r.doc_id for r in packed)


def test_registered(spark):
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{i}" for i in range(1, 14)}
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_odd_and_empty_documents(spark, odd_docs):
    """Nulls, empty and long texts, repeated rows and clashing names pass all stages; so does a table without rows."""
    for docs in (odd_docs, odd_docs.limit(0)):
        rows = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, rows, FOLDER)
            assert found.columns == docs.columns, name
            rows = found.cache()
            assert {r.n_lines - r.row for r in rows.collect()} <= {0, 1}, name
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, FOLDER).collect()
        assert len(packed) == rows.count() and bool(packed) == (docs is odd_docs)
