from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
import pytest

from mediaquarry.llm import _store, hmm, kdtree, packing, partitions, simhash
from mediaquarry.sources.storage import shared_dir

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [packing.op9_packing, simhash.op8_simhash, kdtree.op10_kdtree, partitions.op3_learned_partitions, hmm.op4_hmm])
def test_only_the_result_is_left_and_no_setting_changes(spark, query):
    folder = Path(urlparse(shared_dir(spark)).path) / "mediaquarry"
    before = {p.name for p in folder.glob("*")}
    settings = dict(spark.conf.getAll)
    rows = query(spark, FOLDER).count()
    assert rows and len({p.name for p in folder.glob("*")} - before) == 1
    assert dict(spark.conf.getAll) == settings


def test_scratch_tables_go_when_something_fails(spark):
    folder = Path(urlparse(shared_dir(spark)).path) / "mediaquarry"
    before = {p.name for p in folder.glob("*")}
    with pytest.raises(ZeroDivisionError), _store.scratch():
        _store.write_table(spark.range(3), "numbers")
        1 / 0  # noqa: B018
    assert {p.name for p in folder.glob("*")} == before


def test_slices():
    batch = pa.RecordBatch.from_pydict({"x": list(range(10))})
    assert [b.column(0).to_pylist() for b in _store.sliced(iter([batch, batch.slice(0, 0), batch.slice(3, 2)]), 4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], [3, 4]]


def test_samples_don_t_vanish_at_any_size(spark):
    """A sample of 8,192 of 1e11 rows: the share of a large range, and of each part of it, is as asked."""
    from pyspark.sql import functions as F

    share = 0.95 * 8_192 / 1e11
    assert 1 <= spark.range(0, 100_000_000, 1, 8).filter(_store.picked(share, "id")).count() <= 25
    some = spark.range(0, 4_000_000, 1, 8)
    assert 3_600 < some.filter(_store.picked(1e-3, "id")).count() < 4_400
    assert some.filter(_store.picked(1.0, "id")).count() == 4_000_000
    assert 3_600 < some.filter(_store.picked(F.least(F.lit(1.0), F.lit(0.001)), "id")).count() < 4_400
