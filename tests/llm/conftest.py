import pytest
from pyspark.sql import types as T


@pytest.fixture
def odd_docs(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns with names that operators use."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    same = "one two three four five six seven eight nine ten"
    texts = [None, "", "   \n\t ", same, same, long, "Ünï çødé 日本語 😀", "x" * 5000, "a\nb\n\nc"]
    rows = [(i if i != 2 else None, t, i, f"s{i}", i, 1.5, 7, b"b") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (3, "another text under the same id", 1, "s", 2, 0.5, 8, None)]
    names = "doc_id text row score n_lines id fp bucket".split()
    kinds = [T.LongType(), T.StringType(), T.IntegerType(), T.StringType(), T.IntegerType(), T.DoubleType(), T.IntegerType(), T.BinaryType()]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
