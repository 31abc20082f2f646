"""Byte ranges of files, read by position: no file is ever held whole, and a range is spread over tasks by its pieces.

Paths are what Spark names files by, in stores that Arrow opens too: local
folders, HDFS, S3 and GCS.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blobs
from . import storage


def opened(path: str):
    """A file for positioned reads, None where there is none."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return store.open_input_file(name) if store.get_file_info(name).type == fs.FileType.File else None


def _with_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sizes: dict[str, int | None] = {}
    for batch in batches:
        paths = batch.column(batch.schema.get_field_index("path")).to_pylist()
        for path in {*paths} - sizes.keys():
            file = opened(path) if path is not None else None
            sizes[path] = None if file is None else file.size()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sizes[p] for p in paths], pa.int64())], [*batch.schema.names, "size"])


def read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, offset, bytes, ...) with their content instead of bytes, a batch for each piece."""
    path, file = None, None
    for batch in batches:
        at = batch.schema.get_field_index("bytes")
        for i, (name, offset, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "bytes")), strict=True)):
            if name != path:
                path, file = name, opened(name)
            content = pa.array([file.read_at(size, offset)], pa.binary())
            row = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays([*row.columns[:at], content, *row.columns[at + 1 :]], [*row.schema.names[:at], "content", *row.schema.names[at + 1 :]])


def ranges(requests: DataFrame, piece: int = blobs.PIECE) -> DataFrame:
    """``requests`` (path, header, perhaps more) with size, content_range, piece (from 0), offset (in the file) and content.

    A row for each piece of a range, ``piece`` bytes or less.  A missing file,
    and a range that begins behind the end of its file, has no row; headers are
    read as :func:`blobs.range_bounds` does, and a null one asks for all.
    """
    storage.ship(requests.sparkSession)
    names = [c for c in requests.columns if c not in ("size", "content_range", "piece", "offset", "bytes", "content")]
    asked = requests.select(*names)
    sized = asked.mapInArrow(_with_sizes, T.StructType([*asked.schema, T.StructField("size", T.LongType())])).filter("size IS NOT NULL")
    first, last = blobs.range_bounds(F.coalesce(F.col("header"), F.lit("")), F.col("size"))
    sized = sized.withColumns({"_first": first, "_last": last})
    sized = sized.withColumns({"content_range": blobs.content_range(F.col("_first"), F.col("_last"), F.col("size")), "_sent": blobs.sent(F.col("_first"), F.col("_last"), F.col("size"))})
    cut = sized.select("*", F.explode(blobs.piece_offsets(F.col("_sent"), piece)).alias("_at"))
    cut = cut.select(*names, "size", "content_range", F.floor(F.col("_at") / piece).cast("int").alias("piece"), (F.col("_first") + F.col("_at")).alias("offset"), F.least(F.col("_sent") - F.col("_at"), F.lit(piece)).cast("long").alias("bytes"))
    # a piece of a range is read anywhere; neighbours that meet in a task stand together
    dealt = cut.repartition("path", F.floor(F.col("offset") / (64 * piece))).sortWithinPartitions("path", "offset")
    kinds = [T.StructField("content", T.BinaryType()) if f.name == "bytes" else f for f in dealt.schema]
    return dealt.mapInArrow(read_pieces, T.StructType(kinds))
