"""Tables that grow by segments: what a batch adds is written once, and a manifest says which segments count.

A segment is a folder with a part of each table, in the table's order.  A new
manifest is published by a rename, so readers see all of a batch or nothing of
it, and a batch that was published before is left alone.  Segments of about the
same size are merged when there are ``FAN`` of them, so a row is written again
once for each power of ``FAN`` that its table has grown by.  A folder that no
manifest names was left by a writer that failed; nothing reads it.

There is one writer at a time; readers need no lock, and what a merge replaced
stays until the next one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage

#: Segments of one size that are merged.
FAN = 8


@dataclass(frozen=True)
class Table:
    """The columns of a table, and those in whose order a segment holds it, if any."""

    schema: str
    order: tuple[str, ...]


class Segments:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table], fan: int = FAN) -> None:
        self.spark, self.path, self.tables, self.fan = spark, path, tables, fan

    def manifest(self) -> dict:
        """version, segments (name and rows of each table), the last batch of each source, and folders that are no longer named."""
        names = storage.listed(self.spark, f"{self.path}/manifests")
        if not names:
            return {"version": 0, "segments": [], "batches": {}, "retired": []}
        return json.loads(storage.read_text(self.spark, f"{self.path}/manifests/{max(n for n in names if n.endswith('.json'))}"))

    def read(self, table: str, manifest: dict | None = None) -> DataFrame:
        """All rows of a table, as of a manifest."""
        named = [s for s in (manifest or self.manifest())["segments"] if table in s["rows"]]
        return self._read(table, [f"{self.path}/{s['name']}/{table}" for s in named])

    def _read(self, table: str, paths: list[str]) -> DataFrame:
        schema = self.tables[table].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def new_segment(self) -> str:
        return f"segment-{uuid.uuid4().hex}"

    def write(self, segment: str, table: str, rows: DataFrame) -> DataFrame:
        """A segment's part of a table, written and read back."""
        path, kind = f"{self.path}/{segment}/{table}", self.tables[table]
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(kind.schema)))
        (rows.repartitionByRange(*kind.order).sortWithinPartitions(*kind.order) if kind.order else rows).write.parquet(path)
        return self._read(table, [path])

    def append(self, source: str, batch: int, fill: Callable[[str], dict[str, DataFrame]]) -> bool:
        """Publish what ``fill`` wrote in a new segment, as batch number ``batch`` of a source; False for a batch that is there already."""
        manifest = self.manifest()
        if batch <= manifest["batches"].get(source, -1):
            return False
        segment = self.new_segment()
        rows = {table: n for table, part in fill(segment).items() if (n := part.count())}
        added = [{"name": segment, "rows": rows}] if rows else []
        self._publish(manifest | {"segments": [*manifest["segments"], *added], "batches": manifest["batches"] | {source: batch}})
        return True

    def merge(self) -> int:
        """Merge segments while ``fan`` of them are of one size; the number of segments that are left."""
        while True:
            manifest = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for s in manifest["segments"]:
                tiers.setdefault(self._tier(sum(s["rows"].values())), []).append(s)
            full = next((tiers[k] for k in sorted(tiers) if len(tiers[k]) >= self.fan), None)
            if full is None:
                return len(manifest["segments"])
            segment, names = self.new_segment(), {s["name"] for s in full}
            rows: dict[str, int] = {}
            for table in self.tables:
                if parts := [s for s in full if table in s["rows"]]:
                    self.write(segment, table, self._read(table, [f"{self.path}/{s['name']}/{table}" for s in parts]))
                    rows[table] = sum(s["rows"][table] for s in parts)
            for name in manifest["retired"]:
                storage.remove(self.spark, f"{self.path}/{name}")
            left = [s for s in manifest["segments"] if s["name"] not in names]
            self._publish(manifest | {"segments": [*left, {"name": segment, "rows": rows}], "retired": sorted(names)})

    def _tier(self, rows: int) -> int:
        tier = 0
        while rows >= self.fan:
            rows, tier = rows // self.fan, tier + 1
        return tier

    def _publish(self, manifest: dict) -> None:
        version = manifest["version"] + 1
        storage.publish_text(self.spark, f"{self.path}/manifests/{version:012d}.json", json.dumps(manifest | {"version": version}))


def added_up(parts: DataFrame, by: list[str]) -> DataFrame:
    """Statistics of all segments: sums of the other columns."""
    others = [c for c in parts.columns if c not in by]
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in others]
    return parts.groupBy(*by).agg(*sums)
