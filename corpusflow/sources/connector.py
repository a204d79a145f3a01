"""A Spark data source of work items behind connectors: batch and stream reads of what is new since an offset.

A connector has left its items as Parquet files in a folder for each source, `<path>/source=<name>/`. Each source has an
offset of its kind: a time or a whole number, which is compared with the items' order column, or a token, the name of
the last page (file) that was read. Only footers are read to find what is new; a read then takes the files, and of them
the row groups, that can hold items after the start and up to the end.

On a stream Spark writes the end of a batch to its checkpoint before the batch and its commit after the sink has taken
it, so a run that ends in between repeats the same items, and a sink that overwrites by batch holds each once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "connector_items"
KINDS = ("time", "number", "token")


@dataclass
class Pages(InputPartition):
    """Files of one source, and the offsets that its items lie between; None: no bound."""

    source: str
    files: list[str]
    start: str | int | None
    end: str | int | None


def _shown(value) -> str | int:
    """An order value as it stands in an offset."""
    if isinstance(value, datetime):
        return (value if value.tzinfo else value.replace(tzinfo=UTC)).astimezone(UTC).isoformat(timespec="microseconds")
    return int(value)


class _Folder:
    """The files below the path, by source."""

    def __init__(self, options: dict[str, str]):
        self.path, self.order, self.kind = options["path"], options.get("order", "ts"), options.get("kind", "time")
        self.files_a_task = int(options.get("files_a_task", 16))
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {KINDS}")

    def open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or not self.path.startswith("file:") else "file://" + self.path.removeprefix("file:"))

    def sources(self) -> dict[str, list[str]]:
        system, root = self.open()
        found: dict[str, list[str]] = {}
        for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = f.path.removeprefix(root.rstrip("/") + "/").split("/")
            hidden = any(part.startswith(("_", ".")) for part in name)
            if f.is_file and not hidden and name[0].startswith("source=") and f.path.endswith(".parquet"):
                found.setdefault(name[0].removeprefix("source="), []).append(f.path)
        return {s: sorted(files) for s, files in sorted(found.items())}

    def last(self, files: list[str]) -> str | int | None:
        """The greatest order value of some files, from their footers; of pages the last name."""
        if self.kind == "token":
            return files[-1].rsplit("/", 1)[1]
        system, values = self.open()[0], []
        for f in files:
            meta = pq.read_metadata(system.open_input_file(f))
            at = meta.schema.names.index(self.order)
            told = meta.schema.column(at).physical_type != "INT96"  # such times have no order in a footer
            stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
            if told and all(x is not None and (x.has_min_max or x.num_values == 0) for x in stats):
                values += [x.max for x in stats if x.has_min_max]
            else:
                values.append(pc.max(pq.read_table(system.open_input_file(f), columns=[self.order])[self.order]).as_py())
        known = [_shown(v) for v in values if v is not None]
        return max(known) if known else None

    def latest(self) -> dict[str, str | int]:
        return {s: v for s, files in self.sources().items() if (v := self.last(files)) is not None}

    def pages(self, start: dict, end: dict) -> list[Pages]:
        out = []
        for source, files in self.sources().items():
            a, b = start.get(source), end.get(source)
            if b is None or a == b:
                continue
            if self.kind == "token":
                files = [f for f in files if (a is None or f.rsplit("/", 1)[1] > a) and f.rsplit("/", 1)[1] <= b]
            out += [Pages(source, files[i : i + self.files_a_task], a, b) for i in range(0, len(files), self.files_a_task)]
        return out

    def read(self, pages: Pages, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        system = self.open()[0]
        names = [n for n in schema.names if n != "source"]
        bounds = None
        if pages.end is None:
            return
        if self.kind != "token":
            value = (lambda v: pa.scalar(datetime.fromisoformat(v), pa.timestamp("us", "UTC"))) if self.kind == "time" else int
            bounds = ds.field(self.order) <= value(pages.end)
            if pages.start is not None:
                bounds &= ds.field(self.order) > value(pages.start)
        for f in pages.files:
            table = ds.dataset(f, filesystem=system, format="parquet")
            if self.kind == "time" and pa.types.is_timestamp(kind := table.schema.field(self.order).type) and kind.tz is None:
                plain = lambda v: pa.scalar(datetime.fromisoformat(v).replace(tzinfo=None), pa.timestamp("us"))
                bounds = ds.field(self.order) <= plain(pages.end)
                if pages.start is not None:
                    bounds &= ds.field(self.order) > plain(pages.start)
            for batch in table.to_batches(columns=names, filter=bounds):
                if batch.num_rows:
                    columns = [pa.array([pages.source] * batch.num_rows) if n == "source" else _as(batch.column(n), schema.field(n).type) for n in schema.names]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _as(column: pa.Array, kind: pa.DataType) -> pa.Array:
    if pa.types.is_timestamp(kind) and pa.types.is_timestamp(column.type) and column.type.tz is None and kind.tz:
        column = pc.assume_timezone(column, "UTC")
    return column.cast(kind, safe=False)


class ConnectorItems(DataSource):
    """Options: path; order (the column, default ts) and kind (time, number or token); offsets, for a batch read: JSON of
    the offsets to read after. Without a schema, that of the first file, and the source."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        folder = _Folder(dict(self.options))
        files = [f for found in folder.sources().values() for f in found]
        if not files:
            raise ValueError(f"no items under {folder.path}: give a schema")
        found = pq.read_schema(folder.open()[0].open_input_file(files[0])).remove_metadata()
        utc = [pa.field(f.name, pa.timestamp("us", "UTC")) if pa.types.is_timestamp(f.type) else f for f in found]
        return from_arrow_schema(pa.schema([pa.field("source", pa.string()), *utc]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(dict(self.options), schema)


class _Rows:
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema = options, schema

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _Folder(self.options).read(partition, to_arrow_schema(self.schema))


class _Batch(_Rows, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        folder = _Folder(self.options)
        # a source whose folder is empty keeps its place: Spark asks for one partition at least
        return folder.pages(json.loads(self.options.get("offsets", "{}")), folder.latest()) or [Pages("", [], None, None)]


class _Stream(_Rows, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return json.loads(self.options.get("offsets", "{}"))

    def latestOffset(self) -> dict:
        return _Folder(self.options).latest()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _Folder(self.options).pages(start, end)

    def commit(self, end: dict) -> None:
        """Nothing: what was read stays where it is."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ConnectorItems)
