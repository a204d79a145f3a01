"""Sinks: versioned tables, appended feedback, reports, event rows, backups."""

from __future__ import annotations

import gzip
import hashlib
import json
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.session import written

# Sections of an audit, in order.
SECTIONS = ["quality", "capability", "redteam", "locale_probes"]

_SECRET = r"(?i)(^|/)(_raw|\.env|secrets?|credentials?|tokens?)(/|\.|$)|\.(pem|key|p12)$"


class VersionedTable:
    """A table as data folders and numbered manifests, each of which lists the folders of one version.

    A manifest is written under another name and renamed, after its data; readers take the one with the highest number,
    so they never see a half-written version. Rows lie in folders by the hash of their keys, and merge() writes only the
    folders that its rows fall into again: a small batch costs its own buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        jvm, fs = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())

    def _manifest(self) -> dict:
        found = self.versions()
        if not found:
            return {"folders": {}, "keys": [], "schema": None}
        return json.loads(self.spark.read.text(f"{self.path}/v{found[-1]}.json", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> int:
        jvm, fs = self._fs()
        version = (self.versions() or [0])[-1] + 1
        path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        hidden = path(f"_v{version}-{uuid.uuid4().hex}")
        out = fs.create(hidden, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(path(f"v{version}.json")) or not fs.rename(hidden, path(f"v{version}.json")):
            raise RuntimeError(f"another writer made version {version} of {self.path}")
        return version

    def _read(self, folders: list[str], schema: str | None) -> DataFrame | None:
        if schema is None:
            return None
        kind = T.StructType.fromJson(json.loads(schema))
        if not folders:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame | None:
        manifest = self._manifest()
        return self._read(sorted(manifest["folders"].values()), manifest["schema"])

    def _write(self, df: DataFrame, keys: list[str]) -> dict[str, str]:
        """Folders by bucket, new ones."""
        folder = f"data-{uuid.uuid4().hex}"
        bucket = F.pmod(F.hash(*keys), F.lit(self.buckets)) if keys else F.lit(0)
        df.withColumn("__bucket", bucket).write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        jvm, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}"))]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("__bucket=")}

    def write(self, df: DataFrame, keys: list[str] | None = None) -> int:
        """All of df as the next version."""
        return self._publish({"folders": self._write(df, keys or []), "keys": keys or [], "schema": df.schema.json()})

    def merge(self, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> int:
        """The last version with new's rows in place of those with the same keys, as the next version. See upsert()."""
        from corpusflow.operators.state import upsert

        manifest = self._manifest()
        if manifest["schema"] is None or manifest["keys"] != keys:
            old = self.read()
            empty = new.limit(0) if old is None else old
            return self.write(upsert(empty, new, keys, order), keys)
        touched = {str(r.b) for r in new.select(F.pmod(F.hash(*keys), F.lit(self.buckets)).alias("b")).distinct().collect()}
        old = self._read([f for b, f in manifest["folders"].items() if b in touched], manifest["schema"])
        folders = {b: f for b, f in manifest["folders"].items() if b not in touched}
        return self._publish(manifest | {"folders": folders | self._write(upsert(old, new, keys, order), keys)})

    def create(self, schema: str) -> None:
        """An empty first version, unless there is one."""
        if not self.versions():
            self._publish({"folders": {}, "keys": [], "schema": self.spark.createDataFrame([], schema).schema.json()})


def append_feedback(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def event_rows(steps: DataFrame, by: str, order: Column) -> DataFrame:
    """(by, seq, type, payload) of steps (by, type, payload): what a server would stream to each request."""
    seq = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return steps.select(by, seq.alias("seq"), "type", "payload")


def report_json(summary: DataFrame) -> DataFrame:
    """One JSON document a row."""
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("report"))


def condensed(sections: DataFrame) -> DataFrame:
    """sections (section, summary) of an audit that a short answer names, in its order."""
    at = F.array_position(F.array(*[F.lit(x) for x in SECTIONS]), F.col("section"))
    return sections.where(at > 0).select("section", "summary", at.alias("place"))


def audit_markdown(sections: DataFrame, title: str, facts: dict[str, str]) -> DataFrame:
    """(report): one page of Markdown over sections (section, summary), a row each, which are few."""
    head = "\n".join([f"# {title}", "", *(f"- {k}: `{v}`" for k, v in facts.items()), "", ""])
    part = F.concat(F.lit("## "), "section", F.lit("\n\n```json\n"), "summary", F.lit("\n```\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("section", part.alias("p")))), lambda x: x.p)
    return sections.agg(F.concat(F.lit(head), F.array_join(parts, "\n")).alias("report"))


def as_html(report: Column, title: str) -> Column:
    """A Markdown page shown as text in HTML."""
    safe = F.replace(F.replace(F.replace(report, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit(f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{title}</title></head>\n<body><pre>'), safe, F.lit("</pre></body></html>\n"))


def security_markdown(title: str, tally: DataFrame, breaches: DataFrame, order: list[str], top: int = 10) -> DataFrame:
    """(report): one page of Markdown: a table over tally, a row a guard, which are few, by its first column; then the first
    `top` breaches in an order, as JSON. Null cells are empty."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in tally.columns]), F.lit(" |"))
    lines = tally.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(tally.columns[0]).alias("k"), cells.alias("l")))), lambda x: x.l).alias("rows"))
    place = F.row_number().over(Window.orderBy(*order))  # of `top` rows
    first = breaches.orderBy(*order).limit(top).select(place.alias("k"), F.concat(F.lit("- "), F.to_json(F.struct(*breaches.columns))).alias("l"))
    shown = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "l"))), lambda x: x.l).alias("first"))
    head = "\n".join([f"# {title}", "", "| " + " | ".join(tally.columns) + " |", "|" + "---|" * len(tally.columns), ""])
    page = F.concat(F.lit(head), F.array_join("rows", "\n"), F.lit(f"\n\n## First {top} breaches\n\n"), F.array_join("first", "\n"), F.lit("\n"))
    return lines.crossJoin(F.broadcast(shown)).select(page.alias("report"))  # one row each


def backup_listing(files: DataFrame) -> DataFrame:
    """files (path, content) that a backup takes: no secrets and no raw folders; with sha256."""
    return files.where(~F.col("path").rlike(_SECRET)).select("path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("size_bytes"))


def write_backup(files: DataFrame, out: str) -> DataFrame:
    """Writes files (path, content) that a backup takes as parts under out, and gives back the manifest.

    Each task writes one part, a row of gzip members that hold a tar entry each, under a name of its own; a part counts
    if the manifest names it, so a task that ran twice leaves nothing twice. The parts in the order of their numbers, and
    then the end part, are one .tar.gz: no task and not the driver holds more than a file. Manifest (also written, to
    out/manifest): path, part, part_no, offset and stored (where the member is in its part), start (of the part in the
    archive), size_bytes, sha256. The end part's row has no path. Paths lose a leading slash; repeated ones are repeated
    entries, of which readers take the last.
    """
    spark = files.sparkSession
    kept = files.where(~F.col("path").rlike(_SECRET) & F.col("content").isNotNull()).select(F.regexp_replace("path", "^/+", "").alias("path"), "content")
    schema = "path string, part string, part_no int, offset long, stored long, size_bytes long, sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId()
        name, sink, at = f"part-{no:06d}-{uuid.uuid4().hex}.tar.gz", None, 0
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                if sink is None:
                    system, root = pafs.FileSystem.from_uri(out if "://" in out else f"file://{out.removeprefix('file:')}")
                    system.create_dir(root, recursive=True)
                    sink = system.open_output_stream(f"{root}/{name}", compression=None)
                entry = tarfile.TarInfo(path)
                entry.size = len(data)
                member = gzip.compress(entry.tobuf(tarfile.PAX_FORMAT) + data + bytes(-len(data) % 512), mtime=0)
                sink.write(member)
                rows.append((path, name, no, at, len(member), len(data), hashlib.sha256(data).hexdigest()))
                at += len(member)
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "part", "part_no", "offset", "stored", "size_bytes", "sha256"])
        if sink is not None:
            sink.close()

    entries = written(kept.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(run, schema), "backup")
    starts, total = [], 0
    for r in sorted(entries.groupBy("part_no").agg(F.sum("stored").alias("n")).collect()):  # one row a task
        starts.append((r.part_no, total))
        total += r.n
    end = gzip.compress(bytes(1024), mtime=0)
    system, root = pafs.FileSystem.from_uri(out if "://" in out else f"file://{out.removeprefix('file:')}")
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/end.tar.gz", compression=None) as f:
        f.write(end)
    last = spark.createDataFrame([(None, "end.tar.gz", 2**31 - 1, 0, len(end), 0, None, total)], f"{schema}, start long")
    manifest = entries.join(F.broadcast(spark.createDataFrame(starts, "part_no int, start long")), "part_no").select(*last.columns).unionByName(last)
    manifest.write.mode("overwrite").parquet(f"{out}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{out}/manifest")
