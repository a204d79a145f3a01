"""File sources: watched folders, attachments, JSON states, JSON lines, recent outputs, samples."""

from __future__ import annotations

import email
import email.policy
import io
import json
import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import once
from corpusflow.operators.retrieval import small
from corpusflow.session import written

MAX_FILES, MAX_BYTES = 10_000, 50 << 20
TEXT_KINDS = ["txt", "md", "csv", "html", "htm", "json", "log"]
# Kinds of attachments.
KINDS = ["pdf", "docx", "doc", "xlsx", "xls", "pptx", "ppt", "md", "txt", "eml", "msg", "html", "htm", "csv", "png", "jpg", "jpeg", "tiff", "bmp"]
ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "source", "type", "title", "body", "url", "owner", "priority", "status", "timestamp")] + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


def unsafe_path(path: str) -> str | None:
    """Why a folder must not be watched: the root, home, or a direct child of the root, by any link."""
    full = os.path.abspath(os.path.expanduser(path))
    home = os.path.realpath(os.path.expanduser("~"))
    for p in (full, os.path.realpath(full)):
        if p == "/":
            return "the file system's root"
        if p == home or p == os.path.abspath(os.path.expanduser("~")):
            return "the home folder"
        if os.path.dirname(p) == "/":
            return "a direct child of the root"
    return None


def folder(spark: SparkSession, path: str, extensions: list[str], recursive: bool = True, max_files: int = MAX_FILES, content: bool = False) -> DataFrame:
    """(path, mtime, size_bytes[, content]) of files with these extensions; hidden files and folders are left out.

    The cap is a limit of the feature: the first max_files by path.
    """
    if reason := unsafe_path(path):
        raise ValueError(f"{path} is {reason}")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    rest = F.replace("path", F.lit(Path(path).resolve().as_uri().replace("file:///", "file:/")), F.lit(""))
    shown = ~F.regexp_like(rest, F.lit(r"/\."))
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions])
    columns = ["path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"), *(["content"] if content else [])]
    return found.where(shown & kind & (F.col("length") <= MAX_BYTES)).select(*columns).orderBy("path").limit(max_files)


def _xml_text(data: bytes, block: str) -> list[str]:
    """The text of each element `block`, whatever its namespace."""
    root = ElementTree.fromstring(data)
    return ["".join(x.itertext()) for x in root.iter() if x.tag.rsplit("}", 1)[-1] == block]


def _office(data: bytes, kind: str) -> str:
    """Paragraphs of a document, lines of slides, rows of sheets: all are XML in a ZIP."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if kind == "docx":
            return "\n".join(_xml_text(z.read("word/document.xml"), "p"))
        number = lambda n: int("".join(filter(str.isdigit, n)) or 0)
        if kind == "pptx":
            slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
            return "\n".join(x for n in slides for x in _xml_text(z.read(n), "p"))
        shared = _xml_text(z.read("xl/sharedStrings.xml"), "si") if "xl/sharedStrings.xml" in z.namelist() else []
        lines = []
        for n in sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=number):
            for row in (x for x in ElementTree.fromstring(z.read(n)).iter() if x.tag.endswith("}row")):
                cells = [(c.get("t"), "".join(v.text or "" for v in c.iter() if v.tag.rsplit("}", 1)[-1] in ("v", "t"))) for c in row]
                lines.append("\t".join(shared[int(v)] if t == "s" and v else v for t, v in cells))
        return "\n".join(lines)


def _mail(data: bytes) -> str:
    """Subject, then the plain parts, or the HTML parts where there are none."""
    from corpusflow.functions.html import to_markdown

    message = email.message_from_bytes(data, policy=email.policy.default)
    parts = [p for p in message.walk() if p.get_content_maintype() == "text" and not p.get_filename()]
    plain = [p.get_content() for p in parts if p.get_content_subtype() == "plain"]
    return "\n".join([message.get("subject", ""), *(plain or [to_markdown(p.get_content()) for p in parts])]).strip()


def text_of_file(name: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) by the name's ending."""
    from corpusflow.functions.html import to_markdown

    kind = name.rsplit(".", 1)[-1].lower() if "." in name.rsplit("/", 1)[-1] else ""
    try:
        if kind in ("docx", "pptx", "xlsx"):
            return _office(data, kind), None
        if kind == "eml":
            return _mail(data), None
        if kind in ("html", "htm"):
            return to_markdown(data.decode("utf-8", "replace")), None
        if kind in TEXT_KINDS:
            return data.decode("utf-8", "replace"), None
    except Exception as e:  # noqa: BLE001  a broken attachment is a row with its error
        return None, f"{type(e).__name__}: {e}"
    return None, f"no reader for {kind}" if kind in KINDS else f"Unsupported file type: .{kind}"


_EXTRACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_EXTRACTED)
def _extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for names, contents in batches:
        yield pd.DataFrame([text_of_file(n, bytes(c)) for n, c in zip(names, contents, strict=True)], columns=["text", "error"])


def extracted(files: DataFrame) -> DataFrame:
    """files (path, content) with text, content_hash and error. Text, HTML, mail and Office's XML files are read; binary
    Office files, PDF and images need libraries that are not here, and are error rows, as unknown and broken files are."""
    rows = files.withColumn("__x", once(_extract)(F.col("path"), F.col("content")))
    return rows.select(*[c for c in files.columns if c != "content"], F.col("__x.text").alias("text"), F.substring(F.sha2("__x.text", 256), 1, 12).alias("content_hash"), F.col("__x.error").alias("error"))


def json_state(path: str) -> dict:
    """A small JSON state of the driver; {} if there is none. A broken file ends the run with its name."""
    p = Path(path)
    if not p.exists():
        return {}
    try:
        found = json.loads(p.read_text(encoding="utf-8"))
    except ValueError as e:
        raise SystemExit(f"{path}: not valid JSON: {e}") from e
    return found


def write_json_state(path: str, state: dict) -> None:
    """Replaced at once, by a rename."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=target.parent, delete=False, encoding="utf-8") as f:
        json.dump(state, f)
    os.replace(f.name, target)


def items(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Work items of files that hold a JSON array or object each, or one object a line, which are read in splits."""
    return spark.read.schema(ITEM).option("multiLine", not lines).json(path)


#: Bytes that a tail reads first.
TAIL_BLOCK = 1 << 16


def json_lines_tail(lines: DataFrame, schema: str, n: int, line_no: str = "line_no", value: str = "value", strict: bool = False) -> DataFrame:
    """The last n lines that parse; strict raises on one that does not."""
    parsed = lines.where(F.trim(value) != "").withColumn("__j", F.try_parse_json(value))
    if strict:
        parsed = parsed.withColumn("__j", F.when(F.col("__j").isNull(), F.raise_error(F.concat(F.lit("bad line "), F.col(line_no))).cast("variant")).otherwise(F.col("__j")))
    kept = parsed.where(F.col("__j").isNotNull()).orderBy(F.desc(line_no)).limit(n)
    return kept.select(line_no, F.from_json(value, schema).alias("r")).select(line_no, "r.*").orderBy(line_no)


def tail_lines(spark: SparkSession, path: str, n: int, fits: Callable[[str], bool] = lambda line: bool(line.strip()), block: int = TAIL_BLOCK) -> list[str]:
    """The last n lines that fit, in order, of a file or of a folder's files by time and name. Files are read from their
    end, a range at a time, until enough lines are there, so the cost does not grow with the file."""
    jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    held = sorted((s.getModificationTime(), s.getPath().getName(), s.getLen(), s.getPath()) for s in fs.listStatus(at) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
    out: list[str] = []
    for _, _, size, file in reversed(held):
        span, found = block, []
        while True:
            start = max(0, size - span)
            stream = fs.open(file)
            try:
                stream.seek(start)
                data = jvm.org.apache.commons.io.IOUtils.toString(stream, "ISO-8859-1").encode("latin-1")
            finally:
                stream.close()
            lines = data.split(b"\n")
            whole = lines if start == 0 else lines[1:]  # the first may have begun before
            found = [t for x in whole if fits(t := x.decode("utf-8", "replace").removesuffix("\r"))]
            if start == 0 or len(found) + len(out) >= n:
                break
            span *= 4
        out = found + out
        if len(out) >= n:
            break
    return out[-n:] if n > 0 else []


def json_tail(spark: SparkSession, path: str, schema: str, n: int, strict: bool = True) -> DataFrame:
    """The last n records of JSON lines, in order, from the files' ends. strict: a line among them that is no JSON
    object raises; else such lines do not count. Blank lines never do."""

    def parses(line: str) -> bool:
        try:
            return isinstance(json.loads(line), dict)
        except ValueError:
            return False

    lines = tail_lines(spark, path, n) if strict else tail_lines(spark, path, n, parses)
    if bad := [x for x in lines if not parses(x)]:
        raise ValueError(f"{path}: not a record: {bad[0][:200]!r}")
    rows = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    return rows.select("line_no", F.from_json("value", schema).alias("r")).select("line_no", "r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file in order, read in splits: a line's number is its place in its task plus the lines
    of the tasks before, of which there are as many as splits."""
    lines = written(spark.read.text(path).select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "value"), "lines")
    counts = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", "first", before.alias("before"))
    return lines.join(small(starts), "part").select((F.col("at") - F.col("first") + F.col("before")).alias("line_no"), "value")


def recent(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy(F.desc("mtime"), "path").limit(n)


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash: the same rows whatever the partitions."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def watch_rows(spark: SparkSession, watches: list[dict]) -> DataFrame:
    """(path, label, extensions, recursive); a watch without a label takes its folder's name."""
    rows = [(w["path"], w.get("label") or os.path.basename(w["path"].rstrip("/")), w.get("extensions", TEXT_KINDS), bool(w.get("recursive", True))) for w in watches]
    return spark.createDataFrame(rows, "path string, label string, extensions array<string>, recursive boolean")


def first_by(rows: DataFrame, by: Column, order: list[Column]) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("__n", at).where("__n = 1").drop("__n")
