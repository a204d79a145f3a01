"""WARC records in ZIP packages, read in place.

A package is a ZIP with stored (uncompressed) members: archive/data.warc.gz, whose records are gzip members of their
own, and indexes/index.cdxj, one line a record with its offset and length in the archive. The reader parses the end
record, the ZIP64 locator and end record, and the central directory; it locates the stored members' bytes by their
local headers and range-reads index and records straight from the package. Nothing is extracted. Neighbouring records
are read in one range of up to READ_BYTES.

Packages lie in a shared folder (spark.checkpoint.dir). Its address is made absolute by Hadoop's file system, as Spark
would read it, and then opened by pyarrow's file system of the same scheme; a scheme that pyarrow does not know is an
error. A task writes its package under a name of its own; only names in the written manifest are read, so a retried or
lost task leaves no record twice. A package is read in parts of its index (INDEX_BYTES each), so one of any size is
shared by many tasks. ZIP64 fields are written when a size or count needs them, or always with zip64=True.

Rules: a null payload is empty. Records with equal payloads (SHA-1) of at least `min_revisit_bytes` bytes have one
response, that with the smallest id; the others are revisits, without the payload, that name it. Of repeated ids with
that payload the first row read is the response. Null ids stay null and come after all others; where all ids of a
payload are null, there is none to name, and all are responses. A null address stays null; CR and LF in an address are
written as %0D and %0A. Extra columns are ignored. Rows of an empty table give no packages and no records. Members that
are compressed, cut short or damaged (CRC, when read whole) raise ValueError; names that are not marked as UTF-8 are
read as code page 437.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.shared import Scratch, tidy

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
READ_BYTES = 4 << 20
#: Bytes of an index that one part of a package has, about.
INDEX_BYTES = 1 << 20
#: Payload bytes that one package takes, about.
PACKAGE_BYTES = 64 << 20
#: Tasks that read packages, at most.
TASKS = 10_000
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF
_DOS_DATE = 0x5821  # a fixed day: equal input, equal bytes


# --- ZIP ---


@dataclass
class Member:
    name: str
    method: int
    crc: int
    size: int
    stored_size: int
    header: int


class ZipWriter:
    """Appends stored members to a stream that need not seek."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, chunks: Iterator[bytes]) -> None:
        """Sizes follow the data in a descriptor, as they are not known before."""
        raw = name.encode()
        header, crc, size = self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, _DOS_DATE, 0, _MAX32, _MAX32, len(raw), len(extra)) + raw + extra)
        for chunk in chunks:
            self._put(chunk)
            crc, size = zlib.crc32(chunk, crc), size + len(chunk)
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, size, size))
        self.members.append(Member(name, 0, crc, size, size, header))

    def close(self) -> None:
        start = self.at
        for m in self.members:
            raw = m.name.encode()
            wide = [x for x in (m.size, m.stored_size, m.header) if x >= _MAX32 or self.zip64]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            low = lambda x: _MAX32 if x >= _MAX32 or self.zip64 else x
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, _DOS_DATE, m.crc, low(m.stored_size), low(m.size), len(raw), len(extra), 0, 0, 0, 0, low(m.header)) + raw + extra)
        size, n = self.at - start, len(self.members)
        if self.zip64 or max(start, size) >= _MAX32 or n >= _MAX16:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
            n, size, start = _MAX16, _MAX32, _MAX32
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, start, 0))


class ZipDirectory:
    """Members of a package by name, from its directories alone."""

    def __init__(self, file):
        self.file = file
        length = file.size()
        tail_at = max(0, length - 22 - _MAX16)
        tail = self._read(tail_at, length - tail_at)
        found = tail.rfind(b"PK\5\6")
        # a comment may hold the signature: the record's own comment length must reach the file's end
        while found >= 0 and (found + 22 > len(tail) or found + 22 + struct.unpack_from("<H", tail, found + 20)[0] != len(tail)):
            found = tail.rfind(b"PK\5\6", 0, found)
        if found < 0:
            raise ValueError("no end of central directory")
        _, _, _, _, n, size, start, _ = struct.unpack_from("<IHHHHIIH", tail, found)
        if (n == _MAX16 or size == _MAX32 or start == _MAX32) and found >= 20 and tail[found - 20 : found - 16] == b"PK\6\7":
            end = struct.unpack_from("<Q", tail, found - 12)[0]
            record = self._read(end, 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end record where its locator points")
            n, size, start = struct.unpack_from("<QQQ", record, 32)
        directory = self._read(start, size)
        self.members: dict[str, Member] = {}
        at = 0
        for _ in range(n):
            if directory[at : at + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            flags, method, _, _, crc, stored, full, names, extras, comments, _, _, _, header = struct.unpack_from("<HHHHIIIHHHHHII", directory, at + 8)
            raw = directory[at + 46 : at + 46 + names]
            name = raw.decode("utf-8" if flags & 0x800 or raw.isascii() else "cp437", "replace")
            full, stored, header = self._wide(directory[at + 46 + names : at + 46 + names + extras], full, stored, header)
            self.members[name] = Member(name, method, crc, full, stored, header)
            at += 46 + names + extras + comments

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the package is cut short")
        return data

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """ZIP64 values replace those that hold the mark, in order."""
        out, at = list(values), 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                words = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                out = [next(words) if v == _MAX32 else v for v in out]
            at += 4 + n
        return out

    def place(self, name: str) -> tuple[int, int]:
        """(offset in the package, length) of a stored member's bytes."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed; only stored members can be read in place")
        head = self._read(m.header, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("no local header where the directory points")
        names, extras = struct.unpack_from("<HH", head, 26)
        return m.header + 30 + names + extras, m.size

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        at, size = self.place(name)
        data = self._read(at + offset, size - offset if length is None else length)
        if len(data) == size and zlib.crc32(data) != self.members[name].crc:
            raise ValueError(f"{name} does not match its CRC")
        return data

    def lines(self, name: str, start: int, end: int) -> list[bytes]:
        """The lines that begin from `start` to before `end`."""
        _, size = self.place(name)
        before = max(0, start - 1)
        data = self.read(name, before, min(end, size) - before)
        if start:
            cut = data.find(b"\n") + 1
            if not cut:
                return []
            data = data[cut:]
        at = min(end, size)
        while data and not data.endswith(b"\n") and at < size:  # the last line runs over the end
            more = self.read(name, at, min(4096, size - at))
            at += len(more)
            cut = more.find(b"\n") + 1
            data += more[:cut] if cut else more
        return [x for x in data.split(b"\n") if x]


# --- WARC ---


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, payload_bytes: int) -> bytes:
    """One gzip member; a revisit has no payload."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:corpus:{'null' if record_id is None else record_id}>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(payload_bytes)}
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:corpus:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, payload) of one gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


# --- Spark ---


def first_of_payload(keyed: DataFrame, page_id: str) -> DataFrame:
    """(__sha1, __first, __same) of payloads that several rows of keyed have: the smallest id, and how many rows have both."""
    counts = keyed.groupBy("__sha1", page_id).agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct(F.col(page_id).isNull().alias("last"), F.col(page_id).alias("id"), "n")).alias("least")
    groups = counts.groupBy("__sha1").agg(least, F.sum("n").alias("all")).where("all > 1")
    return groups.select("__sha1", F.col("least.id").alias("__first"), F.col("least.n").alias("__same"))


def _folder(pages: DataFrame, path: str) -> str:
    """The folder as an address that pyarrow opens wherever Spark would."""
    context = pages.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(context._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    scheme, _, rest = fs.resolvePath(target).toUri().toString().partition(":")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    if scheme not in ("file", "hdfs", "s3", "gs", "abfs", "abfss"):
        raise ValueError(f"packages cannot be written to a folder of the scheme {scheme}")
    return f"{scheme}://{rest.removeprefix('//')}"


def write_packages(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0, zip64: bool = False, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes all rows as WARC records; the manifest (package string, records long), already written."""
    scratch = Scratch(pages.sparkSession, "warc")
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    keyed = pages.select(F.col(page_id).cast("long").alias(page_id), F.col(url).cast("string").alias(url), F.col(payload).cast("string").alias(payload), F.sha1(F.encode(text, "UTF-8")).alias("__sha1"))
    # groups of two and more only; written, so that a hot payload's rows can be split at the join
    groups = scratch.table(first_of_payload(keyed.where(F.octet_length(F.coalesce(payload, F.lit(""))) >= min_revisit_bytes), page_id), "groups")
    first = F.lit(True)
    if not groups.where("__same > 1 and __first is not null").isEmpty():  # repeated ids: rows need numbers that stay
        keyed = scratch.table(keyed.withColumn("__uid", F.monotonically_increasing_id()), "numbered", compression="zstd")
        least = keyed.join(groups.where("__same > 1"), "__sha1").where(F.col(page_id) == F.col("__first")).groupBy("__sha1").agg(F.min("__uid").alias("__least"))
        groups = scratch.table(groups.join(least, "__sha1", "left"), "first")
        first = (F.col("__same") == 1) | (F.col("__uid") == F.col("__least"))
    joined = keyed.join(groups, "__sha1", "left")
    is_first = F.col(page_id).eqNullSafe(F.col("__first")) & first
    rows = joined.select(page_id, url, payload, F.when(F.col("__first").isNotNull() & ~is_first, F.col("__first")).alias("refers_to"))
    folder = _folder(pages, f"{scratch.root}/packages")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}"
        writer, part = None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                if writer is None:
                    writer = _Package(f"{name}-{part:04d}.zip", zip64)
                writer.add(*(c[i].as_py() for c in batch.columns))
                if writer.raw >= package_bytes:
                    yield writer.close()
                    writer, part = None, part + 1
        if writer is not None:
            yield writer.close()

    return scratch.table(rows.mapInArrow(run, "package string, records long"), "manifest")


class _Package:
    def __init__(self, uri: str, zip64: bool):
        self.uri, self.lines, self.raw, self.at = uri, [], 0, 0
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.zip = ZipWriter(self.out, zip64)
        self.chunks: list[bytes] = []

    def add(self, record_id: int | None, url: str | None, payload: str | None, refers_to: int | None) -> None:
        data = (payload or "").encode()
        digest = sha1_base32(data)
        record = warc_record(record_id, url, b"" if refers_to is not None else data, digest, refers_to, len(data))
        self.lines.append(json.dumps({"id": record_id, "url": url, "digest": digest, "offset": self.at, "length": len(record)}, ensure_ascii=False))
        self.chunks.append(record)
        self.at += len(record)
        self.raw += len(data)

    def close(self) -> pa.RecordBatch:
        self.zip.add(DATA, iter(self.chunks))
        self.zip.add(INDEX, iter(["".join(x + "\n" for x in self.lines).encode()]))
        self.zip.close()
        self.out.close()
        return pa.RecordBatch.from_arrays([pa.array([self.uri]), pa.array([len(self.lines)], pa.int64())], ["package", "records"])


def index_parts(uri: str, most: int = INDEX_BYTES) -> list[tuple[int, int]]:
    """(start, end) of the parts that a package's index is read in."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as file:
        _, size = ZipDirectory(file).place(INDEX)
    return [(at, min(at + most, size)) for at in range(0, size, most)]


def read_part(uri: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records whose index lines begin in a part, in the index's order."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as file:
        directory = ZipDirectory(file)
        base, _ = directory.place(DATA)
        entries = [json.loads(x) for x in directory.lines(INDEX, start, end)]
        at = 0
        while at < len(entries):
            stop, first = at, entries[at]["offset"]
            while stop < len(entries) and entries[stop]["offset"] + entries[stop]["length"] - first <= max(READ_BYTES, entries[at]["length"]):
                stop += 1
            block = directory._read(base + first, entries[stop - 1]["offset"] + entries[stop - 1]["length"] - first)
            for e in entries[at:stop]:
                yield parse_record(block[e["offset"] - first : e["offset"] - first + e["length"]])
            at = stop


def read_packages(manifest: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(record_id, url, record_type, refers_to, payload, payload_bytes, payload_digest) of every record."""
    scratch = Scratch(manifest.sparkSession, "warc-parts")
    schema = "record_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def number(urn: str) -> int | None:
        last = urn.rsplit(":", 1)[1].rstrip(">")
        return None if last == "null" else int(last)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(uri, a, b) for uri in batch.column(0).to_pylist() for a, b in index_parts(uri, index_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["package", "start", "end"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                rows: list[tuple] = []
                held = 0
                for head, payload in read_part(part["package"], part["start"], part["end"]):
                    full = head["warc-type"] == "response"
                    digest = sha1_base32(payload) if full else head["warc-payload-digest"].removeprefix("sha1:")
                    if full and head["warc-payload-digest"] != f"sha1:{digest}":
                        raise ValueError(f"a payload in {part['package']} does not match its digest")
                    rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], None if full else number(head["warc-refers-to"]), payload if full else None, len(payload) if full else int(head["x-payload-length"]), digest))
                    held += len(payload)
                    if len(rows) == 256 or held > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    packages = manifest.select("package")
    parts = scratch.table(packages.repartition(max(1, min(TASKS, manifest.count())), "package").mapInArrow(plan, "package string, start long, end long"), "parts")
    return parts.repartition(max(1, min(TASKS, parts.count())), "package", "start").mapInArrow(run, schema)
