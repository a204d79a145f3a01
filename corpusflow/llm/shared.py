"""What the operators of this subpackage have in common: the shared folder and written tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: At most so many rows go to the driver to be broadcast; beyond, each operator joins instead.
BROADCAST_ROWS = 200_000
#: Bytes of one Arrow batch that goes to a Python worker, and of text that it works on at once.
BATCH_BYTES = SLICE_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="corpusflow-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with a number, so that df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(len(taken) + 1))) if n.lower() not in taken)


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, unless they are smaller: both sides hold a batch several times,
    and the executor keeps the buffers."""
    if int(spark.conf.get(_BATCH).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


_held: dict[str, Any] = {}


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks of one operator: tokenizers and their tables. See keeping()."""
    if name not in _held:
        _held[name] = make()
    return _held[name]


def keeping(name: str | None) -> Callable[[Callable[[Any], Iterator[Any]]], Callable[[Any], Iterator[Any]]]:
    """For a function over batches: what a worker holds of other operators goes first, and free memory is given back at
    the end. Workers outlive operators and stay, idle, beside the stages that follow."""

    def wrap(run: Callable[[Any], Iterator[Any]]) -> Callable[[Any], Iterator[Any]]:
        def tidied(batches: Any) -> Iterator[Any]:
            if _held.keys() - {name}:
                _held.clear()
                _give_back()
            try:
                yield from run(batches)
            finally:
                _give_back()

        return tidied

    return wrap


#: For operators that keep nothing between tasks.
tidy = keeping(None)


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose values of a string or binary column have about `most` bytes together."""
    at = total = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
        if i > at and (total + n > most or i - at >= 1024):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


class Scratch:
    """Tables of one run under the shared folder. They cut lineage, so a lost executor costs a re-read and no recomputation.

    A table that a returned DataFrame still reads stays until the driver ends; others go by drop().
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/corpusflow/{name}-{uuid.uuid4().hex}"
        self.made = 0
        small_batches(spark)
        atexit.register(_delete, spark, self.root)

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def table(self, df: DataFrame, name: str, *partition_by: str, compression: str = "snappy") -> DataFrame:
        """df, written and read again with the same schema."""
        path = self.path(name)
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def run(self, df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
        """df, written in `buckets` parts by the hash of a column, each sorted by it; readers need no shuffle by that column.

        Bucketed tables have a name in the session's catalog; it goes with drop() or at the end.
        """
        path, table = self.path(name), f"corpusflow_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table, format="parquet")
        atexit.register(_forget, self.spark, table)
        out = self.spark.table(table)
        out.scratch_path, out.scratch_name = path, table
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if hasattr(t, "scratch_name"):
                _forget(self.spark, t.scratch_name)
            delete(self.spark, t.scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget(spark: SparkSession, table: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        spark.sql(f"drop table if exists {table}")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass
