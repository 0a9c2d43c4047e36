"""What the operators of this package share: stored intermediates, joins on hot keys, hashing and word splitting."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STORED: list[tuple[SparkSession, str]] = []
_PATH_OF: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only where it is unset and Spark runs in one
    process, as in tests, a temporary folder takes its place; on a cluster that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="noteloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _STORED.append((spark, path))
    return path


#: Rows of a batch that Python gets while a table is stored.
BATCH_ROWS = 1000


def stash(df: DataFrame, tag: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with small_batches(spark, rows):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATH_OF[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*stored: DataFrame) -> None:
    """Delete what stash wrote, once nothing reads it any more."""
    for df in stored:
        if path := _PATH_OF.pop(df, None):
            _STORED.remove((df.sparkSession, path))
            _delete(df.sparkSession, path)


#: A key that more rows share is a hot one; of these the hottest HOT_KEYS are broadcast.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def join_one(many: DataFrame, one: DataFrame, key: str, n: str, keys: int = HOT_KEYS, hot: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """Join (inner or left) with a stored table that has each key once and, as n, how many rows of `many` share it (n is
    left out).

    Rows of the hottest keys, those that more than `hot` rows share and at most `keys` of them, meet these by a
    broadcast where they are; only the others are shuffled. Both tables are read twice. Null keys meet nothing.
    """
    small = one.where(F.col(n) > hot).orderBy(F.desc(n), key).limit(keys).drop(n)
    found = small.count()
    if not found:
        return many.join(one.drop(n), key, how)
    if hot == 0 and found < keys:  # that is all of them
        return many.join(F.broadcast(small), key, how)
    rest = many.join(F.broadcast(small.select(key)), key, "left_anti")
    return many.join(F.broadcast(small), key).unionByName(rest.join(one.drop(n), key, how))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows that are large, or packed arrays, go to Python a few at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def released(run, *memos: dict):
    """run, a function over batches, that hands memory back when a task ends: workers live on between tasks."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for m in memos:
                m.clear()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only where the C library has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


@atexit.register
def _drop_stored() -> None:
    for spark, path in _STORED:
        try:
            _delete(spark, path)
        except Exception:  # the JVM has gone: the shared folder's owner cleans up
            return


def slices(b: pa.RecordBatch, column: int, rows: int = 256, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch: at most so many rows, and texts of so many bytes in all unless one text alone has more."""
    upto = np.cumsum(np.append(0, pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    at = 0
    while at < b.num_rows:
        end = min(max(at + 1, int(np.searchsorted(upto, upto[at] + size, "right")) - 1), at + rows, b.num_rows)
        yield b.slice(at, end - at)
        at = end


def gathered(batches: Iterator[pa.RecordBatch], column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in parts of about so many rows, or texts of so many bytes, whatever the batches' sizes."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        out = held[0] if len(held) == 1 else pa.concat_batches(held)
        held.clear()
        return out

    for big in batches:
        for b in slices(big, column, rows, size):
            held.append(b)
            if sum(x.num_rows for x in held) >= rows or sum(x.column(column).nbytes for x in held) >= size:
                yield joined()
    if held:
        yield joined()


def lower_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
