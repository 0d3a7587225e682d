"""Shared plumbing: table loading, durable intermediate tables, byte-level text kernels."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of ASCII white space: the complement of ``[^\x20\x09-\x0D]``.
WHITE = b" \t\n\x0b\x0c\r"

IS_WHITE = np.zeros(256, dtype=bool)
IS_WHITE[list(WHITE)] = True

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``: digits, lower-case ASCII letters, all of non-ASCII.
IS_ALNUM = np.zeros(256, dtype=bool)
IS_ALNUM[0x30:0x3A] = True
IS_ALNUM[0x61:0x7B] = True
IS_ALNUM[0x80:] = True


#: Bytes of an Arrow batch: many more would only be held twice, by the JVM and by Python.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``, unless the session's are smaller yet; it has no setting for a single plan."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system, which it would keep for the next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, spread over all cores if its files are too small to be split for them."""
    bound_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor shares, as ``spark.checkpoint.dir`` names it.

    Only a session on one machine may go without the setting; it then gets a
    folder that is removed when the driver's Python ends.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="metaloom-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{where}")
    return f"file://{where}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the copy.

    Cuts the lineage in a way that survives the loss of executors, and lets a
    result be used twice without being computed twice.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Remove a table of ``materialize`` that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_column(docs: DataFrame):
    """The text as a non-null string."""
    return F.coalesce(F.col("text"), F.lit(""))


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty. Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive row ranges [a, b) of about ``most`` bytes each; a longer row is a range of its own."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        out.append((a, min(b, n)))
        a = min(b, n)
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``is_word`` inside each row, and the
    index of each row's first run (one more entry than rows)."""
    n = len(is_word)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    edge[offsets] = True  # rows never share a word
    before = np.concatenate(([False], is_word))
    after = np.concatenate((is_word, [False]))
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, base: np.uint64, key: str) -> np.ndarray:
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        _POWERS[key] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes hashed at a time, so that the tables of powers stay small.
_BLOCK = 1 << 20


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit content hash of each [start, end) slice; the slices ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, low + _BLOCK, side="right")))
            high = ends[to - 1]
            size = int(high - low)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * _powers(size, _BASE, "up"), out=sums[1:])
            a, b = starts[at:to] - low, ends[at:to] - low
            out[at:to] = (sums[b] - sums[a]) * _powers(size + 1, _INVERSE, "down")[a]
            at = to
    with np.errstate(over="ignore"):
        return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
