"""Shared pieces of the training-data operators: scratch tables and byte views of Arrow strings."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at, unless a single document is longer.
STEP_BYTES = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own only in a session of one machine that names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def repeats_ids(docs: DataFrame) -> bool:
    """Whether two rows have the same doc_id, or a row has none."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("d")).agg(F.count("*").alias("n"))
    return bool(ids.where("n > 1 or d is null").limit(1).count())


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column without copying text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        empty = b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else ""
        column = pc.fill_null(column, pa.scalar(empty, type=kind))
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, width)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES):
    """Row ranges [i, j) of at most `most` bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def release() -> None:
    """Give freed memory back to the system; a Python worker lives on for the stages that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run):
    """The same map over batches, releasing memory when a task ends."""

    @functools.wraps(run)
    def of(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return of


def parts_of(batches, column: int | str, most: int = 4 * STEP_BYTES):
    """The batches in parts of about `most` bytes of a text column, so that what is built for a part stays small."""
    for batch in batches:
        _, offsets = utf8_view(batch.column(column))
        for i, j in steps(offsets, most):
            yield batch.slice(i, j - i)
            release()


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate values[starts[i] : starts[i] + lengths[i]] for all i."""
    total = int(lengths.sum())
    if total == 0:
        return values[:0].copy()
    ends = np.cumsum(lengths)
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(starts - (ends - lengths), lengths)
    return values[index]


def binary_array(blob: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary column over one byte array."""
    if offsets[-1] < 2**31 - 1:
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(blob))])
    big = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(blob))])
    return big.cast(pa.binary())


_TABLE = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (Stafford's variant 13 of the murmur finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p) if n else p


def hash_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]; pieces are in order and do not overlap, none is empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    powers = _powers(int(lengths.max()))
    tight = bool((starts[1:] == ends[:-1]).all())
    values = table[data[starts[0] : ends[-1]] if tight else ragged_take(data, starts, lengths)]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(values), dtype=np.int64)
    place -= np.repeat(first, lengths)
    values *= powers[place]
    sums = np.add.reduceat(values, first)
    return mix64(sums + lengths.astype(np.uint64) * _ODD)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def ascii_space(data: np.ndarray) -> np.ndarray:
    """Which bytes are U+0020 or U+0009 to U+000D."""
    return _SPACE[data]


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and the number of words of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~(ascii_space(data) if space is None else space)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    bounds = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(bounds)
