"""Arrow helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
BATCH_ROWS, LONG_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], col: str | int, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a slice hold about max_bytes (one text at least), whatever the row sizes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
        bucket = np.cumsum(sizes, dtype=np.int64) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and the offset at which each begins (nulls are empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lut(allowed: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(allowed)] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_BASE, _INVERSE)]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(raw: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts at once: start and end bytes, 64-bit hashes with A-Z lower-cased, and the first word of each text.

    A word is a longest run of bytes marked in word_byte; it never goes on into the next text."""
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = word_byte[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share; where the session has none, one of this machine, if all of Spark runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="loomstone-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage that all executors share; a folder is set only where the session has none."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def long_rows(spark: SparkSession) -> None:
    """Whole documents go to Python LONG_ROWS at a time, where the session leaves Spark's default for short rows."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(LONG_ROWS))


def release() -> None:
    """Give memory back to the system at a task's end: an idle worker keeps what its process holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def crc_mod(column: str, n: int):
    return F.crc32(F.col(column).cast("string")) % n
