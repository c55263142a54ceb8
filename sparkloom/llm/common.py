"""Shared helpers: intermediate tables, and word hashing on Arrow buffers with numpy."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None
#: Bytes of text hashed at a time; a longer document makes a longer step of its own.
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, one of our own, in local mode (tests) only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or "/tmp/checkpoints"


#: Arrow batches that go to Python: rows, and bytes (a longer row is a batch by itself).
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, actions send batches of BATCHES to Python, so that an executor's buffers are bounded."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing unwritten depends on any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


#: Rows of a few numbers up to which a table is broadcast (16 MB or so); beyond, Spark's planner chooses.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a narrow table that is written already, marked for broadcast if counting it finds it small."""
    return F.broadcast(df) if df.count() <= rows else df


#: A-Z as a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of more bytes are hashed by a keyed digest, shorter ones eight bytes at a time.
LONG_WORD = 64
_KEY = b"words of a corpus"
_SEED = U64(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
#: What parts words ``[^\\x20\\x09-\\x0D]+``, and words of letters and digits (bytes from 128 on are letters).
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = ~np.array([i >= 128 or chr(i).isalnum() for i in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column and the n+1 offsets of its rows; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), ends


def row_steps(offsets: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``step`` bytes each; every row is in one range, whole."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + step, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows that lie one after the other in ``data``: runs of bytes that ``space`` doesn't mark.

    Returns the words' 64-bit hashes (A-Z as a-z), their first and
    past-the-end bytes in ``data[offsets[0]:]``, and n+1 offsets of rows into
    the words.  A hash takes in eight bytes at a time through a bijective
    mixer, so that words of up to eight bytes have equal hashes only if they
    are equal but for chances of 2**-64; long words have a digest's.
    """
    buf = data[offsets[0] : offsets[-1]]
    cuts = (offsets - offsets[0]).astype(np.int64)
    n = len(buf)
    if n == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(cuts), np.int64)
    word = ~space[buf]
    border = np.zeros(n + 1, bool)
    border[cuts] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | border[1:n]
    stops = word.copy()
    stops[:-1] &= ~word[1:] | border[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    lower = np.zeros(n + 8, np.uint8)
    np.take(_LOWER, buf, out=lower[:n])
    eight = np.ndarray((n + 1,), "<u8", lower, strides=(1,))
    size = ends - starts
    hashes = mix((eight[starts] & _FIRST_BYTES[np.minimum(size, 8)]) ^ (size.astype(U64) * _SEED))
    more = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    at = 8
    while len(more):
        hashes[more] = mix(hashes[more] ^ (eight[starts[more] + at] & _FIRST_BYTES[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(lower[starts[i] : ends[i]].tobytes(), digest_size=8, key=_KEY).digest(), "little")
    return hashes, starts, ends, np.searchsorted(starts, cuts)


def release() -> None:
    """Give freed memory back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
