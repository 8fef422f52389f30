"""What the operators share: scratch tables, text blocks, word hashes; connected components from snpweave.shared."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snpweave.shared import components, local_forest, materialize, materialize_and_see, scratch_dir  # noqa: F401

BLOCK_BYTES = 512 << 10
SMALL_ROWS = 200_000
BATCH_ROWS = 1_000
U64 = np.uint64


# ---------------------------------------------------------------- scratch tables


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """df (a few numbers a row) with a hint to broadcast it, if a count shows that it is small; else as it is, for a shuffle."""
    df, seen = materialize_and_see(df, "side", n=F.count(F.lit(1)))
    return F.broadcast(df) if seen["n"] <= SMALL_ROWS else df


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) under fixed names; a null text counts as empty. Arrow batches of this session get fewer rows than Spark's
    default, as a row here is a whole text."""
    if df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def crc_of_id(id_col: Column | str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


# ---------------------------------------------------------------- text blocks for Arrow functions


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most `limit` bytes of text (one longer text stands alone).

    Yields (first row, end row, bytes, offsets from 0)."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        kind = np.int32
    else:
        kind = np.int64
    if len(col) == 0:
        return
    bufs = col.buffers()
    offsets = np.frombuffer(bufs[1], dtype=kind, count=len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(col))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


# ---------------------------------------------------------------- sums of arrays over tasks

PART, SALTS = 8192, 64
_PARTS = "key int, block int, task int, salt int, part binary"


def array_parts(arrays: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What one task adds to `summed_arrays`: its arrays by key, cut into blocks of PART numbers."""
    task = TaskContext.get().partitionId()
    for key, a in arrays.items():
        parts = [a[i : i + PART].tobytes() for i in range(0, len(a), PART)]
        same = lambda x: pa.array([x] * len(parts), pa.int32())  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([same(key), pa.array(range(len(parts)), pa.int32()), same(task), same(task % SALTS), pa.array(parts, pa.binary())], names=[x.split()[0] for x in _PARTS.split(", ")])


def summed_arrays(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], dtype: str) -> dict[int, np.ndarray]:
    """By key, the sum over all tasks of the arrays that `make` yields by `array_parts`. Two levels, each a group a block, so
    that no group holds more than a 64th of the tasks' blocks; the driver gets the one sum."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")
        total = np.frombuffer(pdf["part"].iloc[0], dtype).copy()
        for p in pdf["part"].iloc[1:]:
            total += np.frombuffer(p, dtype)
        return pdf.iloc[:1].assign(part=[total.tobytes()])

    parts = df.mapInArrow(make, _PARTS).groupBy("key", "block", "salt").applyInPandas(add, _PARTS)
    blocks: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.groupBy("key", "block").applyInPandas(add, _PARTS).select("key", "block", "part").collect():
        blocks.setdefault(r["key"], {})[r["block"]] = np.frombuffer(bytes(r["part"]), dtype)
    return {k: np.concatenate([b[i] for i in sorted(b)]) for k, b in blocks.items()}


# ---------------------------------------------------------------- word hashes

_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLES = [_rng.integers(0, 2**64, 256, dtype=np.uint64) | U64(1) for _ in range(2)]
_BASES = [int(x) | 5 for x in _rng.integers(2**40, 2**63, 2, dtype=np.uint64)]
_SHINGLE = _rng.integers(0, 2**64, (2, 8), dtype=np.uint64) | U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's public constants)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        base, inverse = _BASES[which], pow(_BASES[which], -1, 2**64)
        fill = lambda b: np.concatenate(([U64(1)], np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)))
        have = fill(base), fill(inverse)
        if n <= BLOCK_BYTES + 1:
            _POWERS[which] = have
    return have


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of table[byte] * base**position modulo 2**64, with a leading 0."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_TABLES[which][data] * _powers(len(data), which)[0][: len(data)], out=out[1:], dtype=np.uint64)
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of data[start:end] for every pair, the same wherever the bytes stand."""
    return mix((prefix[end] - prefix[start]) * _powers(len(prefix), which)[1][start])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and, for each text, the number of words before it."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(_SPACE[data], out=inside[:-1])
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    last = inside[:-1] & ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word after lower-casing A-Z, and each text's words as a range of them."""
    low = _LOWER[data]
    start, end, bounds = word_bounds(low, offsets)
    if len(start) == 0:
        return np.zeros(0, np.uint64), bounds
    return range_hash(prefix_hash(low, which), start, end, which), bounds


def shingle_hashes(words: np.ndarray, n: int = 5, which: int = 0) -> np.ndarray:
    """Hash of every run of n words; of the whole sequence where there are fewer; none without words."""
    if len(words) == 0:
        return words
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out += words[i : len(words) - k + 1 + i] * _SHINGLE[which, i]
    return mix(out + U64(k))


def digest128(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves of a content digest of an array."""
    import hashlib

    raw = np.frombuffer(hashlib.blake2b(np.ascontiguousarray(values).tobytes(), digest_size=16).digest(), "<i8")
    return int(raw[0]), int(raw[1])


def crc(raw: bytes) -> int:
    return zlib.crc32(raw) & 0xFFFFFFFF
