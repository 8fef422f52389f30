"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A fingerprint holds the k smallest 32-bit hashes of a text's distinct shingles, ascending, in base64. Fewer than k
are the whole set. Fingerprints of parts merge to that of the whole (`merged`), and estimate resemblance,
containment and the number of distinct shingles.

`with_edits` also fingerprints each text with its last quarter replaced by the start of the next document in order of
id. Documents are dealt by ranges of the id and sorted, so the next document stands next; the first text of the next
range travels along once for each range.

Null or empty text: the empty fingerprint, alike only to itself. Null ids come first in the order; repeated ids are
ordered by a hash of the text. With a single row the next document is the row itself. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snpweave.llm.common import BLOCK_BYTES, n_partitions, shingle_hashes, with_text, word_hashes

K, WORDS = 256, 5


def sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct 32-bit hashes."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    if len(h) > 4 * k:
        h = np.partition(h, 4 * k)[: 4 * k] if len(np.unique(np.partition(h, 4 * k)[: 4 * k])) >= k else h
    return np.unique(h)[:k]


def sketches(texts: list[bytes], words: int = WORDS, k: int = K) -> list[np.ndarray]:
    """Sketches of UTF-8 texts, hashed a block at a time."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_BYTES):
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        offsets = np.cumsum([0, *map(len, part)])
        hashes, bounds = word_hashes(np.frombuffer(b"".join(part), np.uint8), offsets)
        out += [sketch(shingle_hashes(hashes[a:b], words), k) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        at = end
    return out


def encode(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u4").tobytes()).decode()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u4")


def merged(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    """The fingerprint of the union of the parts."""
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, np.uint32)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of common ones among the k smallest of both; exact where both hold whole sets of fewer than k together."""
    both = np.intersect1d(a, b, assume_unique=True)
    if len(a) == len(b) == len(both):
        return 1.0
    if len(a) == 0 or len(b) == 0:
        return 0.0
    union = np.union1d(a, b)[:k]
    return float(np.searchsorted(both, union[-1], side="right") / len(union))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**32 / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that are in b."""
    if len(a) == 0:
        return 1.0
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return min(1.0, j / (1 + j) * (na + nb) / na)


def fingerprints(docs: DataFrame, words: int = WORDS, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py().encode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(s) for s in sketches(texts, words, k)], pa.string())], names=["doc_id", "fingerprint"])

    return with_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def _ranged(source: DataFrame, ranges: int) -> DataFrame:
    """Adds the range of the id (null: the first)."""
    bounds = np.unique(np.array(source.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) or [0.0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            at = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(float), side="left").astype(np.int32) + 1
            at[ids.is_null().to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["doc_id", "text", "range"])

    keyed = source.mapInArrow(run, "doc_id long, text string, range int")
    return keyed.select("range", F.lit(0).alias("guest"), "doc_id", F.xxhash64("text").alias("tk"), "text")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame, words: int = WORDS, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and the likeness to both the edited text and the
    next document."""
    source = with_text(docs, id_col, text_col)
    parts = n_partitions(source.sparkSession)
    rows = _ranged(source, 4 * parts)
    # a table of at most 4 * parts + 2 rows: the first document of every range, to stand last in the range before it
    firsts = rows.groupBy("range").agg(F.min(F.struct("doc_id", "tk")).alias("f")).select("range", "f.doc_id", "f.tk").collect()
    order = sorted(firsts, key=lambda r: r["range"])
    guests = [(order[i - 1]["range"], r["doc_id"], r["tk"]) for i, r in enumerate(order)]
    hosts = source.sparkSession.createDataFrame(guests, "host int, g_id long, g_tk long")
    moved = rows.join(F.broadcast(hosts), F.expr("doc_id <=> g_id AND tk = g_tk")).dropDuplicates(["host"])
    moved = moved.select(F.col("host").alias("range"), F.lit(1).alias("guest"), "doc_id", "tk", "text")
    dealt = rows.unionAll(moved).repartition(parts, "range").sortWithinPartitions("range", "guest", F.asc_nulls_first("doc_id"), "tk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _OUT.split(", ")]
        kept: list[tuple] = []  # (doc_id, guest, text, sketch), the last one waits for the next document

        def finish() -> pa.RecordBatch:
            ready, edited = [], []
            for (doc_id, guest, text, own), (_, _, following, other) in zip(kept[:-1], kept[1:], strict=True):
                if not guest:
                    cut = len(text) // 4
                    edited.append((text[: len(text) - cut] + following[:cut]).encode())
                    ready.append((doc_id, len(text), own, other))
            out = []
            for (doc_id, n, own, other), raw, e in zip(ready, edited, sketches(edited, words, k), strict=True):
                out.append((doc_id, n, hashlib.sha256(raw).hexdigest(), encode(own), encode(e), resemblance(own, e, k), resemblance(own, other, k)))
            del kept[:-1]
            c = list(zip(*out, strict=True)) if out else [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names=names)

        for batch in batches:
            size, start = 0, 0
            texts = batch.column(2)
            for i in range(len(batch)):
                size += len(texts[i].as_buffer() or b"")
                if size >= BLOCK_BYTES or i == len(batch) - 1:
                    part = [x.as_py() for x in texts.slice(start, i + 1 - start)]
                    own = sketches([t.encode() for t in part], words, k)
                    kept += list(zip(batch.column(0).slice(start, len(part)).to_pylist(), batch.column(1).slice(start, len(part)).to_pylist(), part, own, strict=True))
                    yield finish()
                    start, size = i + 1, 0

    return dealt.select("doc_id", "guest", "text").mapInArrow(run, _OUT)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
