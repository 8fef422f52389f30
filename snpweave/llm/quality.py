"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled side is text without a label. Features are shares of
byte classes and of repeated words, over whole texts. A linear model minimises the non-negative unbiased risk
  pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))
with squared loss, (1 - z)^2 / 4 and (1 + z)^2 / 4: all three risks are then exact functions of the counts, means and second
moments of the features, which one aggregation sums over all positives and all unlabelled rows, whatever their number. The
class prior pi is estimated from the scores of all of them, counted in bins, each half under a first model of the other
half: the smallest ratio of unlabelled to positive mass above any score (mass above a threshold that negatives don't reach
holds positives alone). The
minimiser of squared loss is the expected label, so (z + 1) / 2, cut to 0 and 1, is the score.

Labels are read only from rows whose crc32 of the id is not 2 modulo 4; labels, lang, source and ids are no features. Only
sums of a few hundred features reach the driver.

Null or empty text: features of an empty text. Null ids: crc32 of the empty text, never labelled. Repeated rows are
scored each; a document is positive if any of its labels is. Without positives or unlabelled rows every score is
0.5. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snpweave.llm.common import array_parts, crc_of_id, materialize, summed_arrays, text_blocks, with_text, word_bounds, word_hashes

MARKS = "|#$%&*!?.,;:'\"-_@/\\<>()[]{}=+~^`"
KINDS = 6 + len(MARKS)
BINS, TOP = 4096, 4.0  # of scores under the first model
ROWS = 4096
DECAY, FEW = 0.1, 0.5  # penalty of weights, and what it grows by with features a row


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 5, np.int64)  # control and the rest
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[[9, 10, 11, 12, 13, 32]] = 3
    kind[128:] = 4
    for i, c in enumerate(MARKS):
        kind[ord(c)] = 6 + i
    return kind


_CLASS = _byte_classes()


def block_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text, all between 0 and about 1."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    count = np.bincount(doc * KINDS + _CLASS[data], minlength=n * KINDS).reshape(n, KINDS).astype(float)
    hashes, bounds = word_hashes(data, offsets)
    start, end, _ = word_bounds(data, offsets)
    words = np.diff(bounds).astype(float)
    owner = np.repeat(np.arange(n), np.diff(bounds))

    def same(lag: int) -> np.ndarray:
        hit = (hashes[lag:] == hashes[:-lag]) & (owner[lag:] == owner[:-lag]) if len(hashes) > lag else np.zeros(0, bool)
        return np.bincount(owner[lag:][hit] if len(hit) else [], minlength=n) / np.maximum(words, 1)

    length = (end - start).astype(float)
    total = np.bincount(owner, length, minlength=n)
    square = np.bincount(owner, length**2, minlength=n)
    mean = total / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(square / np.maximum(words, 1) - mean**2, 0))
    letters = count[:, 0] + count[:, 1] + count[:, 4]
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], float) / np.maximum(np.sqrt(words), 1)
    per_byte = count / np.maximum(size, 1)[:, None]
    return np.column_stack([per_byte, count[:, 1] / np.maximum(letters, 1), same(1), same(2), np.minimum(mean / 20, 2), np.minimum(spread / 20, 2), np.minimum(distinct / 30, 2), np.log1p(words) / 12, np.log1p(size) / 14])


def expand(x: np.ndarray) -> np.ndarray:
    """The features, and saturating copies of them that tell small shares from none."""
    return np.column_stack([x, np.minimum(x / 0.01, 1), np.minimum(x / 0.05, 1), np.minimum(x / 0.2, 1), np.ones(len(x))])


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fold (crc32 of the id modulo 4) and the features as little-endian 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for _, _, data, offsets in text_blocks(batch):
                out += [r.tobytes() for r in block_features(data, offsets).astype("<f4")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["doc_id", "text_key", "fold", "features"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), (crc_of_id() % 4).cast("int").alias("fold"), "text").mapInArrow(run, "doc_id long, text_key long, fold int, features binary")


# ---------------------------------------------------------------- learning


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), -1).astype(float)


def _by_kind(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, expanded features) of rows (kind, features), a bounded number at a time."""
    for at in range(0, len(batch), ROWS):
        part = batch.slice(at, ROWS)
        kinds, x = part.column(0).to_numpy(), expand(_matrix(part.column(1)))
        for k in np.unique(kinds).tolist():
            yield k, x[kinds == k]


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """By kind: count, means and second moments of the expanded features of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in _by_kind(batch):
                sums[k] = sums.get(k, 0) + np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).reshape(-1)))
        yield from array_parts(sums)

    out = {}
    for k, s in summed_arrays(rows, run, "<f8").items():
        d = int(np.sqrt(len(s) - 1))  # 1 + d + d * d numbers
        out[k] = s[0], s[1 : d + 1] / s[0], s[d + 1 :].reshape(d, d) / s[0]
    return out


def histograms(rows: DataFrame, models: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """By kind: the number of rows in each bin of the scores of the kind's model."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in _by_kind(batch):
                at = np.clip((x @ shared.value[k] + TOP) * (BINS / 2 / TOP), 0, BINS - 1).astype(np.int64)
                sums[k] = sums.get(k, 0) + np.bincount(at, minlength=BINS)
        yield from array_parts(sums)

    return summed_arrays(rows, run, "<i8")


def nn_pu(p: tuple, u: tuple, prior: float, decay: float) -> np.ndarray:
    """Weights that minimise the non-negative unbiased squared risk plus decay / 4 * |w|^2, from the moments of positives
    and unlabelled rows. Where the unconstrained minimiser has a negative estimated risk of the negatives, the minimiser
    lies where that risk is 0: the one of pi * R_P(+) + t * (R_U(-) - pi * R_P(-)) with the largest such t below 1
    (0 if it is negative there too, and so counts as 0)."""
    (_, mp, sp), (_, mu, su) = p, u
    linear, square = mu - prior * mp, su - prior * sp
    negative = lambda w: 1 - prior + 2 * linear @ w + w @ square @ w
    at = lambda t: np.linalg.solve(prior * sp + t * square + decay * np.eye(len(mp)), prior * mp - t * linear)
    low, high = 0.0, 1.0
    if negative(at(1.0)) >= 0:
        return at(1.0)
    for _ in range(40):
        t = (low + high) / 2
        low, high = (t, high) if negative(at(t)) >= 0 else (low, t)
    return at(low)


def estimate_prior(p_bins: np.ndarray, u_bins: np.ndarray) -> float:
    """The least ratio of unlabelled to positive mass above a threshold, over thresholds that at least half of the
    positives reach, with a margin for sampling error."""
    n_p, n_u = p_bins.sum(), u_bins.sum()
    fp, fu = (np.cumsum(b[::-1])[::-1] / b.sum() for b in (p_bins, u_bins))
    at = np.searchsorted(-fp, -np.linspace(1.0, 0.5, 51), side="right") - 1  # the last bin that as many reach
    fp, fu = fp[at], fu[at]
    error = np.sqrt(np.maximum(fu * (1 - fu), 1e-9) / n_u) + np.sqrt(np.maximum(fp * (1 - fp), 1e-9) / n_p)
    return float(np.clip(((fu + error) / np.maximum(fp, 1e-9)).min(), 0.05, 0.98))


def _together(parts: list[tuple]) -> tuple:
    """Count and moments of several parts."""
    n = sum(c for c, _, _ in parts)
    return n, sum(c * m for c, m, _ in parts) / n, sum(c * s for c, _, s in parts) / n


def fit(rows: DataFrame) -> np.ndarray | None:
    """The model's weights from rows (kind 2 * half + 1: positive, 2 * half: unlabelled; features); None without one of
    the two."""
    found = moments(rows)
    both = {k: [found[h] for h in (k, k + 2) if h in found] for k in (0, 1)}
    if not all(both.values()):
        return None
    whole = {k: _together(x) for k, x in both.items()}
    _, mean, second = _together(list(whole.values()))
    spread = np.sqrt(np.maximum(np.diag(second) - mean**2, 0))
    scale = np.where(spread > 1e-9, np.maximum(spread, 1e-3), 1.0)

    def model(p: tuple, u: tuple, prior: float) -> np.ndarray:
        p, u = ((c, m / scale, s / np.outer(scale, scale)) for c, m, s in (p, u))
        return nn_pu(p, u, prior, DECAY + FEW * len(scale) / min(p[0], u[0])) / scale

    if len(found) < 4:  # a half without rows: the prior from the model of all
        first = dict.fromkeys(range(4), model(whole[1], whole[0], 0.5))
    else:
        halves = [model(found[2 * h + 1], found[2 * h], 0.5) for h in (0, 1)]
        first = {k: halves[1 - k // 2] for k in range(4)}
    bins = histograms(rows, first)
    p_bins, u_bins = (sum(bins[h] for h in (k, k + 2) if h in bins) for k in (1, 0))
    return model(whole[1], whole[0], estimate_prior(p_bins, u_bins))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted and text_key (xxhash64 of the text)."""
    spark = docs.sparkSession
    features = materialize(document_features(with_text(docs, id_col, text_col)), "features")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(crc_of_id() % 4 != 2)
    marks = marks.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    seen = features.where("fold <> 2").join(marks, "doc_id", "left")
    half = F.pmod(F.xxhash64("features"), F.lit(2)).cast("int")
    seen = seen.withColumn("kind", 2 * half + F.when(F.col("quality") == 1, 1).when(F.col("quality").isNull(), 0)).where("kind IS NOT NULL")
    model = fit(materialize(seen.select("kind", "features"), "seen"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) == 0 or shared.value is None:
                score = np.full(len(batch), 0.5)
            else:
                score = np.clip((expand(_matrix(batch.column(3))) @ shared.value + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], names=["doc_id", "text_key", "fold", "score"])

    out = features.mapInArrow(run, "doc_id long, text_key long, fold int, score double")
    return out.select("doc_id", (F.col("fold") == 2).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "text_key")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text_key")
