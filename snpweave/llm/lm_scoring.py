"""Language-model scoring by deleted interpolation of bigram, unigram and uniform estimates.

  p(w | v) = l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1),   b: bucket of c(v), by powers of two

Words (and one end a text, also the context of a text's first word) are 64-bit hashes. The mixture weights of each
bucket maximise the likelihood of a fold of the training texts that is left out of the counts meanwhile, by
expectation-maximisation over a histogram of (bucket, bigram estimate, unigram estimate) of all its tokens.

Texts are staged as chunks of about a million tokens: local ids and the chunk's vocabulary. A chunk sends its
distinct words and bigrams, sorted, to ranges of the hash; a range adds the counts of all chunks and answers each
chunk with the counts alone, in the order of its question. So no table of the corpus's n-grams is ever collected or
broadcast, hot n-grams arrive once a chunk, and what moves grows with the input.

Null or empty text: one end token. Null ids: fold of the empty text's crc32. Repeated rows count and are scored
each. Without training texts all counts are 0 (V = N = 0). An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snpweave.llm.common import crc_of_id, materialize, mix, text_blocks, with_text, word_hashes

CHUNK_TOKENS, RANGE_KEYS = 1_000_000, 1_500_000
HELD_OUT, TUNING = 2, 3  # folds of crc32 modulo 7
END = np.uint64(2**64 - 1)
STEP = 8  # histogram cells for each doubling of an estimate
BUCKETS = 48


def pack_bytes(a: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()) if len(a) else b""


def unpack_bytes(raw: bytes, dtype: str) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(raw)), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


def stage_chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk: chunk, doc_ids, sizes (tokens with the end), folds, tokens (ids into vocab), vocab (hashes)."""
    schema = "chunk long, doc_ids array<long>, sizes array<int>, folds array<int>, n_tokens long, tokens binary, vocab binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def row(chunk: int, ids: list, folds: list, sizes: list, hashes: list) -> pa.RecordBatch:
        vocab, local = np.unique(np.concatenate(hashes), return_inverse=True)
        cols = [pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([folds], pa.list_(pa.int32())), pa.array([len(local)], pa.int64()), pa.array([pack_bytes(local.astype("<u4"))], pa.binary()), pa.array([pack_bytes(np.diff(vocab, prepend=np.uint64(0)).astype("<u8"))], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 34
        ids, folds, sizes, hashes, total = [], [], [], [], 0
        for batch in batches:
            all_ids, all_folds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, end, data, offsets in text_blocks(batch):
                h, bounds = word_hashes(data, offsets)
                h[h == END] = 0
                own = np.diff(bounds)
                hashes.append(np.insert(h, bounds[1:], END))
                ids += all_ids[first:end]
                folds += all_folds[first:end]
                sizes += (own + 1).tolist()
                total += len(hashes[-1])
                if total >= CHUNK_TOKENS:
                    yield row(chunk, ids, folds, sizes, hashes)
                    chunk += 1
                    ids, folds, sizes, hashes, total = [], [], [], [], 0
        if ids:
            yield row(chunk, ids, folds, sizes, hashes)

    return docs.select("doc_id", (crc_of_id() % 7).cast("int").alias("fold"), "text").mapInArrow(run, schema)


class Chunk:
    """A staged chunk unpacked: per token its word, its bigram and its text; the distinct words and bigrams, sorted."""

    def __init__(self, row) -> None:
        self.vocab = np.cumsum(unpack_bytes(row["vocab"], "<u8"), dtype=np.uint64)
        self.word = unpack_bytes(row["tokens"], "<u4").astype(np.int64)
        sizes = np.asarray(row["sizes"], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.folds = np.asarray(row["folds"], np.int64)
        self.fold = np.repeat(self.folds, sizes)
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.starts] = self.word[self.ends - 1]
        pair, first, self.bigram = np.unique(self.context * len(self.vocab) + self.word, return_index=True, return_inverse=True)
        key = mix(mix(self.vocab[pair // len(self.vocab)]) + self.vocab[pair % len(self.vocab)])
        order = np.argsort(key, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.bigram, self.pair_key = place[self.bigram], key[order]
        self.pair_context, self.pair_word = (pair // len(self.vocab))[order], (pair % len(self.vocab))[order]

    def counts(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in the fitting and in the tuning folds."""
        fit = (self.fold != HELD_OUT) & (self.fold != TUNING)
        return np.bincount(at[fit], minlength=n), np.bincount(at[self.fold == TUNING], minlength=n)


def questions(chunks: DataFrame, bits: int) -> DataFrame:
    """(kind, part, chunk, keys, fit, tune): the distinct words (kind 0) and bigrams (1) of each chunk by hash range."""
    schema = "kind int, part int, chunk long, keys binary, fit binary, tune binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                for kind, keys, at in ((0, c.vocab, c.word), (1, c.pair_key, c.bigram)):
                    fit, tune = c.counts(at, len(keys))
                    cut = np.append(np.searchsorted(keys, edges), len(keys))
                    out = [(kind, i, row["chunk"], pack_bytes(np.diff(keys[a:b], prepend=np.uint64(0))), pack_bytes(fit[a:b].astype("<u4")), pack_bytes(tune[a:b].astype("<u4"))) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                    cols = list(zip(*out, strict=True))
                    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return chunks.select("chunk", "sizes", "folds", "tokens", "vocab").mapInArrow(run, schema)


def answers(asked: DataFrame) -> DataFrame:
    """Per question the counts over the whole corpus; and one row per range (chunk null) with its totals: tokens and
    distinct keys in the fitting folds and in all training folds."""
    schema = "kind int, part int, chunk long, fit binary, tune binary, totals array<long>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unpack_bytes(k, "<u8"), dtype=np.uint64) for k in pdf["keys"]]
        size = [len(k) for k in keys]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        add = lambda c: np.bincount(at, np.concatenate([unpack_bytes(x, "<u4") for x in pdf[c]]), minlength=len(distinct)).astype(np.int64)
        fit, tune = add("fit"), add("tune")
        cut = np.cumsum(size)[:-1]
        out = pd.DataFrame({"kind": pdf["kind"], "part": pdf["part"], "chunk": pdf["chunk"], "fit": [pack_bytes(fit[i].astype("<u4")) for i in np.split(at, cut)], "tune": [pack_bytes(tune[i].astype("<u4")) for i in np.split(at, cut)], "totals": None})
        total = [int(fit.sum()), int((fit > 0).sum()), int((fit + tune).sum()), int((fit + tune > 0).sum())]
        last = pd.DataFrame({"kind": [pdf["kind"].iloc[0]], "part": [pdf["part"].iloc[0]], "chunk": [None], "fit": [None], "tune": [None], "totals": [total]})
        return pd.concat([out, last]).astype({"chunk": "Int64"})

    return asked.groupBy("kind", "part").applyInPandas(run, schema)


def _read(chunk: pd.DataFrame, answer: pd.DataFrame) -> tuple[Chunk, list[np.ndarray], list[np.ndarray]]:
    answer = answer.sort_values(["kind", "part"])
    load = lambda kind, c: np.concatenate([np.zeros(0, np.int64), *(unpack_bytes(x, "<u4").astype(np.int64) for x in answer[c][answer["kind"] == kind])])
    return Chunk(chunk.iloc[0]), [load(0, "fit"), load(0, "tune")], [load(1, "fit"), load(1, "tune")]


def bucket_of(c: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2)."""
    return np.where(c > 0, np.minimum(1 + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64), BUCKETS - 1), 0)


def tuning_histogram(chunks: DataFrame, answer: DataFrame, n: int) -> DataFrame:
    """(bucket, two, one, tokens): tuning tokens by context bucket and by the cells of both estimates (-1: zero)."""

    def cell(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.rint(-np.log2(np.maximum(p, 1e-300)) * STEP), -1).astype(np.int64)

    def run(chunk: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        c, uni, bi = _read(chunk, answer)
        times = np.bincount(c.bigram[c.fold == TUNING], minlength=len(c.pair_key))
        at = np.flatnonzero(times)
        context = uni[0][c.pair_context[at]]
        two = cell(bi[0][at] / np.maximum(context, 1))
        one = cell(uni[0][c.pair_word[at]] / max(n, 1))
        out = pd.DataFrame({"bucket": bucket_of(context), "two": two, "one": one, "tokens": times[at]})
        return out.groupby(["bucket", "two", "one"], as_index=False).sum()

    got = chunks.groupBy("chunk").cogroup(answer.groupBy("chunk")).applyInPandas(run, "bucket long, two long, one long, tokens long")
    return got.groupBy("bucket", "two", "one").agg(F.sum("tokens").alias("tokens"))


def mixture_weights(hist: pd.DataFrame, v: int, rounds: int = 100) -> np.ndarray:
    """(bucket, 3) weights of bigram, unigram and uniform by expectation-maximisation; even ones without tuning tokens."""
    out = np.full((BUCKETS, 3), 1 / 3)
    out[0] = (0, 0.5, 0.5)
    for b, part in hist.groupby("bucket"):
        p = np.column_stack([np.where(part[k] >= 0, np.exp2(-part[k] / STEP), 0) for k in ("two", "one")] + [np.full(len(part), 1 / (v + 1))])
        w, times = out[b].copy(), part["tokens"].to_numpy(float)
        for _ in range(rounds):
            share = p * w
            share = share / share.sum(axis=1, keepdims=True)
            w = times @ share / times.sum()
        # no estimate falls out altogether: one count each
        out[b] = (w * times.sum() + 1) / (times.sum() + 3)
        if b == 0:
            out[b] = out[b] * (0, 1, 1) / out[b, 1:].sum()
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    chunks = materialize(stage_chunks(with_text(docs, id_col, text_col)), "chunks")
    total = int(chunks.agg(F.sum("n_tokens")).first()[0] or 0)
    bits = max(4, (max(1, total // RANGE_KEYS) - 1).bit_length())
    answer = materialize(answers(questions(chunks, bits)), "counts")
    sums = answer.where("kind = 0 AND chunk IS NULL").select(*(F.sum(F.col("totals")[i]) for i in range(4))).first()
    fit_n, fit_v, n, v = (int(x or 0) for x in sums)
    reply = answer.where("chunk IS NOT NULL").select("chunk", "kind", "part", "fit", "tune")
    hist = tuning_histogram(chunks, reply, fit_n).toPandas()
    weights = mixture_weights(hist, fit_v)

    def run(chunk: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        c, uni, bi = _read(chunk, answer)
        word, pair = uni[0] + uni[1], bi[0] + bi[1]
        context = word[c.pair_context]
        w = weights[bucket_of(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word[c.pair_word] / max(n, 1) + w[:, 2] / (v + 1)
        sums = lambda x: np.add.reduceat(x, c.starts)
        base = np.log10((word + 1) / (n + 1 * (v + 1)))
        ids = chunk["doc_ids"].iloc[0]
        return pd.DataFrame({"doc_id": pd.array([None if x is None or x != x else int(x) for x in ids], "Int64"), "held_out": c.folds == HELD_OUT, "n_tokens": c.ends - c.starts, "n_known": sums((word[c.word] > 0).astype(np.int64)), "train_tokens": n, "base_score": sums(base[c.word]), "score": sums(np.log10(p)[c.bigram])})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(reply.groupBy("chunk")).applyInPandas(run, schema)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
