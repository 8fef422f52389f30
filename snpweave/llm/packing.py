"""Packing of token sequences by cutting-stock column generation.

Documents longer than a sequence are cut into full sequences; what remains of each is an item. Items are
counted by length class. A linear program over patterns (which classes share a sequence) is solved by
column generation: a knapsack dynamic program prices new patterns against the duals. Rounded-down pattern
counts are dealt to the ranked items of each class. Classes round lengths up, so every sequence has a small
gap; a reserved share of items is the filler that is cut to close these gaps exactly. What is left of the
filler forms full sequences, and its end goes into sequences whose lengths are powers of two, which need no
padding.

Only the length histogram (at most max_len rows) and pattern counts reach the driver; ranks and positions are
running totals over chunks of rows.

Null or empty text: a document of the end token alone. Null ids are kept as null. Repeated rows are packed
each. An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snpweave.llm.common import crc, materialize, n_partitions, with_text
from snpweave.llm.prefix import running_total

CLASS_TOKENS = 32
END_ID = 1


@lru_cache(maxsize=2)
def byte_bpe(json_path: str, ranks_path: str | None):
    """A function from text to the ids of the byte-level BPE file; `ranks_path` holds the same vocabulary as
    ranks and is the quicker library (equal ids; the tests compare both)."""
    def load():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(json_path)

    if ranks_path is None:
        whole = load()
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(json_path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    names, slow = set(special), []

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special=names, disallowed_special=())
        except BaseException as e:  # its regular expressions give up on very long runs of white space, by a panic
            if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                raise
            if not slow:
                slow.append(load())  # rarely needed, so loaded then
            return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def _tokenizer_files(name: str = "byte_bpe_50k") -> tuple[str, str | None]:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


def token_lengths(docs: DataFrame, files: tuple[str, str | None], max_len: int) -> DataFrame:
    """doc_id, text_key, n (with the end id) and crcs of the ids in each run of max_len."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(*files)
        step = 4 * max_len
        for batch in batches:
            lengths, sums = [], []
            for text in batch.column(2):
                ids = encode(text.as_py())
                ids.append(END_ID)
                raw = array("I", ids).tobytes()
                lengths.append(len(ids))
                sums.append([crc(raw[i : i + step]) for i in range(0, len(raw), step)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n", "crcs"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, "doc_id long, text_key long, n long, crcs array<long>")


def tail_ids(docs: DataFrame, files: tuple[str, str | None], max_len: int) -> DataFrame:
    """doc_id, text_key and the ids after the last full run of max_len, as little-endian 32-bit bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(*files)
        for batch in batches:
            out = []
            for text in batch.column(2):
                ids = encode(text.as_py())
                ids.append(END_ID)
                out.append(array("I", ids[len(ids) // max_len * max_len :]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "text_key", "ids"])

    return docs.mapInArrow(run, "doc_id long, text_key long, ids binary")


# ---------------------------------------------------------------- the linear program


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: sizes 1..len(prices) with these prices, by dynamic programming over the capacity."""
    sizes = np.arange(1, len(prices) + 1)
    value, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        fits = sizes[sizes <= c]
        gain = value[c - fits] + prices[fits - 1]
        k = int(np.argmax(gain))
        value[c], taken[c] = (gain[k], fits[k]) if gain[k] > value[c - 1] + 1e-12 else (value[c - 1], 0)
    pattern, c = np.zeros(len(prices), np.int64), capacity
    while c > 0:
        if taken[c]:
            pattern[taken[c] - 1] += 1
            c -= taken[c]
        else:
            c -= 1
    return float(value[capacity]), pattern


def cutting_stock(demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and their (fractional) uses that meet the demand for sizes 1..len(demand) with the fewest
    sequences: the basis of a revised simplex method whose entering columns come from the knapsack."""
    have = np.flatnonzero(demand > 0)
    if len(have) == 0:
        return []
    full = np.zeros(len(demand))
    basis = np.zeros((len(have), len(have)))
    for i, k in enumerate(have):
        basis[i, i] = capacity // (k + 1)
    need = demand[have].astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        use = inverse @ need
        full[:] = 0
        full[have] = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = best_pattern(full, capacity)
        if value <= 1 + 1e-9:
            break
        column = inverse @ pattern[have].astype(float)
        if not (column > 1e-12).any():
            break
        ratio = np.where(column > 1e-12, use / np.maximum(column, 1e-12), np.inf)
        basis[:, int(np.argmin(ratio))] = pattern[have]
    out = []
    use = np.linalg.solve(basis, need)
    for j in range(len(have)):
        pattern = np.zeros(len(demand), np.int64)
        pattern[have] = np.rint(basis[:, j]).astype(np.int64)
        out.append((pattern, max(0.0, float(use[j]))))
    return out


def plan_patterns(histogram: dict[int, int], max_len: int, class_tokens: int = CLASS_TOKENS) -> list[tuple[np.ndarray, int]]:
    """Patterns over length classes and whole numbers of sequences, after a share of items is reserved as filler."""
    classes = max_len // class_tokens
    count, gap, total = np.zeros(classes, np.int64), 0, 0
    for length, n in histogram.items():
        k = -(-length // class_tokens)
        count[k - 1] += n
        gap += n * (k * class_tokens - length)
        total += n * length
    if total == 0:
        return []
    first = cutting_stock(count, classes)
    waste = sum(u for _, u in first) * classes - float((np.arange(1, classes + 1) * count).sum())
    gap += max(0.0, waste) * class_tokens
    share = min(1.0, (1.08 * gap + 2 * max_len) / (total + 1.08 * gap))
    kept = np.floor(count * (1 - share)).astype(np.int64)
    return [(p, int(u + 1e-6)) for p, u in cutting_stock(kept, classes) if u >= 1 - 1e-6]


# ---------------------------------------------------------------- the operator


def pack(docs: DataFrame, max_len: int = 2048, files: tuple[str, str | None] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark: SparkSession = docs.sparkSession
    files = files or _tokenizer_files()
    source = with_text(docs, id_col, text_col)
    lengths = materialize(token_lengths(source, files, max_len), "lengths")
    rows = lengths.count()
    chunks = max(n_partitions(spark), -(-rows // 20_000))
    chunk = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(chunks)).cast("long")
    lengths = lengths.withColumn("chunk", chunk)

    # full runs: one sequence each
    full = lengths.where(F.col("n") >= max_len).withColumn("runs", F.floor(F.col("n") / max_len).cast("long"))
    full = running_total(full, "runs", "chunk", ["doc_id", "text_key"], "first")
    full = full.select("doc_id", "n", "first", F.posexplode(F.slice("crcs", F.lit(1), F.col("runs").cast("int"))).alias("i", "ids_crc32"))
    n_full = int(lengths.select(F.sum(F.floor(F.col("n") / max_len)).cast("long")).first()[0] or 0)
    full = full.select("doc_id", (F.col("i") * F.lit(max_len)).cast("long").alias("start"), F.lit(max_len).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), (F.col("first") + F.col("i")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # items: what remains of each document, ranked within its length class
    items = lengths.withColumn("r", F.col("n") % max_len).where("r > 0").select("doc_id", "text_key", "n", "r", F.element_at("crcs", -1).alias("ids_crc32"), "chunk", F.ceil(F.col("r") / CLASS_TOKENS).cast("int").alias("class"))
    histogram = {int(r["r"]): int(r["c"]) for r in items.groupBy("r").agg(F.count("*").alias("c")).collect()}
    patterns = plan_patterns(histogram, max_len)
    inside = Window.partitionBy("class", "chunk").orderBy("doc_id", "text_key")
    per = items.groupBy("class", "chunk").agg(F.count("*").alias("c"))
    before = per.select("class", "chunk", F.coalesce(F.sum("c").over(Window.partitionBy("class").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = items.withColumn("in", F.row_number().over(inside) - 1).join(before, ["class", "chunk"]).withColumn("rank", F.col("in") + F.col("before")).drop("in", "before")

    # (class, ranks lo..hi) -> (first sequence of the pattern, pieces of this class in one sequence)
    deals, taken, next_seq = [], np.zeros(max_len // CLASS_TOKENS + 1, np.int64), n_full
    for pattern, uses in patterns:
        for k in np.flatnonzero(pattern):
            deals.append((int(k) + 1, int(taken[k]), int(taken[k] + pattern[k] * uses), next_seq, int(pattern[k])))
            taken[k] += pattern[k] * uses
        next_seq += uses
    deal = spark.createDataFrame(deals, "class int, lo long, hi long, first long, many long")
    per_class = spark.createDataFrame([(k + 1, int(taken[k])) for k in range(len(taken))], "class int, dealt long")
    ranked = materialize(ranked.join(F.broadcast(per_class), "class"), "ranked")
    placed = ranked.where("rank < dealt").join(F.broadcast(deal), "class").where("rank >= lo AND rank < hi")
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("many")).cast("long"))
    by_seq = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank")
    placed = placed.withColumn("offset", F.coalesce(F.sum("r").over(by_seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    placed = materialize(placed.select("doc_id", (F.col("n") - F.col("r")).alias("start"), F.col("r").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), "sequence_id", "offset"), "placed")

    # gaps and filler, both laid out on one line of tokens
    gaps = placed.groupBy("sequence_id").agg(F.sum("length").cast("long").alias("base")).withColumn("size", F.lit(max_len).cast("long") - F.col("base")).where("size > 0")
    gaps = gaps.withColumn("chunk", F.floor(F.col("sequence_id") / 4096).cast("long"))
    gaps = running_total(gaps, "size", "chunk", ["sequence_id"], "at").select("sequence_id", "base", "at", "size")
    filler = ranked.where("rank >= dealt").select("doc_id", "text_key", "n", F.col("r").alias("size"), "chunk")
    filler = running_total(filler, "size", "chunk", ["doc_id", "text_key"], "at").drop("chunk")
    filler, gaps = materialize(filler, "filler"), materialize(gaps, "gaps")
    room = int(gaps.select(F.sum("size")).first()[0] or 0)
    have = int(filler.select(F.sum("size")).first()[0] or 0)
    extra = max(0, have - room)
    whole = extra // max_len
    more = spark.range(whole).select((F.col("id") + F.lit(next_seq)).alias("sequence_id"), F.lit(0).cast("long").alias("base"), (F.col("id") * F.lit(max_len) + F.lit(room)).cast("long").alias("at"), F.lit(max_len).cast("long").alias("size"))
    last, at, left = [], room + whole * max_len, extra % max_len
    for bit in reversed(range(max_len.bit_length())):
        if left >> bit & 1:
            last.append((next_seq + whole + len(last), 0, at, 1 << bit))
            at += 1 << bit
    gaps = gaps.unionAll(more).unionAll(spark.createDataFrame(last, "sequence_id long, base long, at long, size long"))
    cell = lambda df: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("at") / max_len).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / max_len).cast("long"))))
    g = cell(gaps.select("sequence_id", "base", F.col("at").alias("at"), "size")).withColumnsRenamed({"at": "g_at", "size": "g_size"})
    f = cell(filler).withColumnsRenamed({"at": "f_at", "size": "f_size"})
    lo, hi = F.greatest("g_at", "f_at"), F.least(F.col("g_at") + F.col("g_size"), F.col("f_at") + F.col("f_size"))
    cut = g.join(f, "cell").where((lo < hi) & (F.floor(lo / max_len) == F.col("cell")))
    cut = cut.select("doc_id", "text_key", "n", "f_size", (lo - F.col("f_at")).alias("skip"), (hi - lo).alias("length"), "sequence_id", (F.col("base") + lo - F.col("g_at")).alias("offset"))

    keys = filler.select("doc_id", "text_key").distinct()
    keyed = source.select("doc_id", F.xxhash64("text").alias("text_key"), "text").alias("d")
    texts = keyed.join(keys.alias("k"), F.expr("d.doc_id <=> k.doc_id AND d.text_key = k.text_key"), "left_semi")
    ids = tail_ids(texts, files, max_len).dropDuplicates(["doc_id", "text_key"]).alias("i")
    filled = cut.alias("c").join(ids, F.expr("c.doc_id <=> i.doc_id AND c.text_key = i.text_key")).select(
        F.col("c.doc_id"), (F.col("n") - F.col("f_size") + F.col("skip")).cast("long").alias("start"), F.col("length").cast("long"),
        F.crc32(F.expr("substring(ids, cast(4 * skip + 1 AS int), cast(4 * length AS int))")).alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), "sequence_id", F.col("offset").cast("long"),
    )
    return full.unionByName(placed).unionByName(filled)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
