"""Ranked lexical search: a sharded inverted index, and a document-at-a-time merge of its lists.

The index has one row per (shard, term): postings in order of the shard's documents, which are sorted by doc_id, as
variable-length gaps and counts; and one row per shard with its doc_ids and lengths. A task makes the shards of the rows it
reads, about SHARD_BYTES of text each, so building it shuffles nothing. A term is a 64-bit hash of its lower-cased bytes.

A search joins the distinct terms of all queries with the index, adds up their document frequencies over the shards, and
sends the lists to groups of (shard, block of queries). There each query's lists are merged by a heap of cursors, keyed by
the next document of each: the cursors that stand inside the next SPAN documents are taken from the heap, run through
the span and go back, so the scores of these documents are whole when they are offered, in order of doc_id, to a heap of
the k best keyed by score and then doc_id. The shards' best are merged by a window with a limit, partial before its shuffle.
All scores are 64-bit integers, so the order of the sums doesn't matter.

Equal (item_id, text) rows are one item; different texts of one item_id are ranked each. Null text: no terms (no rows for an
item, no part in the counts for a document). Repeated doc_ids are documents each; null doc_ids come last among equal scores.
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snpweave.llm.common import materialize, materialize_and_see, small_or_shuffled, text_blocks, with_text, word_hashes
from snpweave.llm.lm_scoring import pack_bytes, unpack_bytes

SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 17
QUERIES = 512  # in a block
SPAN = 4096
NO_ID = 2**63 - 1
_TERM = np.arange(256, dtype=np.uint8)  # bytes of terms; all others become spaces
_TERM[65:91] += 32
_TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


# ---------------------------------------------------------------- postings


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**35 as bytes of seven bits, the lowest first, and where each number ends."""
    x = x.astype(np.uint64)
    size = 1 + sum((x >= np.uint64(1 << b)).astype(np.int64) for b in (7, 14, 21, 28))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8)
    for k in range(5):
        at = np.flatnonzero(size > k)
        more = np.where(size[at] > k + 1, 128, 0)
        out[ends[at] - size[at] + k] = ((x[at] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.int64) | more
    return out, ends


def from_varints(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    first = np.append(0, last[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(_TERM[data], offsets)


_INDEX = "shard long, term long, n_docs long, n_terms long, postings binary, doc_ids binary"


def shard_rows(shard: int, ids: list, sizes: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """The index of one shard: its documents under a null term, then its terms."""
    keys = np.array([NO_ID if i is None else i for i in ids], np.int64)
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    vocab, term = np.unique(hashes, return_inverse=True)
    pairs, counts = np.unique(term * len(ids) + np.repeat(place, sizes), return_counts=True)
    term, doc = pairs // len(ids), pairs % len(ids)
    first = np.flatnonzero(np.diff(term, prepend=-1))
    gaps = np.diff(doc, prepend=0)
    gaps[first] = doc[first]
    raw, ends = varints(np.column_stack([gaps, counts]).reshape(-1))
    df = np.diff(np.append(first, len(pairs)))
    ends = ends[2 * np.cumsum(df) - 1] if len(df) else np.zeros(0, np.int64)
    doc_blob = pack_bytes(sizes[order].astype("<u4"))
    ends = np.concatenate(([0, len(doc_blob)], ends + len(doc_blob))).astype("<i4")
    lists = pa.Array.from_buffers(pa.binary(), len(df) + 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(doc_blob + raw.tobytes())])
    missing = pa.array(np.append(True, np.zeros(len(df), bool)))
    terms = pa.array(np.append(0, vocab.view(np.int64)), mask=missing.to_numpy(zero_copy_only=False))
    id_blobs = pa.array([pack_bytes(keys[order].astype("<i8"))] + [None] * len(df), pa.binary())
    total = lambda head, rest: pa.array(np.append(head, rest), pa.int64())
    cols = [pa.array(np.full(len(df) + 1, shard), pa.int64()), terms, total(int((sizes > 0).sum()), df), total(int(sizes.sum()), np.zeros(len(df), np.int64)), lists, id_blobs]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _INDEX.split(", ")])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, written: shard, term (null: the shard's documents), n_docs, n_terms, postings (the documents' lengths),
    doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        ids, sizes, hashes, held = [], [], [], 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            for first, end, data, offsets in text_blocks(batch):
                h, bounds = term_hashes(data, offsets)
                ids += own[first:end]
                sizes.append(np.diff(bounds))
                hashes.append(h)
                held += len(data)
                if held >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                    yield shard_rows(shard, ids, np.concatenate(sizes), np.concatenate(hashes))
                    shard, ids, sizes, hashes, held = shard + 1, [], [], [], 0
        if ids:
            yield shard_rows(shard, ids, np.concatenate(sizes), np.concatenate(hashes))

    return materialize(with_text(docs, id_col, text_col).mapInArrow(run, _INDEX), "index")


# ---------------------------------------------------------------- search


def query_terms(items: DataFrame, text_col: str) -> DataFrame:
    """(query, term): the distinct terms of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, end, data, offsets in text_blocks(batch):
                h, bounds = term_hashes(data, offsets)
                name = np.repeat(np.array(names[first:end], np.int64), np.diff(bounds))
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(h.view(np.int64))], names=["query", "term"])

    texts = items.select("query", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "query long, term long").distinct()


def merge_lists(lists: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[int, int]]:
    """The k best (score, document) of lists of (documents ascending, gains), merged in order of the documents; of equal
    scores the smaller documents."""
    at = [0] * len(lists)
    ahead = [(int(docs[0]), i) for i, (docs, _) in enumerate(lists) if len(docs)]
    heapq.heapify(ahead)
    best: list[tuple[int, int]] = []  # (score, -document), the worst first
    while ahead:
        low = ahead[0][0]
        total = np.zeros(SPAN, np.int64)
        while ahead and ahead[0][0] < low + SPAN:
            i = heapq.heappop(ahead)[1]
            docs, gains = lists[i]
            end = at[i] + int(np.searchsorted(docs[at[i] :], low + SPAN))
            total[docs[at[i] : end] - low] += gains[at[i] : end]
            at[i] = end
            if end < len(docs):
                heapq.heappush(ahead, (int(docs[end]), i))
        offers = np.flatnonzero(total > (best[0][0] if len(best) == k else 0))
        if len(offers) > k:  # of these only the k best, the earliest of equal ones
            score = total[offers]
            last = np.partition(score, -k)[-k]
            over = offers[score > last]
            offers = np.sort(np.concatenate([over, offers[score == last][: k - len(over)]]))
        for doc in offers.tolist():
            entry = (int(total[doc]), -(low + doc))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return [(s, -d) for s, d in best]


def search(index: DataFrame, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """For each item its k documents of highest score above 0: item_id, rank (from 1), doc_id, score."""
    plain = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("item_text")).distinct()
    named, seen = materialize_and_see(plain.withColumn("query", F.monotonically_increasing_id()), "queries", n=F.count(F.lit(1)))
    blocks = max(1, -(-seen["n"] // QUERIES))
    asked = materialize(query_terms(named, "item_text"), "asked")
    whole = index.where("term IS NULL").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, length = (int(x or 0) for x in whole)

    lists = materialize(index.where("term IS NOT NULL").select("shard", "term", "n_docs", "postings").join(small_or_shuffled(asked.select("term").distinct()), "term"), "lists")
    found = lists.groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2 * n + 2) / F.lit(1.0)) / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.join(found, "term").select("query", "term", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"), weight.alias("weight")).where("weight > 0")
    wanted = weighed.groupBy("term", "block", "weight").agg(F.collect_list("query").alias("queries"))
    dealt = lists.join(wanted, "term")
    shards = index.where("term IS NULL").select("shard", "postings", "doc_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def run(terms: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(terms) or not len(shard):
            return pd.DataFrame({"query": pd.array([], "int64"), "doc_id": pd.array([], "Int64"), "score": pd.array([], "int64")})
        ids, size = unpack_bytes(shard["doc_ids"].iloc[0], "<i8"), unpack_bytes(shard["postings"].iloc[0], "<u4").astype(np.int64)
        m = 100 - 50 + (50 * size * n) // length
        df = terms["n_docs"].to_numpy(np.int64)
        pairs = from_varints(np.frombuffer(b"".join(terms["postings"]), np.uint8)).reshape(-1, 2)
        first = np.cumsum(df) - df
        run_on = np.cumsum(pairs[:, 0])
        docs = run_on - np.repeat(run_on[first] - pairs[first, 0], df)
        gains = (1_000_000_000 * pairs[:, 1]) // (1000 * pairs[:, 1] + 20 * m[docs]) * np.repeat(terms["weight"].to_numpy(np.int64), df)
        of: dict[int, list] = {}
        for a, b, queries in zip(first.tolist(), (first + df).tolist(), terms["queries"], strict=True):
            for q in queries:
                of.setdefault(int(q), []).append((docs[a:b], gains[a:b]))
        rows = [(q, int(ids[d]), s) for q, cursors in of.items() for s, d in merge_lists(cursors, k)]
        out = pd.DataFrame(rows, columns=["query", "doc_id", "score"], dtype="int64")
        return out.assign(doc_id=out["doc_id"].astype("Int64").mask(out["doc_id"] == NO_ID))

    hits = dealt.groupBy("shard", "block").cogroup(shards.groupBy("shard", "block")).applyInPandas(run, "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(small_or_shuffled(named.select("query", "item_id")), "query").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS_SQL = r"""unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
f AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, {_TERMS_SQL} AS term FROM d) GROUP BY r, doc_id, term),
n AS (SELECT r, sum(tf) AS n FROM f GROUP BY r),
g AS (SELECT count(*) AS docs, sum(n) AS len FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term),
q AS (SELECT DISTINCT item_id, text, term FROM (SELECT item_id, text, {_TERMS_SQL} AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))),
s AS (
  SELECT item_id, q.text, f.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // len)))) AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN n ON n.r = f.r, g
  GROUP BY item_id, q.text, f.r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= 50
"""
