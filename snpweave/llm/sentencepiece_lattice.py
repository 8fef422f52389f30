"""SentencePiece encoding and decoding by a relational lattice over distinct words.

1. Texts are cut where no piece can reach over: before a run of space marks and around characters that no piece holds.
   Texts become chunks: a body of local word numbers, and a question for each of the chunk's distinct words. One exchange
   deals bodies by chunk and questions by word; all that follows keeps that dealing.
2. Lattice. Every distinct word of the corpus is exploded into its substrings of at most the longest piece; these are
   joined with the piece table (bounded by the model, broadcast); the edges that match are grouped by word.
3. Fold, a Spark higher-order `aggregate` over a word's edges. For a unigram model `viterbi` finds the path of the
   highest sum of log probabilities. The model that the query uses is a merge model (BPE), whose scores are merge
   ranks: a best path by sums gives other segmentations than the library, so `merge_fold` takes the edges by rank and
   place and merges an edge if its ends are boundaries and exactly one boundary lies between.
4. The answers to a chunk's questions, packed, go back to it, and it lines up the ids. Characters without a piece become
   bytes.

Why one fold by rank is the library's result: the library merges, again and again, the adjacent pair of the least rank.
It could differ only if a pair appeared whose rank is less than that of a merge already made. Both ends of such a pair P
are boundaries, and boundaries never come back, so nothing has been merged over them, and what happened between them is
what happens to P's characters alone. `Pieces` checks for every piece that ranks are distinct and that folding its
characters alone, by rank, ends in the piece itself; so P would have been merged at its rank. (By induction over length.)
Only pieces that are nothing but marks may share a rank; runs of marks are compared with the library up to eight times the
longest piece.

Words of more than 61 characters (a long's bits hold the boundaries) are folded by the same rule in Python, where the
boundaries of others become ids; results don't depend on the limit.

Null or empty text: no ids. Null ids are kept. Repeated rows are encoded each. An empty table gives no rows. Extra
columns are ignored. Decoding gives the text back, except that a space mark inside the text becomes a space.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snpweave.llm.common import n_partitions, with_text
from snpweave.llm.lm_scoring import pack_bytes, unpack_bytes
from snpweave.llm.token_counts import MARK, _model_path, piece_model

CHUNK_WORDS, LONGEST = 5_000_000, 61
SLICE = 200_000  # words whose ids are lined up at once
ASKED = 400_000  # questions that are answered together


class Pieces:
    """Pieces of a model by text, the id of byte 0, the longest piece and the cut pattern."""

    def __init__(self, path: str) -> None:
        model = piece_model(path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = [model.get_score(i) for i in normal if len(self.names[i].strip(MARK)) > 0 and len(self.names[i]) > 1]
        if len(set(scores)) < len(scores):
            raise ValueError("two pieces have one rank")
        ranks = np.argsort(np.argsort([-model.get_score(i) for i in normal], kind="stable"), kind="stable")
        self.rank = {self.names[i]: int(r) for i, r in zip(normal, ranks, strict=True)}
        self.id = {self.names[i]: i for i in normal}
        self.byte0 = model.piece_to_id("<0x00>")
        self.longest = max(map(len, self.rank))
        held = set("".join(self.rank))
        cuts = "".join(c for c in "\n\t\r\v\f" if c not in held)
        if any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in self.rank):
            raise ValueError("a piece reaches over the start of a word")
        self.cut = re.compile(f"[{re.escape(cuts)}]|{MARK}+[^{MARK}{re.escape(cuts)}]*|[^{MARK}{re.escape(cuts)}]+") if cuts else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        for p in self.rank:
            if self.fold(p) != [self.id[p]]:
                raise ValueError(f"merges in {p!r} are not in the order of ranks")
        for k in range(2, 8 * self.longest):
            if self.fold(MARK * k) != model.encode(" " * (k - 1)):
                raise ValueError("a run of marks is merged in another order")
        self.raw = [bytes([i - self.byte0]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.names)]

    def fold(self, word: str) -> list[int]:
        """The merge rule in Python, for words too long for a long's bits."""
        n = len(word)
        edges = sorted((self.rank[word[i:j]], i, j) for i in range(n) for j in range(i + 2, min(n, i + self.longest) + 1) if word[i:j] in self.rank)
        after, before = list(range(1, n + 1)), list(range(-1, n))  # next boundary after, and before, each boundary
        alive = [True] * (n + 1)
        after.append(n + 1)
        for _, i, j in edges:
            if alive[i] and alive[j] and after[i] < j and after[after[i]] == j:
                alive[after[i]] = False
                after[i], before[j] = j, i
        ids, i = [], 0
        while i < n:
            j = after[i]
            ids += [self.id[word[i:j]]] if word[i:j] in self.id else [self.byte0 + b for b in word[i:j].encode()]
            i = j
        return ids

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """piece, rank."""
    return spark.createDataFrame(list(pieces_of(path).rank.items()), "piece string, rank int")


def stage_words(docs: DataFrame, path: str) -> DataFrame:
    """Rows of chunks. A question: key (a word), the chunk (a digest of what it holds) and at (the word's number in it,
    frequent ones first). A body: key (the digest as text), the chunk, at null, and the packed word numbers, sizes (words),
    ids, and for each text whether its id is null (1) and whether it holds a space mark (2)."""
    schema = "key string NOT NULL, chunk long NOT NULL, at int, body binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(ids: list, sizes: list, marks: list, words: array, vocab: dict) -> Iterator[pa.RecordBatch]:
        local = np.frombuffer(words, "<u4") if words else np.zeros(0, "<u4")
        order = np.argsort(-np.bincount(local, minlength=len(vocab)), kind="stable")
        place = np.empty(len(order), "<u4")
        place[order] = np.arange(len(order), dtype="<u4")  # frequent words get small numbers, which pack better
        parts = [pack_bytes(place[local] if len(local) else local), pack_bytes(np.array(sizes, "<u4")), pack_bytes(np.array([i or 0 for i in ids], "<i8")), bytes((i is None) + 2 * m for i, m in zip(ids, marks, strict=True))]
        body = b"".join(len(x).to_bytes(8, "little") + x for x in parts)
        texts = pa.array(vocab, pa.string()).take(pa.array(order))
        key = hashlib.blake2b(body, digest_size=8)
        for x in texts.buffers()[1:]:
            key.update(x or b"")
        chunk = int.from_bytes(key.digest(), "little", signed=True)
        yield pa.RecordBatch.from_arrays([pa.array([str(chunk)]), pa.array([chunk], pa.int64()), pa.nulls(1, pa.int32()), pa.array([body], pa.binary())], names=names)
        for at in range(0, len(texts), 20_000):
            some = texts.slice(at, 20_000)
            yield pa.RecordBatch.from_arrays([some, pa.array(np.full(len(some), chunk)), pa.array(np.arange(at, at + len(some), dtype=np.int32)), pa.nulls(len(some), pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = pieces_of(path).cut.findall
        ids, sizes, marks, words, vocab = [], [], [], array("I"), {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                found = cut(MARK + text.replace(" ", MARK)) if text else []
                for w in set(found):
                    if w not in vocab:
                        vocab[w] = len(vocab)
                words.extend(map(vocab.__getitem__, found))
                ids.append(doc_id)
                sizes.append(len(found))
                marks.append(MARK in text)
                if len(words) >= CHUNK_WORDS:
                    yield from rows(ids, sizes, marks, words, vocab)
                    ids, sizes, marks, words, vocab = [], [], [], array("I"), {}
        if ids:
            yield from rows(ids, sizes, marks, words, vocab)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def lattice(words: DataFrame, table: DataFrame, longest: int, keys: list[str], edge: Column, none: Column) -> DataFrame:
    """keys and edges of every word: `edge` (of the piece's row, its start i from 1, its size l and the word's size n) for
    each piece of more than one character that stands in the word, and `none` once. Substrings are exploded, joined with the
    pieces and grouped by word; the row of a word's first character stays for words without edges and gives `none`."""
    n = F.length("word").alias("n")
    spots = words.select(*keys, "word", n).select("*", F.explode(F.expr("sequence(1, n)")).alias("i"))
    sizes = F.expr(f"CASE WHEN i = 1 THEN sequence(1, least({longest}, n)) WHEN i < n THEN sequence(2, least({longest}, n - i + 1)) ELSE array() END")
    spots = spots.select("*", F.explode(sizes).alias("l"))
    parts = spots.select(*keys, "n", "i", "l", F.expr("substring(word, i, l)").alias("piece"))
    edges = parts.join(F.broadcast(table.where(F.length("piece") > 1).withColumn("found", F.lit(True))), "piece", "left").where("found OR (i = 1 AND l = 1)")
    return edges.select(*keys, F.when(F.col("found"), edge).otherwise(none).alias("e")).groupBy(*keys).agg(F.collect_list("e").alias("edges"))


def _ranked() -> tuple[Column, Column]:
    """An edge as one number that sorts by rank and place, and the word's size as one below 0."""
    return F.expr("shiftleft(cast(rank AS long), 32) | shiftleft(cast(i - 1 AS long), 16) | cast(i + l - 1 AS long)"), F.expr("cast(-n AS long)")


def merge_fold() -> Column:
    """Boundaries (bit b: a boundary before character b) after all merges by rank and place."""
    i, j = "cast(shiftright(e, 16) & 65535 AS int)", "cast(e & 65535 AS int)"
    inside = f"shiftleft(shiftleft(1L, {j} - {i} - 1) - 1L, {i} + 1)"
    return F.expr(f"""
      aggregate(sort_array(edges), 0L, (acc, e) -> CASE
        WHEN e < 0 THEN shiftleft(1L, cast(1 - e AS int)) - 1L
        WHEN (shiftright(acc, {i}) & 1L) = 0L OR (shiftright(acc, {j}) & 1L) = 0L THEN acc
        WHEN bit_count(acc & {inside}) = 1 THEN acc & ~{inside}
        ELSE acc END)""")


def viterbi(words: DataFrame, table: DataFrame, longest: int, unknown: float) -> DataFrame:
    """word and its boundaries on the path of the highest sum of scores, for a unigram table (piece, score double) with all
    scores below 0; a character that is no piece costs `unknown`. Of equal sums the one whose last piece is longest wins.

    The fold goes over the ends of pieces: it holds the best sum at every place so far and where its last piece begins."""
    singles = F.broadcast(table.where(F.length("piece") == 1).select(F.col("piece").alias("c"), F.col("score").alias("one")))
    chars = words.select("word", F.explode(F.expr("sequence(1, length(word))")).alias("i")).withColumn("c", F.expr("substring(word, i, 1)"))
    ones = chars.join(singles, "c", "left").groupBy("word").agg(F.expr(f"transform(sort_array(collect_list(struct(i, coalesce(one, {unknown}D) AS one))), x -> x.one)").alias("ones"))
    edge = F.struct("score", (F.col("i") - 1).alias("i"), (F.col("i") + F.col("l") - 1).alias("j"))
    lat = lattice(words, table, longest, ["word"], edge, F.lit(None)).withColumn("n", F.length("word")).join(ones, "word")
    fold = F.expr("""
      aggregate(sequence(1, n), named_struct('sum', array(0D), 'start', array(0)), (acc, b) ->
        named_struct('sum', concat(acc.sum, array(array_max(concat(array(acc.sum[b - 1] + ones[b - 1]), transform(filter(edges, e -> e.j = b), e -> acc.sum[e.i] + e.score))))),
                     'start', concat(acc.start, array(-array_max(concat(array(named_struct('s', acc.sum[b - 1] + ones[b - 1], 'i', 1 - b)), transform(filter(edges, e -> e.j = b), e -> named_struct('s', acc.sum[e.i] + e.score, 'i', -e.i)))).i))))""")
    lat = lat.withColumn("best", fold)
    back = F.expr("aggregate(sequence(1, n), array(n), (cuts, x) -> CASE WHEN cuts[size(cuts) - 1] > 0 THEN concat(cuts, array(best.start[cuts[size(cuts) - 1]])) ELSE cuts END)")
    return lat.select("word", F.array_sort(back).alias("cuts"), F.expr("best.sum[n]").alias("score"))


def word_ids(word: str, mask: int | None, p: Pieces) -> list[int]:
    """Ids of a word from its boundaries; without them by the rule itself."""
    if mask is None:
        return p.fold(word)
    ids, i, mask = [], 0, mask >> 1
    while mask:
        j = i + (mask & -mask).bit_length()
        mask >>= j - i
        one = p.id.get(word[i:j])
        ids += [one] if one is not None else [p.byte0 + b for b in word[i:j].encode()]
        i = j
    return ids


def _only(rows: DataFrame, condition: str, *columns: str) -> DataFrame:
    """Some rows of an exchange that others read too: a filter would go below it and make it another one, an array of one
    row or none doesn't."""
    kept = F.explode(F.expr(f"CASE WHEN {condition} THEN array(struct({', '.join(columns)})) ELSE array() END")).alias("r")
    return rows.select("key", kept).select("key", *[f"r.{c}" for c in columns])


def answers(asked: DataFrame, path: str) -> DataFrame:
    """Rows (whose: the chunk as text, reply) from rows (chunk, at, word, mask): packed word numbers, sizes, ids, and the numbers of words that
    don't decode to themselves. A chunk has one row for some of its words."""

    def flush(chunks: list, ats: list, owners: list, ids: array, sizes: array, bad: list[bool]) -> pa.RecordBatch:
        chunk, at, word = (np.concatenate(x) for x in (chunks, ats, owners))
        flat, size = np.frombuffer(ids, "<u4"), np.array(sizes, np.int64)
        first = np.cumsum(size) - size
        order = np.lexsort((at, chunk))
        chunk, at, word = chunk[order], at[order], word[order]
        cut = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        wrong = np.array(bad)[word]
        packed = []
        for i, j in zip(cut, np.append(cut[1:], len(chunk)), strict=True):
            n = size[word[i:j]]
            ends = np.cumsum(n)
            own = flat[np.repeat(first[word[i:j]] - (ends - n), n) + np.arange(int(n.sum()))]
            parts = [pack_bytes(np.diff(at[i:j], prepend=0).astype("<u4")), pack_bytes(n.astype("<u4")), pack_bytes(own), pack_bytes(at[i:j][wrong[i:j]].astype("<u4"))]
            packed.append(b"".join(len(x).to_bytes(8, "little") + x for x in parts))
        return pa.RecordBatch.from_arrays([pa.array([str(c) for c in chunk[cut]]), pa.array(packed, pa.binary())], names=["whose", "reply"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(path)
        chunks, ats, owners, n = [], [], [], 0
        ids, sizes, bad = array("I"), array("I"), []
        for batch in batches:
            if len(batch) == 0:
                continue
            runs = pc.run_end_encode(batch.column(2))  # a word's questions come one after the other
            length = np.diff(runs.run_ends.to_numpy(), prepend=0)
            masks = batch.column(3).take(pa.array(runs.run_ends.to_numpy() - 1)).to_pylist()
            for word, mask in zip(runs.values.to_pylist(), masks, strict=True):
                own = word_ids(word, mask, p)
                ids.extend(own)
                sizes.append(len(own))
                bad.append(b"".join([p.raw[x] for x in own]) != word.replace(MARK, " ").encode())
            chunks.append(batch.column(0).to_numpy())
            ats.append(batch.column(1).to_numpy().astype(np.int64))
            owners.append(np.repeat(np.arange(len(sizes) - len(length), len(sizes)), length))
            n += len(batch)
            if n >= ASKED:
                yield flush(chunks, ats, owners, ids, sizes, bad)
                chunks, ats, owners, n = [], [], [], 0
                ids, sizes, bad = array("I"), array("I"), []
        if n:
            yield flush(chunks, ats, owners, ids, sizes, bad)

    return asked.mapInArrow(run, "whose string, reply binary")


def _parts(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, round_trip (whether decoding gives the text back)."""
    path = path or _model_path()
    p, spark = pieces_of(path), docs.sparkSession
    parts = 4 * n_partitions(spark)
    dealt = stage_words(with_text(docs, id_col, text_col), path).repartition(parts, "key")
    asked = _only(dealt, "at IS NOT NULL", "chunk", "at", "body")
    words = _only(dealt, f"at IS NOT NULL AND length(key) <= {LONGEST}", "chunk", "at", "body").select(F.col("key").alias("word")).distinct()
    folded = lattice(words, piece_table(spark, path), p.longest, ["word"], *_ranked()).select(F.col("word").alias("key"), merge_fold().alias("mask"))
    known = asked.join(folded, "key", "left").select("chunk", "at", F.col("key").alias("word"), "mask", "body")
    reply = answers(known, path).repartition(parts, "whose").groupBy("whose").agg(F.collect_list("reply").alias("replies"))
    bodies = _only(dealt, "at IS NULL", "chunk", "at", "body")
    joined = bodies.join(reply, F.col("key") == F.col("whose"), "left").select("body", "replies", "chunk", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, replies in zip(batch.column(0), batch.column(1), strict=True):  # the others keep both sides' columns alike
                head = _parts(body.as_py())
                got = [[unpack_bytes(x, "<u4").astype(np.int64) for x in _parts(r)] for r in (replies.as_py() or [])]
                got = [r + [np.zeros(0, np.int64)] * (4 - len(r)) for r in got]
                at = np.concatenate([np.cumsum(r[0]) for r in got]) if got else np.zeros(0, np.int64)
                sizes, flat, bad_at = (np.concatenate([r[k] for r in got]) if got else np.zeros(0, np.int64) for k in (1, 2, 3))
                local = unpack_bytes(head[0], "<u4")
                if len(np.unique(at)) != (int(local.max()) + 1 if len(local) else 0):
                    raise RuntimeError("words of a chunk without an answer: its source gives other rows when it is read again")
                size, first, bad = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
                size[at], first[at], bad[bad_at] = sizes, np.cumsum(sizes) - sizes, True
                flat, n_words = flat.astype(np.int32), unpack_bytes(head[1], "<u4").astype(np.int64)
                doc_ids, marks = unpack_bytes(head[2], "<i8"), np.frombuffer(head[3], np.uint8)
                end, doc = np.cumsum(n_words), 0
                while doc < len(n_words):  # some documents at a time
                    begin = int(end[doc] - n_words[doc])
                    stop = max(doc + 1, int(np.searchsorted(end, begin + SLICE, side="right")))
                    mine = local[begin : int(end[stop - 1])]
                    count = size[mine]
                    ends = np.append(0, np.cumsum(count))
                    tokens = flat[np.repeat(first[mine] - ends[:-1], count) + np.arange(int(ends[-1]))]
                    cuts = np.append(0, end[doc:stop] - begin)
                    wrong = np.diff(np.append(0, np.cumsum(bad[mine]))[cuts]) > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[doc:stop], pa.int64(), mask=marks[doc:stop] & 1 > 0), pa.array(np.diff(ends[cuts])), pa.ListArray.from_arrays(pa.array(ends[cuts].astype(np.int32)), pa.array(tokens)), pa.array(~(wrong | (marks[doc:stop] & 2 > 0)), pa.bool_())],
                        names=["doc_id", "n_tokens", "ids", "round_trip"],
                    )
                    doc = stop

    return joined.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of its ids."""
    path = path or _model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces_of(path).decode(x.as_py() or []) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
