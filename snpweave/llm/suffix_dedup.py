"""Removal of long byte strings that occur more than once, by suffix arrays.

Every byte covered by a `length`-byte string that also starts at another place (in any document) goes.

1. Candidates. In every window of `length` bytes the GRAM-byte strings with the smallest hash are its anchors
   (winnowing); equal windows have the same anchors, so a window can only repeat where one of its anchors does.
   Copies of one text are one entity, and anchors are counted over all documents.
2. Cores. The windows that hold a repeated anchor are taken in STEPS groups of neighbouring starts; what all windows
   of a group have in common is its core. Only cores that stand at several places go on. A string is a core with the
   few bytes on either side that its windows reach; equal strings are merged on the way, so a passage in thousands
   of documents is one string.
3. Shards. The strings of a core go to one shard, the core itself as a single symbol. Each shard builds a suffix array
   by Larsson-Sadakane refinement (rank doubling that sorts only groups still unsorted) and common prefixes by Kasai's
   rule (a suffix's common prefix is at least its left neighbour's less one, so only irreducible ones are compared).
   Runs of common prefixes that span a whole window are repeated windows.
4. The strings of a core with very many of them are dealt over several shards. Their windows are merged across these:
   sorted window digests by range, each looked up among those of all shards by binary search.

Null or empty text: nothing to remove. Null ids are kept. Repeated rows are copies of each other: texts of at
least `length` bytes then go altogether. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snpweave.llm.common import digest128, materialize, mix, n_partitions, prefix_hash, range_hash, small_or_shuffled, text_blocks, with_text

GRAM, STEPS = 232, 4
SHARD_BYTES = 1_500_000
SPLIT_AT, LEAST_SPLIT = 4_000, 250
_A = "kind int, doc_id long, rid long, tk long, eid long, n_bytes long, d1 long, d2 long, sha256 string, fp long, pos int"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- anchors


def sliding(a: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over a[i:i+w] for every i with a whole window (running op from both ends of blocks of w)."""
    n = len(a)
    if n < w:
        return a[:0]
    size = -(-n // w) * w
    x = np.full(size, fill, a.dtype)
    x[:n] = a
    x = x.reshape(-1, w)
    ahead = op.accumulate(x, axis=1).reshape(-1)
    back = op.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in data) and hashes of the anchors of all windows that lie inside one text."""
    n, w = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - gram + 1)
    h = range_hash(prefix_hash(data), at, at + gram)
    low = sliding(h, w, np.minimum, 2**64 - 1)
    size = np.diff(offsets)
    valid = np.zeros(len(low), bool)
    for a, b in zip(offsets[:-1][size >= length], offsets[1:][size >= length], strict=True):
        valid[a : b - length + 1] = True
    # hash 0 never marks an anchor; a window that crosses texts marks none
    low[~valid] = 0
    padded = np.zeros(len(low) + 2 * (w - 1), np.uint64)
    padded[w - 1 : w - 1 + len(low)] = low
    reach = sliding(padded, w, np.maximum, 0)[: len(h)]
    pos = np.flatnonzero((h == reach) & (reach > 0))
    return pos, h[pos]


def anchor_rows(source: DataFrame, length: int) -> DataFrame:
    """kind 0: one row per document; kind 1: anchors of each text (d1, d2: its digest) that is new in its task."""
    names = [x.split()[0] for x in _A.split(", ")]

    def rows(kind: int, n: int, **cols) -> pa.RecordBatch:
        types = {"pos": pa.int32(), "kind": pa.int32(), "sha256": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)) if k == "kind" else pa.array(cols[k], types.get(k, pa.int64())) if k in cols else pa.nulls(n, types.get(k, pa.int64())) for k in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, seen = TaskContext.get().partitionId() << 34, {}
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch):
                head: list = []
                fresh = []
                for i in range(end - first):
                    raw = data[offsets[i] : offsets[i + 1]]
                    d = digest128(raw)
                    eid = seen.get(d)
                    if eid is None:
                        if len(seen) >= 100_000:
                            seen.clear()
                        eid = seen[d] = serial
                        serial += 1
                        fresh.append(i)
                    head.append((eid, len(raw), *d, hashlib.sha256(raw.tobytes()).hexdigest()))
                c = list(zip(*head, strict=True))
                yield rows(0, end - first, doc_id=batch.column(0).slice(first, end - first), rid=batch.column(1).slice(first, end - first), tk=batch.column(2).slice(first, end - first), eid=c[0], n_bytes=c[1], d1=c[2], d2=c[3], sha256=c[4])
                pos, h = anchors(data, offsets, length)
                doc = np.searchsorted(offsets, pos, side="right") - 1
                new = np.zeros(end - first, bool)
                new[fresh] = True
                keep = new[doc]
                pos, h, doc = pos[keep], h[keep], doc[keep]
                if len(pos):
                    yield rows(1, len(pos), d1=np.array(c[2], np.int64)[doc], d2=np.array(c[3], np.int64)[doc], fp=h.view(np.int64), pos=(pos - offsets[doc]).astype(np.int32))

    return source.select("doc_id", "rid", "tk", "text").mapInArrow(run, _A)


# ---------------------------------------------------------------- cores of repeated anchors


def reach(length: int, gram: int = GRAM, steps: int = STEPS) -> int:
    """Starts in a group of windows less one: the bytes that its windows reach on either side of their core."""
    return -(-(length - gram + 1) // steps) - 1


def cores(texts: DataFrame, length: int, with_bytes: bool, gram: int = GRAM, steps: int = STEPS) -> DataFrame:
    """For every repeated anchor (gid, text, at: array of positions) and group of windows: two digests c1, c2 of the
    core and s1, s2 of the string, where the core starts, and (with_bytes) what stands before and after it."""
    schema = "c1 long, c2 long, s1 long, s2 long, gid long, start int" + (", ahead binary, after binary" if with_bytes else "")
    side = reach(length, gram, steps)
    size = length - side

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for gid, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                p = at.values.to_numpy().astype(np.int64)
                # the core of group k holds the anchor and ends it at the latest: its first window starts side before it
                start = np.unique(np.concatenate([p - k * (side + 1) for k in range(steps)]))
                start = start[(start >= 0) & (start + size <= len(raw))]
                lo, hi = np.maximum(0, start - side), np.minimum(len(raw), start + size + side)
                sums = [prefix_hash(raw, i) for i in (0, 1)]
                c = [range_hash(sums[i], start, start + size, i).view(np.int64) for i in (0, 1)]
                edge = (((start - lo) << 32) | (hi - lo)).astype(np.uint64)
                s = [(mix(range_hash(sums[i], lo, hi, i) ^ edge)).view(np.int64) for i in (0, 1)]
                cols = [pa.array(c[0]), pa.array(c[1]), pa.array(s[0]), pa.array(s[1]), pa.array(np.full(len(start), gid, np.int64)), pa.array(start.astype(np.int32))]
                if with_bytes:
                    cols += [pa.array([raw[x:y].tobytes() for x, y in zip(lo, start, strict=True)], pa.binary()), pa.array([raw[x:y].tobytes() for x, y in zip(start + size, hi, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return texts.select("gid", "text", "at").mapInArrow(run, schema)


# ---------------------------------------------------------------- suffix arrays


def suffix_array(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes of an array of symbols sorted by their first `length` symbols, the place of each in that order, and the
    ranks by first h symbols for doubling h (Larsson-Sadakane: each round sorts only groups that are still ties)."""
    n = len(text)
    each = 4 if n == 0 or int(text.max()) < 1 << 16 else 2
    padded = np.zeros(n + each, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for i in range(each):
        key = (key << np.uint64(64 // each)) | padded[i : n + i]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)).astype(np.int32)
    h, levels = each, [(each, rank.copy())]
    while h < length:
        step = min(h, length - h)
        first = np.flatnonzero(new)
        group_size = np.diff(np.append(first, n))
        tied = np.repeat(group_size > 1, group_size)
        at = np.flatnonzero(tied)
        if len(at):
            mine = order[at]
            nxt = np.where(mine + step < n, rank[np.minimum(mine + step, n - 1)], -1).astype(np.int64)
            both = (rank[mine].astype(np.int64) << 32) | (nxt + 1)
            by = np.argsort(both)
            order[at] = mine[by]
            both = both[by]
            new[at[1:]] |= both[1:] != both[:-1]
            rank = rank.copy()
            rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)).astype(np.int32)
        h += step
        levels.append((h, rank))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place, levels


def common_prefixes(text: np.ndarray, order: np.ndarray, place: np.ndarray, levels: list, length: int) -> np.ndarray:
    """Common prefix (at most `length`) of each suffix with the one before it in the order, by Kasai's rule."""
    n = len(text)
    left = np.full(n, -1, np.int64)
    left[order[1:]] = order[:-1]
    i = np.arange(n)
    reducible = (left > 0) & (i > 0) & (text[i - 1] == text[left - 1]) & (left[i - 1] == left - 1)
    at = np.flatnonzero(~reducible & (left >= 0))
    x, y, got = at.copy(), left[at].copy(), np.zeros(len(at), np.int64)
    whole = levels[-1][1]
    same = (whole[at] == whole[left[at]]) & (at + length <= n) & (left[at] + length <= n)
    got[same] = length
    live = ~same
    for h, rank in reversed(levels[:-1]):
        ok = live & (x + h <= n) & (y + h <= n)
        ok[ok] = rank[x[ok]] == rank[y[ok]]
        x[ok] += h
        y[ok] += h
        got[ok] += h
    for _ in range(levels[0][0]):
        ok = live & (x < n) & (y < n)
        ok[ok] = text[x[ok]] == text[y[ok]]
        live &= ok
        x[ok] += 1
        y[ok] += 1
        got[ok] += 1
    shared = np.full(n, -1, np.int64)
    shared[at] = np.minimum(got, length) + at
    prefix = np.maximum.accumulate(shared) - i
    prefix[left < 0] = 0
    # a reducible suffix follows one whose known common prefix may have been cut off at `length`
    prefix = np.where(reducible & (whole == whole[np.maximum(left, 0)]) & (i + length <= n) & (left + length <= n), length, np.maximum(prefix, 0))
    return np.minimum(prefix, length)[order]


def repeated_windows(core: np.ndarray, ahead: list[bytes], after: list[bytes], owner: np.ndarray, start: np.ndarray, copied: np.ndarray, side: int) -> list[np.ndarray]:
    """For each string (core number, bytes ahead of and after it; start: of its core in text `owner`; copied: it has
    equals elsewhere) which of its windows, by bytes ahead of the core, also stand at another place."""
    lead = np.array([len(x) for x in ahead])
    size = lead + 1 + np.array([len(x) for x in after])
    first = np.cumsum(size) - size
    text = np.frombuffer(b"".join(x + b"\0" + y for x, y in zip(ahead, after, strict=True)), np.uint8).astype(np.int64)
    text[first + lead] = 256 + core
    length = side + 1
    order, place, levels = suffix_array(text, length)
    prefix = common_prefixes(text, order, place, levels, length)
    run = np.cumsum(prefix < length)
    part = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(text)) - first[part]
    ok = ((inner <= lead[part]) & (size[part] - inner >= length))[order]
    suffix, run = order[ok], run[ok]
    flags = np.zeros(len(text), bool)
    if len(run):
        where = (owner[part[suffix]].astype(np.int64) << 32) | (start[part[suffix]] - lead[part[suffix]] + inner[suffix])
        edge = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        twice = (np.minimum.reduceat(where, edge) != np.maximum.reduceat(where, edge)) | np.logical_or.reduceat(copied[part[suffix]], edge)
        flags[suffix] = np.repeat(twice, np.diff(np.append(edge, len(run))))
    return [flags[f : f + n + 1][::-1] for f, n in zip(first, lead, strict=True)]


_SHARD = "s1 long, s2 long, spans array<int>, c1 long, c2 long, w1 long, w2 long, ahead int, gid long, start long, copied boolean"


def window_spans(ahead: np.ndarray, length: int) -> list[int]:
    """Union of windows given by their bytes ahead of the core (ascending), flat, relative to the core's start."""
    if len(ahead) == 0:
        return []
    return [-int(ahead[-1]), length - int(ahead[0])]  # they all hold the core


def shard_matches(shards: DataFrame, length: int) -> DataFrame:
    """Rows with spans: what each string of a shard repeats, relative to its core. Rows with w1, w2: digests and places
    of the windows of a core that is dealt over several shards."""
    side = reach(length)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ahead, after = [bytes(x) for x in pdf["ahead"]], [bytes(x) for x in pdf["after"]]
        core = np.unique(pdf["c1"].to_numpy() ^ (pdf["c2"].to_numpy() << 1), return_inverse=True)[1]
        owner = np.unique(pdf["gid"].to_numpy(), return_inverse=True)[1]
        start = pdf["start"].to_numpy().astype(np.int64)
        flags = repeated_windows(core, ahead, after, owner, start, pdf["copied"].to_numpy(), side)
        out = pdf[["s1", "s2"]].assign(spans=[window_spans(np.flatnonzero(f), length) for f in flags])
        out = out[[len(x) > 0 for x in out["spans"]]]
        found = [out.reindex(columns=[x.split()[0] for x in _SHARD.split(", ")])]
        split = np.flatnonzero(pdf["split"].to_numpy())
        for k in split:
            l = np.arange(max(0, side - len(after[k])), min(side, len(ahead[k])) + 1)
            raw = np.frombuffer(ahead[k] + after[k], np.uint8)
            w = [mix(range_hash(prefix_hash(raw, i), len(ahead[k]) - l, len(ahead[k]) - l + side, i) + l.astype(np.uint64)).view(np.int64) for i in (0, 1)]
            found.append(pd.DataFrame({"s1": pdf["s1"].iloc[k], "s2": pdf["s2"].iloc[k], "spans": None, "c1": pdf["c1"].iloc[k], "c2": pdf["c2"].iloc[k], "w1": w[0], "w2": w[1], "ahead": l, "gid": pdf["gid"].iloc[k], "start": start[k] - l, "copied": bool(pdf["copied"].iloc[k])}))
        whole = pd.concat(found) if len(found) > 1 else found[0]
        return whole.astype({k: "Int64" for k in ("c1", "c2", "w1", "w2", "ahead", "gid", "start")} | {"copied": "boolean"})

    return shards.groupBy("shard").applyInPandas(run, _SHARD)


def merge_across(windows: DataFrame, length: int, ranges: int) -> DataFrame:
    """Windows that stand at several places, of cores dealt over several shards: by range of the digest, all sorted, each
    looked up by binary search."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = lambda c: pdf[c].to_numpy().view(np.uint64)
        key = mix(mix(bits("w1") ^ bits("c1")) + (bits("w2") ^ mix(bits("c2"))))
        owner = np.unique(pdf["gid"].to_numpy(), return_inverse=True)[1]
        where = (owner.astype(np.int64) << 32) | pdf["start"].to_numpy()
        order = np.argsort(key, kind="stable")
        ordered, where, copied = key[order], where[order], pdf["copied"].to_numpy().astype(bool)[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        twice = (np.minimum.reduceat(where, first) != np.maximum.reduceat(where, first)) | np.logical_or.reduceat(copied, first)
        hit = pdf[twice[np.searchsorted(ordered[first], key)]]
        return hit.assign(spans=pd.Series([[-int(l), length - int(l)] for l in hit["ahead"]], dtype=object, index=hit.index))[["s1", "s2", "spans"]]

    flat = windows.withColumn("range", F.pmod("w1", F.lit(ranges)))
    return flat.groupBy("range").applyInPandas(run, "s1 long, s2 long, spans array<int>")


# ---------------------------------------------------------------- the operator


def merge_spans(flat: np.ndarray) -> np.ndarray:
    """Union of half-open spans (k, 2); touching spans become one."""
    flat = flat[np.argsort(flat[:, 0], kind="stable")]
    top = np.maximum.accumulate(flat[:, 1])
    cut = np.flatnonzero(flat[1:, 0] > top[:-1])
    return np.column_stack((flat[np.append(0, cut + 1), 0], top[np.append(cut, len(flat) - 1)]))


def removed_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, rid, tk, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (flat byte offsets)."""
    spark = docs.sparkSession
    source = with_text(docs, id_col, text_col).select("doc_id", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("rid"), F.xxhash64("text").alias("tk"), "text")
    rows = materialize(anchor_rows(source, length), "anchors")
    heads = rows.where("kind = 0").select("doc_id", "rid", "tk", "eid", "n_bytes", "d1", "d2", "sha256")
    classes = heads.groupBy("d1", "d2").agg(F.min("eid").alias("gid"), F.count("*").alias("copies"), F.min(F.struct("rid", "tk")).alias("of"), F.first("n_bytes").alias("n_bytes"))
    classes = materialize(classes.select("d1", "d2", "gid", "copies", "of.rid", "of.tk", "n_bytes"), "classes")

    # a text is named by its digest from the start: equal texts of several tasks are one, and only texts are given numbers
    found = rows.where("kind = 1").select("fp", "d1", "d2", "pos")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("d1", "d2", "pos") for f in (F.min, F.max)]
    spread = found.groupBy("fp").agg(*ends).where("min_d1 <> max_d1 OR min_d2 <> max_d2 OR min_pos <> max_pos").select("fp")
    # what is joined by a hash or a digest stands in a table of its own first, so that a join can split the rows of a hot one
    some = found.join(small_or_shuffled(spread), "fp", "left_semi")
    by_doc = some.groupBy("d1", "d2").agg(F.collect_set("pos").alias("at")).join(classes.select("d1", "d2", "gid", "rid", "tk"), ["d1", "d2"])
    texts = source.select("rid", "tk", "text").join(by_doc, ["rid", "tk"]).groupBy("rid", "tk").agg(F.first("gid").alias("gid"), F.first("text").alias("text"), F.first("at").alias("at"))
    texts = materialize(texts.select("gid", "text", "at"), "texts")

    strings = cores(texts, length, True).groupBy("c1", "c2", "s1", "s2", "ahead", "after").agg(F.min("gid").alias("gid"), F.min("start").alias("start"), ((F.min("gid") != F.max("gid")) | (F.min("start") != F.max("start"))).alias("copied"))
    strings = materialize(strings, "strings")
    kinds = strings.groupBy("c1", "c2").agg(F.count("*").alias("kinds")).where("kinds > 1")
    many = materialize(strings.join(small_or_shuffled(kinds), ["c1", "c2"]), "shared")
    size, rows_in = many.agg(F.sum(F.length("ahead") + F.length("after") + 1), F.count("*")).first()
    shards = max(n_partitions(spark), -(-(size or 0) // SHARD_BYTES))
    split = F.col("kinds") > min(SPLIT_AT, max(LEAST_SPLIT, rows_in // shards))  # a core gets no more than a shard's share
    many = many.withColumn("split", split).withColumn("shard", F.pmod(F.when(split, F.xxhash64("c1", "s1")).otherwise(F.xxhash64("c1", "c2")), F.lit(shards)))
    matches = materialize(shard_matches(many, length), "matches")
    crossed = merge_across(matches.where("w1 IS NOT NULL").drop("spans"), length, shards)
    core_size = length - reach(length)
    whole = strings.where("copied").select("s1", "s2", F.array(-F.length("ahead"), F.length("after") + core_size).alias("spans")).where(F.col("spans")[1] - F.col("spans")[0] >= length)
    # all windows of a string hold its core, so together they cover one span
    spans = matches.where("spans IS NOT NULL").select("s1", "s2", "spans").unionAll(crossed).unionAll(whole)
    spans = small_or_shuffled(spans.groupBy("s1", "s2").agg(F.array(F.min(F.col("spans")[0]), F.max(F.col("spans")[1])).alias("spans")))

    placed = cores(texts, length, False).select("s1", "s2", "gid", "start").join(spans, ["s1", "s2"])
    placed = placed.select("gid", F.expr("transform(spans, x -> x + start)").alias("spans"))
    placed = placed.groupBy("gid").agg(F.flatten(F.collect_set("spans")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for gid, text, flat in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                s = merge_spans(np.array(flat.as_py(), np.int64).reshape(-1, 2))
                raw, keep = text.as_py().encode(), hashlib.sha256()
                for a, b in zip(np.append(0, s[:, 1]), np.append(s[:, 0], len(raw)), strict=True):
                    keep.update(raw[a:b])
                out.append((gid, int((s[:, 1] - s[:, 0]).sum()), len(s), keep.hexdigest(), s.reshape(-1).tolist()))
            c = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string()), pa.array(c[4], pa.list_(pa.int64()))], names=["gid", "n_removed", "n_spans", "kept_sha256", "spans"])

    done = texts.select("gid", "text").join(placed, "gid").select("gid", "text", "spans").mapInArrow(cut, "gid long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    result = classes.join(done, "gid", "left").select(
        "d1", "d2",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(EMPTY_SHA)).otherwise(F.col("kept_sha256")).alias("kept"),
        F.when(gone, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"),
    )
    return heads.join(result, ["d1", "d2"]).select("doc_id", "rid", "tk", "n_bytes", "n_removed", "n_spans", F.coalesce("kept", "sha256").alias("kept_sha256"), "spans")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut_spans(docs: DataFrame, spans: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, text_key, text, ...) with the byte spans of `spans` (doc_id, text_key, spans) cut out of their
    texts; a character of which a part goes is dropped. n_chars follows the new text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, flat in zip(batch.column(0), batch.column(1), strict=True):
                raw, s = text.as_py().encode(), np.array(flat.as_py(), np.int64).reshape(-1, 2)
                out.append(b"".join(raw[a:b] for a, b in zip(np.append(0, s[:, 1]), np.append(s[:, 0], len(raw)), strict=True)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], names=["text", *batch.schema.names[2:]])

    side = materialize(spans, "cuts")
    keys = small_or_shuffled(side.select("doc_id", "text_key"))
    same = F.expr("d.doc_id <=> s.doc_id AND d.text_key = s.text_key")
    plain = docs.alias("d").join(keys.alias("s"), same, "left_anti").select(*columns)
    some = docs.alias("d").join(keys.alias("s"), same, "left_semi").alias("d").join(side.alias("s"), same)
    rest = [c for c in columns if c not in ("text", "n_chars")]
    some = some.select("d.text", "s.spans", *[f"d.{c}" for c in rest])
    schema = ", ".join(["text string", *[f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest]])
    return plain.unionByName(some.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long")).select(*columns))
