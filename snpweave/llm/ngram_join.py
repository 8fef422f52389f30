"""N-gram Jaccard self-join with rare-first prefix, length, positional and suffix filters.

A document's set holds its distinct n-word shingles as 64-bit hashes. All shingles of all documents are
counted into a fixed-size count sketch, which orders every set rare-first; a document enters the join with
the first n - ceil(t*n) + 1 of them. Documents meet on prefix shingles; each pair left by the filters is
verified once, on the whole sets.

Equal sets are one class from the start, so copies never form pairs. Links are found in passes, for the sake of
groups with thousands of near copies: first every posting is paired with the first and with the previous one
of its list (a list that the sketch shows to be long is dealt over parts, whose first ones meet), then with the member of its list that has most links (in a group of edited copies the original)
and with the few that have its shingle foremost (the copies with the fewest edits), which joins nearly all of each group; last, all pairs of postings whose classes are still in different components
are verified, so no link between components is lost.

Null or empty text, or text without words: an empty set, linked with nothing, its own component. A text with
fewer than n words is one shingle. Null ids stay null (such rows still link others); a component whose ids are
all null is null. Repeated rows are copies. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snpweave.llm.common import SMALL_ROWS, array_parts, components, digest128, materialize, materialize_and_see, mix, shingle_hashes, small_or_shuffled, summed_arrays, text_blocks, with_text, word_hashes

SLOTS, SEEN, HUB_ROUNDS, LIST, BEFORE, MIDDLE = 1 << 19, 50_000, 1, 500, 16, 4
_KIND = "kind int, doc_id long, eid long, n int, d1 long, d2 long, h long, pos int, part int, buckets binary, text_key long"


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text in the batch."""
    for first, end, data, offsets in text_blocks(batch):
        hashes, bounds = word_hashes(data, offsets)
        for row in range(first, end):
            yield row, np.unique(shingle_hashes(hashes[bounds[row - first] : bounds[row - first + 1]], words))


def frequency_sketch(docs: DataFrame, words: int, slots: int = SLOTS) -> np.ndarray:
    """Occurrences of all shingles of all texts, added up in `slots` counters by hash: 4 bytes a counter, whatever
    the corpus. Parts are summed on the executors; the driver gets the one sum."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch):
                hashes, bounds = word_hashes(data, offsets)
                found = [shingle_hashes(hashes[bounds[i] : bounds[i + 1]], words) for i in range(end - first)]
                total += np.bincount((np.concatenate(found) & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
        yield from array_parts({0: total})

    found = summed_arrays(docs.select("text"), count, "<i8")
    return np.minimum(found.get(0, np.zeros(slots, np.int64)), 2**32 - 1).astype(np.uint32)


def strangers_on_a_counter(sketch: np.ndarray) -> float:
    """What a counter holds beside any one shingle, at most but for rare ones: the median counter and six standard deviations.
    It grows with the corpus, so that only shingles that are frequent in themselves count as long lists at any size."""
    usual = float(np.median(sketch))
    return usual + 6 * usual**0.5


def postings(docs: DataFrame, sketch: np.ndarray, words: int, percent: int) -> DataFrame:
    """kind 0: one row per document (doc_id, class eid of its task, n, digest, text_key); kind 1: the prefix postings of each
    class (eid, n, h, pos, part). A class seen before in the same task sends no postings again. A shingle that the sketch
    shows more than LIST times beyond what strangers put on its counter has its postings dealt over parts 1, 2, ... by class;
    others have part 0."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    slots, strangers = len(sketch), strangers_on_a_counter(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, seen, serial = shared.value, {}, TaskContext.get().partitionId() << 34
        for batch in batches:
            ids = batch.column(0).to_pylist()
            head, posts = [], []
            for row, s in _sets(batch, words):
                n = len(s)
                if n == 0:
                    head.append((ids[row], None, 0, None, None, None))
                    continue
                d = digest128(s)
                eid, buckets = seen.get(d), None
                if eid is None:
                    buckets = bucket_counts(s)
                    if len(seen) >= SEEN:
                        seen.clear()
                    eid = seen[d] = serial
                    serial += 1
                    p = n - -(-percent * n // 100) + 1
                    f = freq[(s & np.uint64(slots - 1)).astype(np.int64)]
                    order = np.lexsort((s, f))[:p]
                    lists = np.maximum(f[order] - strangers, 0).astype(np.uint64) // np.uint64(LIST)
                    deal = np.where(lists > 0, mix(np.full(p, eid, np.uint64)) % (lists + np.uint64(1)) + np.uint64(1), 0)
                    posts.append((eid, n, s[order], deal.astype(np.int32)))
                head.append((ids[row], eid, n, *d, buckets))
                if len(posts) >= 256:
                    yield _post_rows(posts)
                    posts = []
            if posts:
                yield _post_rows(posts)
            if head:
                c = list(zip(*head, strict=True))
                none = pa.nulls(len(head), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(head), np.int32)), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()), none, *[pa.nulls(len(head), pa.int32())] * 2, pa.array(c[5], pa.binary()), batch.column(2)], names=_names())

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, _KIND)


def _names() -> list[str]:
    return [x.split()[0] for x in _KIND.split(", ")]


def _post_rows(posts: list) -> pa.RecordBatch:
    sizes = np.array([len(p[2]) for p in posts])
    total = int(sizes.sum())
    none = pa.nulls(total, pa.int64())
    pos = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ones(total, np.int32)), none, pa.array(np.repeat(np.array([p[0] for p in posts], np.int64), sizes)), pa.array(np.repeat(np.array([p[1] for p in posts], np.int32), sizes)), none, none, pa.array(np.concatenate([p[2] for p in posts]).view(np.int64)), pa.array(pos.astype(np.int32)), pa.array(np.concatenate([p[3] for p in posts])), pa.nulls(total, pa.binary()), none],
        names=_names(),
    )


def set_table(texts: DataFrame, words: int) -> DataFrame:
    """(d1, d2, shingles): the whole set of every text, sorted, as little-endian 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, raw, size = [], [], 0
            for _, s in _sets(batch, words):
                if len(s):
                    d.append(digest128(s))
                    raw.append(s.astype("<u8").tobytes())
                    size += len(raw[-1])
                if size > 8 << 20:
                    yield _set_rows(d, raw)
                    d, raw, size = [], [], 0
            yield _set_rows(d, raw)

    return texts.select("text").mapInArrow(run, "d1 long, d2 long, shingles binary")


def _set_rows(d: list, raw: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), pa.array(raw, pa.binary())], names=["d1", "d2", "shingles"])


def bucket_counts(s: np.ndarray) -> bytes:
    """Sizes of the parts into which the leading bits of the hashes split a set, about two elements a part (a byte each;
    empty if one doesn't fit)."""
    bits = min(16, max(6, int(len(s) // 2).bit_length()))
    parts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return parts.astype(np.uint8).tobytes() if parts.max() < 256 else b""


def common_bound(x: bytes, y: bytes, most: int) -> int:
    """No more common elements than this: per part, the smaller of both sizes (the suffix filter, over all parts at once)."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if len(a) == 0 or len(b) == 0:
        return most
    k = min(len(a), len(b))
    return int(np.minimum(a.reshape(k, -1).sum(axis=1), b.reshape(k, -1).sum(axis=1)).sum())


def _least(n: int, percent: int) -> int:
    """The overlap that sets of n elements together need."""
    return -(-percent * n // (100 + percent))


def suffix_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of class ids that the bucket counts of both sets leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, m, n, x, y = (batch.column(i) for i in range(6))
            keep = pa.array([common_bound(p, q, min(i, j)) >= _least(i + j, percent) for i, j, p, q in zip(m.to_pylist(), n.to_pylist(), x.to_pylist(), y.to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    side = lambda k, n, x: classes.select(F.col("gid").alias(k), F.col("n").alias(n), F.col("buckets").alias(x))
    both = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b")
    return both.select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long")


def signatures(classes: DataFrame) -> DataFrame:
    """gid, sig: the bucket counts added up to 64 (null where one is above 127)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                sums = np.frombuffer(x, np.uint8).astype(np.int64).reshape(64, -1).sum(axis=1) if x else None
                out.append(sums.tolist() if sums is not None and sums.max() < 128 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int8()))], names=["gid", "sig"])

    return classes.select("gid", "buckets").mapInArrow(run, "gid long, sig array<tinyint>")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of class ids whose whole sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                keep.append(int((y[at] == x).sum()) >= _least(len(x) + len(y), percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = pairs.join(sets.select(F.col("gid").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("gid").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _near_sql(n1: str, p1: str, n2: str, p2: str, percent: int) -> str:
    """Length and positional filters of two postings of one shingle. At the first shingle that two sets share, in the
    common order, no more than it and what follows on the shorter side can be shared; every pair meets there."""
    most = f"least({n1} - {p1}, {n2} - {p2})"
    return f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) AND {100 + percent} * {most} >= {percent} * ({n1} + {n2})"


def _near(n1: str, p1: str, n2: str, p2: str, percent: int):
    return F.expr(_near_sql(n1, p1, n2, p2, percent))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    return jaccard_groups(docs, words, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """jaccard_components with text_key (xxhash64 of the text) and component, which tells groups apart whatever their
    ids; it is null for texts without words."""
    source = with_text(docs, id_col, text_col)
    sketch = frequency_sketch(source, words)
    table = materialize(postings(source, sketch, words, percent), "postings")
    heads = table.where("kind = 0").select("doc_id", "text_key", "eid", "n", "d1", "d2", "buckets")
    classes = heads.where("n > 0").groupBy("d1", "d2").agg(F.min("eid").alias("gid"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("buckets", ignorenulls=True).alias("buckets"))
    classes = materialize(classes, "classes")
    local = heads.where("n > 0").select("eid", "d1", "d2").distinct()
    gid_of = materialize(local.join(classes.select("d1", "d2", "gid"), ["d1", "d2"]).select("eid", "gid"), "gids")

    cell = F.struct("eid", "n", "pos")

    def in_line(df: DataFrame, keys: list[str]) -> DataFrame:
        by = Window.partitionBy(*keys).orderBy("n", "eid")
        return df.select("*", F.lag(cell).over(by).alias("prev"), F.lead("eid").over(by).alias("next"), F.first(cell).over(by).alias("first"))

    lists = in_line(table.where("kind = 1").select("h", "part", "eid", "n", "pos"), ["h", "part"])
    lists = materialize(lists.where("prev IS NOT NULL OR next IS NOT NULL OR part > 0").drop("next"), "lists")

    # pass 1: each posting with the first and the previous one of its part of the list, and so the first ones of the parts
    tops = in_line(lists.where("part > 0 AND prev IS NULL").select("h", "eid", "n", "pos"), ["h"])
    met = lists.select("eid", "n", "pos", "prev", "first").unionAll(tops.select("eid", "n", "pos", "prev", "first")).where("prev IS NOT NULL")
    met = met.select("eid", "n", "pos", F.explode(F.array("prev", "first")).alias("o"))
    met = met.where(_near("n", "pos", "o.n", "o.pos", percent)).select("eid", F.col("o.eid").alias("other")).distinct()
    met = met.join(gid_of, "eid").select(F.col("gid").alias("a"), F.col("other").alias("eid")).join(gid_of, "eid").select("a", F.col("gid").alias("b"))
    met = met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first_pairs = materialize(suffix_filter(met, classes, percent), "pairs")

    def sets_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("gid")).distinct()
        needed, seen = materialize_and_see(ids.join(classes.select("gid", "doc_id", "d1", "d2"), "gid"), "needed", n=F.count(F.lit(1)))
        side = F.broadcast if seen["n"] <= SMALL_ROWS else lambda df: df
        keys = side(needed.select("doc_id").distinct())
        texts = source.alias("s").join(keys.alias("k"), F.expr("s.doc_id <=> k.doc_id"), "left_semi")
        found = set_table(texts, words).join(side(needed.select("d1", "d2", "gid")), ["d1", "d2"])
        return materialize(found.select("gid", "shingles").dropDuplicates(["gid"]), "sets")

    links = materialize(verify(first_pairs, sets_of(first_pairs), percent), "links1")

    grouped = lists.select("h", "eid", "n", "pos").join(gid_of, "eid").groupBy("h", "gid").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    grouped, tried = materialize(grouped, "grouped"), first_pairs

    def still_open() -> DataFrame:
        """Postings with their component, of lists that hold more than one."""
        part = components(links)
        shown = grouped.join(part.withColumnRenamed("id", "gid"), "gid", "left").withColumn("component", F.coalesce("component", "gid"))
        shown = materialize(shown, "shown")
        split = shown.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("h", "size")
        return materialize(shown.join(small_or_shuffled(split), "h"), "open")

    # pass 2: every posting with the member of its list that has most links so far and with the MIDDLE ones that have it
    # foremost, if they are in another component. A copy's own edits are rare and come before what it shares with others, so
    # these are the copies with the fewest edits, which link with copies that have too many to link with each other. A long
    # list is dealt over parts by hash, each with foremost ones of its own
    rows = still_open()
    for round_ in range(HUB_ROUNDS):
        degree = links.select(F.explode(F.array("a", "b")).alias("gid")).groupBy("gid").agg(F.count("*").alias("degree"))
        hubs = rows.join(degree, "gid").groupBy("h").agg(F.max(F.struct("degree", "gid", "n", "pos", "component")).alias("o"))
        by_hub = rows.join(small_or_shuffled(hubs), "h").select("gid", "n", "pos", "component", F.struct("o.gid", "o.n", "o.pos", "o.component").alias("o"))
        dealt = rows.select("*", F.xxhash64("gid", F.lit(round_)).alias("at")).withColumn("part", F.expr(f"pmod(at, size div {LIST} + 1)"))
        ahead = Window.partitionBy("h", "part").orderBy("pos", "at")
        foremost = F.array(*[F.nth_value(F.struct("gid", "n", "pos", "component"), k + 1).over(ahead) for k in range(MIDDLE)])
        others = F.expr(f"filter(o, x -> x.component <> component AND {_near_sql('n', 'pos', 'x.n', 'x.pos', percent)})")
        by_pos = dealt.select("gid", "n", "pos", "component", foremost.alias("o")).select("gid", "n", "pos", "component", F.explode(others).alias("o"))
        met = by_hub.unionAll(by_pos).where("component <> o.component").where(_near("n", "pos", "o.n", "o.pos", percent))
        met = met.select(F.least("gid", "o.gid").alias("a"), F.greatest("gid", "o.gid").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        met = materialize(suffix_filter(met, classes, percent), "pairs")
        links = materialize(links.unionAll(verify(met, sets_of(met), percent)), "links")
        tried, rows = tried.unionAll(met), still_open()

    # pass 3: all pairs of one list that are still in different components, each at the first list that both are in (the
    # BEFORE lists before it are compared, so few pairs are met twice), if 64 bucket sums leave it possible
    own = rows.groupBy("gid").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("p"))
    own = own.join(signatures(classes.join(own.select("gid"), "gid", "left_semi")), "gid")
    cells = F.expr(f"transform(p, (x, i) -> struct(x.h AS h, x.pos AS pos, transform(slice(p, greatest(i - {BEFORE - 1}, 1), least(i, {BEFORE})), y -> y.h) AS before))")
    shown = own.select("gid", "n", "component", "sig", F.explode(cells).alias("c")).select("gid", "n", "component", "sig", "c.h", "c.pos", "c.before")
    shown = materialize(shown, "shown")
    common = f"coalesce({100 + percent} * aggregate(zip_with(l.sig, r.sig, (x, y) -> least(x, y)), 0, (t, x) -> t + x) >= {percent} * (l.n + r.n), true)"
    l, r = shown.alias("l"), shown.alias("r")
    crossing = l.join(r, F.expr("l.h = r.h AND l.gid < r.gid AND l.component <> r.component") & _near("l.n", "l.pos", "r.n", "r.pos", percent) & F.expr("NOT arrays_overlap(l.before, r.before)") & F.expr(common))
    crossing = crossing.select(F.col("l.gid").alias("a"), F.col("r.gid").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    crossing = materialize(suffix_filter(crossing, classes, percent), "crossing")
    all_links = materialize(links.unionAll(verify(crossing, sets_of(crossing), percent)), "links")
    whole = materialize(components(all_links), "components")

    member = classes.drop("n", "buckets").join(whole.withColumnRenamed("id", "gid"), "gid", "left").withColumn("component", F.coalesce("component", "gid"))
    names = member.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = member.join(names, "component").select("d1", "d2", "component", "component_id")
    return heads.join(named, ["d1", "d2"], "left").select("doc_id", "text_key", "component", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a AS id, a AS reach FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
m AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""
