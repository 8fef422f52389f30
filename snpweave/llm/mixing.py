"""Mixing sources to target weights by a low-discrepancy schedule.

Sources by code point (null last) get weights in a repeating cycle; their targets share all words by weight, no target
above `limit` times its source (what is above goes to the others by weight). The mix is a line of equal slots of about
`block` words, cut at the targets' running totals; slot i is read at the turn that is i's bits reversed (the van der
Corput sequence), so every stretch of turns holds each source in its share. A source's slots, ranked by turn, take one
block of its words after the other: its documents in an order shuffled by a hash, laid end to end and repeated. Slots and
documents meet by an equi-join on (source, block). The last slots of a source are shorter, so it takes its target to the word.

The share above all sources is settled in rounds of one small aggregate each. Slots are made from the sources' ends in
two steps and ranked by ranges of turns; documents are laid out by ranges of the hash; equal rows are counted first and
told apart at the end. So no source, id or repeated row meets in one task.

Null text or text without words: size 0, taken 0. A null source is a source of its own. Null ids are kept. Repeated rows are
mixed each, one behind the other. Without words all targets are 0. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snpweave.llm.common import materialize, materialize_and_see, small_or_shuffled
from snpweave.llm.prefix import running_total, running_total_in
from snpweave.shared import numbered

WORD = r"[^\x20\x09-\x0D]+"
STEP = 1 << 14  # slots or copies that one row is unfolded to, and turns that are ranked together


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, key, n): the distinct rows, key by id and text, and how often each occurs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"))
    return rows.groupBy("source", "doc_id", "size", "key").agg(F.count(F.lit(1)).alias("n"))


def with_targets(sources: DataFrame, cycle: tuple[int, ...], limit: int) -> DataFrame:
    """(source, source_size) with part, number, target and take (the target in whole words), by rounds: sources above the
    limit are set to it and the rest is shared anew, until no source is above."""
    ordered = materialize(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("number") % len(cycle) + 1).cast("int")).cast("long")
    table = materialize(numbered(ordered, "part", [F.col("source").asc_nulls_last()], "number").withColumn("weight", weight), "weights")
    whole, weights = (int(x or 0) for x in table.agg(F.sum("source_size"), F.sum("weight")).first())
    most, left = F.col("source_size") * limit, whole
    while weights:
        above = most < F.expr(f"(weight * {left} + {weights - 1}) div {weights}")
        w, full = (int(x or 0) for x in table.agg(F.sum(F.when(~above, F.col("weight"))), F.sum(F.when(above, most))).first())
        if (w, whole - full) == (weights, left):
            break
        weights, left = w, whole - full
    share = F.col("weight") * left
    target = F.when(above, most.cast("double")).otherwise(share.cast("double") / weights) if weights else F.lit(0.0)
    take = F.when(above, most).otherwise(F.expr(f"(weight * {left}) div {weights}")) if weights else F.lit(0)
    return table.select("source", "source_size", "part", "number", target.alias("target"), take.cast("long").alias("take"))


def unfold(df: DataFrame, first: Column, last: Column, out: str) -> DataFrame:
    """One row for each number from first to last, in two steps with a shuffle between, so that one row may become many."""
    far = df.withColumn("__last", last).withColumn("__from", F.explode(F.sequence(first, F.col("__last"), F.lit(STEP).cast("long"))))
    return far.repartition("number", "__from").withColumn(out, F.explode(F.sequence("__from", F.least("__last", F.col("__from") + STEP - 1)))).drop("__from", "__last")


def turns(sources: DataFrame, bits: int, width: int) -> DataFrame:
    """(number, turn, begin, length): the slots of each source; `begin` is where its block begins in the source's stream."""
    placed = running_total(sources, "take", "part", ["number"], "left").where("take > 0").withColumn("right", F.col("left") + F.col("take"))
    slots = unfold(placed.select("number", "left", "right"), F.expr(f"left div {width}"), F.expr(f"(right - 1) div {width}"), "slot")
    length = F.least("right", (F.col("slot") + 1) * width) - F.greatest("left", F.col("slot") * width)
    turn = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long") if bits else F.col("slot")
    # whole slots first, those cut at an end of the target after them
    chunk = F.when(F.col("length") < width, F.lit(1 << 50)).otherwise(F.expr(f"turn div {STEP}"))
    return running_total_in(slots.select("number", length.alias("length"), turn.alias("turn")).withColumn("chunk", chunk), "length", ["number"], "chunk", ["turn"], "begin").drop("chunk")


def mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), limit: int = 3, block: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix, one row a piece: turn and offset in its slot, the document (doc_id, size, source_size, target, number of its
    source, start in the source's line), first_word and n_words of the piece. Documents that are not taken have one row with
    n_words 0 and a null turn."""
    rows, seen = materialize_and_see(measured(docs, id_col, text_col, source_col), "sizes", n=F.count(F.lit(1)))
    sources = with_targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), cycle, limit)
    sources, told = materialize_and_see(sources, "targets", take=F.sum("take"))
    total = int(told["take"] or 0)
    bits = max(0, math.ceil(math.log2(max(1, total / block))))
    width = max(1, -(-total >> bits))

    fine = min(14, max(0, math.ceil(math.log2(max(1, seen["n"] / 500)))))
    of = small_or_shuffled(sources.select(F.col("source").alias("its"), "number", "source_size", "target", "take"))
    known = rows.join(of, F.col("source").eqNullSafe(F.col("its"))).drop("its", "source")
    known = known.withColumn("words", F.col("size") * F.col("n")).withColumn("chunk", F.shiftright(F.conv(F.substring("key", 1, 4), 16, 10).cast("int"), 16 - fine))
    lines = running_total_in(known, "words", ["number"], "chunk", ["key"], "start").drop("words", "chunk", "key")
    twice = unfold(lines.where("n > 1"), F.lit(0).cast("long"), F.col("n") - 1, "copy").withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    lines = lines.where("n = 1").drop("n").unionByName(twice.drop("n", "copy"))

    rounds = F.expr(f"filter(sequence(0L, {limit - 1}L), e -> size > 0 AND e * source_size + start < take)")
    spans = lines.withColumn("round", F.explode_outer(rounds)).withColumn("from", F.col("round") * F.col("source_size") + F.col("start"))
    spans = spans.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("take"))).withColumn("cell", F.explode_outer(F.expr(f"sequence(from div {width}, (to - 1) div {width})")))
    slots = turns(sources, bits, width).withColumn("cell", F.explode(F.expr(f"sequence(begin div {width}, (begin + length - 1) div {width})")))
    met = spans.alias("d").join(slots.alias("s"), F.expr("d.number = s.number AND d.cell = s.cell AND d.from < s.begin + s.length AND d.to > s.begin"), "left")
    begin = F.expr(f"greatest(d.from, s.begin, d.cell * {width})")
    n = F.expr(f"least(d.to, s.begin + s.length, (d.cell + 1) * {width})") - begin
    kept = ["doc_id", "size", "source_size", "target", F.col("d.number").alias("number"), "start"]
    out = met.select("turn", (begin - F.col("begin")).alias("offset"), *kept, (begin - F.col("from")).alias("first_word"), F.when(F.col("turn").isNull(), 0).otherwise(n).alias("n_words"))
    return out.where("turn IS NULL OR n_words > 0")


def taken_words(pieces: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    some = pieces.where("size > 0").groupBy("number", "start", "doc_id", "size", "source_size", "target").agg(F.sum("n_words").alias("taken"))
    out = ["doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return some.select(*out).unionByName(pieces.where("size = 0").withColumn("taken", F.lit(0)).select(*out))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (
  SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(source_size) OVER () AS whole,
         coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM s),
a AS (SELECT *, 3 * source_size * weights < weight * (whole - before) AS above FROM o),
l AS (SELECT any_value(whole) - coalesce(sum(3 * source_size) FILTER (above), 0) AS rest, sum(weight) FILTER (NOT above) AS shares FROM a),
t AS (
  SELECT source, source_size,
         CASE WHEN above THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / shares END AS target,
         CASE WHEN above THEN 3 * source_size ELSE (weight * rest) // shares END AS take
  FROM a, l),
p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (take // source_size) + greatest(0, least(size, take % source_size - start)) END AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
