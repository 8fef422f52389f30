"""From raw documents to packed sequences: five stages, each on all that its predecessor kept.

Rows are named by their id and a hash of their text, so repeated ids with different texts are told apart. A stage that
filters or edits sends only its decisions to the documents; they are broadcast if a count shows that they are few.
Null texts count as empty throughout; rows with a null id are scored, edited and packed like others, and dropped as
copies of others like them. Empty tables give empty results. Columns beside those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snpweave.llm.common import materialize, small_or_shuffled
from snpweave.llm.ngram_join import jaccard_groups
from snpweave.llm.packing import pack
from snpweave.llm.quality import score_quality
from snpweave.llm.secrets import redact
from snpweave.llm.suffix_dedup import cut_spans, removed_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))


def _same(left: str, right: str):
    return F.expr(f"{left}.doc_id <=> {right}.doc_id AND {left}.text_key = {right}.text_key")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = small_or_shuffled(scored.where("predicted = 0").select("doc_id", "text_key").distinct())
    return _keyed(docs).alias("d").join(bad.alias("b"), _same("d", "b"), "left_anti").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked at a word-shingle Jaccard of 0.75 stays: that with the smallest id (null ids last),
    of one id that with the smallest text key. Texts without words are in no group; of those with one id and text one
    stays."""
    found = materialize(jaccard_groups(docs).select("doc_id", "text_key", "component"), "groups")
    linked = found.where("component IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    groups = small_or_shuffled(linked.groupBy("component").agg(first, F.count("*").alias("n")).where("n > 1").select("component", "first.doc_id", "first.text_key"))
    others = linked.alias("l").join(groups.alias("g"), F.expr("l.component = g.component")).where(~_same("l", "g"))
    gone = small_or_shuffled(others.select("l.doc_id", "l.text_key").distinct())
    kept = _keyed(docs).alias("d").join(gone.alias("g"), _same("d", "g"), "left_anti")
    named = found.where("component IS NOT NULL OR doc_id IS NOT NULL")
    twice = small_or_shuffled(named.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key")).alias("t")
    again = kept.join(twice, _same("d", "t"), "left_semi").dropDuplicates(["doc_id", "text_key"]).select(*COLUMNS)
    return kept.join(twice, _same("d", "t"), "left_anti").select(*COLUMNS).unionByName(again)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 400 bytes or more that stand at several places are cut out everywhere."""
    spans = removed_spans(docs).where("n_removed > 0").select("doc_id", F.col("tk").alias("text_key"), "spans").dropDuplicates(["doc_id", "text_key"])
    return cut_spans(_keyed(docs), spans, COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return redact(docs, COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_join", near_duplicate_stage),
    ("suffix_dedup", repeated_passage_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
