"""Scores on request: a stream of set requests is scored against a fixed dataset, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snpweave.functions.scalars import split_list
from snpweave.operators.scores import CLOSED_FORM, score_sets
from snpweave.operators.sets import MAX_SIZE
from snpweave.sources.readers import aliases


def answer(requests: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, snps: DataFrame, y: str) -> DataFrame:
    """request_id, score, value, status: requests(request_id, scores, snps: ';'-lists). 400: an unknown score or more than
    ten SNPs; 404: an unknown SNP; 200 otherwise, a row a score."""
    asked = requests.select("request_id", split_list(F.upper("scores"), ";").alias("scores"), F.array_distinct(split_list(F.col("snps"), ";")).alias("names"))
    members = asked.select("request_id", F.explode("names").alias("alias")).join(aliases(snps), "alias", "left")
    known = members.groupBy("request_id").agg(F.sum(F.col("snp_id").isNull().cast("int")).alias("unknown"), F.array_sort(F.collect_set("snp_id")).alias("ids"))
    wrong = F.size(F.array_except("scores", F.array(*[F.lit(c) for c in CLOSED_FORM]))) > 0
    asked = asked.join(known, "request_id", "left").withColumn("status", F.when(wrong | (F.size("names") > MAX_SIZE) | (F.size("names") == 0), 400).when(F.coalesce("unknown", F.lit(1)) > 0, 404).otherwise(200))
    good = asked.where("status = 200")
    sets = good.select(F.col("request_id").alias("set_id"), F.col("ids").alias("snps"))
    scored = score_sets(sets, genotypes, phenotypes, y).unpivot("set_id", list(CLOSED_FORM), "score", "value").withColumnRenamed("set_id", "request_id")
    right = good.select("request_id", F.explode("scores").alias("score")).join(scored, ["request_id", "score"]).select("request_id", "score", "value", F.lit(200).alias("status"))
    bad = asked.where("status <> 200").select("request_id", F.lit(None).cast("string").alias("score"), F.lit(None).cast("double").alias("value"), "status")
    return right.unionByName(bad)


def serve(stream: DataFrame, reply: Callable[[DataFrame, int], None], checkpoint: str, **dataset) -> StreamingQuery:
    """Answers every micro-batch of the request stream and hands it to `reply`."""
    return stream.writeStream.foreachBatch(lambda batch, n: reply(answer(batch, **dataset), n)).option("checkpointLocation", checkpoint).start()
