"""SNP sets (set_id, snps: ascending array): set algebra, subsets, results and their tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snpweave import shared

MAX_SIZE = 10


def canonical(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def union(a: Column, b: Column) -> Column:
    """Members of either, ascending; null above ten."""
    u = F.array_sort(F.array_union(a, b))
    return F.when(F.size(u) <= MAX_SIZE, u)


def minus(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def subsets(sets: DataFrame, k_min: int, k_max: int) -> DataFrame:
    """set_id, snps: every subset of k_min to k_max members, and the set itself, by growing subsets a member at a time."""
    grown = sets.select("set_id", F.col("snps").alias("all"), F.expr("transform(snps, (s, i) -> struct(array(s) AS snps, i AS last))").alias("parts"))
    out = grown.select("set_id", "all", F.explode("parts").alias("p")).select("set_id", "all", "p.snps", "p.last")
    layers = [out]
    for _ in range(k_max - 1):
        last = layers[-1]
        nxt = last.select("set_id", "all", "snps", "last", F.explode(F.expr("CASE WHEN last + 1 <= size(all) - 1 THEN sequence(last + 1, size(all) - 1) ELSE array() END")).alias("i"))
        layers.append(nxt.select("set_id", "all", F.expr("concat(snps, array(all[i]))").alias("snps"), F.col("i").alias("last")))
    found = sets.select("set_id", "snps")
    for k, layer in enumerate(layers, 1):
        if k >= k_min:
            found = found.unionAll(layer.select("set_id", "snps"))
    return found.distinct()


def singletons(sets: DataFrame) -> DataFrame:
    """The distinct members of all sets, each a set of one."""
    return sets.select(F.explode("snps").alias("snp_id")).distinct().select(F.col("snp_id").cast("long").alias("set_id"), F.array("snp_id").alias("snps"))


def size_distribution(sets: DataFrame) -> DataFrame:
    return sets.groupBy(F.size("snps").alias("size")).agg(F.count("*").alias("n"))


def collapse(results: DataFrame, attributes: list[str]) -> DataFrame:
    """Equal result sets become one: NUM_MERGED, and for each attribute all values in order of seed and the distinct ones."""
    out = [F.count("*").alias("NUM_MERGED")]
    for a in attributes:
        value = F.col(a).cast("string")
        out.append(F.expr(f"array_join(transform(array_sort(collect_list(struct(set_id, cast(`{a}` AS string) AS v))), x -> x.v), ';')").alias(f"{a}_ALL"))
        out.append(F.array_join(F.array_sort(F.collect_set(value)), ";").alias(f"{a}_DISTINCT"))
    return results.withColumn("key", F.array_join("snps", ",")).groupBy("key").agg(*out)


def annotated(sets: DataFrame, annotations: DataFrame) -> DataFrame:
    """set_id, ANNOTATIONS: sorted distinct labels of the members."""
    m = sets.select("set_id", F.explode("snps").alias("snp_id"))
    return m.join(annotations, "snp_id").groupBy("set_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ";").alias("ANNOTATIONS"))


def results_table(scored: DataFrame, sets: DataFrame, snps: DataFrame, annotations: DataFrame, score: str) -> DataFrame:
    """`RANK (<score>)`, RS_IDS, the scores and ANNOTATIONS, best first."""
    from snpweave.operators.scores import rank_sets

    m = sets.select("set_id", F.posexplode("snps").alias("pos", "snp_id")).join(snps, "snp_id")
    names = m.groupBy("set_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(pos, name))), x -> x.name), ';')").alias("RS_IDS"))
    out = rank_sets(scored, score).join(names, "set_id").join(annotated(sets, annotations), "set_id", "left")
    keep = [c for c in scored.columns if c != "set_id"]
    return out.select(F.col("RANK").alias(f"RANK ({score})"), "RS_IDS", *keep, "ANNOTATIONS")


def with_carriers(table: DataFrame, carriers: DataFrame, categories: list) -> DataFrame:
    """Adds NUM_INDIVIDUALS_<c>, FREQ_INDIVIDUALS_<c> and INDIVIDUALS_<c> of every category to a table with set_id, from rows
    (set_id, category, num, freq, individuals); a set without carriers in a category has 0, 0 and the empty text."""
    wide = carriers.groupBy("set_id").pivot("category", categories).agg(F.first("num").alias("num"), F.first("freq").alias("freq"), F.first("individuals").alias("individuals"))
    out = table.join(wide, "set_id", "left")
    for c in categories:
        none = {"num": F.lit(0).cast("long"), "freq": F.lit(0.0), "individuals": F.lit("")}
        for part, name in (("num", "NUM_INDIVIDUALS"), ("freq", "FREQ_INDIVIDUALS"), ("individuals", "INDIVIDUALS")):
            out = out.withColumn(f"{name}_{c}", F.coalesce(F.col(f"`{c}_{part}`"), none[part])).drop(f"{c}_{part}")
    return out


def attribute_lists(values: DataFrame, key: str, value: str) -> DataFrame:
    """key and the sorted distinct values of all its rows, joined by ';': genes of a SNP, SNPs of a gene, sources of a set."""
    return values.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ";").alias(value))


def map_labels(sets: DataFrame, annotations: DataFrame, how: str = "left") -> DataFrame:
    """set_id, snp_id, label: the labels of every member; `how` as in joins (left keeps members without a label)."""
    members = sets.select("set_id", F.explode("snps").alias("snp_id"))
    return members.join(annotations.select("snp_id", "label").distinct(), "snp_id", how).select("set_id", "snp_id", "label")


def random_like(sets: DataFrame, snps: DataFrame, seed: int) -> DataFrame:
    """Random sets with the sizes of the input, members drawn with replacement (so a set may shrink), by a seeded hash."""
    numbered = shared.numbered(snps.select("snp_id", F.pmod(F.xxhash64("snp_id"), F.lit(256)).alias("part")), "part", ["snp_id"], "i").select("snp_id", "i")
    n = snps.count()
    draws = sets.select("set_id", F.explode(F.sequence(F.lit(1), F.size("snps"))).alias("d")).withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "set_id", "d"), F.lit(n)).cast("int"))
    return draws.join(numbered, "i").groupBy("set_id").agg(F.array_sort(F.collect_set("snp_id")).alias("snps"))


def best_of_clusters(candidates: DataFrame, quantile: float) -> DataFrame:
    """The best candidate (least score) of every cluster, and the best ceil(q N) of all; ties by set_id."""
    candidates = shared.materialize(candidates, "candidates")
    n = candidates.count()
    ranked = shared.in_order(candidates, "score", ["set_id"], "all").withColumn("in", F.row_number().over(Window.partitionBy("cluster").orderBy("score", "set_id")))
    return ranked.where((F.col("in") == 1) | (F.col("all") < math.ceil(round(quantile * n, 9)))).select("set_id", "cluster", "score")


def best_so_far(trace: DataFrame, time: str, score: str) -> DataFrame:
    """time, score where the running minimum improves. A prefilter by hour (its own minimum) keeps the global window to the
    improvements inside each hour."""
    local = Window.partitionBy("part").orderBy(time, score).rowsBetween(Window.unboundedPreceding, -1)
    t = trace.withColumn("part", F.date_trunc("hour", time)).withColumn("low", F.min(score).over(local)).where(F.col("low").isNull() | (F.col(score) < F.col("low")))
    whole = Window.orderBy(time, score).rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("low", F.min(score).over(whole)).where(F.col("low").isNull() | (F.col(score) < F.col("low"))).select(time, score)
