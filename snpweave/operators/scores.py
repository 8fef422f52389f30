"""Statistical scores of SNP sets, as grouped aggregations over joint genotypes.

A set's individuals fall into at most 3^k cells, one for each joint genotype. Every closed-form score is a function of
the cells' counts and sums, so the individuals are counted once (`blocks`) and the rest works on a few rows a set.
Genotypes, sets and phenotypes are never collected. `joint_genotypes` is for results that name individuals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import NumericType

from snpweave.functions.stats import TINY, chi2_sf, clamp_probability, f_sf, ln_factorial, ln_factorials, normal_quantile
from snpweave.operators.blocks import category_cells, value_cells
from snpweave.shared import in_order, materialize

#: whether a larger score is better
MAXIMISE = {"PENETRANCE_LLH", "REGRESSION_LLH", "REGRESSION_NLL_GAIN", "REGRESSION_LLH_GAIN", "REGRESSION_AIC_GAIN", "REGRESSION_BIC_GAIN"}
CLOSED_FORM = ("BAYESIAN", "VARIANCE", "PENETRANCE_NLL", "PENETRANCE_LLH", "PENETRANCE_AIC", "PENETRANCE_BIC")


def is_better(score: str, a, b):
    """Whether a is strictly better than b in the score's sense."""
    return a > b if score in MAXIMISE else a < b


def joint_genotypes(sets: DataFrame, genotypes: DataFrame) -> DataFrame:
    """set_id, ind_id, gid: base-3 number of each individual's dosages, the set's first SNP most significant."""
    members = sets.select("set_id", F.size("snps").alias("k"), F.posexplode("snps").alias("pos", "snp_id"))
    weight = members.select("set_id", "snp_id", F.pow(F.lit(3), F.col("k") - 1 - F.col("pos")).cast("long").alias("w"))
    return weight.join(genotypes, "snp_id").groupBy("set_id", "ind_id").agg(F.sum(F.col("w") * F.col("g")).alias("gid"))


def cells(sets: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, y: str) -> DataFrame:
    """set_id, gid, y, n: individuals by joint genotype and category, counted by blocks."""
    return category_cells(sets, genotypes, phenotypes, y)


def _with_empty(cell: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds the categories that a cell lacks, with n = 0, and each cell's size."""
    size = cell.groupBy("set_id", "gid").agg(F.sum("n").alias("size"))
    grid = size.crossJoin(F.broadcast(totals))  # a few categories a cell
    return grid.join(cell, ["set_id", "gid", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def category_totals(phenotypes: DataFrame, y: str) -> DataFrame:
    """y, total: individuals by category."""
    return phenotypes.groupBy(F.col(y).alias("y")).agg(F.count("*").alias("total"))


def bayesian(cell: DataFrame) -> DataFrame:
    """K2 score: the sum over cells of ln (n + 1)! less the sum of ln n_c! of its categories."""
    parts = cell.groupBy("set_id", "gid").agg(F.sum("n").alias("size"), F.sum(ln_factorial(F.col("n"))).alias("own"))
    return parts.groupBy("set_id").agg(F.sum(ln_factorial(F.col("size") + 1) - F.col("own")).alias("BAYESIAN"))


def quantile_bins(phenotypes: DataFrame, y: str, bins: int = 100) -> DataFrame:
    """ind_id, bin of a quantitative phenotype: floor(bins * normal cdf(y)), with the population variance in the place of
    the standard deviation."""
    stat = phenotypes.select(F.avg(y), F.var_pop(y)).first()
    edges = np.array([normal_quantile(k / bins) for k in range(1, bins)])

    @pandas_udf("int")
    def binned(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, (v.to_numpy() - stat[0]) / stat[1], side="right"))

    return phenotypes.select("ind_id", binned(F.col(y).cast("double")).alias("bin"))


def chi_squared(cell: DataFrame, totals: DataFrame) -> DataFrame:
    """chi2 and df of cells against categories (empty ones skipped) and the p-value VARIANCE; 0 and p = 1 where there is
    one cell or one category."""
    n = F.sum("total").over(Window.partitionBy())
    totals = totals.where("total > 0").withColumn("all", n)
    full = _with_empty(cell, totals)
    expected = F.col("total") * F.col("size") / F.col("all")
    out = full.groupBy("set_id").agg(F.sum((F.col("n") - expected) ** 2 / expected).alias("chi2"), F.countDistinct("gid").alias("groups"), F.countDistinct("y").alias("categories"))
    out = out.withColumn("df", (F.col("groups") - 1) * (F.col("categories") - 1)).withColumn("chi2", F.when(F.col("df") > 0, F.col("chi2")).otherwise(0.0))

    @pandas_udf("double")
    def p_value(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(np.where(df > 0, chi2_sf(x.to_numpy(), np.maximum(df.to_numpy(), 1.0)), 1.0))

    return out.withColumn("VARIANCE", p_value("chi2", F.col("df").cast("double"))).select("set_id", "chi2", F.col("df").cast("long").alias("df"), "VARIANCE")


def quantitative_cells(sets: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, y: str) -> DataFrame:
    """set_id, gid, n, mean and population variance of a quantitative phenotype by joint genotype."""
    return value_cells(sets, genotypes, phenotypes, y).drop("low", "high")


def anova(cell: DataFrame) -> DataFrame:
    """One-way analysis of variance over the non-empty cells: f, df1, df2 and p-value VARIANCE."""
    whole = cell.groupBy("set_id").agg(F.sum("n").alias("total"), F.count("*").alias("G"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"))
    parts = cell.join(whole, "set_id").groupBy("set_id", "total", "G").agg(F.sum(F.col("n") * (F.col("mean") - F.col("m")) ** 2).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"))
    out = parts.withColumn("df1", F.col("G") - 1).withColumn("df2", F.col("total") - F.col("G"))
    f = F.when((F.col("df1") < 1) | (F.col("between") == 0), 0.0).when((F.col("df2") < 1) | (F.col("within") == 0), float("inf")).otherwise(F.col("between") / F.col("df1") / (F.col("within") / F.col("df2")))

    @pandas_udf("double")
    def p_value(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        v = x.to_numpy()
        plain = (v > 0) & np.isfinite(v)
        p = f_sf(np.where(plain, v, 1.0), np.maximum(a.to_numpy(), 1.0), np.maximum(b.to_numpy(), 1.0))
        return pd.Series(np.where(plain, p, np.where(v == 0, 1.0, TINY)))

    return out.withColumn("f", f).select("set_id", "f", F.col("df1").cast("long"), F.col("df2").cast("long"), p_value("f", F.col("df1").cast("double"), F.col("df2").cast("double")).alias("VARIANCE"))


def penetrance(sets: DataFrame, cell: DataFrame, totals: DataFrame, min_cell: int | None = None) -> DataFrame:
    """Maximum-likelihood penetrance of a categorical phenotype: negative log likelihood, likelihood, AIC and BIC.

    A cell of at least min_cell (10 a category) individuals has its own category shares, a smaller one the shares of
    all. Shares of zero become 1e-5, taken evenly from the others.
    """
    cats = totals.withColumn("C", F.count("*").over(Window.partitionBy()).cast("double")).withColumn("people", F.sum("total").over(Window.partitionBy()))
    full = _with_empty(cell, cats)
    small = F.col("size") < (F.lit(min_cell) if min_cell is not None else 10 * F.col("C"))
    share = F.when(small, F.col("total") / F.col("people")).otherwise(F.col("n") / F.col("size"))
    full = full.withColumn("share", share)
    seen = full.groupBy("set_id", "gid").agg(F.sum(F.when(F.col("share") > 0, 1).otherwise(0)).alias("s"))
    full = full.join(seen, ["set_id", "gid"])
    p = F.when(F.col("share") == 0, 1e-5).otherwise(F.col("share") - 1e-5 * (F.col("C") - F.col("s")) / F.col("s"))
    nll = full.groupBy("set_id").agg(F.sum(-F.col("n") * F.log(clamp_probability(p))).alias("nll"), F.max("C").alias("C"), F.max("people").alias("people"))
    return _criteria(nll.join(sets.select("set_id", F.size("snps").alias("k")), "set_id"))


def penetrance_quantitative(sets: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, y: str, min_cell: int = 10) -> DataFrame:
    """As `penetrance` with normal densities: a cell's mean and population standard deviation (0 becomes 1e-4), or those
    of all where it is smaller than min_cell; densities above 1 count as 1."""
    pheno = phenotypes.select("ind_id", F.col(y).cast("double").alias("y"))
    whole = pheno.agg(F.avg("y").alias("gm"), F.stddev_pop("y").alias("gsd"), F.count("*").alias("people"))
    stats = value_cells(sets, genotypes, phenotypes, y).crossJoin(F.broadcast(whole))  # one row
    own = F.col("n") >= min_cell
    stats = stats.withColumn("m", F.when(own, F.col("mean")).otherwise(F.col("gm"))).withColumn("sd", F.when(own, F.sqrt("var")).otherwise(F.col("gsd"))).withColumn("sd", F.when(F.col("sd") == 0, 1e-4).otherwise(F.col("sd")))
    # no density of the cell is cut at 1 or at the smallest double: its sum of squares gives its likelihood
    scale = F.col("sd") * 2.5066282746310002
    far = F.greatest(F.abs(F.col("low") - F.col("m")), F.abs(F.col("high") - F.col("m"))) / F.col("sd")
    stats = stats.withColumn("plain", (scale >= 1) & (far * far / 2 + F.log(scale) < 708)).withColumn("nll", F.col("n") * F.log(scale) + F.col("n") * (F.col("var") + (F.col("mean") - F.col("m")) ** 2) / (2 * F.col("sd") ** 2))
    stats = materialize(stats.select("set_id", "gid", "people", "m", "sd", "plain", "nll"), "cells")
    parts = stats.where("plain").select("set_id", "nll", "people")
    cut = stats.where("NOT plain")
    if not cut.isEmpty():  # the others individual by individual
        some = sets.join(cut.select("set_id").distinct(), "set_id", "left_semi")
        joint = joint_genotypes(some, genotypes).join(pheno, "ind_id").join(cut, ["set_id", "gid"])
        z = (F.col("y") - F.col("m")) / F.col("sd")
        parts = parts.unionAll(joint.select("set_id", (-F.log(clamp_probability(F.exp(-z * z / 2) / scale))).alias("nll"), "people"))
    nll = parts.groupBy("set_id").agg(F.sum("nll").alias("nll"), F.max("people").alias("people"), F.lit(2.0).alias("C"))
    return _criteria(nll.join(sets.select("set_id", F.size("snps").alias("k")), "set_id"))


def _criteria(nll: DataFrame) -> DataFrame:
    df = F.pow(F.lit(3.0), F.col("k")) * F.col("C")
    return nll.select("set_id", F.col("nll").alias("PENETRANCE_NLL"), F.exp(-F.col("nll")).alias("PENETRANCE_LLH"), (2 * F.col("nll") + 2 * df).alias("PENETRANCE_AIC"), (2 * F.col("nll") + F.log("people") * df).alias("PENETRANCE_BIC"))


def predict_penetrance(sets: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, y: str) -> DataFrame:
    """set_id, ind_id, predicted: the most frequent category of the individual's cell (the smallest of equals)."""
    joint = joint_genotypes(sets, genotypes)
    cell = joint.join(phenotypes.select("ind_id", F.col(y).alias("y")), "ind_id").groupBy("set_id", "gid", "y").agg(F.count("*").alias("n"))
    best = cell.groupBy("set_id", "gid").agg(F.max(F.struct("n", (-F.col("y")).alias("y"))).alias("b"))
    return joint.join(best, ["set_id", "gid"]).select("set_id", "ind_id", (-F.col("b.y")).alias("predicted"))


def training_hits(cell: DataFrame) -> DataFrame:
    """set_id, right: individuals whose category is the one that `predict_penetrance` gives their cell."""
    best = cell.groupBy("set_id", "gid").agg(F.max(F.struct("n", (-F.col("y")).alias("y"))).alias("b"))
    return best.groupBy("set_id").agg(F.sum("b.n").alias("right"))


def score_sets(sets: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, y: str) -> DataFrame:
    """All closed-form scores of a categorical phenotype from one table of cells."""
    cell = materialize(cells(sets, genotypes, phenotypes, y), "cells")
    totals = category_totals(phenotypes, y)
    return bayesian(cell).join(chi_squared(cell, totals).select("set_id", "VARIANCE"), "set_id").join(penetrance(sets, cell, totals), "set_id")


def rank_sets(scored: DataFrame, score: str, tie: str = "set_id") -> DataFrame:
    """Adds RANK: 1..n in the score's sense, ties by id."""
    if not isinstance(scored.schema[score].dataType, NumericType):
        raise TypeError(f"{score} is no number")
    by = scored.withColumn("__by", -F.col(score) if score in MAXIMISE else F.col(score))
    return in_order(by, "__by", [tie], "RANK").withColumn("RANK", (F.col("RANK") + 1).cast("long")).drop("__by")


def monte_carlo(sets: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, y: str, rounds: int = 10_000, seed: int = 0) -> DataFrame:
    """set_id, p: (rounds whose BAYESIAN score the original doesn't beat + 1) / (rounds + 1).

    When a phenotype is dealt anew at random, the counts of a set's cells have the multivariate hypergeometric distribution
    of tables with the same cell sizes and category totals. Each round draws such a table from the set's cells, so a round
    costs a few draws and not a pass over the individuals."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cats, c = np.unique(pdf["y"].to_numpy(), return_inverse=True)
        gids, g = np.unique(pdf["gid"].to_numpy(), return_inverse=True)
        table = np.zeros((len(gids), len(cats)), np.int64)
        np.add.at(table, (g, c), pdf["n"].to_numpy())
        size, ln = table.sum(axis=1), ln_factorials(int(table.sum()) + 1)
        own = (ln[size + 1] - ln[table].sum(axis=1)).sum()
        rng = np.random.default_rng([seed, int(pdf["set_id"].iloc[0]) & 0xFFFFFFFF])
        rest = np.tile(table.sum(axis=0), (rounds, 1))  # individuals of each category not dealt yet
        score = np.full(rounds, ln[size + 1].sum())
        for n in size[np.argsort(-size)]:  # in any order; cells without individuals left to choose from cost little
            left, others = np.full(rounds, n), rest.sum(axis=1)
            for k in range(len(cats)):
                others = others - rest[:, k]
                drawn = rng.hypergeometric(rest[:, k], others, left) if k < len(cats) - 1 else left  # the last category has what is left
                rest[:, k] -= drawn
                left = left - drawn
                score -= ln[drawn]
        worse = (score <= own + 1e-9 * abs(own)).sum()
        return pd.DataFrame({"set_id": [pdf["set_id"].iloc[0]], "p": [(worse + 1) / (rounds + 1)]})

    return cells(sets, genotypes, phenotypes, y).groupBy("set_id").applyInPandas(run, "set_id long, p double")
