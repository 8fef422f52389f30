"""Regression scores of SNP sets: linear, logistic and softmax models with and without products of dosages.

Individuals of one joint genotype have the same features, so a set's model depends on its cells alone (counts by category,
or counts, sums and sums of squares): gradients are sums over at most 3^k weighted rows, whatever the number of people.
Descent starts from all ones and stops when the summed loss falls by less than STOP (or rises), as the scores are defined by
it; all sets of a task descend together in whole-array steps. A task gets a chunk of sets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snpweave.functions.stats import TINY, clamp_probability
from snpweave.operators.blocks import category_cells, value_cells
from snpweave.operators.scores import joint_genotypes
from snpweave.shared import materialize

RATE, STOP, MOST = 0.1, 1e-4, 50_000
CHUNK = 256
NAMES = ("NLL", "LLH", "AIC", "BIC", "NLL_GAIN", "LLH_GAIN", "AIC_GAIN", "BIC_GAIN")
ROOT = 2.5066282746310002


def features(gids: np.ndarray, k: int, products: bool) -> np.ndarray:
    """1, the dosages of joint genotypes, and with `products` those of every two SNPs; one row each."""
    g = np.stack([gids // 3 ** (k - 1 - i) % 3 for i in range(k)], axis=-1).astype(float)
    columns = [np.ones((*g.shape[:-1], 1)), g]
    if products:
        columns += [(g[..., i] * g[..., j])[..., None] for i in range(k) for j in range(i + 1, k)]
    return np.concatenate(columns, axis=-1)


def descend(x: np.ndarray, outputs: int, step: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Predictions and weights of models of many sets (x: sets, cells, features) where each one's loss stops falling.
    step(predictors of the sets at, at) -> loss a set, prediction, and its derivative a cell and output, over people."""
    w = np.ones((len(x), x.shape[2], outputs))
    before, final = np.full(len(x), np.inf), np.zeros((len(x), x.shape[1], outputs))
    at = np.arange(len(x))
    now = x
    for turn in range(MOST):
        loss, prediction, slope = step(now @ w[at], at)
        done = ~(before[at] - loss >= STOP) if turn else np.zeros(len(at), bool)
        before[at] = loss
        final[at] = prediction
        if done.any():
            at, slope = at[~done], slope[~done]
            now = x[at]
        if len(at) == 0 or turn == MOST - 1:
            break
        w[at] -= RATE * (np.swapaxes(now, 1, 2) @ slope)
    return final, w


def fit_linear(x: np.ndarray, n: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predictions a cell, the mean squared error and the weights a set, from counts, sums and sums of squares a cell."""

    def step(z: np.ndarray, at: np.ndarray) -> tuple:
        h, people = z[..., 0], n[at].sum(axis=1, keepdims=True)
        loss = (n[at] * h**2 - 2 * h * s1[at] + s2[at]).sum(axis=1)
        return loss, z, ((n[at] * h - s1[at]) / people)[..., None]

    with np.errstate(over="ignore", invalid="ignore"):
        h, w = descend(x, 1, step)
        h = h[..., 0]
        return h, np.maximum((n * h**2 - 2 * h * s1 + s2).sum(axis=1), 0) / n.sum(axis=1), w


def fit_categories(x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the categories a cell and the weights a set, from the counts: logistic for two, softmax for more."""
    people = np.maximum(counts.sum(axis=(1, 2)), 1)

    def step(z: np.ndarray, at: np.ndarray) -> tuple:
        c = counts[at]
        if c.shape[2] == 2:
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            share = np.concatenate([1 - p, p], axis=2)
            slope = p * c.sum(axis=2, keepdims=True) - c[..., 1:]
        else:
            e = np.exp(z - z.max(axis=2, keepdims=True))
            share = e / e.sum(axis=2, keepdims=True)
            slope = share * c.sum(axis=2, keepdims=True) - c
        loss = -(c * np.log(np.maximum(share, TINY))).sum(axis=(1, 2))
        return loss, z, slope / people[at][:, None, None]

    z, w = descend(x, 1 if counts.shape[2] == 2 else counts.shape[2], step)
    if counts.shape[2] == 2:
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        return np.concatenate([1 - p, p], axis=2), w
    e = np.exp(z - z.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True), w


def likeliest(z: np.ndarray) -> np.ndarray:
    """The category of predictors (the last axis: one for the second of two categories, or one a category); of equals the later
    one than the first."""
    z = z if z.shape[-1] == 1 else z[..., 1:] - z[..., :1]
    return np.where(z.max(axis=-1) >= 0, 1 + z.argmax(axis=-1), 0)


def _scores(full: np.ndarray, alone: np.ndarray, df: float, df0: float, people: np.ndarray, strict: bool) -> dict[str, np.ndarray]:
    """Scores from both negative log likelihoods. The gains of AIC and BIC add the larger model's penalty, as these scores
    are defined; `strict` takes it off, as textbooks do."""
    sign = -1 if strict else 1
    log = np.log(people)
    return {
        "NLL": full, "LLH": np.exp(-full), "AIC": 2 * full + 2 * df, "BIC": 2 * full + log * df,
        "NLL_GAIN": alone - full, "LLH_GAIN": np.exp(-full) - np.exp(-alone), "AIC_GAIN": 2 * (alone - full) + 2 * df0 + sign * 2 * df, "BIC_GAIN": 2 * (alone - full) + log * df0 + sign * log * df,
    }


def _by_size(cell: DataFrame, sets: DataFrame, run: Callable, schema: str) -> DataFrame:
    """`run` on the cells of some sets of one size at a time."""
    chunks = max(1, -(-sets.count() // CHUNK))
    sized = cell.join(sets.select("set_id", F.size("snps").alias("k")), "set_id")
    return sized.withColumn("chunk", F.pmod(F.xxhash64("set_id"), F.lit(chunks))).groupBy("k", "chunk").applyInPandas(run, schema)


def _grid(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The sets, their joint genotypes (sets, cells; padded with 0 where a set has fewer) and each row's place in them."""
    ids, row = np.unique(pdf["set_id"].to_numpy(), return_inverse=True)
    gid = pdf["gid"].to_numpy(np.int64)
    top = gid.max() + 1
    cell, at = np.unique(row * top + gid, return_inverse=True)
    owner = cell // top
    place = np.arange(len(cell)) - np.searchsorted(owner, np.arange(len(ids)))[owner]
    gids = np.zeros((len(ids), int(place.max()) + 1), np.int64)
    gids[owner, place] = cell % top
    return ids, gids, np.stack([row, place[at]]), int(pdf["k"].iloc[0])


def regression(sets: DataFrame, cell: DataFrame, categories: int | None = None, strict: bool = False) -> DataFrame:
    """set_id and REGRESSION_* of a categorical phenotype, from cells (set_id, gid, y, n) with categories 0, 1, ..."""
    cell = cell.where("y IS NOT NULL")
    wide = categories or (cell.agg(F.max("y")).first()[0] or 0) + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, gids, (row, at), k = _grid(pdf)
        counts = np.zeros((*gids.shape, max(wide, 2)))
        np.add.at(counts, (row, at, pdf["y"].to_numpy().astype(int)), pdf["n"].to_numpy())
        nll, size = [], []
        for products in (True, False):
            x = features(gids, k, products)
            nll.append(-(counts * np.log(np.clip(fit_categories(x, counts)[0], TINY, 1))).sum(axis=(1, 2)))
            size.append(x.shape[2] * (max(wide, 2) - 1))
        found = _scores(nll[0], nll[1], size[0], size[1], counts.sum(axis=(1, 2)), strict)
        return pd.DataFrame({"set_id": ids, **{f"REGRESSION_{c}": found[c] for c in NAMES}})

    return _by_size(cell, sets, run, "set_id long, " + ", ".join(f"REGRESSION_{c} double" for c in NAMES))


def regression_quantitative(sets: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, y: str, strict: bool = False) -> DataFrame:
    """As `regression` with a linear model. The likelihood is a normal density whose standard deviation is the mean squared
    error; densities are kept within (smallest double, 1]."""
    cell = value_cells(sets, genotypes, phenotypes, y)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, gids, (row, at), k = _grid(pdf)
        table = lambda v: _filled(gids.shape, row, at, v)
        n, mean, var = (table(pdf[c].to_numpy().astype(float)) for c in ("n", "mean", "var"))
        low, high = table(pdf["low"].to_numpy()), table(pdf["high"].to_numpy())
        out = {"set_id": ids, "people": n.sum(axis=1), "k": k, "gids": [g.tolist() for g in gids]}
        for name, products in (("full", True), ("alone", False)):
            h, sigma, _ = fit_linear(features(gids, k, products), n, n * mean, n * (var + mean**2))
            sigma = np.maximum(sigma, TINY)
            squares = n * (var + (mean - h) ** 2)
            far = np.where(n > 0, np.maximum(np.abs(low - h), np.abs(high - h)), 0).max(axis=1) / sigma
            plain = np.isfinite(sigma) & (sigma * ROOT >= 1) & (far**2 / 2 + np.log(sigma * ROOT) < 708)
            nll = n.sum(axis=1) * np.log(sigma * ROOT) + squares.sum(axis=1) / (2 * sigma**2)
            out |= {name: np.where(plain, nll, np.nan), f"{name}_h": [v.tolist() for v in h], f"{name}_s": sigma}
        return pd.DataFrame(out)

    fitted = _by_size(cell, sets, run, "set_id long, people double, k int, gids array<long>, full double, full_h array<double>, full_s double, alone double, alone_h array<double>, alone_s double")
    fitted = materialize(fitted, "fits")
    for name in ("full", "alone"):
        cut = fitted.where(F.col(name).isNull() | F.isnan(name)).select("set_id", f"{name}_s", F.explode(F.arrays_zip("gids", f"{name}_h")).alias("c")).select("set_id", F.col("c.gids").alias("gid"), F.col(f"c.{name}_h").alias("h"), F.col(f"{name}_s").alias("s")).dropDuplicates(["set_id", "gid"])
        if cut.isEmpty():
            continue
        # some densities are cut: these sets go individual by individual
        joint = joint_genotypes(sets.join(cut.select("set_id").distinct(), "set_id", "left_semi"), genotypes).join(phenotypes.select("ind_id", F.col(y).cast("double").alias("y")), "ind_id").join(cut, ["set_id", "gid"])
        z = (F.col("y") - F.col("h")) / F.col("s")
        exact = joint.groupBy("set_id").agg(F.sum(-F.log(clamp_probability(F.exp(-z * z / 2) / (F.col("s") * ROOT)))).alias("exact"))
        fitted = materialize(fitted.join(exact, "set_id", "left").withColumn(name, F.coalesce("exact", name)).drop("exact"), "fits")

    def score(pdfs):
        for pdf in pdfs:
            k = pdf["k"].to_numpy()
            df0, df = k + 2.0, k + 2.0 + k * (k - 1) / 2  # features, and one for the error
            found = _scores(pdf["full"].to_numpy(), pdf["alone"].to_numpy(), df, df0, pdf["people"].to_numpy(), strict)
            yield pd.DataFrame({"set_id": pdf["set_id"], **{f"REGRESSION_{c}": found[c] for c in NAMES}})

    return fitted.select("set_id", "k", "people", "full", "alone").mapInPandas(score, "set_id long, " + ", ".join(f"REGRESSION_{c} double" for c in NAMES))


def _filled(shape: tuple, row: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(shape)
    out[row, at] = values
    return out


def predict(sets: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, y: str, categorical: bool = True, train: DataFrame | None = None) -> DataFrame:
    """set_id, ind_id, predicted: the likeliest category (0.5 or more of the second of two), or the linear model's value, of
    every individual under the model with products, fitted on `train` (all phenotypes by default)."""
    train = phenotypes if train is None else train
    cell = category_cells(sets, genotypes, train, y) if categorical else value_cells(sets, genotypes, train, y)
    wide = (train.agg(F.max(y)).first()[0] or 0) + 1 if categorical else 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, gids, (row, at), k = _grid(pdf)
        x = features(gids, k, True)
        if categorical:
            counts = np.zeros((*gids.shape, max(wide, 2)))
            np.add.at(counts, (row, at, pdf["y"].to_numpy().astype(int)), pdf["n"].to_numpy())
            w = fit_categories(x, counts)[1]
        else:
            n, mean, var = (_filled(gids.shape, row, at, pdf[c].to_numpy().astype(float)) for c in ("n", "mean", "var"))
            w = fit_linear(x, n, n * mean, n * (var + mean**2))[2]
        z = features(np.arange(3**k), k, True) @ w  # of every cell, also those without people
        value = likeliest(z) if categorical else z[..., 0]
        return pd.DataFrame({"set_id": np.repeat(ids, 3**k), "gid": np.tile(np.arange(3**k), len(ids)), "predicted": value.reshape(-1).astype(float)})

    by_cell = _by_size(cell, sets, run, "set_id long, gid long, predicted double")
    return joint_genotypes(sets, genotypes).join(by_cell, ["set_id", "gid"]).select("set_id", "ind_id", "predicted")


def residuals(phenotypes: DataFrame, covariates: DataFrame, y: str) -> DataFrame:
    """phenotypes with `y` replaced by its residual after least squares on the covariates (ind_id and numbers) and a
    constant: what the covariate variants of the other scores are computed from. Individuals without covariates go. The
    moments are summed by Spark; only they reach the driver."""
    given = [c for c in covariates.columns if c != "ind_id"]
    names = [f"__cov{i}" for i in range(len(given))]  # whatever they are called
    both = phenotypes.join(covariates.select("ind_id", *[F.col(c).alias(n) for c, n in zip(given, names, strict=True)]), "ind_id").where(" AND ".join(f"`{c}` IS NOT NULL" for c in [y, *names]))
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    value = F.col(y).cast("double")
    d = len(cols)
    sums = [F.sum(cols[i] * cols[j]) for i in range(d) for j in range(i, d)] + [F.sum(c * value) for c in cols]
    row = [v or 0.0 for v in both.agg(*[s.alias(f"m{i}") for i, s in enumerate(sums)]).first()]
    xx, at = np.zeros((d, d)), 0
    for i in range(d):
        for j in range(i, d):
            xx[i, j] = xx[j, i] = row[at]
            at += 1
    w = np.linalg.lstsq(xx, np.array(row[at:]), rcond=None)[0]
    fitted = sum(F.lit(float(b)) * c for b, c in zip(w, cols, strict=True))
    return both.withColumn(y, value - fitted).select(*phenotypes.columns)


def cross_validated(sets: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, y: str, fold: DataFrame, categorical: bool = True) -> DataFrame:
    """set_id, quality: predictions of every individual by the model of the other folds (ind_id, fold), against the truth:
    balanced accuracy of categories (from counts by cell, fold and category), or the mean absolute error of values."""
    folds = sorted(r[0] for r in fold.select("fold").distinct().collect())  # a handful
    if categorical:
        wide = max(2, (phenotypes.agg(F.max(y)).first()[0] or 0) + 1)
        place = F.create_map(*[F.lit(v) for i, f in enumerate(folds) for v in (f, i)])
        both = phenotypes.join(fold, "ind_id").where(F.col(y).isNotNull()).select("ind_id", (place[F.col("fold")] * wide + F.col(y)).cast("long").alias("code"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, gids, (row, at), k = _grid(pdf)
            counts = np.zeros((*gids.shape, len(folds), wide))
            code = pdf["y"].to_numpy().astype(int)
            np.add.at(counts, (row, at, code // wide, code % wide), pdf["n"].to_numpy())
            x, hits = features(gids, k, True), np.zeros((len(ids), wide))
            for f in range(len(folds)):
                train = counts.sum(axis=2) - counts[:, :, f]
                guess = likeliest(x @ fit_categories(x, train)[1])
                hits += np.stack([(counts[:, :, f, c] * (guess == c)).sum(axis=1) for c in range(wide)], axis=1)
            people = counts.sum(axis=(1, 2))
            share = np.where(people > 0, hits / np.maximum(people, 1), np.nan)
            return pd.DataFrame({"set_id": ids, "quality": np.nanmean(share, axis=1)})

        return _by_size(category_cells(sets, genotypes, both, "code"), sets, run, "set_id long, quality double")
    parts = None
    for k in folds:
        inside = fold.where(F.col("fold") == k).select("ind_id")
        train = phenotypes.join(inside, "ind_id", "left_anti")
        test = phenotypes.join(inside, "ind_id", "left_semi")
        one = predict(sets, genotypes, test, y, False, train).join(test.select("ind_id", F.col(y).cast("double").alias("truth")), "ind_id")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("set_id").agg(F.avg(F.abs(F.col("predicted") - F.col("truth"))).alias("quality"))


def compare_models(scores: DataFrame, models: list[str]) -> DataFrame:
    """model, other, cosine: cosine similarity of the scores that two models (columns) give the same sets."""
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(models) for j, b in enumerate(models) if i <= j]
    one = scores.agg(*sums)
    rows = [F.struct(F.lit(a).alias("model"), F.lit(b).alias("other"), (F.col(f"{min(i, j)}_{max(i, j)}") / F.sqrt(F.col(f"{i}_{i}") * F.col(f"{j}_{j}"))).alias("cosine")) for i, a in enumerate(models) for j, b in enumerate(models)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def summarize_comparisons(runs: DataFrame, best_is_least: bool = True) -> DataFrame:
    """model, mean, std, best: of runs (run, model, value), the mean and sample deviation a model, and in how many runs it
    is the best (ties count for each)."""
    low = runs.groupBy("run").agg((F.min if best_is_least else F.max)("value").alias("top"))
    return runs.join(low, "run").groupBy("model").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.sum((F.col("value") == F.col("top")).cast("long")).alias("best"))
