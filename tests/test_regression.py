"""Regression scores against descent over individuals, and what is built on them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snpweave.operators import blocks, filters, regression, scores

PEOPLE, SETS = 60, [[0], [0, 1], [1, 2], [0, 1, 2]]


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(9)
    g = np.array([[r.randrange(3) for _ in range(PEOPLE)] for _ in range(3)])
    y2 = [int(r.random() < 0.2 + 0.2 * g[0, i] * g[1, i]) for i in range(PEOPLE)]
    y3 = [r.randrange(3) for _ in range(PEOPLE)]
    q = [2 + 3 * float(g[0, i]) - float(g[1, i]) + 4 * r.gauss(0, 1) for i in range(PEOPLE)]
    geno = spark.createDataFrame([(s, i, int(g[s, i])) for s in range(3) for i in range(PEOPLE)], "snp_id int, ind_id long, g int")
    people = spark.createDataFrame([(i, y2[i], y3[i], q[i], float(i % 7)) for i in range(PEOPLE)], "ind_id long, y2 int, y3 int, q double, age double")
    sets = spark.createDataFrame(list(enumerate(SETS)), "set_id long, snps array<int>")
    return g, {"y2": y2, "y3": y3, "q": q}, geno, people, sets


def design(g, snps, products):
    cols = [np.ones(PEOPLE), *[g[s] for s in snps]]
    if products:
        cols += [g[a] * g[b] for i, a in enumerate(snps) for b in snps[i + 1 :]]
    return np.column_stack(cols).astype(float)


def slow_fit(x, y, kind, weights=False):
    """Descent over individuals: the negative log likelihood, or the weights."""
    c = 1 if kind != "softmax" else max(y) + 1
    w, last = np.ones((x.shape[1], c)), math.inf
    for _ in range(50_000):
        z = x @ w
        if kind == "linear":
            loss, slope = ((z[:, 0] - y) ** 2).sum(), z - np.array(y)[:, None]
        elif kind == "logistic":
            p = 1 / (1 + np.exp(-z[:, 0]))
            loss, slope = -sum(math.log(p[i] if v else 1 - p[i]) for i, v in enumerate(y)), (p - np.array(y))[:, None]
        else:
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            loss, slope = -sum(math.log(p[i, v]) for i, v in enumerate(y)), p - np.eye(c)[y]
        if last - loss < 1e-4:
            break
        last = loss
        w = w - 0.1 * x.T @ slope / len(y)
    if weights:
        return w
    if kind == "linear":
        sigma = loss / len(y)
        d = np.exp(-(((np.array(y) - z[:, 0]) / sigma) ** 2) / 2) / (sigma * 2.5066282746310002)
        return -np.log(np.clip(d, 2.2250738585072014e-308, 1)).sum()
    return loss


@pytest.mark.parametrize(("y", "kind"), [("y2", "logistic"), ("y3", "softmax"), ("q", "linear")])
def test_scores_are_those_of_descent_over_individuals(data, y, kind):
    g, values, geno, people, sets = data
    found = regression.regression_quantitative(sets, geno, people, y) if kind == "linear" else regression.regression(sets, scores.cells(sets, geno, people, y))
    rows = {r.set_id: r for r in found.collect()}
    assert len(rows) == len(SETS)
    for i, snps in enumerate(SETS):
        full, alone = (slow_fit(design(g, snps, p), values[y], kind) for p in (True, False))
        k, per = len(snps), {"logistic": 1, "softmax": 2, "linear": 1}[kind]
        df, df0 = ((n * per + (kind == "linear")) for n in (1 + k + k * (k - 1) // 2, 1 + k))
        want = {"NLL": full, "AIC": 2 * full + 2 * df, "BIC": 2 * full + math.log(PEOPLE) * df, "NLL_GAIN": alone - full, "AIC_GAIN": 2 * (alone - full) + 2 * (df0 + df)}
        for name, v in want.items():
            assert rows[i][f"REGRESSION_{name}"] == pytest.approx(v, abs=1e-5), (i, name)


def test_cut_densities_go_individual_by_individual(spark, data):
    g, values, geno, people, sets = data
    small = people.withColumn("q", F.col("q") / 40)
    found = {r.set_id: r.REGRESSION_NLL for r in regression.regression_quantitative(sets, geno, small, "q").collect()}
    for i, snps in enumerate(SETS):
        assert found[i] == pytest.approx(slow_fit(design(g, snps, True), [v / 40 for v in values["q"]], "linear"), abs=1e-5)


def test_cells_leave_missing_calls_out(spark, data):
    g, values, geno, people, sets = data
    holes = geno.where("NOT (snp_id = 1 AND ind_id < 5)").withColumn("g", F.when((F.col("snp_id") == 0) & (F.col("ind_id") == 9), None).otherwise(F.col("g")))
    n = {r.set_id: r.n for r in blocks.category_cells(sets, holes, people, "y2").groupBy("set_id").agg(F.sum("n").alias("n")).collect()}
    assert n == {0: PEOPLE - 1, 1: PEOPLE - 6, 2: PEOPLE - 5, 3: PEOPLE - 6}
    assert blocks.category_cells(sets, geno.limit(0), people, "y2").count() == 0 and blocks.category_cells(sets, geno, people.limit(0), "y2").count() == 0


def test_blocks_add_up(data, monkeypatch):
    _, _, geno, people, sets = data
    want = sorted(map(tuple, blocks.category_cells(sets, geno, people, "y3").collect()))
    values = {(r.set_id, r.gid): r for r in blocks.value_cells(sets, geno, people, "q").collect()}
    monkeypatch.setattr(blocks, "BLOCK", 7)
    monkeypatch.setattr(blocks, "CHUNK", 1)
    assert sorted(map(tuple, blocks.category_cells(sets, geno, people, "y3").collect())) == want
    for r in blocks.value_cells(sets, geno, people, "q").collect():
        assert tuple(r) == pytest.approx(tuple(values[r.set_id, r.gid]))


def said(z, kind):
    """The likeliest category by the predictors of one individual, or the value."""
    if kind == "linear":
        return float(z[0])
    if kind == "logistic":
        return int(z[0] >= 0)
    later = [v - z[0] for v in z[1:]]
    return 1 + later.index(max(later)) if max(later) >= 0 else 0


def test_predictions_are_those_of_descent_over_individuals(data):
    g, values, geno, people, sets = data
    train = people.where("ind_id % 3 <> 0")  # leaves cells without people
    inside = [i for i in range(PEOPLE) if i % 3]
    for y, kind in (("y2", "logistic"), ("y3", "softmax"), ("q", "linear")):
        rows = regression.predict(sets, geno, people, y, kind != "linear", train).collect()
        assert len(rows) == len(SETS) * PEOPLE
        w = [slow_fit(design(g, snps, True)[inside], [values[y][i] for i in inside], kind, True) for snps in SETS]
        for r in rows:
            assert r.predicted == pytest.approx(said(design(g, SETS[r.set_id], True)[r.ind_id] @ w[r.set_id], kind), abs=1e-6), (y, r)


def test_cross_validation(data):
    g, values, geno, people, sets = data
    fold = filters.folds(people, 3)
    of = {r.ind_id: r.fold for r in fold.collect()}
    for y, kind in (("y2", "logistic"), ("y3", "softmax"), ("q", "linear")):
        got = {r.set_id: r.quality for r in regression.cross_validated(sets, geno, people, y, fold, kind != "linear").collect()}
        for i, snps in enumerate(SETS):
            x, guess = design(g, snps, True), {}
            for f in set(of.values()):
                inside = [k for k in range(PEOPLE) if of[k] != f]
                w = slow_fit(x[inside], [values[y][k] for k in inside], kind, True)
                guess |= {k: said(x[k] @ w, kind) for k in range(PEOPLE) if of[k] == f}
            v = values[y]
            if kind == "linear":
                want = sum(abs(guess[k] - v[k]) for k in guess) / PEOPLE
            else:
                want = np.mean([np.mean([guess[k] == c for k in guess if v[k] == c]) for c in set(v)])
            assert got[i] == pytest.approx(want, abs=1e-6), (y, i)


def test_residuals_and_comparison(spark, data):
    _, values, _, people, _ = data
    got = {r.ind_id: r.q for r in regression.residuals(people, people.select("ind_id", "age"), "q").collect()}
    x = np.column_stack([np.ones(PEOPLE), [i % 7 for i in range(PEOPLE)]])
    w = np.linalg.lstsq(x, np.array(values["q"]), rcond=None)[0]
    assert all(got[i] == pytest.approx(values["q"][i] - x[i] @ w) for i in range(PEOPLE))
    table = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (0.0, 1.0)], "a double, b double")
    cos = {(r.model, r.other): r.cosine for r in regression.compare_models(table, ["a", "b"]).collect()}
    assert cos["a", "b"] == pytest.approx(10 / math.sqrt(5 * 21)) and cos["a", "a"] == pytest.approx(1)
    runs = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", 4.0), (2, "b", 4.0)], "run int, model string, value double")
    assert {r.model: (r.mean, r.best) for r in regression.summarize_comparisons(runs).collect()} == {"a": (3.0, 2), "b": (3.5, 1)}
