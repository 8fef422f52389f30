"""Likeness of models and t-tests against numpy and a numeric integral."""

import math

import numpy as np
import pytest

from snpweave.functions import stats
from snpweave.operators import comparison


def test_similarity_of_many_models(spark):
    r = np.random.default_rng(3)
    x = r.normal(1, 2, (60, 5))
    x[r.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 0  # never differs from 0
    rows = [(i, f"m{j}", None if np.isnan(x[i, j]) and i % 2 else float(x[i, j])) for i in range(60) for j in range(5)]
    table = spark.createDataFrame([*rows, rows[0], (1, "other", 3.0), (None, "m0", None)], "set_id long, model string, value double").repartition(6)
    models = [f"m{j}" for j in range(5)]
    got = {(a.model, a.other): a.cosine for a in comparison.similarity(table, models).collect()}
    assert len(got) == 25
    for i in range(5):
        for j in range(5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            want = None if 4 in (i, j) else a @ b / math.sqrt((a @ a) * (b @ b))
            assert got[f"m{i}", f"m{j}"] == (want if want is None else pytest.approx(want))
    mean = {a.model: a.mean_cosine for a in comparison.mean_similarity(comparison.similarity(table, models)).collect()}
    assert mean["m0"] == pytest.approx(np.mean([got["m0", f"m{j}"] for j in (1, 2, 3)])) and mean["m4"] is None
    assert comparison.mean_similarity(comparison.similarity(table, ["m0"])).first().mean_cosine is None
    assert {a.cosine for a in comparison.similarity(table.limit(0), ["m0", "m1"]).collect()} <= {None}


def upper_tail(t, df):
    """The t distribution's upper tail by the trapezoid rule."""
    at = np.linspace(0, abs(t), 20001)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    half = np.trapezoid(c * (1 + at * at / df) ** (-(df + 1) / 2), at)
    return 0.5 - half if t > 0 else 0.5 + half


def test_t_tests(spark):
    r = np.random.default_rng(5)
    values = {"less": r.normal(0.3, 1, 12), "more": r.normal(0.3, 1, 9), "flat": np.full(4, 2.0), "single": np.array([1.0])}
    rows = [(i, m, float(v)) for m, vs in values.items() for i, v in enumerate(vs)] + [(99, "less", None)]
    scores = spark.createDataFrame(rows, "set_id long, model string, value double")
    known = spark.createDataFrame([("less", 0.0, True), ("more", 0.0, False), ("flat", 1.0, True), ("single", 0.0, True)], "model string, value double, less_is_better boolean")
    got = {a.model: a for a in comparison.t_tests(scores, known).collect()}
    for m, sign in (("less", 1), ("more", -1)):
        v = values[m]
        t = v.mean() / (v.std(ddof=1) / math.sqrt(len(v)))
        assert got[m].n == len(v) and got[m].t == pytest.approx(t) and got[m].p == pytest.approx(upper_tail(sign * t, len(v) - 1), abs=1e-6)
    assert got["flat"].t is None and got["flat"].p == stats.one_sample_t(values["flat"], 1.0, "upper") and (got["single"].t, got["single"].p) == (None, None)
    assert comparison.t_tests(scores.limit(0), known).count() == 0
