"""Principal components and regression with covariates against numpy on whole matrices."""

import math

import numpy as np
import pytest

from snpweave.operators import covariate_regression as cr
from snpweave.operators import pca

N, M = 90, 24


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(4)
    group = r.integers(0, 3, N)
    rate = r.uniform(0.1, 0.9, (3, M))
    g = r.binomial(2, rate[group].T)
    g[5] = 1  # no variation
    holes = {(2, 7), (2, 8), (9, 0)}
    rows = [(s, i, None if (s, i) in holes else int(g[s, i])) for s in range(M) for i in range(N) if (s, i) != (11, 3)]
    geno = spark.createDataFrame(rows, "snp_id int, ind_id long, g int")
    age = r.normal(50, 9, N)
    z = 0.8 * g[0] - 0.9 * g[1] + 0.05 * (age - 50) + 0.7 * (group == 1)
    y2 = (r.random(N) < 1 / (1 + np.exp(-z))).astype(int)
    y3 = r.integers(0, 3, N)
    q = z + r.normal(0, 3, N)
    people = spark.createDataFrame([(i, int(y2[i]), int(y3[i]), float(q[i])) for i in range(N)], "ind_id long, y2 int, y3 int, q double")
    cov = spark.createDataFrame([(i, float(age[i]), float(i % 4)) for i in range(N)], "ind_id long, age double, y double")
    x = g.astype(float)
    known = np.ones((M, N), bool)
    for s, i in holes | {(11, 3)}:
        known[s, i] = False
    return g, x, known, geno, people, cov, {"y2": y2, "y3": y3, "q": q}, np.column_stack([age, np.arange(N) % 4])


def exact_components(x, known, n):
    z = []
    for row, k in zip(x, known, strict=True):
        mean, sd = row[k].mean(), row[k].std()
        if sd > 0:
            z.append(np.where(k, (row - mean) / sd, 0))
    u, s, _ = np.linalg.svd(np.array(z).T, full_matrices=False)
    return u[:, :n] * s[:n], s[:n] ** 2 / len(u)


@pytest.fixture(scope="module")
def found(data):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pca, "BLOCK", 40)
        m.setattr(pca, "CHUNK", 13)
        m.setattr(pca, "WHOLE", 5)
        return pca.principal_components(data[3], 4, extra=14)


def test_components_are_those_of_the_whole_matrix(data, found):
    _, x, known, *_ = data
    got, variance = found
    want, values = exact_components(x, known, 4)
    assert variance == pytest.approx(list(values), rel=1e-6)
    rows = sorted(got.collect())
    assert [r[0] for r in rows] == list(range(N))
    mine = np.array([r[1:] for r in rows])
    for j in range(4):
        sign = np.sign(want[:, j] @ mine[:, j])
        assert np.abs(mine[:, j] - sign * want[:, j]).max() < 1e-2 * np.abs(want[:, j]).max()
        assert mine[np.abs(mine[:, j]).argmax(), j] > 0


def test_few_markers_take_two_passes(data, found):
    got, variance = pca.principal_components(data[3], 3)
    assert variance == pytest.approx(found[1][:3], rel=1e-6)
    mine, other = (np.array([r[1:4] for r in sorted(x.collect())]) for x in (got, found[0]))
    assert np.abs(mine - other).max() < 1e-2


def test_components_of_little_or_nothing(spark):
    empty = spark.createDataFrame([], "snp_id int, ind_id long, g int")
    assert pca.principal_components(empty)[1] == []
    flat = spark.createDataFrame([(0, i, 1) for i in range(5)], "snp_id int, ind_id long, g int")
    assert pca.principal_components(flat)[1] == []
    one = spark.createDataFrame([(0, i, i % 2) for i in range(6)], "snp_id int, ind_id long, g int")
    got, variance = pca.principal_components(one, 10)
    assert variance == pytest.approx([1.0]) and sorted(abs(r.pc1) for r in got.collect()) == pytest.approx([1.0] * 6)


def newton(x, y, classes):
    """The largest likelihood over whole arrays; the weights of the first category are 0."""
    f = x.shape[1]
    w = np.zeros((classes - 1, f))

    def loss(w):
        z = np.column_stack([np.zeros(len(x)), x @ w.T])
        return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(x)), y]).sum(), z

    for _ in range(60):
        _, z = loss(w)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        slope = ((p - np.eye(classes)[y])[:, 1:].T @ x).reshape(-1)
        h = np.zeros((len(slope), len(slope)))
        for i in range(len(x)):
            v = p[i, 1:]
            h += np.kron(np.diag(v) - np.outer(v, v), np.outer(x[i], x[i]))
        w = w - np.linalg.lstsq(h, slope, rcond=1e-12)[0].reshape(w.shape)
    return loss(w)[0]


SETS = [[0], [0, 1], [1, 2], [0, 1, 9], [5, 6]]


@pytest.mark.parametrize(("y", "classes"), [("y2", 2), ("y3", 3), ("q", None)])
def test_scores_with_covariates_and_components(spark, data, found, y, classes, monkeypatch):
    monkeypatch.setattr(cr, "BLOCK", 50)
    monkeypatch.setattr(cr, "CHUNK", 3)
    g, x, known, geno, people, cov, values, plain_cov = data
    parts = found[0].select("ind_id", "pc1", "pc2", "pc3")
    columns = cr.with_components(cov, parts)
    pcs = np.array([r[1:] for r in sorted(parts.collect())])
    sets = spark.createDataFrame(list(enumerate(SETS)), "set_id long, snps array<int>")
    got = {r.set_id: r for r in cr.covariate_scores(sets, geno, people, columns, y, classes).collect()}
    assert len(got) == len(SETS)
    every = np.column_stack([plain_cov, pcs])
    every = (every - every.mean(axis=0)) / every.std(axis=0)
    for i, snps in enumerate(SETS):
        ok = known[snps].all(axis=0)
        nll, wide = {}, {}
        for m in cr.MODELS:
            d = [np.ones(N), *[g[s] for s in snps]]
            if "Q" in m:
                d += [g[a] * g[b] for n, a in enumerate(snps) for b in snps[n + 1 :]]
            d = np.column_stack([*d, every] if "C" in m else d)[ok].astype(float)
            v, wide[m] = values[y][ok], d.shape[1] * ((classes or 2) - 1) + (classes is None)
            if classes:
                nll[m] = newton(d, v, classes)
            else:
                e = v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
                sigma = (e @ e) / len(e)
                nll[m] = -np.log(np.clip(np.exp(-((e / sigma) ** 2) / 2) / (sigma * math.sqrt(2 * math.pi)), 2.2250738585072014e-308, 1)).sum()
            assert got[i][f"NLL_{m}"] == pytest.approx(nll[m], abs=1e-4), (i, m)
        assert got[i].REGRESSION_COV_AIC == pytest.approx(2 * nll["QC"] + 2 * wide["QC"], abs=1e-3)
        assert got[i].REGRESSION_COV_BIC_GAIN == pytest.approx(2 * (nll["LC"] - nll["QC"]) + math.log(ok.sum()) * (wide["LC"] + wide["QC"]), abs=1e-3)
        assert got[i].REGRESSION_CLG_L_LC == pytest.approx(math.exp(-nll["LC"]) - math.exp(-nll["L"]), abs=1e-12)


def test_people_without_covariates_and_separable_classes(spark):
    geno = spark.createDataFrame([(s, i, (i // (s + 1)) % 3) for s in range(2) for i in range(30)], "snp_id int, ind_id long, g int")
    people = spark.createDataFrame([(i, int(i >= 15) if i != 4 else None) for i in range(30)], "ind_id long, y2 int")
    cov = spark.createDataFrame([(i, float(i) if i != 9 else None) for i in range(28)], "ind_id long, c double")
    sets = spark.createDataFrame([(0, [0, 1]), (1, [0, 77])], "set_id long, snps array<int>")
    rows = cr.covariate_scores(sets, geno, people, cov, "y2", 2).collect()
    assert [r.set_id for r in rows] == [0] and rows[0].NLL_LC < 1e-3 < rows[0].NLL_L  # the covariate tells the classes apart
    assert cr.covariate_scores(sets.limit(0), geno, people, cov, "y2", 2).count() == 0


def test_sums_once_a_task_f10_f11(spark, monkeypatch):
    """A task sends one row a model, however many blocks it meets, and marker tiles hold every call at its place."""
    import numpy as np

    from snpweave.operators import covariate_regression as cr

    monkeypatch.setattr(cr, "BLOCK", 16)
    rng = np.random.default_rng(2)
    calls, y, c = rng.integers(0, 3, (200, 3)), rng.normal(size=200), rng.normal(size=200)
    g = spark.createDataFrame([(int(s), int(i), int(calls[i, s])) for i in range(200) for s in range(3)], "snp_id int, ind_id long, g int")
    p = spark.createDataFrame([(i, float(y[i])) for i in range(200)], "ind_id long, yq double")
    cov = spark.createDataFrame([(i, float(c[i])) for i in range(200)], "ind_id long, c double")
    sets = spark.createDataFrame([(0, 1, [0, 1]), (0, 2, [1, 2])], "chunk int, set_id long, snps array<int>")
    tile = cr.tiles(sets, g, p, cov, "yq").coalesce(1)
    state = sets.selectExpr("chunk", "set_id", "snps", "'L' AS model", "array(0D, 0D, 0D) AS weights", "array(0D, 0D, 0D) AS step", "1D AS share", "1D AS sigma")
    found = cr._over_models(tile, state, lambda x, v, m: {"people": float(len(v)), "slope": x.T @ v}, 2, "people double, slope binary").collect()
    assert tile.count() > 8 and len(found) == 2
    for r in found:
        a, b = (0, 1) if r.set_id == 1 else (1, 2)
        assert r.people == 200
        assert np.allclose(np.frombuffer(r.slope), [y.sum(), calls[:, a] @ y, calls[:, b] @ y])
