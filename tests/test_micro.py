"""Hand-computed fixtures of the score, filter and graph operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from snpweave.functions import scalars, stats
from snpweave.operators import filters, linkage, network, paths, scores, search, sets

G = {0: [0] * 4 + [1] * 4 + [2] * 4, 1: [0, 1, 2, 0, 1, 2, 0, 1, 2, 0, 1, 2], 2: [0] * 4 + [1] * 4 + [2] * 4}
Y = [0, 0, 0, 1, 0, 1, 0, 1, 1, 1, 1, 1]
Q = [1, 2, 1.5, 0.5, 2.5, 3.5, 2, 3, 4, 3, 3.5, 4.5]
SETS = [(0, [0]), (1, [1]), (2, [0, 1]), (3, [0, 2])]


@pytest.fixture(scope="module")
def data(spark):
    geno = spark.createDataFrame([(s, i, g) for s, row in G.items() for i, g in enumerate(row)], "snp_id int, ind_id int, g int")
    pheno = spark.createDataFrame([(i, y, y, float(q)) for i, (y, q) in enumerate(zip(Y, Q, strict=True))], "ind_id int, y int, y2 int, q double")
    return spark.createDataFrame(SETS, "set_id long, snps array<int>"), geno, pheno


def column(df, key, value):
    return {r[0]: r[1] for r in df.select(key, value).collect()}


def test_k2(data):
    x, g, p = data
    got = column(scores.bayesian(scores.cells(x, g, p, "y")), "set_id", "BAYESIAN")
    assert got == pytest.approx({0: 8.006368, 1: 9.798127, 2: 8.841014, 3: 8.006368}, abs=1e-5)


def test_chi_squared(data):
    x, g, p = data
    df = scores.chi_squared(scores.cells(x, g, p, "y"), scores.category_totals(p, "y"))
    assert column(df, "set_id", "chi2") == pytest.approx({0: 4.8, 1: 0.685714, 2: 7.885714, 3: 4.8}, abs=1e-5)
    assert column(df, "set_id", "df") == {0: 2, 1: 2, 2: 8, 3: 2}
    p = column(df, "set_id", "VARIANCE")
    assert p[0] == pytest.approx(0.090718, abs=1e-5) and p[1] == pytest.approx(0.709740, abs=1e-5)


@pytest.mark.parametrize("least, want", [(None, {k: 8.150319 for k in range(4)}), (2, {0: 5.021969, 1: 7.794518, 2: 7.016004, 3: 5.021969})])
def test_penetrance(data, least, want):
    x, g, p = data
    df = scores.penetrance(x, scores.cells(x, g, p, "y"), scores.category_totals(p, "y"), least)
    assert column(df, "set_id", "PENETRANCE_NLL") == pytest.approx(want, abs=1e-5)


def test_anova(data):
    x, g, p = data
    df = scores.anova(scores.quantitative_cells(x, g, p, "q"))
    assert column(df, "set_id", "f") == pytest.approx({0: 15.2, 1: 2.796296, 2: 16.041667, 3: 15.2}, abs=1e-5)


def test_order_of_members_does_not_matter(spark, data):
    _, g, p = data
    two = spark.createDataFrame([(0, [0, 1]), (1, [1, 0])], "set_id long, snps array<int>")
    got = column(scores.bayesian(scores.cells(two, g, p, "y")), "set_id", "BAYESIAN")
    assert got[0] == pytest.approx(got[1])


def test_ld_maf_carriers(spark, data):
    x, g, p = data
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a int, b int")
    assert {(r.a, r.b): round(r.r2, 6) for r in linkage.pairwise_ld(g, pairs).collect()} == {(0, 1): 0.0625, (0, 2): 1.0}
    assert column(filters.minor_allele_frequency(g), "snp_id", "maf") == {0: 0.5, 1: 0.5, 2: 0.5}
    c = {r.category: r.individuals for r in filters.carriers(x.where("set_id = 2"), g, p, "y").collect()}
    assert c == {0: "4", 1: "5;7;8;10;11"}


def test_benjamini_hochberg(spark):
    t = spark.createDataFrame([(p,) for p in (0.01, 0.04, 0.03, 0.005, 0.5)], "p double")
    got = {r.p: round(r.q, 9) for r in filters.benjamini_hochberg(t).collect()}
    assert got == {0.01: 0.025, 0.04: 0.05, 0.03: 0.05, 0.005: 0.025, 0.5: 0.5}


def test_folds(data):
    f = filters.folds(data[2], 5).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in f] == [3, 3, 2, 2, 2]


def test_scalars(spark):
    df = spark.createDataFrame([(0, "30s"), (31, "10m"), (32, "2h"), (1000, "5d")], "n int, t string")
    got = df.select(scalars.base32(F.col("n")).alias("b"), scalars.timespan_minutes(F.col("t")).alias("m")).collect()
    assert [r.b for r in got] == ["0", "V", "10", "V8"] and [r.m for r in got] == [0.5, 10, 120, 7200]
    row = spark.range(1).select(scalars.genotype_id(F.array(F.lit(2), F.lit(0), F.lit(1))).alias("g"), scalars.genotype_of(F.lit(19), 3).alias("v")).first()
    assert row.g == 19 and row.v == [2, 0, 1]


def test_subsets(spark):
    x = spark.createDataFrame([(0, [3, 7, 9])], "set_id long, snps array<int>")
    assert sorted(tuple(r.snps) for r in sets.subsets(x, 2, 2).collect()) == [(3, 7), (3, 7, 9), (3, 9), (7, 9)]


def test_graph(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (5, 6)], "node1 int, node2 int")
    assert column(network.degrees(e), "node", "degree") == {0: 2, 1: 2, 2: 3, 3: 2, 4: 1, 5: 1, 6: 1}
    assert column(network.components(e), "node", "component") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 5}
    assert paths.diameter(e).first()[0] == 3
    joint = {(r.d_in, r.d_out): r.n for r in network.joint_degrees(e).collect()}
    assert joint == {(2, 2): 2, (2, 3): 3, (3, 2): 3, (1, 2): 1, (2, 1): 1, (1, 1): 2}
    assert sum(r[0] for r in network.page_rank(e).select("rank").collect()) == pytest.approx(1)


def test_components_of_long_paths(spark):
    order = list(range(400, 1, -2)) + [0, 1] + list(range(3, 402, 2))  # both smallest nodes in the middle
    path = [(a, b) for a, b in zip(order, order[1:])]
    links = [(a, b) for a, b in path if (a, b) != (0, 1)]
    e = lambda rows: spark.createDataFrame([(min(x), max(x)) for x in rows], "node1 int, node2 int").repartition(8)
    assert set(column(network.components(e(path)), "node", "component").values()) == {0}
    got = column(network.components(e([*links, (900, 900)])), "node", "component")
    assert got == {v: v if v == 900 else v % 2 for v in [*order, 900]}


def test_centralities_of_a_long_path(spark):
    n = 30  # a path that ends in a clique mixes slowly
    links = [(i, i + 1) for i in range(n)] + [(a, b) for a in range(n, n + 6) for b in range(a + 1, n + 6)]
    links = sorted(set(links))
    e = spark.createDataFrame(links, "node1 int, node2 int")
    m = np.zeros((n + 6, n + 6))
    for a, b in links:
        m[a, b] = m[b, a] = 1
    want = np.linalg.solve(np.eye(len(m)) - 0.85 * (m / m.sum(axis=0)), np.full(len(m), 0.15 / len(m)))
    got = column(network.page_rank(e), "node", "rank")
    assert [got[i] for i in range(len(m))] == pytest.approx(want, abs=1e-9)
    path = spark.createDataFrame([(i, i + 1) for i in range(7)], "node1 int, node2 int")
    assert column(paths.closeness(path), "node", "closeness") == pytest.approx({i: 7 / sum(abs(i - j) for j in range(8)) for i in range(8)})
    assert column(paths.closeness(path, 3), "node", "closeness")[0] == pytest.approx(3 / 6)


def test_label_edges(spark):
    ann = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (3, "C")], "snp_id int, label string")
    net = spark.createDataFrame([("A", "C"), ("A", "A")], "label1 string, label2 string")
    assert [(r.node1, r.node2) for r in network.same_label_edges(ann).collect()] == [(1, 2)]
    assert sorted((r.node1, r.node2) for r in network.label_network_edges(ann, net, "N").collect()) == [(1, 3), (2, 3)]


def test_special_functions():
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.f_sf(4.0, 1, 1e7) == pytest.approx(0.0455, abs=1e-4)
    assert 2 * stats.t_sf(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.normal_cdf(1.959963984540054) == pytest.approx(0.975)
    assert stats.hardy_weinberg_mid_p(25, 50, 25) > 0.9 and stats.hardy_weinberg_mid_p(50, 0, 50) < 1e-20


def test_random_seeds_are_a_matching(spark):
    e = spark.createDataFrame([(i, (i * 7 + 1) % 40) for i in range(40) if i < (i * 7 + 1) % 40], "node1 int, node2 int")
    used = [s for r in search.random_connected_seeds(e, 30).collect() for s in r.snps]
    assert used and len(used) == len(set(used))


def test_annealing_finds_the_minimum(spark):
    q = spark.createDataFrame([(0, 0, 0, -1.0), (0, 1, 1, -2.0), (0, 0, 1, 4.0)], "cluster_id long, i long, j long, w double")
    r = search.anneal(q, samples=4, sweeps=50).first()
    assert r.energy == pytest.approx(-2) and r.ones == [1]


def test_ln_factorial(spark):
    got = spark.range(0, 200, 7).select("id", stats.ln_factorial(F.col("id")).alias("v")).collect()
    assert all(r.v == pytest.approx(math.lgamma(r.id + 1), abs=1e-9) for r in got)
