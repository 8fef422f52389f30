"""Search options, tempering, seeding, merging, exports and centralities on small data with known answers."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snpweave.functions import scalars
from snpweave.operators import community, filters, network, paths, scores, search, sets
from snpweave.sources import binary, readers, writers

PATH = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (5, 6)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(PATH, "node1 int, node2 int")


@pytest.fixture(scope="module")
def small(spark):
    r = random.Random(4)
    g = np.array([[r.randrange(3) for _ in range(80)] for _ in range(8)])
    y = [int(r.random() < (0.9 if g[2, i] and g[5, i] else 0.2)) for i in range(80)]
    geno = spark.createDataFrame([(s, i, int(g[s, i])) for s in range(8) for i in range(80)], "snp_id int, ind_id long, g int")
    people = spark.createDataFrame(list(enumerate(y)), "ind_id long, y int")
    ring = spark.createDataFrame([(a, b) for a, b in itertools.combinations(range(8), 2) if (b - a) in (1, 2, 3)], "node1 int, node2 int")
    return geno, people, ring


def test_centralities(edges):
    near = {r.node: r.closeness for r in paths.closeness(edges).collect()}
    assert near[2] == pytest.approx(4 / 5) and near[4] == pytest.approx(4 / 9) and near[5] == 1
    between = {r.node: r.betweenness for r in paths.betweenness(edges, None).collect()}
    assert between == {0: 0, 1: 0, 2: 4, 3: 3, 4: 0, 5: 0, 6: 0}
    cut = {r.node: r.betweenness for r in paths.betweenness(edges, 2).collect()}
    assert cut[2] == 2 and cut[3] == 1
    a = np.zeros((7, 7))
    for x, y in PATH:
        a[x, y] = a[y, x] = 1
    lead = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = {r.node: r.eigenvector for r in network.eigenvector(edges).collect()}
    assert all(got[i] == pytest.approx(lead[i] / lead.max(), abs=1e-6) for i in range(7))
    m = a / np.maximum(a.sum(axis=0), 1)
    rank = np.linalg.solve(np.eye(7) - 0.85 * m, np.full(7, 0.15 / 7))
    assert {r.node: round(r.rank, 8) for r in network.page_rank(edges).collect()} == {i: round(float(v), 8) for i, v in enumerate(rank)}
    assert paths.diameter(edges).first()[0] == 3 and paths.diameter(edges.limit(0)).first()[0] == -1
    top = network.top_nodes(network.degrees(edges), {"degree": True}, 2).collect()
    assert [(r.node, r.value) for r in top] == [(2, 3.0), (0, 2.0)]


def test_paths_by_small_batches_of_sources(edges, monkeypatch):
    monkeypatch.setattr(paths, "STATE_ROWS", 1)
    assert paths.diameter(edges).first()[0] == 3
    assert {r.node: round(r.closeness, 6) for r in paths.closeness(edges).collect()}[2] == 0.8
    assert {r.node: r.betweenness for r in paths.betweenness(edges, None).collect()}[2] == 4


def brute_paths(links, limit):
    """Distances between all nodes, and betweenness by listing every shortest path."""
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    far, between = {}, dict.fromkeys({v for e in links for v in e}, 0.0)
    for s in near:
        routes = {s: [[s]]}
        front = [s]
        for d in range(1, (limit or len(near)) + 1):
            step = {}
            for v in front:
                for w in near[v]:
                    if w not in routes:
                        step.setdefault(w, []).extend([*r, w] for r in routes[v])
            routes.update(step)
            front = list(step)
            far.update({(s, w): d for w in step})
        for w, rs in routes.items():
            for r in rs:
                for v in r[1:-1]:
                    between[v] += 0.5 / len(rs)
    return far, between


@pytest.mark.parametrize("limit, rows", [(None, 200_000_000), (2, 200_000_000), (3, 9000)])
def test_paths_of_many_words(spark, monkeypatch, limit, rows):
    monkeypatch.setattr(paths, "STATE_ROWS", rows)
    r = random.Random(6)
    links = [(r.randrange(90), r.randrange(90)) for _ in range(130)] + [(0, v) for v in range(200, 240)] + [(300, 300), (5, 6), (6, 5)]
    e = spark.createDataFrame(links, "node1 int, node2 int")
    far, between = brute_paths(links, limit)
    got = {x.node: x.closeness for x in paths.closeness(e, limit).collect()}
    nodes = {a for a, _ in far}
    want = {v: sum(1 for a, _ in far if a == v) / sum(d for (a, _), d in far.items() if a == v) for v in nodes}
    assert got == pytest.approx(want) and 300 not in got
    found = {x.node: x.betweenness for x in paths.betweenness(e, limit).collect()}
    assert found == pytest.approx(between) and found[300] == 0
    if limit is None:
        assert paths.diameter(e).first()[0] == max(far.values())


def test_paths_without_edges(spark):
    none = spark.createDataFrame([], "node1 int, node2 int")
    loops = spark.createDataFrame([(1, 1)], "node1 int, node2 int")
    assert paths.diameter(loops).first()[0] == 0 and paths.closeness(loops).count() == 0 and paths.closeness(none).count() == 0
    assert [tuple(x) for x in paths.betweenness(loops).collect()] == [(1, 0.0)] and paths.betweenness(none).count() == 0


def test_shuffling_and_rewiring(spark):
    r = random.Random(1)
    e = spark.createDataFrame(sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(200)}), "node1 int, node2 int")
    count = lambda x: sorted(map(tuple, network.degrees(x).groupBy("degree").count().collect()))
    for within in (False, True):
        after = network.shuffle_labels(e, 3, within)
        assert count(after) == count(e) and after.exceptAll(e).count() > 0
    assert network.shuffle_report(e, network.shuffle_labels(e, 3, True)).first().changed_degrees == 0
    new = network.rewire(e, 5)
    assert new.where("node1 >= node2").count() == 0 and new.count() == new.distinct().count() and 0.6 * e.count() < new.count() <= e.count()


def test_label_subnetwork_and_lists(spark):
    ann = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C"), (1, "A")], "snp_id int, label string")
    net = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "A")], "label1 string, label2 string")
    x = spark.createDataFrame([(0, [0, 1])], "set_id long, snps array<int>")
    assert [tuple(r) for r in network.label_subnetwork(x, ann, net).collect()] == [("A", "B")]
    assert {r.snp_id: r.label for r in sets.attribute_lists(ann, "snp_id", "label").collect()} == {0: "A", 1: "A;B", 2: "C"}
    assert sets.map_labels(x, ann).count() == 3
    tagged = spark.createDataFrame([(0, 1, "X"), (0, 1, "Y"), (1, 2, "X")], "node1 int, node2 int, tag string")
    assert {r.tag: r.n for r in network.edge_counts(tagged).collect()} == {"X": 2, "Y": 1}


def test_carrier_columns(small):
    geno, people, _ = small
    x = geno.sparkSession.createDataFrame([(0, [2, 5]), (1, [0, 1, 3])], "set_id long, snps array<int>")
    found = filters.carriers(x, geno, people, "y")
    rows = {r["set_id"]: r for r in sets.with_carriers(x, found, [0, 1, 2]).collect()}
    g = {(r.snp_id, r.ind_id): r.g for r in geno.collect()}
    y = {r.ind_id: r.y for r in people.collect()}
    for i, snps in ((0, [2, 5]), (1, [0, 1, 3])):
        for c in (0, 1, 2):
            own = [k for k in range(80) if y[k] == c and all(g[s, k] for s in snps)]
            assert rows[i][f"NUM_INDIVIDUALS_{c}"] == len(own) and rows[i][f"INDIVIDUALS_{c}"] == ";".join(map(str, own))


def test_ld_cutoff(spark):
    r2 = spark.createDataFrame([(a, b, 0.9) for a, b in itertools.combinations(range(8), 2)], "a int, b int, r2 double")
    assert search.ld_cutoff(r2, 200, 2, 4) == pytest.approx(0.9)


def test_tempering_and_annealing_find_the_optimum(spark):
    r = random.Random(2)
    rows = [(c, i, j, r.uniform(-3, 3)) for c in (0, 1) for i in range(9) for j in range(i, 9)]
    q = spark.createDataFrame(rows, "cluster_id long, i long, j long, w double")
    for solver in (search.parallel_tempering, search.anneal):
        for x in solver(q).collect():
            energy = lambda bits: sum(w for c, i, j, w in rows if c == x.cluster_id and bits[i] and bits[j])  # noqa: B023, E731
            assert x.energy == pytest.approx(min(map(energy, itertools.product((0, 1), repeat=9)))) == pytest.approx(energy([i in x.ones for i in range(9)]))


def test_seeding(spark, small):
    geno, people, ring = small
    ctx = [geno, people]
    score = lambda x: scores.bayesian(scores.cells(x, *ctx, "y")).select("set_id", F.col("BAYESIAN").alias("score"))
    nodes = sorted({v for r in ring.collect() for v in (r.node1, r.node2)})
    given = spark.createDataFrame([(v, nodes[i - i % 4]) for i, v in enumerate(nodes)], "node int, cluster int")
    for found in (community.community_seeds(ring, score, clusters=given), community.qubo_seeds(ring, score, least=3, clusters=given)):
        rows = found.collect()
        clusters = {r.cluster for r in rows}
        assert rows and len(clusters) >= 2 and all(2 <= len(set(r.snps)) == len(r.snps) <= 10 for r in rows)


def test_merging_by_alleles(spark):
    s1 = spark.createDataFrame([(0, "rs1", "A", "C"), (1, "rs2", "A", "G"), (2, "rs3", "T", "C")], "snp_id int, name string, a1 string, a2 string")
    s2 = spark.createDataFrame([(0, "rs2", "G", "A"), (1, "rs1", "A", "T"), (2, "rs4", "C", "G")], "snp_id int, name string, a1 string, a2 string")
    g1 = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (2, 0, 0)], "snp_id int, ind_id int, g int")
    g2 = spark.createDataFrame([(0, 0, 2), (1, 0, 1), (2, 0, None)], "snp_id int, ind_id int, g int")
    snps, g = filters.merge_by_alleles([(s1, g1), (s2, g2)])
    names = {r.snp_id: r.name for r in snps.collect()}
    assert sorted(names.values()) == ["rs2", "rs3", "rs4"]  # rs1 has three alleles
    assert {(names[r.snp_id], r.ind_id, r.g) for r in g.collect()} == {("rs2", 0, 2), ("rs2", 1, 0), ("rs3", 0, 0), ("rs4", 1, None)}, names


def test_exports(spark, tmp_path, small):
    geno, people, _ = small
    holes = geno.withColumn("g", F.when((F.col("snp_id") == 1) & (F.col("ind_id") == 3), None).otherwise(F.col("g")))
    binary.write_bed(holes, str(tmp_path / "x.bed"))
    back = binary.read_bed(spark, str(tmp_path / "x.bed"), 80)
    same = lambda d: sorted((r.snp_id, r.ind_id, -1 if r.g is None else r.g) for r in d.collect())
    assert same(back) == same(holes)
    snps = spark.createDataFrame([(i, f"rs{i}", "1", str(i)) for i in range(8)], "snp_id int, name string, chrom string, pos string")
    writers.tped_lines(holes, snps).coalesce(1).write.text(str(tmp_path / "t"))
    line = next(r.value for r in spark.read.text(str(tmp_path / "t")).collect() if r.value.startswith("1 rs1 "))
    assert line.split()[4 + 2 * 3 : 6 + 2 * 3] == ["0", "0"]
    tables = writers.pocos_tables(geno, people, snps)
    assert tables["genotype"].count() == 8 and {r.value for r in tables["phenotype"].collect()} == {"1", "2"}
    cell = scores.cells(spark.createDataFrame([(0, [0, 1])], "set_id long, snps array<int>"), geno, people, "y")
    writers.save_cells(cell, str(tmp_path / "model"))
    assert sorted(map(tuple, writers.load_cells(spark, str(tmp_path / "model")).collect())) == sorted(map(tuple, cell.collect()))
    (tmp_path / "d").mkdir()
    for n in ("a.json.quantitative", "b.csv.categorical.3", "note"):
        (tmp_path / "d" / n).write_text("x")
    assert readers.find_file(spark, str(tmp_path / "d"), "a.*").endswith("a.json.quantitative")
    with pytest.raises(FileNotFoundError, match="more than one"):
        readers.find_file(spark, str(tmp_path / "d"), "*")
    assert {(r.name, r.format, r.phenotype, r.categories) for r in readers.list_datasets(spark, str(tmp_path / "d")).collect()} == {("a", "json", "quantitative", None), ("b", "csv", "categorical", 3)}
    (tmp_path / "dis.txt").write_text('"rs1", rs2,rs99\n')
    assert {r.name for r in readers.read_disease_snps(spark, str(tmp_path / "dis.txt"), snps).collect()} == {"rs1", "rs2"}


def test_small_functions(small):
    _, people, _ = small
    assert scalars.binomial(10, 3) == 120 and scalars.binomial(3, 5) == 0
    assert filters.constant_phenotype(people, "y", 1).where("y <> 1").count() == 0
    p = {r.set_id: r.p for r in scores.monte_carlo(people.sparkSession.createDataFrame([(0, [2, 5]), (1, [0, 7])], "set_id long, snps array<int>"), small[0], people, "y", 2000).collect()}
    assert p[0] < 0.01 < p[1]
    assert math.isclose(p[0] * 2001, round(p[0] * 2001))
