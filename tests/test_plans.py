"""Pipelines, score requests and communities on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from snpweave.operators import community
from snpweave.operators.scores import bayesian, cells
from snpweave.plans import pipeline
from snpweave.sources import star
from snpweave.streaming import scoring

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def state(spark):
    g = star.genotypes100(spark, DIR).where("snp_id < 40").cache()
    p = star.individuals(spark, DIR).cache()
    return pipeline.State(g, p, star.snps100(spark).where("snp_id < 40"), star.labels100(spark, DIR).where("snp_id < 40").cache())


def test_search_pipeline(spark, state):
    names = sorted(r.label for r in state.annotations.select("label").distinct().collect())
    net = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "label1 string, label2 string")
    plan = pipeline.Pipeline(pipeline.same_label(), pipeline.label_network(net, "NET"), pipeline.random_seeds(4, 1), pipeline.local_search("y2", rounds=3, high=3))
    rows = plan.run(state).results.collect()
    assert rows and all(2 <= len(r.snps) <= 3 for r in rows)
    assert '"label_network"' in plan.config()


def test_score_calculator_and_requests(spark, state):
    x = spark.createDataFrame([(0, [1, 5]), (1, [2, 3, 7])], "set_id long, snps array<int>")
    from dataclasses import replace

    table = pipeline.score_calculator(replace(state, sets=x), "y2")
    rows = table.orderBy("RANK (BAYESIAN)").collect()
    assert [r[0] for r in rows] == [1, 2] and rows[0].BAYESIAN <= rows[1].BAYESIAN
    want = {r.set_id: r.BAYESIAN for r in bayesian(cells(x, state.genotypes, state.phenotypes, "y2")).collect()}
    req = spark.createDataFrame([(10, "BAYESIAN", "rs1;5"), (11, "NOPE", "rs1"), (12, "BAYESIAN", "rs777")], "request_id long, scores string, snps string")
    got = {r.request_id: r for r in scoring.answer(req, state.genotypes, state.phenotypes, state.snps, "y2").collect()}
    assert got[10].value == pytest.approx(want[0]) and got[11].status == 400 and got[12].status == 404


def test_stream_of_requests(spark, state, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"request_id": 1, "scores": "BAYESIAN", "snps": "rs1;rs2"}\n')
    stream = spark.readStream.schema("request_id long, scores string, snps string").json(str(tmp_path / "in"))
    seen = []
    q = scoring.serve(stream, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"), genotypes=state.genotypes, phenotypes=state.phenotypes, snps=state.snps, y="y2")
    q.processAllAvailable()
    q.stop()
    assert len(seen) == 1 and seen[0].status == 200


def test_converter(state):
    g, stages = pipeline.convert(state.genotypes, state.phenotypes.select("ind_id", F.col("y2").alias("y")), state.snps)
    rows = stages.collect()
    assert [r.stage for r in rows] == ["input", "rs_names", "duplicates", "missing", "maf", "hardy_weinberg", "strict_missing"]
    assert all(a.variants >= b.variants for a, b in zip(rows, rows[1:], strict=False))


def test_communities(spark):
    e = [(a, b) for s in (0, 10) for a in range(s, s + 6) for b in range(a + 1, s + 6)] + [(20, 21)]
    edges = spark.createDataFrame(e, "node1 int, node2 int")
    got = community.communities(edges, limit=6)
    groups = {}
    for r in got.collect():
        groups.setdefault(r.cluster, set()).add(r.node)
    assert groups == {0: set(range(6)), 10: set(range(10, 16)), 20: {20, 21}}
    stars = community.star_candidates(got, edges, num_sets=3, size=3).collect()
    assert {r.cluster for r in stars} == {0, 10, 20} and all(len(r.snps) <= 3 for r in stars)
