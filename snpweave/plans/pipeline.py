"""Operators chained over an immutable state of DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snpweave.operators import filters, network, open_search, scores, search, sets


@dataclass(frozen=True)
class State:
    """What operators read and replace: genotypes, phenotypes, snps, annotations, edges (with tag) and sets."""

    genotypes: DataFrame
    phenotypes: DataFrame
    snps: DataFrame
    annotations: DataFrame | None = None
    edges: DataFrame | None = None
    sets: DataFrame | None = None
    results: DataFrame | None = None


@dataclass(frozen=True)
class Step:
    """A named operator with the options that it was made with."""

    name: str
    apply: Callable[[State], State]
    options: dict = field(default_factory=dict)


class Pipeline:
    def __init__(self, *steps: Step) -> None:
        self.steps = steps

    def run(self, state: State) -> State:
        for step in self.steps:
            state = step.apply(state)
        return state

    def config(self) -> str:
        return json.dumps([{"name": s.name, "options": s.options} for s in self.steps], indent=2)


def marker_filter(y: str, cutoff: float) -> Step:
    """Markers that are associated alone leave: single-marker tests at or below the cutoff."""

    def apply(s: State) -> State:
        single = s.snps.select(F.col("snp_id").cast("long").alias("set_id"), F.array(F.col("snp_id").cast("int")).alias("snps"))
        tests = scores.chi_squared(scores.cells(single, s.genotypes, s.phenotypes, y), scores.category_totals(s.phenotypes, y))
        gone = filters.single_marker_filter(tests, cutoff).where("is_removed").select(F.col("set_id").cast("int").alias("snp_id"))
        keep = lambda df: df.join(gone, "snp_id", "left_anti")
        return replace(s, snps=keep(s.snps), genotypes=keep(s.genotypes), annotations=None if s.annotations is None else keep(s.annotations))

    return Step("marker_filter", apply, {"y": y, "cutoff": cutoff})


def same_label() -> Step:
    return Step("same_label", lambda s: replace(s, edges=_more(s.edges, network.same_label_edges(s.annotations))))


def label_network(net: DataFrame, tag: str) -> Step:
    return Step("label_network", lambda s: replace(s, edges=_more(s.edges, network.label_network_edges(s.annotations, net, tag))), {"tag": tag})


def _more(edges: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if edges is None else edges.unionByName(new)


def random_seeds(n: int, seed: int) -> Step:
    return Step("random_seeds", lambda s: replace(s, sets=search.random_connected_seeds(s.edges, n, seed)), {"n": n, "seed": seed})


def local_search(y: str, **options) -> Step:
    """Search from every set; equal results are merged."""

    def apply(s: State) -> State:
        rest = {k: v for k, v in options.items() if k != "score"}
        grade = open_search.cell_score(s.genotypes, s.phenotypes, y, options.get("score", "PENETRANCE_NLL"))
        return replace(s, results=open_search.local_search(s.sets, s.edges, grade, **rest))

    return Step("local_search", apply, {"y": y, **options})


def multi_network(s: State, y: str, networks: dict[str, DataFrame], n: int, seed: int, **options) -> DataFrame:
    """Every label network is searched from the same state; the merged sets and the edges inside them, tagged by network,
    are searched once more."""
    found, inside = None, None
    for tag, net in networks.items():
        one = Pipeline(same_label(), label_network(net, tag), random_seeds(n, seed), local_search(y, **options)).run(replace(s, edges=None))
        edges = network.induced_edges(one.results, one.edges).select("node1", "node2").distinct().withColumn("tag", F.lit(tag))
        found = one.results if found is None else found.unionByName(one.results)
        inside = edges if inside is None else inside.unionByName(edges)
    seeds = found.select("snps").distinct().select(F.xxhash64(F.array_join("snps", ",")).alias("set_id"), "snps")
    return local_search(y, **options).apply(replace(s, edges=inside, sets=seeds)).results


def score_calculator(s: State, y: str, rank_by: str = "BAYESIAN", k_min: int | None = None, k_max: int | None = None) -> DataFrame:
    """Scores of given sets (and of their subsets of k_min to k_max members), ranked and annotated."""
    x = s.sets if k_min is None else _numbered(sets.subsets(s.sets, k_min, k_max or k_min))
    return sets.results_table(scores.score_sets(x, s.genotypes, s.phenotypes, y), x, s.snps, s.annotations, rank_by)


def _numbered(x: DataFrame) -> DataFrame:
    return x.select("snps").distinct().select(F.xxhash64(F.array_join("snps", ",")).alias("set_id"), "snps")


def convert(genotypes: DataFrame, phenotypes: DataFrame, snps: DataFrame, missing: float = 0.2, maf: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The converter's filters in their order: rs names, duplicates, missing calls, allele frequency, Hardy-Weinberg, and
    last every missing call. Returns (genotypes, one row of counts a stage)."""
    spark, stages = genotypes.sparkSession, []

    def note(stage: str, g: DataFrame) -> DataFrame:
        r = g.agg(F.countDistinct("snp_id"), F.countDistinct("ind_id")).first()
        stages.append((stage, r[0], r[1]))
        return g

    g = note("input", genotypes)
    g = note("rs_names", g.join(filters.filter_rs(snps).select("snp_id"), "snp_id", "left_semi"))
    g = note("duplicates", g.join(filters.drop_duplicate_variants(snps, ["name"], ["snp_id"]).select("snp_id"), "snp_id", "left_semi"))
    g = note("missing", filters.filter_missing(g, missing))
    g = note("maf", g.join(filters.filter_maf(g, maf).select("snp_id"), "snp_id", "left_semi"))
    g = note("hardy_weinberg", g.join(filters.hardy_weinberg(g, phenotypes).where("ok").select("snp_id"), "snp_id", "left_semi"))
    g = note("strict_missing", filters.filter_missing(g, 0.0))
    return g, spark.createDataFrame(stages, "stage string, variants long, samples long")
