"""Seeds of SNP networks, LD cutoffs, QUBO construction and annealing. Local search is in `open_search`."""

from __future__ import annotations

import math
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snpweave import shared

def ld_cutoff(ld: DataFrame, samples: int = 10_000, low: int = 2, high: int = 10, mode: str = "mean", seed: int = 0) -> float:
    """The value that 95 % of random SNPs keep to with random sets of low to high members: sampled sets and SNPs, their mean
    or largest r2 with the set, sorted, element floor(0.95 n) - 1. ld: a, b, r2, each pair once; others have 0."""
    names = ld.select(F.explode(F.array("a", "b")).alias("snp")).distinct()
    numbered = shared.materialize(shared.numbered(names.select("snp", F.pmod(F.xxhash64("snp"), F.lit(64)).alias("part")), "part", ["snp"], "i").select("snp", "i"), "snps")
    n = numbered.count()
    if n <= high:
        raise ValueError("fewer SNPs than a set has members")
    size = F.lit(low) + F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(high - low + 1))
    # enough draws to have size + 1 different ones; the first is the SNP, the next ones the set
    draws = ld.sparkSession.range(samples).select("id", size.cast("int").alias("size"), F.posexplode(F.expr(f"array_distinct(transform(sequence(1, {8 * (high + 1)}), d -> pmod(xxhash64({seed}, id, d), {n})))")).alias("at", "i")).where("at <= size")
    named = draws.join(numbered, "i").select("id", "at", "snp")
    one, rest = named.where("at = 0").select("id", F.col("snp").alias("x")), named.where("at > 0").select("id", F.col("snp").alias("y"))
    both = ld.select("a", "b", "r2").unionAll(ld.select(F.col("b"), F.col("a"), "r2"))
    value = one.join(rest, "id").join(both, F.expr("x = a AND y = b"), "left").groupBy("id").agg((F.avg if mode == "mean" else F.max)(F.coalesce("r2", F.lit(0.0))).alias("v"))
    place = max(int(samples * 0.95) - 1, 0)
    return float(value.orderBy("v").limit(place + 1).agg(F.max("v")).first()[0])


def _least_at_both_ends(left: DataFrame) -> DataFrame:
    """Of edges (node1, node2, h) those whose h is the least at both ends."""
    ends = left.select("h", F.explode(F.array("node1", "node2")).alias("node"))
    least = ends.groupBy("node").agg(F.min("h").alias("m"))
    a, b = least.select(F.col("node").alias("node1"), F.col("m").alias("m1")), least.select(F.col("node").alias("node2"), F.col("m").alias("m2"))
    return left.join(a, "node1").join(b, "node2").where("h = m1 AND h = m2").select("node1", "node2", "h")


def random_connected_seeds(edges: DataFrame, n: int, seed: int = 0, total: int | None = None) -> DataFrame:
    """set_id, snps: a random matching. Every edge has a hash; in each round the edges that are least at both ends are taken
    and their ends leave, until n are taken or none is left. Joins and aggregations only.

    Where the number of edges is given (total), those of the smallest hashes are tried first: an edge among them is least at
    its ends in the whole network if it is least among them, and if n of them are, they are the n that the first round
    over all edges gives."""
    hashed = edges.select("node1", "node2").withColumn("h", F.xxhash64(F.lit(seed), "node1", "node2"))
    share = 64 * n / max(total, 1) if total is not None else 1.0
    while share < 0.25:
        few = shared.materialize(hashed.where(F.col("h") < -(1 << 63) + int(share * (1 << 64))).distinct(), "few")
        won = shared.materialize(_least_at_both_ends(few), "won")
        if won.count() >= n:
            return _named_pairs(won, n)
        share *= 16
    left = shared.materialize(hashed.distinct(), "left")
    taken, have = None, 0
    while True:
        won = shared.materialize(_least_at_both_ends(left), "won")
        more = won.count()
        if more == 0:
            break
        taken, have = (won if taken is None else taken.unionByName(won)), have + more
        if have >= n:
            break
        used = won.select(F.explode(F.array("node1", "node2")).alias("u"))
        left = shared.materialize(left.join(used.withColumnRenamed("u", "node1"), "node1", "left_anti").join(used.withColumnRenamed("u", "node2"), "node2", "left_anti"), "left")
    if taken is None:
        return edges.sparkSession.createDataFrame([], "set_id long, snps array<int>")
    return _named_pairs(taken, n)


def _named_pairs(taken: DataFrame, n: int) -> DataFrame:
    return taken.orderBy("h").limit(n).select(F.xxhash64("node1", "node2").alias("set_id"), F.array(F.col("node1").cast("int"), F.col("node2").cast("int")).alias("snps"))


# ---------------------------------------------------------------- QUBO


def clique_qubo(pairs: DataFrame, n_cliques: int = 2, k: int = 3, penalty: float = 5.0, reward: float = 1.0, overlap: float = 1.0, nu: float = 0.5) -> DataFrame:
    """i, j, w (i <= j) of the problem of n heaviest k-cliques: pairs (i, j, stat, bio) of one cluster, variables numbered
    clique by clique."""
    nodes = pairs.select(F.explode(F.array("i", "j")).alias("v")).distinct()
    n = nodes.agg((F.max("v") + 1).alias("n"))
    copies = pairs.sparkSession.range(n_cliques).select(F.col("id").alias("c"))
    shift = F.col("c") * F.col("n")
    base = nodes.crossJoin(F.broadcast(copies)).crossJoin(F.broadcast(n))  # a copy a clique
    diag = base.select((F.col("v") + shift).alias("i"), (F.col("v") + shift).alias("j"), F.lit(penalty * (1 - 2 * k)).alias("w"))
    weight = nu * F.col("stat") + (1 - nu) * F.col("bio")
    inner = pairs.crossJoin(F.broadcast(copies)).crossJoin(F.broadcast(n)).select((F.col("i") + shift).alias("i"), (F.col("j") + shift).alias("j"), (2 * penalty - reward * weight).alias("w"))
    a, b = base.alias("a"), base.alias("b")
    across = a.join(b, F.expr("a.v = b.v AND a.c < b.c")).select(F.expr("a.v + a.c * a.n").alias("i"), F.expr("b.v + b.c * b.n").alias("j"), F.lit(overlap).alias("w"))
    return diag.unionAll(inner).unionAll(across).select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("w").cast("double"))


def ising(qubo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields (i, h) and couplings (i, j, c) of the same problem for spins."""
    diag = qubo.where("i = j").select("i", (F.col("w") / 2).alias("h"))
    off = qubo.where("i <> j")
    ends = off.select(F.explode(F.array("i", "j")).alias("i"), (F.col("w") / 4).alias("h"))
    return diag.unionAll(ends).groupBy("i").agg(F.sum("h").alias("h")), off.select("i", "j", (F.col("w") / 4).alias("c"))


class Solver(Protocol):
    """What solves the QUBO problems of clusters: rows (cluster_id, i, j, w) to (cluster_id, energy, ones)."""

    def __call__(self, qubo: DataFrame) -> DataFrame: ...


def anneal(qubo: DataFrame, samples: int = 10, sweeps: int = 1000, seed: int = 1234) -> DataFrame:
    """cluster_id, energy, ones: the best of several simulated annealings of each cluster's QUBO (cluster_id, i, j, w)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf["i"].max(), pdf["j"].max())) + 1
        q = np.zeros((n, n))
        np.add.at(q, (pdf["i"].to_numpy(), pdf["j"].to_numpy()), pdf["w"].to_numpy())
        sym, diag = q + q.T - 2 * np.diag(np.diag(q)), np.diag(q)
        rng = np.random.default_rng(seed)
        top = max(np.abs(diag + np.abs(sym).sum(axis=1)).max(), 1e-9)
        low = min(np.abs(q[q != 0]).min(), top) if (q != 0).any() else 1.0
        betas = np.geomspace(math.log(2) / top, math.log(100) / low, sweeps)
        best, best_x = math.inf, None
        for _ in range(samples):
            x = rng.integers(0, 2, n)
            local = diag + sym @ x
            for beta in betas:
                for i in range(n):
                    delta = local[i] * (1 - 2 * x[i])
                    if delta <= 0 or rng.random() < math.exp(-min(delta * beta, 700.0)):
                        step = 1 - 2 * x[i]
                        x[i] += step
                        local += sym[:, i] * step
            energy = float(x @ np.triu(q) @ x) if np.allclose(q, np.triu(q)) else float(x @ q @ x)
            if energy < best:
                best, best_x = energy, x.copy()
        return pd.DataFrame({"cluster_id": [pdf["cluster_id"].iloc[0]], "energy": [best], "ones": [np.flatnonzero(best_x).tolist()]})

    return qubo.groupBy("cluster_id").applyInPandas(run, "cluster_id long, energy double, ones array<int>")


def parallel_tempering(qubo: DataFrame, chains: int = 8, sweeps: int = 500, seed: int = 1234) -> DataFrame:
    """cluster_id, energy, ones: the best state of Metropolis chains at temperatures from 1 to 0.01 (in units of the largest
    local field), whose neighbours exchange states after every sweep, with probability exp of the product of differences of
    inverse temperatures and energies."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf["i"].max(), pdf["j"].max())) + 1
        q = np.zeros((n, n))
        np.add.at(q, (pdf["i"].to_numpy(), pdf["j"].to_numpy()), pdf["w"].to_numpy())
        diag = np.diag(q).copy()
        sym = q + q.T - 2 * np.diag(diag)
        rng = np.random.default_rng(seed)
        top = max(np.abs(diag).max() + np.abs(sym).sum(axis=1).max(), 1e-9)
        beta = 1 / (np.geomspace(1, 1e-2, chains) * top)
        x = rng.integers(0, 2, (chains, n))
        local = diag + x @ sym
        energy = np.einsum("ci,ij,cj->c", x, q, x).astype(float)
        low = int(energy.argmin())
        best, best_x = energy[low], x[low].copy()
        for _ in range(sweeps):
            for i in rng.permutation(n):  # all chains at once
                step = 1 - 2 * x[:, i]
                delta = local[:, i] * step
                flip = (delta <= 0) | (rng.random(chains) < np.exp(-np.minimum(np.maximum(delta, 0) * beta, 700)))
                x[flip, i] += step[flip]
                energy[flip] += delta[flip]
                local[flip] += step[flip, None] * sym[i]
            for c in range(chains - 1):
                gain = (beta[c + 1] - beta[c]) * (energy[c + 1] - energy[c])
                if gain >= 0 or rng.random() < math.exp(gain):
                    for v in (x, local, energy):
                        v[[c, c + 1]] = v[[c + 1, c]]
            low = int(energy.argmin())
            if energy[low] < best - 1e-12:
                best, best_x = energy[low], x[low].copy()
        return pd.DataFrame({"cluster_id": [pdf["cluster_id"].iloc[0]], "energy": [float(best_x @ q @ best_x)], "ones": [np.flatnonzero(best_x).tolist()]})

    return qubo.groupBy("cluster_id").applyInPandas(run, "cluster_id long, energy double, ones array<int>")


def decode_cliques(solved: DataFrame, nodes: DataFrame, most: int = 10) -> DataFrame:
    """set_id, cluster_id, snps: the SNPs of every clique of the solutions; nodes: cluster_id, v, snp_id, as numbered in the
    problems, clique by clique. Empty ones, and those of more than `most`, go."""
    sizes = nodes.groupBy("cluster_id").agg((F.max("v") + 1).alias("n"))
    ones = solved.select("cluster_id", F.explode("ones").alias("o")).join(sizes, "cluster_id")
    placed = ones.select("cluster_id", F.floor(F.col("o") / F.col("n")).alias("clique"), (F.col("o") % F.col("n")).cast("int").alias("v"))
    named = placed.join(nodes.select("cluster_id", F.col("v").cast("int").alias("v"), "snp_id"), ["cluster_id", "v"])
    out = named.groupBy("cluster_id", "clique").agg(F.array_sort(F.collect_set(F.col("snp_id").cast("int"))).alias("snps")).where(F.size("snps") <= most)
    return out.select(F.xxhash64("cluster_id", F.array_join("snps", ",")).alias("set_id"), "cluster_id", "snps").dropDuplicates(["set_id"])
