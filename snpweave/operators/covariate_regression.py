"""Regression of a phenotype on a SNP set together with covariates and principal components.

With such columns the people of one cell differ, so a model can't be had from the cells. People are dealt into blocks and sets
into chunks; a tile holds what one chunk needs of one block. A round evaluates the models of all sets that are still
open: a task adds up loss, gradient and curvature of every model of its tile over the tile's people, Spark adds them up
over the blocks, and one small system a model gives the next weights (Newton's method; a step that makes the loss larger
is halved). So a round is one pass over the tiles and a handful of rounds fit all sets together, whatever the number
of people. Weights live in a table between rounds; nothing passes through the driver.

Models of a set: L (dosages), Q (dosages and their products), LC and QC (the same with covariates). They are fitted to the
largest likelihood (to a relative fall of TOLERANCE, MOST rounds at most: where categories can be told apart without
error there is no largest one). Quantitative phenotypes: least squares, and as in `regression` a normal density
whose standard deviation is the mean squared error, kept within (smallest double, 1].

People without a phenotype or a covariate are left out of all sets, people with a missing call out of the sets that have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from snpweave.functions.stats import TINY
from snpweave.operators.pca import MISSING, dealt, genotype_tiles
from snpweave.shared import materialize, materialize_and_see

BLOCK, CHUNK, SHARED = 4096, 1024, 64
MOST, TOLERANCE = 25, 1e-10
ROOT = 2.5066282746310002
MODELS = ("L", "Q", "LC", "QC")
FEW, HELD = 20_000, 50_000  # sets whose models are broadcast; models whose sums a task holds before it goes to another chunk
SUMS = "people double, loss double, slope binary, curve binary"
STATE = "chunk int, set_id long, snps array<int>, model string, weights array<double>, step array<double>, share double, loss double, people double, sigma double, open boolean"


def with_components(covariates: DataFrame | None, components: DataFrame) -> DataFrame:
    """Covariates (ind_id and numbers) and principal components side by side, for those who have both."""
    return components if covariates is None else covariates.join(components, "ind_id")


def tiles(sets: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, covariates: DataFrame, y: str) -> DataFrame:
    """One row per (chunk, block): the chunk's markers (snps) and their dosages in the block, phenotypes and covariates; the
    latter centred and scaled, which changes no model."""
    names = [c for c in covariates.columns if c != "ind_id"]
    cov = covariates.select("ind_id", *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    people = phenotypes.select("ind_id", F.col(y).cast("double").alias("y")).join(cov, "ind_id").where(" AND ".join(["y IS NOT NULL", *[f"c{i} IS NOT NULL" for i in range(len(names))]]))
    known = people.agg(*[f(f"c{i}") for i in range(len(names)) for f in (F.avg, F.stddev_pop)]).first() if names else []
    for i in range(len(names)):
        people = people.withColumn(f"c{i}", (F.col(f"c{i}") - (known[2 * i] or 0.0)) / (known[2 * i + 1] or 1.0))
    people = materialize(people, "people")
    placed = materialize(dealt(people, "ind_id", BLOCK, "block"), "placed")
    asked = materialize(sets.select("chunk", F.explode("snps").alias("snp_id")).distinct(), "asked")

    # dosages of every marker by block, then what each chunk asks of them
    markers = materialize(dealt(asked, "snp_id", 64, "chunk"), "asked_markers")
    packed = genotype_tiles(genotypes.join(markers.select("snp_id"), "snp_id", "left_semi"), placed, markers)
    columns = packed.join(markers, "chunk").select("snp_id", "block", F.expr("substring(tile, pos * n_people + 1, n_people)").alias("calls"))
    sent = asked.join(columns, "snp_id").groupBy("chunk", "block").agg(F.array_sort(F.collect_list(F.struct("snp_id", "calls"))).alias("g"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        c = np.ascontiguousarray(pdf[[f"c{i}" for i in range(len(names))]].to_numpy(np.float64))
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "n": [len(pdf)], "y": [pdf["y"].to_numpy(np.float64).tobytes()], "cov": [c.tobytes()]})

    own = people.join(placed, "ind_id").groupBy("block").applyInPandas(pack, "block int, n int, y binary, cov binary")
    return sent.join(own, "block").select("chunk", "block", "n", F.col("g.snp_id").alias("markers"), F.col("g.calls").alias("calls"), "y", "cov")


def design(model: str, g: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """1, the dosages (a row a SNP), with Q their products of two, with C the covariates: a column each."""
    columns = [np.ones(g.shape[1]), *g]
    if "Q" in model:
        columns += [g[i] * g[j] for i in range(len(g)) for j in range(i + 1, len(g))]
    return np.column_stack([np.stack(columns, axis=1), cov]) if "C" in model else np.stack(columns, axis=1)


def evaluate(x: np.ndarray, y: np.ndarray, w: np.ndarray, categories: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature at the weights: squared error (categories 0) or the negative log likelihood of
    categories, the first of which has the predictor 0. Weights: features for one category after the other."""
    f = x.shape[1]
    if categories == 0:
        e = x @ w - y
        return float(e @ e), 2 * (x.T @ e), 2 * (x.T @ x)
    z = np.column_stack([np.zeros(len(x)), x @ w.reshape(categories - 1, f).T])
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=1, keepdims=True)
    p, own = e / total, y.astype(np.int64)
    loss = float((top[:, 0] + np.log(total[:, 0]) - z[np.arange(len(z)), own]).sum())
    slope = p[:, 1:] - (own[:, None] == np.arange(1, categories))
    curve = np.zeros(((categories - 1) * f, (categories - 1) * f))
    for a in range(categories - 1):
        for b in range(a, categories - 1):
            weight = p[:, a + 1] * ((a == b) - p[:, b + 1])
            part = x.T @ (weight[:, None] * x)
            curve[a * f : (a + 1) * f, b * f : (b + 1) * f] = part
            curve[b * f : (b + 1) * f, a * f : (a + 1) * f] = part
    return loss, (slope.T @ x).reshape(-1), curve


def _over_models(tile: DataFrame, state: DataFrame, one, n_sets: int, sums: str) -> DataFrame:
    """What `one` (features, phenotypes, the model's row) gives for every model, added up over the blocks that a task meets: chunk,
    part (a number of the task), set_id, model and the sums (numbers, or arrays as bytes). State rows come as one list a
    chunk, broadcast where there are at most FEW sets, so that tiles are read where they lie; a task unpacks it once."""
    listed = state.groupBy("chunk").agg(F.collect_list(F.struct("set_id", "snps", "model", "weights", "step", "share", "sigma")).alias("models"))
    schema = f"chunk int, part int, set_id long, model string, {sums}"
    names = [x.split()[0] for x in sums.split(", ")]
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        total: dict[tuple, list] = {}
        at, models = None, []

        def flushed() -> pa.RecordBatch:
            rows = [(*key[:1], part, *key[1:], *[v.tobytes() if isinstance(v, np.ndarray) else v for v in values]) for key, values in total.items()]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)

        for whole in batches:
            for i in range(whole.num_rows):
                r = {n: whole.column(n)[i] for n in whole.schema.names}
                chunk, n = r["chunk"].as_py(), r["n"].as_py()
                if chunk != at:
                    at, models = chunk, r["models"].as_py()
                    if len(total) > HELD:
                        yield flushed()
                rows = {int(s): np.frombuffer(c, np.int8) for s, c in zip(r["markers"].as_py(), r["calls"].as_py(), strict=True)}
                y, cov = np.frombuffer(r["y"].as_py()), np.frombuffer(r["cov"].as_py()).reshape(n, -1)
                for m in models:
                    calls = [rows.get(int(s)) for s in m["snps"]]
                    if any(c is None for c in calls):
                        continue
                    g = np.stack(calls)
                    ok = (g != MISSING).all(axis=0)
                    if ok.any():
                        some = slice(None) if ok.all() else ok
                        found = one(design(m["model"], g[:, some].astype(float), cov[some]), y[some], m)
                        key = (chunk, m["set_id"], m["model"])
                        have = total.get(key)
                        total[key] = [found[k] for k in names] if have is None else [x + found[k] for x, k in zip(have, names, strict=True)]
        yield flushed()

    return tile.join(F.broadcast(listed) if n_sets <= FEW else listed, "chunk").mapInArrow(run, schema)


def fit(tile: DataFrame, sets: DataFrame, n_cov: int, categories: int, models: tuple[str, ...] = MODELS) -> DataFrame:
    """The state of every (set, model) when it is fitted; sets: chunk, set_id, snps. categories 0: least squares."""
    k = F.size("snps")
    wide = F.lit(1) + k + F.when(F.col("model").contains("Q"), (k * (k - 1) / 2).cast("int")).otherwise(0) + F.when(F.col("model").contains("C"), n_cov).otherwise(0)
    zeros = F.array_repeat(F.lit(0.0), (wide * max(1, categories - 1)).cast("int"))
    state = sets.select("chunk", "set_id", "snps", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    state = state.select("*", zeros.alias("weights"), zeros.alias("step"), F.lit(1.0).alias("share"), F.lit(float("inf")).alias("loss"), F.lit(0.0).alias("people"), F.lit(1.0).alias("sigma"), F.lit(True).alias("open"))
    state, done = materialize(state, "models"), None
    n_sets = sets.count()
    deals = max(1, -(-n_sets // SHARED))

    def one(x: np.ndarray, y: np.ndarray, m) -> dict:
        loss, slope, curve = evaluate(x, y, np.asarray(m["weights"]) + m["share"] * np.asarray(m["step"]), categories)
        return {"people": float(len(y)), "loss": loss, "slope": slope, "curve": curve[np.triu_indices(len(slope))]}

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total: dict[tuple, list] = {}
        for r in pdf.itertuples():
            row = [r.people, r.loss, np.frombuffer(r.slope), np.frombuffer(r.curve)]
            have = total.get((r.set_id, r.model))
            total[r.set_id, r.model] = row if have is None else [x + y for x, y in zip(have, row, strict=True)]
        rows = [(pdf["deal"].iloc[0], 0, s, m, n, loss, slope.tobytes(), curve.tobytes()) for (s, m), (n, loss, slope, curve) in total.items()]
        return pd.DataFrame(rows, columns=["deal", "part", "set_id", "model", "people", "loss", "slope", "curve"])

    def advance(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for r in pdf.itertuples():
                w, step = np.asarray(r.weights, float), np.asarray(r.step, float)
                row = {"chunk": r.chunk, "set_id": r.set_id, "snps": r.snps, "model": r.model, "people": r.now_people, "sigma": r.sigma}
                if not np.isfinite(r.loss) or r.now <= r.loss:  # the step is taken
                    fell = r.loss - r.now
                    w = w + r.share * step
                    slope = np.frombuffer(r.slope)
                    curve = np.zeros((len(slope), len(slope)))
                    curve[np.triu_indices(len(slope))] = np.frombuffer(r.curve)
                    curve += np.triu(curve, 1).T
                    step = -np.linalg.lstsq(curve, slope, rcond=1e-12)[0]
                    row |= {"loss": r.now, "share": 1.0, "open": not (np.isfinite(fell) and fell <= TOLERANCE * (1 + abs(r.now)))}
                else:
                    row |= {"loss": r.loss, "share": r.share / 2, "open": r.share > 1e-6 and r.now - r.loss > TOLERANCE * (1 + abs(r.loss))}
                out.append(row | {"weights": w, "step": step})
            yield pd.DataFrame(out, columns=[x.split()[0] for x in STATE.split(", ")])

    for _ in range(MOST):
        parts = _over_models(tile, state, one, n_sets, SUMS).withColumn("deal", F.pmod(F.xxhash64("set_id"), F.lit(deals)).cast("int")).drop("chunk")
        # two levels, so that no group holds the sums of more than about SHARED sets from 64 tasks
        summed = f"deal int, part int, set_id long, model string, {SUMS}"
        sums = parts.groupBy("deal", F.expr("part div 64")).applyInPandas(add, summed).groupBy("deal").applyInPandas(add, summed)
        sums = sums.select("set_id", "model", F.col("people").alias("now_people"), F.col("loss").alias("now"), "slope", "curve")
        after = state.join(sums, ["set_id", "model"]).mapInPandas(advance, STATE)
        after, seen = materialize_and_see(after, "models", open=F.sum(F.col("open").cast("long")))
        ended = after.where("NOT open")
        done = ended if done is None else done.unionAll(ended)
        state = after.where("open")
        if not seen["open"]:
            return done
    return done.unionAll(state)


def covariate_scores(sets: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, covariates: DataFrame, y: str, categories: int | None = None) -> DataFrame:
    """set_id and its models' scores: NLL_L, NLL_Q, NLL_LC, NLL_QC; of QC the REGRESSION_COV_ scores NLL, LLH, AIC, BIC and the
    gains of its products (over LC); and REGRESSION_CLG_L_LC, _Q_QC and _Q_LC, the likelihood of the model with covariates
    less that without. categories: number of values 0, 1, ... of the phenotype, None for a quantitative one. Sets of
    which nobody has all calls have no row."""
    chunks = max(1, -(-sets.count() // CHUNK))
    chunked = materialize(sets.select(F.pmod(F.xxhash64("set_id"), F.lit(chunks)).cast("int").alias("chunk"), F.col("set_id").cast("long").alias("set_id"), F.col("snps").cast("array<int>").alias("snps")), "sets")
    many = chunks * max(1, -(-phenotypes.count() // BLOCK))
    tile = materialize(tiles(chunked, genotypes, phenotypes, covariates, y).repartition(min(many, max(64, many // 8)), "chunk", "block"), "tiles")
    n_cov, classes = len(covariates.columns) - 1, 0 if categories is None else max(2, categories)
    fitted = fit(tile, chunked, n_cov, classes)
    if categories is None:
        fitted = materialize(fitted.withColumn("sigma", F.greatest(F.col("loss") / F.col("people"), F.lit(TINY))), "fits")

        def density(x: np.ndarray, v: np.ndarray, m) -> dict:
            z = (v - x @ np.asarray(m["weights"])) / m["sigma"]
            return {"nll": float(-np.log(np.clip(np.exp(-z * z / 2) / (m["sigma"] * ROOT), TINY, 1)).sum())}

        parts = _over_models(tile, fitted, density, chunked.count(), "nll double")
        fitted = fitted.join(parts.groupBy("set_id", "model").agg(F.sum("nll").alias("nll")), ["set_id", "model"])
    else:
        fitted = fitted.withColumn("nll", F.col("loss"))
    wide = F.size("weights") + (1 if categories is None else 0)
    by = fitted.withColumn("df", wide).groupBy("set_id").agg(F.max("people").alias("people"), *[F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{c}_{m}") for m in MODELS for c in ("nll", "df")])
    llh = lambda m: F.exp(-F.col(f"nll_{m}"))
    log, q, a, dq, da = F.log("people"), F.col("nll_QC"), F.col("nll_LC"), F.col("df_QC"), F.col("df_LC")
    out = {
        "REGRESSION_COV_NLL": q, "REGRESSION_COV_LLH": llh("QC"), "REGRESSION_COV_AIC": 2 * q + 2 * dq, "REGRESSION_COV_BIC": 2 * q + log * dq,
        "REGRESSION_COV_NLL_GAIN": a - q, "REGRESSION_COV_LLH_GAIN": llh("QC") - llh("LC"), "REGRESSION_COV_AIC_GAIN": 2 * (a - q) + 2 * da + 2 * dq, "REGRESSION_COV_BIC_GAIN": 2 * (a - q) + log * (da + dq),
        "REGRESSION_CLG_L_LC": llh("LC") - llh("L"), "REGRESSION_CLG_Q_QC": llh("QC") - llh("Q"), "REGRESSION_CLG_Q_LC": llh("LC") - llh("Q"),
    }
    return by.select("set_id", *[F.col(f"nll_{m}").alias(f"NLL_{m}") for m in MODELS], *[c.alias(n) for n, c in out.items()])
