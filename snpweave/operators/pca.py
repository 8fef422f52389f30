"""Principal components of the standardised genotype matrix, by subspace iteration over tiles.

Individuals are dealt into blocks and markers into chunks; a tile holds the dosages of one chunk in one block, a byte each. A
pass multiplies every tile with its block's (or chunk's) rows of the other side's matrix, a few numbers an individual or
marker, and adds the products up by grouped sums. Only the small square matrices between passes (as wide as the number
of components sought) come to the driver, so neither individuals nor markers are bound by one machine.

Markers are centred and scaled by their own mean and deviation; a missing call counts as the mean, and markers without
variation are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snpweave.shared import materialize

BLOCK, CHUNK = 4096, 1024
WHOLE = 128
MISSING = 3


def dealt(df: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """(key, name, pos): rows dealt by hash into parts of about `size`, numbered inside each."""
    keys = df.select(key).distinct()
    parts = max(1, -(-keys.count() // size))
    at = keys.withColumn(name, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    return at.withColumn("pos", (F.row_number().over(Window.partitionBy(name).orderBy(key)) - 1).cast("int"))


def genotype_tiles(genotypes: DataFrame, people: DataFrame, markers: DataFrame) -> DataFrame:
    """One row per (chunk, block): n_markers, n_people and the dosages, marker by marker (MISSING where there is none)."""
    rows = people.groupBy("block").agg(F.count("*").alias("n_people"))
    cols = markers.groupBy("chunk").agg(F.count("*").alias("n_markers"))
    calls = genotypes.where("g IS NOT NULL").select("snp_id", "ind_id", F.col("g").cast("tinyint").alias("g"))
    # a row an individual and chunk: calls are moved by individual once, and only packed afterwards
    placed = calls.join(markers.select("snp_id", "chunk", F.col("pos").cast("short").alias("s")), "snp_id")
    rows_of = placed.groupBy("ind_id", "chunk").agg(F.collect_list("s").alias("s"), F.collect_list("g").alias("g"))
    packed = rows_of.join(people.select("ind_id", "block", F.col("pos").alias("i")), "ind_id")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m, n = int(pdf["n_markers"].iloc[0]), int(pdf["n_people"].iloc[0])
        tile = np.full((m, n), MISSING, np.int8)
        for i, s, g in zip(pdf["i"], pdf["s"], pdf["g"], strict=True):
            tile[np.asarray(s), i] = np.asarray(g)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "block": pdf["block"].iloc[:1], "n_markers": [m], "n_people": [n], "tile": [tile.tobytes()]})

    sized = packed.join(rows, "block").join(cols, "chunk")
    return sized.groupBy("chunk", "block").applyInPandas(pack, "chunk int, block int, n_markers int, n_people int, tile binary")


def as_matrix(rows: DataFrame, part: str, cols: list[str]) -> DataFrame:
    """(part, matrix): each part's rows in order of pos, as bytes of doubles."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.sort_values("pos")[cols].to_numpy(np.float64)
        return pd.DataFrame({part: pdf[part].iloc[:1], "matrix": [np.ascontiguousarray(m).tobytes()]})

    return rows.groupBy(part).applyInPandas(pack, f"{part} int, matrix binary")


def times(tiles: DataFrame, scale: DataFrame, side: DataFrame, part: str, width: int) -> DataFrame:
    """(other part, pos, v0, v1, ...): the standardised tiles times the matrix of a side (part: "block", summed over people,
    or "chunk", over markers), added up over the parts."""
    other = "chunk" if part == "block" else "block"
    names = [f"v{j}" for j in range(width)]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for r in pdf.itertuples():
                g = np.frombuffer(r.tile, np.int8).reshape(r.n_markers, r.n_people)
                mean, sd = np.frombuffer(r.scale, np.float64).reshape(-1, 2).T
                z = np.where(g == MISSING, 0.0, (g - mean[:, None]) / sd[:, None])
                q = np.frombuffer(r.matrix, np.float64).reshape(-1, width)
                out = z @ q if part == "block" else z.T @ q
                yield pd.DataFrame(out, columns=names).assign(**{other: getattr(r, other), "pos": np.arange(len(out))})[[other, "pos", *names]]

    both = tiles.join(scale, "chunk").join(side, part)
    sums = both.mapInPandas(run, f"{other} int, pos int, " + ", ".join(f"{v} double" for v in names))
    return sums.groupBy(other, "pos").agg(*[F.sum(v).alias(v) for v in names])


def gram(rows: DataFrame, width: int) -> np.ndarray:
    """Sums of the products of every two columns: added up a task at a time, and over the tasks by Spark."""
    names = [f"v{j}" for j in range(width)]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in pdfs:
            m = pdf[names].to_numpy()
            total += m.T @ m
        i, j = np.triu_indices(width)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    out = np.zeros((width, width))
    for r in rows.select(*names).mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def rotated(rows: DataFrame, by: np.ndarray) -> DataFrame:
    """block, pos and the columns v0, v1, ... times a small matrix."""
    before, after = [f"v{j}" for j in range(len(by))], [f"v{j}" for j in range(by.shape[1])]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pd.concat([pdf[["block", "pos"]], pd.DataFrame(pdf[before].to_numpy() @ by, columns=after, index=pdf.index)], axis=1)

    return rows.select("block", "pos", *before).mapInPandas(run, "block int, pos int, " + ", ".join(f"{v} double" for v in after))


def orthonormal(rows: DataFrame, width: int) -> DataFrame:
    """Columns that span the same space, at right angles and of length 1; twice where once loses digits."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(gram(rows, width))
        low = values.max() * 1e-14 if values.max() > 0 else 1.0
        rows = materialize(rotated(rows, vectors / np.sqrt(np.maximum(values, low))), "basis")
        if values.min() > values.max() * 1e-6:
            break
    return rows


def principal_components(genotypes: DataFrame, n: int = 10, extra: int = 30, rounds: int = 40, tolerance: float = 1e-7, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """(ind_id, pc1, pc2, ...) and the components' variances: of the standardised matrix, the projections of individuals on
    the n directions of largest variance. Each component's entry of largest size is positive. Fewer components come back
    where there are fewer markers with variation or individuals. `extra` more columns than asked speed the iteration up
    (with up to WHOLE markers or individuals there are as many columns, and the second pass is exact); it ends when no variance
    changes by more than `tolerance` of the first."""
    stats = genotypes.where("g IS NOT NULL").groupBy("snp_id").agg(F.avg("g").alias("mean"), F.stddev_pop("g").alias("sd")).where("sd > 0")
    stats = materialize(stats, "scale")
    markers = materialize(dealt(stats, "snp_id", CHUNK, "chunk").join(stats, "snp_id"), "markers")
    people = materialize(dealt(genotypes, "ind_id", BLOCK, "block"), "people")
    n_people = people.count()
    most = min(stats.count(), n_people)
    width = most if most <= WHOLE else min(n + extra, most)
    n = min(n, width)
    if not n:
        return people.select("ind_id"), []
    tiles = materialize(genotype_tiles(genotypes, people, markers), "tiles")
    scale = materialize(as_matrix(markers, "chunk", ["mean", "sd"]).withColumnRenamed("matrix", "scale"), "scales")

    def start(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = [np.random.default_rng([seed, b, p]).standard_normal(width) for b, p in zip(pdf["block"], pdf["pos"], strict=True)]
            yield pd.DataFrame(np.reshape(rows, (-1, width)), columns=[f"v{j}" for j in range(width)]).assign(block=pdf["block"], pos=pdf["pos"])[["block", "pos", *[f"v{j}" for j in range(width)]]]

    shape = "block int, pos int, " + ", ".join(f"v{j} double" for j in range(width))
    basis = orthonormal(materialize(people.select("block", "pos").mapInPandas(start, shape), "start"), width)
    names, before = [f"v{j}" for j in range(width)], None
    for _ in range(rounds):
        loads = materialize(times(tiles, scale, as_matrix(basis, "block", names), "block", width), "loads")
        values, vectors = np.linalg.eigh(gram(loads, width))  # the squared matrix seen from the basis
        values, vectors = values[::-1], vectors[:, ::-1]
        if before is not None and (width == most or np.abs(values[:n] - before[:n]).max() <= tolerance * values[0]):
            break
        before = values
        basis = orthonormal(materialize(times(tiles, scale, as_matrix(loads, "chunk", names), "chunk", width), "basis"), width)
    scores = materialize(rotated(basis, vectors[:, :n] * np.sqrt(np.maximum(values[:n], 0))), "components")
    signs = scores.agg(*[F.max_by(F.signum(f"v{j}"), F.struct(F.round(F.abs(F.col(f"v{j}")), 9), -F.col("block"), -F.col("pos"))) for j in range(n)]).first()
    named = scores.join(people, ["block", "pos"]).select("ind_id", *[(F.col(f"v{j}") * float(s or 1.0)).alias(f"pc{j + 1}") for j, s in enumerate(signs)])
    return named, [float(v) / n_people for v in values[:n]]
