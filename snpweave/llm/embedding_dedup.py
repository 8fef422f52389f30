"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors of one label are one class. Classes are scaled to unit length and rotated onto the principal axes
of all of them. Vectors linked at cosine t differ by at most sqrt(2 - 2t) on every axis, so cells of that width on
the two leading axes bound who can meet: a cell with itself and its neighbours. Cells with many vectors are dealt
into tiles of a bounded size; each pair of tiles is one task's work. There the products over the leading axes are
added up first; a pair stays only while that sum plus the product of both suffix norms can reach t. Pairs left at
the end are decided on the given vectors in double precision. A task returns link counts and a spanning forest, not
its pairs.

Vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, link with
nothing. Vectors of different lengths are never compared. Null ids are kept (never `kept`, unless alone); repeated
rows are copies of each other. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snpweave.llm.common import array_parts, components, digest128, materialize, summed_arrays

TILE = 1024
SLACK = 1e-9


def _digests(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, d1, d2 (null where the vector can't be compared) and the vector as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, v in zip(batch.column(1), batch.column(2), strict=True):
                x = v.values
                if not label.is_valid or not v.is_valid or len(x) == 0 or x.null_count:
                    out.append((None, None, None, None))
                    continue
                x = x.to_numpy().astype("<f8") + 0.0
                norm = np.linalg.norm(x)
                if not np.isfinite(norm):  # large but finite components
                    norm = np.abs(x).max()
                ok = np.isfinite(x).all() and norm > 0
                out.append((len(x), *digest128(x), x.tobytes()) if ok else (None, None, None, None))
            c = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.binary())], names=["vec_id", "label", "dim", "d1", "d2", "vector"])

    return vectors.mapInArrow(run, "vec_id long, label long, dim int, d1 long, d2 long, vector binary")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow or underflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by vector length: sums of outer products from every task, added up on the executors by blocks."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            raw = batch.column(1).to_pylist()
            for dim in np.unique(dims).tolist():
                x = unit(np.frombuffer(b"".join(raw[k] for k in np.flatnonzero(dims == dim)), "<f8").reshape(-1, dim))
                sums[dim] = sums.get(dim, 0) + x.T @ x
        yield from array_parts({d: s.reshape(-1) for d, s in sums.items()})

    found = summed_arrays(classes.select("dim", "vector"), gram, "<f8")
    return {d: np.linalg.eigh(s.reshape(d, d))[1][:, ::-1].copy() for d, s in found.items()}


def _rotated(classes: DataFrame, axes: dict[int, np.ndarray], width: float) -> DataFrame:
    """Cells on the two leading axes, and the rotated unit vector."""
    shared = classes.sparkSession.sparkContext.broadcast(axes)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for dim, part in pdf.groupby("dim"):
                y = unit(np.frombuffer(b"".join(part["vector"]), "<f8").reshape(-1, dim)) @ shared.value[dim]
                yield pd.DataFrame({"cid": part["cid"].to_numpy(), "label": part["label"].to_numpy(), "dim": dim, "copies": part["copies"].to_numpy(), "c0": np.floor(y[:, 0] / width).astype(np.int32), "c1": np.floor(y[:, min(1, dim - 1)] / width).astype(np.int32), "rotated": [r.tobytes() for r in y], "vector": part["vector"].to_numpy()})

    return classes.select("cid", "label", "dim", "copies", "vector").mapInPandas(run, "cid long, label long, dim int, copies long, c0 int, c1 int, rotated binary, vector binary")


def close_pairs(a: np.ndarray, b: np.ndarray, least: float, steps: tuple[int, ...] = (4, 12, 24, 48)) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose product may reach `least`: leading columns first, the rest bounded by suffix norms."""
    dim = a.shape[1]
    at = [s for s in steps if s < dim] + [dim]
    tail = lambda x, k: np.sqrt(np.maximum((x[:, k:] ** 2).sum(axis=1), 0))
    total = a[:, : at[0]] @ b[:, : at[0]].T
    i, j = np.nonzero(total + np.outer(tail(a, at[0]), tail(b, at[0])) >= least)
    total = total[i, j]
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if len(i) == 0:
            break
        ta, tb = tail(a, hi), tail(b, hi)
        keep_i, keep_j, keep_t = [], [], []
        for s in range(0, len(i), 200_000):
            x, y = i[s : s + 200_000], j[s : s + 200_000]
            t = total[s : s + 200_000] + np.einsum("ij,ij->i", a[x, lo:hi], b[y, lo:hi])
            ok = t + ta[x] * tb[y] >= least
            keep_i.append(x[ok])
            keep_j.append(y[ok])
            keep_t.append(t[ok])
        i, j, total = np.concatenate(keep_i), np.concatenate(keep_j), np.concatenate(keep_t)
    return i, j


def _tile_links(tiles: DataFrame, threshold: float) -> DataFrame:
    """Per pair of tiles: (cid, links, root): copies linked across the pair and a vertex of the same component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] <= 1], pdf[pdf["side"] >= 1]
        left, right = left.sort_values("cid"), right.sort_values("cid")
        none = pd.DataFrame({"cid": [], "links": [], "root": []}).astype("int64")
        if left.empty or right.empty:
            return none
        dim = int(pdf["dim"].iloc[0])
        load = lambda x, c: np.frombuffer(b"".join(x[c]), "<f8").reshape(-1, dim)
        i, j = close_pairs(load(left, "rotated"), load(right, "rotated"), threshold - SLACK)
        lid, rid = left["cid"].to_numpy(), right["cid"].to_numpy()
        same = bool((pdf["side"] == 1).any())
        if same:
            i, j = i[lid[i] < rid[j]], j[lid[i] < rid[j]]
        x, y = unit(load(left, "vector")), unit(load(right, "vector"))
        ok = np.concatenate([np.einsum("ij,ij->i", x[i[s : s + 200_000]], y[j[s : s + 200_000]]) >= threshold for s in range(0, len(i), 200_000)] or [np.zeros(0, bool)])
        i, j = i[ok], j[ok]
        if len(i) == 0:
            return none
        ids, code = np.unique(np.concatenate((lid[i], rid[j])), return_inverse=True)
        a, b = code[: len(i)], code[len(i) :]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, right["copies"].to_numpy()[j])
        np.add.at(links, b, left["copies"].to_numpy()[i])
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({"cid": ids, "links": links, "root": ids[root]})

    return tiles.groupBy("label", "dim", "left", "right").applyInPandas(run, "cid long, links long, root long")


def embedding_components(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = _digests(rows)
    heads = materialize(rows, "vectors")
    classes = heads.where("d1 IS NOT NULL").groupBy("label", "d1", "d2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    width = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    placed = materialize(_rotated(classes, _axes(classes), width), "rotated")
    cells = placed.groupBy("label", "dim", "c0", "c1").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = cells.select("label", "dim", "c0", "c1", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # each pair of tiles once: later cells of the same label within one step on both axes, or later parts of the cell
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])).alias("s")
    near = tiles.select("*", steps).select("label", "dim", F.col("c0").alias("l0"), F.col("c1").alias("l1"), F.col("part").alias("lp"), (F.col("c0") + F.col("s.a")).alias("c0"), (F.col("c1") + F.col("s.b")).alias("c1"))
    near = near.join(tiles, ["label", "dim", "c0", "c1"]).where("l0 <> c0 OR l1 <> c1 OR lp <= part")
    name = lambda a, b, p: F.concat_ws(",", a, b, p)
    near = near.select("label", "dim", name("l0", "l1", "lp").alias("left"), name("c0", "c1", "part").alias("right"))
    sides = F.when(F.col("left") == F.col("right"), F.array(F.struct(F.col("left").alias("tile"), F.lit(1).alias("side")))).otherwise(F.array(F.struct(F.col("left").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("right").alias("tile"), F.lit(2).alias("side"))))
    uses = near.select("label", "dim", "left", "right", F.explode(sides).alias("u")).select("label", "dim", "left", "right", "u.tile", "u.side")
    dealt = placed.join(cells, ["label", "dim", "c0", "c1"]).withColumn("tile", name("c0", "c1", F.pmod(F.xxhash64("cid"), F.col("parts"))))
    found = materialize(_tile_links(dealt.select("label", "dim", "tile", "cid", "copies", "rotated", "vector").join(uses, ["label", "dim", "tile"]), threshold), "found")

    whole = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    member = classes.drop("vector").join(counts, "cid", "left").join(whole.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    names = member.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    member = member.join(names, "component").select("label", "d1", "d2", "copies", F.coalesce("links", F.lit(0)).alias("links"), "component_id")
    out = heads.select("vec_id", "label", "d1", "d2").join(member, ["label", "d1", "d2"], "left")
    component = F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.col("copies").isNull()).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
r AS (SELECT a AS id, a AS reach FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
m AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS n_links FROM e GROUP BY a)
SELECT t.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(m.component_id, t.vec_id) AS component_id,
  t.vec_id = coalesce(m.component_id, t.vec_id) AS kept
FROM embeddings t LEFT JOIN m ON m.id = t.vec_id LEFT JOIN n ON n.id = t.vec_id
"""
