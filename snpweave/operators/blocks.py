"""Counts of joint genotypes by blocks of individuals and chunks of sets.

Individuals are dealt into blocks of about BLOCK, and each marker's dosages in a block become one row of small arrays. Sets
are dealt into chunks of about CHUNK; a task gets one chunk, one block and the rows of the markers that the chunk's sets
name, counts every set's cells in whole-array steps, and sends a few rows a set. So neither sets times individuals nor the
matrix ever stands in one place: what moves is the named markers' dosages once a chunk, a byte or two a call, and at most
3^k rows a set and block.

An individual with a missing call (null, or no row) at any SNP of a set is in none of the set's cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, CHUNK = 2048, 1024
MISSING = 3


def _people(phenotypes: DataFrame, y: str) -> DataFrame:
    """block, pos (number inside the block), ind_id, y as double."""
    blocks = max(1, -(-phenotypes.count() // BLOCK))
    dealt = phenotypes.select("ind_id", F.col(y).cast("double").alias("y"), F.pmod(F.xxhash64("ind_id"), F.lit(blocks)).cast("int").alias("block"))
    return dealt.withColumn("pos", F.row_number().over(Window.partitionBy("block").orderBy("ind_id")) - 1)


def _by_chunk_and_block(sets: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, y: str) -> DataFrame:
    """Rows of every (chunk, block): kind 0: a marker's dosages; kind 1: the chunk's sets; kind 2: the block's phenotype."""
    people = _people(phenotypes, y)
    chunks = max(1, -(-sets.count() // CHUNK))
    dealt = sets.select("set_id", "snps", F.pmod(F.xxhash64("set_id"), F.lit(chunks)).cast("int").alias("chunk"))
    calls = genotypes.where("g IS NOT NULL").select("snp_id", "ind_id", F.col("g").cast("tinyint").alias("g")).join(people.select("ind_id", "block", F.col("pos").cast("smallint").alias("pos")), "ind_id")
    packed = calls.groupBy("snp_id", "block").agg(F.collect_list("pos").alias("pos"), F.collect_list("g").alias("g"))
    needed = dealt.select("chunk", F.explode("snps").alias("snp_id")).distinct()
    ids, values, people_ids = F.lit(None).cast("array<struct<set_id:bigint,snps:array<int>>>"), F.lit(None).cast("array<double>"), F.lit(None).cast("array<bigint>").alias("ind_ids")
    dosages = needed.join(packed, "snp_id").select("chunk", "block", F.lit(0).alias("kind"), F.col("snp_id").cast("long").alias("snp_id"), "pos", "g", ids.alias("sets"), values.alias("y"), people_ids)
    no = [F.lit(None).cast("long").alias("snp_id"), F.lit(None).cast("array<smallint>").alias("pos"), F.lit(None).cast("array<tinyint>").alias("g")]
    whole = dealt.groupBy("chunk").agg(F.collect_list(F.struct(F.col("set_id").cast("long").alias("set_id"), F.col("snps").cast("array<int>").alias("snps"))).alias("sets"))
    rows = people.select("block", "pos", "y", F.col("ind_id").cast("long").alias("ind_id"))
    blocks = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "y", "ind_id"))).alias("p")).select("block", F.col("p.y").alias("y"), F.col("p.ind_id").alias("ind_ids"))
    # a chunk's sets go to every block and a block's phenotype to every chunk: a few bytes a set and a person each
    asked = whole.crossJoin(blocks.select("block")).select("chunk", "block", F.lit(1).alias("kind"), *no, "sets", values.alias("y"), people_ids)
    own = blocks.crossJoin(whole.select("chunk")).select("chunk", "block", F.lit(2).alias("kind"), *no, ids.alias("sets"), "y", "ind_ids")
    return dosages.unionAll(asked).unionAll(own)


def _counted(rows: DataFrame, one: Callable[[np.ndarray, np.ndarray, np.ndarray], dict], schema: str, absent: int = MISSING, first: int = 0) -> DataFrame:
    """What `one` (cell numbers, phenotypes and ids of the individuals without a missing call) gives for every set and
    block. absent: the dosage of calls without a row. first: a digit before those of the SNPs."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["kind"].to_numpy()
        own = int(np.flatnonzero(kind == 2)[0])
        y, ids = np.array([np.nan if v is None else v for v in pdf["y"].iloc[own]], float), np.asarray(pdf["ind_ids"].iloc[own])
        rows: dict[int, np.ndarray] = {}
        for k in np.flatnonzero(kind == 0):
            g = np.full(len(y), absent, np.int64)
            g[np.asarray(pdf["pos"].iloc[k])] = np.asarray(pdf["g"].iloc[k])
            rows[int(pdf["snp_id"].iloc[k])] = g
        known = ~np.isnan(y)
        nothing = None if absent == MISSING else np.full(len(y), absent, np.int64)
        out: list[dict[str, np.ndarray]] = []
        for s in pdf["sets"].iloc[int(np.flatnonzero(kind == 1)[0])] if (kind == 1).any() else []:
            calls = [rows.get(int(v), nothing) for v in s["snps"]]
            if any(c is None for c in calls):
                continue
            gid, ok = np.full(len(y), first, np.int64), known.copy()
            for c in calls:
                gid = gid * 3 + c
                ok &= c != MISSING
            found = one(gid[ok], y[ok], ids[ok])
            out.append({"set_id": np.full(len(found["gid"]), s["set_id"], np.int64), **found})
        if not out:
            return pd.DataFrame({n: [] for n in names})
        return pd.DataFrame({n: np.concatenate([o[n] for o in out]) if not isinstance(out[0][n], list) else [v for o in out for v in o[n]] for n in names})

    return rows.groupBy("chunk", "block").applyInPandas(run, schema)


def category_cells(sets: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, y: str, absent: int = MISSING) -> DataFrame:
    """set_id, gid, y, n: individuals by joint genotype and category. absent: the dosage of calls without a row, so that a table
    may leave the dosage 0 out."""

    def one(gid: np.ndarray, y: np.ndarray, _: np.ndarray) -> dict[str, np.ndarray]:
        codes, at = np.unique(y, return_inverse=True)
        found, n = np.unique(gid * max(len(codes), 1) + at, return_counts=True)
        return {"gid": found // max(len(codes), 1), "y": codes[found % max(len(codes), 1)].astype(np.int64), "n": n}

    kind = phenotypes.schema[y].dataType
    parts = _counted(_by_chunk_and_block(sets, genotypes, phenotypes, y), one, "set_id long, gid long, y long, n long", absent)
    return parts.groupBy("set_id", "gid", F.col("y").cast(kind).alias("y")).agg(F.sum("n").alias("n"))


def value_cells(sets: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, y: str) -> DataFrame:
    """set_id, gid, n, mean, var (population), low and high of a quantitative phenotype by joint genotype. Sums are taken
    about the mean of all, so that large values lose no digits."""
    centre = phenotypes.agg(F.avg(F.col(y).cast("double"))).first()[0] or 0.0

    def one(gid: np.ndarray, y: np.ndarray, _: np.ndarray) -> dict[str, np.ndarray]:
        order = np.argsort(gid, kind="stable")
        gid, v = gid[order], y[order]
        first = np.flatnonzero(np.append(True, gid[1:] != gid[:-1])) if len(gid) else np.zeros(0, np.int64)
        if len(first) == 0:
            return {k: np.zeros(0) for k in ("gid", "n", "s1", "s2", "low", "high")}
        add = lambda x: np.add.reduceat(x, first)
        return {"gid": gid[first], "n": np.diff(np.append(first, len(gid))), "s1": add(v - centre), "s2": add((v - centre) ** 2), "low": np.minimum.reduceat(v, first), "high": np.maximum.reduceat(v, first)}

    parts = _counted(_by_chunk_and_block(sets, genotypes, phenotypes, y), one, "set_id long, gid long, n long, s1 double, s2 double, low double, high double")
    out = parts.groupBy("set_id", "gid").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")], F.min("low").alias("low"), F.max("high").alias("high"))
    shift = F.col("s1") / F.col("n")
    return out.select("set_id", "gid", "n", (F.lit(centre) + shift).alias("mean"), F.greatest(F.col("s2") / F.col("n") - shift * shift, F.lit(0.0)).alias("var"), "low", "high")


def decimal_cells(sets: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, y: str, digits: int) -> DataFrame:
    """set_id, gid, n, s1, s2 of a phenotype with at most `digits` decimals: sums and sums of squares in units of its last
    decimal, as whole numbers, so that no order of adding changes them. Values below 2**31 units."""
    unit = 10**digits

    def one(gid: np.ndarray, y: np.ndarray, _: np.ndarray) -> dict[str, np.ndarray]:
        order = np.argsort(gid, kind="stable")
        gid, v = gid[order], np.rint(y[order] * unit).astype(np.int64)
        if not len(gid):
            return {k: np.zeros(0, np.int64) for k in ("gid", "n", "s1", "s2")}
        first = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
        # squares by halves of 2**16, as a block's sum of squares may pass 2**63
        low, high = np.add.reduceat(v * v & 0xFFFF, first), np.add.reduceat(v * v >> 16, first)
        s2 = [(int(h) << 16) + int(l) for h, l in zip(high, low, strict=True)]
        return {"gid": gid[first], "n": np.diff(np.append(first, len(gid))), "s1": np.add.reduceat(v, first), "s2": [str(x) for x in s2]}

    parts = _counted(_by_chunk_and_block(sets, genotypes, phenotypes, y), one, "set_id long, gid long, n long, s1 long, s2 string")
    return parts.groupBy("set_id", "gid").agg(F.sum("n").alias("n"), F.sum(F.col("s1").cast("decimal(28,0)")).alias("s1"), F.sum(F.col("s2").cast("decimal(28,0)")).alias("s2"))


def carriers(sets: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, y: str) -> DataFrame:
    """set_id, y, ind_ids: individuals with a non-zero dosage at every SNP of the set, ascending, by category. Ids go from the
    blocks to their set as gaps, a byte or two each, and are ids again where a set's blocks have met."""
    kind = phenotypes.schema[y].dataType

    def one(gid: np.ndarray, y: np.ndarray, ids: np.ndarray) -> dict:
        rest, all_of = gid.copy(), np.ones(len(gid), bool)
        while (rest > 0).any():  # digits in base 3 behind a first one, so that a SNP without the allele is a 0 among them
            all_of &= (rest % 3 > 0) | (rest == 0)
            rest //= 3
        return _by_category(y[all_of], ids[all_of])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.sort(np.concatenate([from_gaps(b) for b in batch.column(2)[i].as_py()]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int64()))], names=["set_id", "y", "ind_ids"])

    parts = _counted(_by_chunk_and_block(sets, genotypes, phenotypes, y), one, "set_id long, gid long, y long, ids binary", first=1)
    met = parts.groupBy("set_id", "y").agg(F.collect_list("ids").alias("ids")).mapInArrow(unpack, "set_id long, y long, ind_ids array<long>")
    return met.select("set_id", F.col("y").cast(kind).alias("y"), "ind_ids")


def as_gaps(ids: np.ndarray) -> bytes:
    """Ascending ids as a byte of width, the first one and the gaps in as few bytes each as the largest needs."""
    gaps = np.diff(ids).astype(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if not len(gaps) or w == 8 or int(gaps.max()) < 1 << 8 * w)
    return bytes([width]) + ids[:1].astype("<i8").tobytes() + gaps.astype(f"<u{width}").tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, f"<u{data[0]}", offset=9).astype(np.int64)
    return np.cumsum(np.concatenate([np.frombuffer(data, "<i8", 1, 1), gaps]))


def _by_category(y: np.ndarray, ids: np.ndarray) -> dict:
    codes = np.unique(y)
    return {"gid": np.zeros(len(codes), np.int64), "y": codes.astype(np.int64), "ids": [as_gaps(np.sort(ids[y == c])) for c in codes]}
