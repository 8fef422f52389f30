"""Linkage disequilibrium by bit planes: markers as bits of people, pairs in tiles, sums by population count.

A marker's calls in a block of BLOCK people are three rows of bits: called, dosage 1 or more, dosage 2. Markers stand in tiles
of TILE; a task takes two tiles, one block and the pairs asked for between them, and sends six whole numbers a pair. Pairs
times people stand nowhere, and a task holds at most 2 * TILE * 3 * BLOCK / 8 bytes of planes and TILE * TILE pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snpweave import shared

TILE = 64  # markers
BLOCK = 1 << 16  # people
PAIRS_AT_ONCE = 512
SUMS = ["n", "x", "y", "xx", "yy", "xy"]


def planes(genotypes: DataFrame) -> DataFrame:
    """snp_id, block, called, one, two: each marker's bits in each block of people (ids BLOCK * block and on), 64 to a long,
    as arrays of (word, called, one, two) rows. Missing dosages (null or outside 0 to 2) and null ids have no bit; of
    repeated calls bits are OR-ed, so the largest counts."""
    good = genotypes.where("g BETWEEN 0 AND 2 AND snp_id IS NOT NULL AND ind_id IS NOT NULL")
    bit = F.expr("shiftleft(1L, cast(pmod(ind_id, 64) AS int))")
    zero = F.lit(0).cast("long")
    words = good.groupBy("snp_id", F.floor(F.col("ind_id") / 64).cast("long").alias("word")).agg(
        F.bit_or(bit).alias("called"),
        F.bit_or(F.when(F.col("g") >= 1, bit).otherwise(zero)).alias("one"),
        F.bit_or(F.when(F.col("g") == 2, bit).otherwise(zero)).alias("two"),
    )
    per = BLOCK // 64
    block = F.floor(F.col("word") / per).cast("long")
    rows = words.groupBy("snp_id", block.alias("block")).agg(F.collect_list(F.struct(F.pmod("word", F.lit(per)).cast("int").alias("at"), "called", "one", "two")).alias("words"))
    pick = lambda f: F.transform("words", lambda w: w[f]).alias(f)
    return rows.select("snp_id", "block", pick("at"), pick("called"), pick("one"), pick("two"))


def _dense(rows: pd.DataFrame) -> np.ndarray:
    """Planes [plane, marker, word] of a tile's rows."""
    out = np.zeros((3, len(rows), BLOCK // 64), np.uint64)
    for i, row in enumerate(rows.itertuples()):
        for k, plane in enumerate((row.called, row.one, row.two)):
            out[k, i, row.at] = np.asarray(plane, np.int64).view(np.uint64)
    return out


def _pair_sums(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    names = rows["snp_id"].to_numpy()
    order = np.argsort(names)
    names = names[order]
    bits = _dense(rows.iloc[order])
    a, b = asked["a"].to_numpy(), asked["b"].to_numpy()
    here = np.isin(a, names) & np.isin(b, names)
    a, b = a[here], b[here]
    out = np.zeros((len(a), 6), np.int64)
    for at in range(0, len(a), PAIRS_AT_ONCE):
        now = slice(at, at + PAIRS_AT_ONCE)
        (pa, a1, a2), (pb, b1, b2) = bits[:, np.searchsorted(names, a[now])], bits[:, np.searchsorted(names, b[now])]
        count = lambda u, v: np.bitwise_count(u & v).sum(axis=1, dtype=np.int64)
        x1, x2, y1, y2 = count(a1, pb), count(a2, pb), count(b1, pa), count(b2, pa)
        xy = count(a1, b1) + count(a1, b2) + count(a2, b1) + count(a2, b2)
        out[now] = np.stack([count(pa, pb), x1 + x2, y1 + y2, x1 + 3 * x2, y1 + 3 * y2, xy], axis=1)
    return pd.DataFrame({"a": a, "b": b} | {s: out[:, i] for i, s in enumerate(SUMS)})


def pairwise_ld(genotypes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, r2: squared correlation of dosages over the people called at both markers, for each distinct pair (a, b). From
    whole numbers, so it doesn't depend on order. r2 is null where a marker does not vary among these people; pairs without
    such people, and pairs with nulls, have no row."""
    kind = genotypes.schema["snp_id"].dataType.simpleString()
    pairs = pairs.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    pairs = shared.materialize(pairs, "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("snp_id")).distinct()
    place = shared.numbered(named.withColumn("p", F.floor(F.col("snp_id") / TILE)), "p", ["snp_id"], "i").select("snp_id", F.floor(F.col("i") / TILE).cast("long").alias("tile"))
    place = shared.materialize(place, "tiles")
    bits = shared.materialize(planes(genotypes).join(place, "snp_id"), "planes")

    one, two = place.select(F.col("snp_id").alias("a"), F.col("tile").alias("ta")), place.select(F.col("snp_id").alias("b"), F.col("tile").alias("tb"))
    asked = shared.materialize(pairs.join(one, "a").join(two, "b").select("a", "b", F.least("ta", "tb").alias("t1"), F.greatest("ta", "tb").alias("t2")), "asked")
    tiles = asked.select("t1", "t2").distinct()
    wanted = tiles.select("t1", "t2", F.explode(F.array_distinct(F.array("t1", "t2"))).alias("tile"))
    left = bits.join(wanted, "tile").select("t1", "t2", "block", "snp_id", "at", "called", "one", "two")
    blocks = left.select("t1", "t2", "block").distinct()
    right = asked.join(blocks, ["t1", "t2"]).select(*[F.col(c).alias(c) for c in ("t1", "t2", "block", "a", "b")])  # columns of its own for the cogroup
    schema = f"a {kind}, b {kind}, " + ", ".join(f"{s} long" for s in SUMS)
    keys = ["t1", "t2", "block"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_pair_sums, schema)
    total = parts.groupBy("a", "b").agg(*[F.sum(s).cast("double").alias(s) for s in SUMS]).where("n > 0")
    spread = (F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("n") * F.col("yy") - F.col("y") * F.col("y"))
    cov = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    return total.select("a", "b", F.when(spread > 0, cov * cov / spread).alias("r2"))
