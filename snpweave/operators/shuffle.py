"""Shuffled phenotypes as a control: a seeded bijection of row numbers, so that a shuffle is one join and no sort.

n numbers are laid out as cells (l, r) of a grid of a columns and b rows, a the ceiling of the root of n and b the least number of
rows that holds them. Four rounds of a Feistel network change l by a mix of r and r by a mix of l, each an addition modulo
the side, so that every round can be undone. A number that lands on one of the fewer than a cells beyond n walks on until it
lands below n, which again is a bijection.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snpweave import shared

ROUNDS = 4
# fixed values of the mix: odd multipliers below 2^31, and the modulus that keeps products within a long
MIX1, MIX2, MODULUS = 1540483477, 668265263, 1 << 31
MOST_STEPS = 64


def round_keys(seed: int) -> list[int]:
    """One key a round, below 2^31, from the seed."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:4], "little") % MODULUS for k in range(ROUNDS)]


def sides(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def _mix(v: Column, key: int) -> Column:
    """A number below 2^31 from one below 2^31 (sides are roots of row counts) and a key."""
    x = F.pmod(v * F.lit(MIX1) + F.lit(key), F.lit(MODULUS))
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = F.pmod(x * F.lit(MIX2), F.lit(MODULUS))
    return x.bitwiseXOR(F.shiftright(x, 13))


def permuted(number: Column, n: int, seed: int) -> Column:
    """The number that a number from 0 to n - 1 goes to. All of 0 .. n - 1 are hit once."""
    a, b = sides(n)
    keys = round_keys(seed)
    cell = lambda l, r: F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))

    def round_of(i: int, key: int):
        if i % 2 == 0:
            return lambda x: cell(F.pmod(x["l"] + _mix(x["r"], key), F.lit(a)), x["r"])
        return lambda x: cell(x["l"], F.pmod(x["r"] + _mix(x["l"], key), F.lit(b)))

    def turn(c: Column) -> Column:
        for i, key in enumerate(keys):
            c = F.transform(F.array(c), round_of(i, key))[0]  # an array of one, so that a round's cell is computed once
        return c

    place = lambda c: c["l"] + F.lit(a) * c["r"]
    start = number.cast("long")
    first = turn(cell(F.pmod(start, F.lit(a)), (start - F.pmod(start, F.lit(a))) / a))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_STEPS)), first, lambda c, k: F.when(place(c) < n, c).otherwise(turn(c)))
    once = F.transform(F.array(walked), lambda c: F.when(place(c) < n, place(c)).otherwise(F.raise_error(F.lit("no number below n on the walk")).cast("long")))
    return once[0]


def shuffle_phenotypes(phenotypes: DataFrame, seed: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Individuals with the phenotypes (all columns but ind_id, or those named) of others: the i-th by ind_id takes the row
    of the permuted i-th. Rows of phenotypes stay together, so that every column keeps its values, also nulls, and
    the columns their relation. The other columns stay with the individual. Repeatable by seed, whatever the partitioning, where
    ind_id is unique; rows of equal or null ids are told apart by their values. An empty table stays empty."""
    columns = [c for c in phenotypes.columns if c != "ind_id"] if columns is None else columns
    ties = [c for c in phenotypes.columns if c != "ind_id"]
    placed, seen = shared.materialize_and_see(shared.in_order(phenotypes, "ind_id", ties, "__row"), "people", n=F.count(F.lit(1)))
    n = seen["n"]
    if n == 0:
        return phenotypes
    taken = placed.select(F.col("__row").alias("__from"), *columns)
    stay = placed.select("__row", *[c for c in phenotypes.columns if c not in columns]).withColumn("__from", permuted(F.col("__row"), n, seed))
    return stay.join(taken, "__from").select(*phenotypes.columns)
