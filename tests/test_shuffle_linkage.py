"""Shuffled phenotypes are a bijection that keeps rows whole; linkage by bit planes equals numpy's correlation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snpweave.operators import linkage, shuffle


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 17, 100, 1000, 4097])
def test_numbers_are_permuted(spark, n):
    rows = lambda seed: [r[0] for r in spark.range(n).select(shuffle.permuted(F.col("id"), n, seed)).collect()]
    one = rows(1)
    assert sorted(one) == list(range(n)) and one == rows(1)
    if n >= 100:
        stays = sum(i == v for i, v in enumerate(one))
        assert stays < 10 and one != rows(2)
        assert abs(np.corrcoef(np.arange(n), one)[0, 1]) < 0.4


def test_numbers_beyond_two_to_the_32(spark):
    n = 5_000_000_000
    got = [r[0] for r in spark.range(n - 2000, n).select(shuffle.permuted(F.col("id"), n, 3)).collect()]
    assert len(set(got)) == 2000 and 0 <= min(got) and max(got) < n and np.mean(np.array(got) < n / 2) == pytest.approx(0.5, abs=0.05)


def test_phenotypes_are_shuffled(spark):
    rows = [(i * 3, i % 2, None if i % 7 == 0 else float(i), f"n{i}") for i in range(200)]
    people = spark.createDataFrame(rows, "ind_id long, y int, q double, name string")
    got = [tuple(r) for r in shuffle.shuffle_phenotypes(people.repartition(7), 5, ["y", "q"]).collect()]
    again = [tuple(r) for r in shuffle.shuffle_phenotypes(people, 5, ["y", "q"]).collect()]
    assert sorted(got) == sorted(again)
    assert sorted((r[0], r[3]) for r in got) == [(r[0], r[3]) for r in rows]
    assert sorted(((r[1], r[2]) for r in got), key=str) == sorted(((r[1], r[2]) for r in rows), key=str)
    assert sum(a[2] == b[2] for a, b in zip(sorted(got), rows)) < 20
    assert shuffle.shuffle_phenotypes(people.limit(0), 5).count() == 0
    odd = spark.createDataFrame([(None, 1), (None, 2), (4, 3), (4, 3)], "ind_id long, y int")
    got = shuffle.shuffle_phenotypes(odd).collect()
    assert sorted(r.y for r in got) == [1, 2, 3, 3] and sorted(str(r.ind_id) for r in got) == ["4", "4", "None", "None"]


def test_linkage_of_many_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(linkage, "TILE", 4)
    monkeypatch.setattr(linkage, "BLOCK", 128)
    r = np.random.default_rng(2)
    g = r.integers(0, 3, (11, 300)).astype(float)
    g[3] = np.where(r.random(300) < 0.8, g[2], g[3])
    g[r.random(g.shape) < 0.1] = np.nan
    g[7] = 1.0  # doesn't vary
    g[8, 128:] = np.nan  # one block alone
    g[9, :150], g[10, 150:] = np.nan, np.nan  # nobody has both
    calls = [(s, i, None if np.isnan(v) else int(v)) for s in range(11) for i, v in enumerate(g[s])]
    geno = spark.createDataFrame([*calls, (None, 1, 2), (2, None, 1)], "snp_id int, ind_id long, g int").repartition(3)
    pairs = [(a, b) for a in range(11) for b in range(11) if (a + b) % 3] + [(4, 4), (50, 1)]
    asked = spark.createDataFrame([*pairs, (1, 0), (None, 2)], "a int, b int")
    got = {(x.a, x.b): x.r2 for x in linkage.pairwise_ld(geno, asked).collect()}
    want = {}
    for a, b in set(pairs) - {(50, 1)}:
        both = ~np.isnan(g[a]) & ~np.isnan(g[b])
        if both.any():
            x, y = g[a, both], g[b, both]
            want[a, b] = None if x.std() == 0 or y.std() == 0 else np.corrcoef(x, y)[0, 1] ** 2
    assert set(got) == set(want) and (9, 10) not in got
    assert all((got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, abs=1e-12)) for k, v in want.items())
    assert linkage.pairwise_ld(geno, asked.limit(0)).count() == 0
