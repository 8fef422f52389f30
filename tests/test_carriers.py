"""Carriers by gaps of their ids."""

import numpy as np

from snpweave.operators import blocks


def test_gaps_f25():
    for ids in ([5], [0, 1, 2], [3, 258, 259], [-7, 0, 70_000], [0, 1 << 33, (1 << 62) + 1], list(range(0, 100_000, 3))):
        data = blocks.as_gaps(np.array(ids, np.int64))
        assert blocks.from_gaps(data).tolist() == ids
    assert len(data) < 2 * len(ids)


def test_carriers_f25(spark, monkeypatch):
    """Dosages of 0 at any place leave, also at the first one and in sets of one; missing calls and phenotypes leave."""
    monkeypatch.setattr(blocks, "BLOCK", 8)
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, (50, 3))
    calls = [(s, i * 1000, int(g[i, s])) for i in range(50) for s in range(3) if (i, s) != (4, 1)]
    people = [(i * 1000, None if i == 7 else i % 2) for i in range(50)]
    sets = spark.createDataFrame([(0, [0]), (1, [0, 1]), (2, [0, 1, 2]), (3, [2, 1])], "set_id long, snps array<int>")
    found = blocks.carriers(sets, spark.createDataFrame(calls, "snp_id int, ind_id long, g int"), spark.createDataFrame(people, "ind_id long, y int"), "y")
    got = {(r.set_id, r.y): r.ind_ids for r in found.collect()}
    want = {}
    for k, s in ((0, [0]), (1, [0, 1]), (2, [0, 1, 2]), (3, [2, 1])):
        for i in range(50):
            if i != 7 and all(g[i, v] > 0 for v in s) and not (i == 4 and 1 in s):
                want.setdefault((k, i % 2), []).append(i * 1000)
    assert got == want
