import numpy as np

from snpweave.llm.embedding_dedup import close_pairs, embedding_components

from .conftest import smallest_reachable


def test_embedding_components(spark):
    r = np.random.default_rng(3)
    centre = r.normal(size=(12, 16))
    rows = []
    for i in range(300):
        x = (centre[i % 12] + r.normal(size=16) * (0.05 if i % 2 else 0.12)).astype(np.float32)
        rows.append((i, [float(v) for v in x], i % 3))
    rows += [(300 + k, rows[5][1], rows[5][2]) for k in range(40)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] * 16, 1), (404, rows[1][1], None), (405, [None] * 16, 1), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "vec_id long, embedding array<float>, label int, copies string")
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    links = [(a, b) for n, (a, x, p) in enumerate(ok) for b, y, q in ok[n + 1 :] if p == q and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98]
    want = smallest_reachable([x[0] for x in rows], links)
    count = {i: 0 for i, *_ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    for tile in (1024, 16):
        got = embedding_components(df, tile=tile).collect()
        assert len(got) == len(rows)
        for g in got:
            assert (g.n_links, g.component_id, g.kept) == (count[g.vec_id], want[g.vec_id], want[g.vec_id] == g.vec_id)
    assert embedding_components(df.limit(0)).count() == 0


def test_bounds_lose_no_pair():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 30))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = close_pairs(x, x, 0.3)
    assert {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.3 + 1e-9), strict=True)} <= set(zip(i, j, strict=True))
