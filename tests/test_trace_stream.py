"""The trace stream against running minima over finished traces: any order of rows, late rows, restarts."""

import random
from datetime import datetime, timedelta

from snpweave.streaming import trace

START = datetime(2024, 1, 1)
SCHEMA = "search string, time timestamp, score double, other int"


def running(rows, until):
    """search -> [(time, score)] where the minimum improves, up to a moment."""
    out, best = set(), {}
    for s, t, v, _ in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[1], r[2])):
        if t <= until and v < best.get(s, float("inf")):
            best[s] = v
            out.add((s, t, v))
    return out


def step(spark, rows, folder, n):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(folder / "in"))
    trace.follow(stream, str(folder / "out"), str(folder / "checkpoint"), "search", "time", "score", "10 minutes")
    found = [tuple(r) for r in spark.read.parquet(str(folder / "out")).collect()]
    assert len(found) == len(set(found)), n
    return set(found)


def some_rows(r, since, minutes, n):
    return [(f"s{r.randrange(3)}", since + timedelta(microseconds=r.randrange(minutes * 60 * 10**6)), round(r.uniform(0, 100), 1), i) for i in range(n)]


def test_order_restart_and_late_rows(spark, tmp_path):
    r = random.Random(1)
    first = some_rows(r, START, 60, 200)
    first += [first[0], ("s1", START, None, 0), ("s2", None, 0.5, 0), (None, START + timedelta(minutes=5), 4.0, 0), ("s0", first[0][1], first[0][2] - 1, 0)]
    newest = max(x[1] for x in first if x[1])
    cut = lambda t: (t - timedelta(minutes=10)).replace(microsecond=(t.microsecond // 1000) * 1000)
    assert step(spark, first, tmp_path, 1) == {x for x in running(first, cut(newest))}

    # a restart from the checkpoint: rows in front of the watermark count in their places, rows behind it are dropped
    fresh = some_rows(r, cut(newest) + timedelta(seconds=1), 90, 200) + [("s0", newest - timedelta(minutes=9), 0.25, 0)]
    late = [("s1", START + timedelta(minutes=1), 0.01, 0), ("s9", START, 1.0, 0)]
    last = max(x[1] for x in fresh)
    got = step(spark, fresh + late, tmp_path, 2)
    assert got == running(first + fresh, cut(last))
    assert ("s0", newest - timedelta(minutes=9), 0.25) in got and not any(x[2] == 0.01 or x[0] == "s9" for x in got)

    # nothing new: nothing is written twice
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    trace.follow(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "search", "time", "score", "10 minutes")
    assert {tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()} == got


def test_empty(spark, tmp_path):
    assert step(spark, [], tmp_path, 1) == set()
