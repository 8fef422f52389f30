"""Score traces as streams: the improvements of every search in order of event time, whatever order rows arrive in."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(out: list[tuple]) -> pd.DataFrame:
    names, times, scores = zip(*out, strict=True) if out else ((), (), ())
    return pd.DataFrame({"search": pd.Series(names, dtype=object), "at": pd.Series(times, dtype="int64"), "score": pd.Series(scores, dtype=float)})


def _millis(at: int) -> int:
    """The first millisecond not before the moment: timers and watermarks know no microseconds."""
    return -(-at // 1000)


class BestSoFar(StatefulProcessor):
    """State of a search: the best score behind the watermark, and in front of it the moments (microseconds) that improve on
    it and on all earlier ones so far. A moment is settled by its timer once the watermark has passed it, since no earlier
    row can come any more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "score double")
        self.open = handle.getMapState("open", "at long", "score double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = self.best.get()[0] if self.best.exists() else math.inf
        before = {k[0]: v[0] for k, v in self.open.iterator()}
        steps = pd.Series(before, dtype=float)
        for batch in rows:
            lowest = pd.concat([steps, batch.set_index("at")["score"]]).groupby(level=0).min()
            steps = lowest[lowest < lowest.cummin().shift(fill_value=math.inf).clip(upper=best)]
        after = dict(zip(steps.index.tolist(), steps.tolist(), strict=True))
        for at in before.keys() - after.keys():
            self.open.removeKey((at,))
        for at, score in after.items():
            if at not in before:
                self.handle.registerTimer(_millis(at))
            if before.get(at) != score:
                self.open.updateValue((at,), (score,))
        yield _rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        out = sorted((k[0], v[0]) for k, v in self.open.iterator() if _millis(k[0]) <= passed)
        for at, _ in out:
            self.open.removeKey((at,))
        if out:
            self.best.update((out[-1][1],))  # every step is lower than the one before
        yield _rows([(key[0], at, score) for at, score in out])

    def close(self) -> None:
        pass


def improvements(trace: DataFrame, search: str, time: str, score: str, late: str) -> DataFrame:
    """A stream of search, time, score: a row wherever a search's score falls below all earlier ones, as
    `sets.best_so_far` gives them for a finished trace, once the watermark (`late` behind the newest row) has passed it.

    Rows of one moment count as its lowest score. Rows behind the watermark are dropped. Rows without a time or score are
    ignored; a null search is a search of its own. State is keyed by search, and holds only moments in front of the watermark.
    All rows of
    a search in a micro-batch meet in one task, an Arrow batch at a time. The session's state store must be RocksDB
    (`STATE_STORE`)."""
    rows = trace.select(F.col(search).alias("search"), F.col(time).cast("timestamp").alias("time"), F.col(score).cast("double").alias("score"))
    rows = rows.where("time IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)").withWatermark("time", late)
    rows = rows.withColumn("at", F.unix_micros("time"))
    kind = rows.schema["search"].dataType.simpleString()
    steps = rows.groupBy("search").transformWithStateInPandas(statefulProcessor=BestSoFar(), outputStructType=f"search {kind}, at long, score double", outputMode="Append", timeMode="EventTime")
    return steps.select("search", F.timestamp_micros("at").alias("time"), "score")


def follow(trace: DataFrame, path: str, checkpoint: str, search: str, time: str, score: str, late: str) -> None:
    """Appends the improvements of all rows that are there now to a Parquet table; the next call with the same checkpoint goes
    on where this one ended, also after a failure."""
    spark = trace.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)  # read when the query starts
    try:
        started = improvements(trace, search, time, score, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        started.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
