"""Comparison of scoring models: likeness of their score vectors from one Gram matrix, and the one-sample t-test of a known
set's score against those of random sets.

Scores are (set_id, model, value). Models are few (a task holds a matrix of models by models); sets may be any number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snpweave.functions import stats


def similarity(scores: DataFrame, models: list[str]) -> DataFrame:
    """model, other, cosine: of all ordered pairs of models, over the sets that both score (null where there are none, or all
    of a model's scores there are 0). Null and not-a-number values count as not scored; of repeated rows of a set and model
    the least value counts.

    Sets become rows of an array per model; a batch of rows sends its products, one row a pair of models, which are summed.
    """
    good = scores.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")) & F.col("model").isin(models))
    each = [F.min(F.when(F.col("model") == m, F.col("value").cast("double"))) for m in models]
    rows = good.groupBy("set_id").agg(F.array(*each).alias("x")).select("x")
    m = len(models)
    first, second = (v.reshape(-1) for v in np.indices((m, m)))

    def products(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xy, xx = np.zeros((m, m)), np.zeros((m, m))
        for pdf in pdfs:
            if len(pdf):
                x = np.array(pdf["x"].tolist(), float).reshape(-1, m)
                here = ~np.isnan(x)
                x = np.where(here, x, 0.0)
                xy += x.T @ x
                xx += (x * x).T @ here
        yield pd.DataFrame({"i": first, "j": second, "xy": xy.reshape(-1), "xx": xx.reshape(-1), "yy": xx.T.reshape(-1)})

    total = rows.mapInPandas(products, "i int, j int, xy double, xx double, yy double").groupBy("i", "j").agg(F.sum("xy").alias("xy"), F.sum("xx").alias("xx"), F.sum("yy").alias("yy"))
    names = F.array(*[F.lit(v) for v in models])
    cosine = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / (F.sqrt("xx") * F.sqrt("yy")))
    return total.select(names[F.col("i")].alias("model"), names[F.col("j")].alias("other"), cosine.alias("cosine"))


def mean_similarity(similarities: DataFrame) -> DataFrame:
    """model, mean_cosine: the mean over the other models (null for one alone)."""
    return similarities.groupBy("model").agg(F.avg(F.when(F.col("model") != F.col("other"), F.col("cosine"))).alias("mean_cosine"))


def t_tests(scores: DataFrame, known: DataFrame) -> DataFrame:
    """model, n, t, p: the one-sample t-test of random sets' scores against the score of a known set, known(model, value,
    less_is_better). Where less is better, p is the chance of a mean that far above the known score, else below. t and p are
    null for fewer than two scores; without spread p is 1 where the mean agrees in that sense, else the smallest positive
    number, as in `stats.one_sample_t`."""
    per = scores.where("value IS NOT NULL").groupBy("model").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    both = per.join(known.withColumnRenamed("value", "own"), "model")
    gap = F.col("mean") - F.col("own")
    both = both.withColumn("t", F.when(F.col("sd") > 0, gap / (F.col("sd") / F.sqrt("n")))).withColumn("side", F.signum(gap))

    def tails(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            p = []
            for r in pdf.itertuples():
                sign = 1 if r.less_is_better else -1
                if r.n < 2:
                    p.append(None)
                else:
                    p.append((1.0 if sign * r.side <= 0 else stats.TINY) if pd.isna(r.t) else float(stats.t_sf(sign * r.t, r.n - 1)))
            yield pdf[["model", "n", "t"]].assign(p=pd.array(p, "Float64"))

    return both.select("model", "n", "t", "side", "less_is_better").mapInPandas(tails, "model string, n long, t double, p double")
