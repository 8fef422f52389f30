"""What operators of all kinds share: scratch tables and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


# ---------------------------------------------------------------- scratch tables


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one only where none is set and all run on one machine, as in
    tests; on a cluster its files would be seen by one executor each."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-snpweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/snpweave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_and_see(df: DataFrame, name: str, **what: Column) -> tuple[DataFrame, dict]:
    """`materialize`, and aggregates of the rows that are taken while they are written, so that no job of its own is needed."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(k) for k, c in what.items()]), name)
    return out, seen.get


# ---------------------------------------------------------------- numbers in an order


def numbered(df: DataFrame, part: str, order: list[str], out: str) -> DataFrame:
    """Add `out`: the rows' numbers from 0, by part and then by `order`. Rows are numbered inside each part, and the parts'
    sizes (few rows) are added up in order."""
    here = df.withColumn("__in", F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    sizes = df.groupBy(part).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(part).alias("__part"), before.cast("long").alias("__before"))
    return here.join(starts, F.col(part).eqNullSafe(F.col("__part"))).withColumn(out, F.col("__in") + F.col("__before")).drop("__in", "__part", "__before")


def in_order(df: DataFrame, value: str, ties: list[str], out: str, parts: int = 64) -> DataFrame:
    """`numbered` by a number and then by `ties`, in ranges of the number with about equally many rows; nulls come first."""
    df = materialize(df, "ordered")
    edges = df.approxQuantile(value, [k / parts for k in range(1, parts)], 0.25 / parts)
    part = F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges))]).cast("array<double>"), lambda e: e < F.col(value).cast("double")))
    ranged = df.withColumn("__range", F.when(F.col(value).isNull(), -1).otherwise(part))
    return numbered(ranged, "__range", [value, *ties], out).drop("__range")


def line_numbers(lines: DataFrame, out: str) -> DataFrame:
    """Add `out`: numbers from 0 in the order in which Spark reads the rows of a file."""
    at = lines.withColumn("__line", F.monotonically_increasing_id())
    return numbered(at.withColumn("__file_part", F.shiftright("__line", 33)), "__file_part", ["__line"], out).drop("__line", "__file_part")


# ---------------------------------------------------------------- connected components


def local_forest(edges: DataFrame) -> DataFrame:
    """Per task, replace blocks of the links (a, b) by a forest with the same components: fewer, flatter links."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent: dict[int, int] = {}

            def find(x: int) -> int:
                root = x
                while parent.setdefault(root, root) != root:
                    root = parent[root]
                while parent[x] != root:
                    parent[x], x = root, parent[x]
                return root

            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
            rows = [(x, find(x)) for x in parent if find(x) != x]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(reduce, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in the links (a, b): component is the smallest id reachable.

    Alternates large and small stars; each is one aggregation and one join, so no node's links meet in
    one task, and every round is a table in the shared folder. Null ends and loops are ignored.
    """
    flat = local_forest(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b"))
    now = materialize(flat.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        whole = lambda c: F.sum(c.cast("decimal(38,0)"))
        now, sums = materialize_and_see(small, "links", n=F.count(F.lit(1)), a=whole(F.col("a")), b=whole(F.col("b")), h=whole(F.xxhash64("a", "b")))
        if sums == before:
            break
        before = sums
    tops = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionAll(tops)


def running_total_in(df: DataFrame, value: str, group: list[str], chunk: str, order: list, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the rows before this one in its group, by chunk and then by `order`. Each chunk of a
    group is summed on its own and the chunks' totals are added up, so that a group that holds most rows is still summed by
    many tasks. Group and chunk columns hold no nulls."""
    keys = [*group, chunk]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    before = totals.select(*keys, F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    here = df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return here.join(before, keys).withColumn(out, F.col("__inside") + F.col("__before")).drop("__inside", "__before")
