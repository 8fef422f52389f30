"""Genotype views derived from a star schema: individuals are customers, markers are brands or part numbers, dosages
count their line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snpweave import shared


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ind_id, y2 (balance of 4500 or more), y5 (market segment 0-4), yq (balance)."""
    c = _t(spark, sf_dir, "customer")
    segments = c.select("c_mktsegment").distinct().withColumn("y5", F.dense_rank().over(Window.orderBy("c_mktsegment")) - 1)
    c = c.join(F.broadcast(segments), "c_mktsegment")
    return c.select(F.col("c_custkey").cast("long").alias("ind_id"), (F.col("c_acctbal") >= 4500).cast("int").alias("y2"), F.col("y5").cast("int"), F.col("c_acctbal").cast("double").alias("yq"))


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ind_id, nation."""
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("ind_id"), F.col("c_nationkey").cast("double").alias("nation"))


def _dosages(spark: SparkSession, sf_dir: str, marker: DataFrame, markers: DataFrame) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("long").alias("ind_id"))
    # one row an individual, so that the matrix is laid out where its individuals are and isn't joined call by call
    lines = marker.where("snp_id IS NOT NULL").join(orders, "l_orderkey").repartition("ind_id")
    n = lines.groupBy("ind_id", "snp_id").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("g"))
    own = n.groupBy("ind_id").agg(F.map_from_entries(F.collect_list(F.struct("snp_id", "g"))).alias("own"))
    grid = individuals(spark, sf_dir).select("ind_id").join(own, "ind_id", "left").crossJoin(F.broadcast(markers.select("snp_id")))  # the matrix itself
    return grid.select("snp_id", "ind_id", F.coalesce(F.try_element_at("own", F.col("snp_id")), F.lit(0)).cast("int").alias("g"))


def snps25(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = _t(spark, sf_dir, "part").select("p_brand").distinct()
    return brands.select((F.dense_rank().over(Window.orderBy("p_brand")) - 1).cast("int").alias("snp_id"), F.col("p_brand").alias("name"))


def genotypes25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp_id, ind_id, g: 25 markers, one a brand."""
    snps = snps25(spark, sf_dir)
    part = _t(spark, sf_dir, "part").join(F.broadcast(snps.withColumnRenamed("name", "p_brand")), "p_brand").select(F.col("p_partkey").alias("l_partkey"), "snp_id")
    marker = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey").select("l_orderkey", "snp_id")
    return _dosages(spark, sf_dir, marker, snps)


def snps100(spark: SparkSession) -> DataFrame:
    return spark.range(100).select(F.col("id").cast("int").alias("snp_id"), F.concat(F.lit("rs"), "id").alias("name"))


def genotypes100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp_id, ind_id, g: 100 markers by part number modulo 100."""
    marker = _t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 100).cast("int").alias("snp_id"))
    return _dosages(spark, sf_dir, marker, snps100(spark))


def part_dosages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp_id, ind_id, g of the markers that are parts; calls of dosage 0 have no row."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("long").alias("ind_id"))
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("int").alias("snp_id"))
    return lines.join(orders, "l_orderkey").groupBy("snp_id", "ind_id").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("g"))


def snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp_id, name: one marker a part."""
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("snp_id"), F.concat(F.lit("rs"), "p_partkey").alias("name"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp_id, label: two labels a part, its brand and size, and its type and size."""
    both = F.array(*[F.concat_ws("/", c, F.col("p_size").cast("string")) for c in ("p_brand", "p_type")])
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("snp_id"), F.explode(both).alias("label"))


def label_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label1, label2: each type and size with the one that it is ordered with most often (the first by name of equals).

    Labels go by numbers; an order's labels meet inside its row, each pair once, and only counts by pair are moved on."""
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("label"))
    names = part.select("label").distinct().withColumn("part", F.pmod(F.xxhash64("label"), F.lit(256)))
    names = shared.materialize(shared.numbered(names, "part", ["label"], "id").select("label", F.col("id").cast("int").alias("id")), "label_names")
    coded = shared.materialize(part.join(names, "label").select("l_partkey", "id"), "coded_parts")
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").where("l_orderkey IS NOT NULL").join(coded.hint("shuffle_hash"), "l_partkey")
    orders = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    one = orders.select("ids", F.posexplode("ids").alias("at", "a"))
    pairs = one.select("a", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("b"))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    both = counted.unionAll(counted.select("b", "a", "n"))
    best = both.join(names.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("first"))
    return best.join(names.select(F.col("id").alias("a"), F.col("label").alias("label1")), "a").select("label1", F.col("first.label").alias("label2"))


def labels100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp_id, label: for the 100 markers by part number modulo 100, the brand and the type ordered most often."""
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    li = _t(spark, sf_dir, "lineitem").select("l_partkey").join(part, "l_partkey").select((F.col("l_partkey") % 100).cast("int").alias("snp_id"), F.explode(F.array("p_brand", "p_type")).alias("label"), F.col("p_brand"))
    counted = li.withColumn("kind", F.col("label") == F.col("p_brand")).groupBy("snp_id", "kind", "label").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("snp_id", "kind").orderBy(F.desc("n"), "label"))
    return counted.withColumn("i", first).where("i = 1").select("snp_id", "label")


def eqtl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp_id, gene, p, tissue."""
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene"))
    li = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_discount").cast("double").alias("p"), F.col("l_returnflag").alias("tissue"))
    return li.join(part, "l_partkey").select((F.col("l_partkey") % 100).cast("int").alias("snp_id"), "gene", "p", "tissue", "l_orderkey", "l_linenumber")


def pair_sets(spark: SparkSession, n: int = 25, triples_of: int = 25) -> DataFrame:
    """set_id, snps: all pairs of n markers, then all triples of the first `triples_of`."""
    import itertools

    sets = [list(c) for c in itertools.combinations(range(n), 2)] + [list(c) for c in itertools.combinations(range(triples_of), 3)]
    return spark.createDataFrame(list(enumerate(sets)), "set_id long, snps array<int>")
