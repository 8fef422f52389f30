"""Sinks: result tables, networks, exports for other tools. Each returns or writes DataFrames; nothing is collected but
what a format holds in one cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snpweave.functions.scalars import base32
from snpweave.operators.network import degrees, joint_degrees, symmetric


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def adjacency_list_json(edges: DataFrame) -> DataFrame:
    """value: one JSON object per node with its neighbours."""
    lists = symmetric(edges).groupBy("node").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))
    return lists.select(F.to_json(F.struct("node", "neighbours")).alias("value"))


def adjacency_matrix(edges: DataFrame) -> DataFrame:
    """node and one 0/1 column per node."""
    nodes = [r[0] for r in degrees(edges).select("node").orderBy("node").collect()]
    return symmetric(edges).groupBy("node").pivot("other", nodes).agg(F.lit(1)).na.fill(0)


def node_edge_tables(edges: DataFrame, snps: DataFrame, annotations: DataFrame) -> dict[str, DataFrame]:
    """nodes (base-32 id, name), annotations, has_annotation and edges (one boolean column a tag)."""
    used = edges.select(F.explode(F.array("node1", "node2")).alias("snp_id")).distinct()
    nodes = snps.join(used, "snp_id", "left_semi").select(base32(F.col("snp_id")).alias("id"), "name")
    marks = annotations.join(used, "snp_id", "left_semi").distinct()
    tags = [r[0] for r in edges.select("tag").distinct().orderBy("tag").collect()]
    wide = edges.groupBy("node1", "node2").pivot("tag", tags).agg(F.lit(True)).na.fill(False)
    return {
        "nodes": nodes,
        "annotations": marks.select("label").distinct(),
        "has_annotation": marks.select(base32(F.col("snp_id")).alias("node"), "label"),
        "edges": wide.withColumns({c: base32(F.col(c)) for c in ("node1", "node2")}),
    }


def joint_degree_matrix(edges: DataFrame) -> DataFrame:
    """d_in and one column per d_out."""
    return joint_degrees(edges).groupBy("d_in").pivot("d_out").agg(F.first("n")).na.fill(0)


def set_ld(sets: DataFrame, ld: DataFrame) -> DataFrame:
    """set_id, a, b, r2: the upper triangle of each set; write it partitioned by set_id."""
    m = sets.select("set_id", F.explode("snps").alias("s"))
    left = m.withColumnRenamed("s", "a").join(ld, "a")
    return left.join(m.withColumnRenamed("s", "b"), ["set_id", "b"]).select("set_id", "a", "b", "r2")


def epigen_json(genotypes: DataFrame, phenotypes: DataFrame, snps: DataFrame) -> DataFrame:
    """value: the dataset as one JSON object (a format of a single object; for small exports)."""
    row = F.expr("transform(array_sort(collect_list(struct(ind_id, g))), x -> x.g)")
    lists = genotypes.groupBy("snp_id").agg(row.alias("g"), (F.sum("g") / (2 * F.count("g"))).alias("maf")).join(snps, "snp_id")
    wide = lists.agg(F.array_sort(F.collect_list(F.struct("snp_id", "g", "maf", "name"))).alias("s"))
    people = phenotypes.agg(F.array_sort(F.collect_list(F.struct("ind_id", "y"))).alias("p"))
    both = wide.crossJoin(people)  # one row each
    return both.select(F.to_json(F.struct(F.size("s").alias("num_snps"), F.size("p").alias("num_inds"), F.expr("transform(s, x -> x.g)").alias("genotype"), F.expr("transform(p, x -> cast(x.y AS string))").alias("phenotype"), F.expr("transform(s, x -> array(x.name, '0', '0', 'A', 'B'))").alias("snps"), F.expr("transform(s, x -> x.maf)").alias("mafs"), F.array().cast("array<int>").alias("disease_snps"))).alias("value"))


def macoed_table(genotypes: DataFrame, phenotypes: DataFrame, names: list[str]) -> DataFrame:
    """One row per individual: a column per SNP and Class; dichotomous phenotypes."""
    wide = genotypes.groupBy("ind_id").pivot("snp_id", list(range(len(names)))).agg(F.first("g"))
    return wide.join(phenotypes.select("ind_id", F.col("y").alias("Class")), "ind_id").orderBy("ind_id").drop("ind_id").toDF(*names, "Class")


def linden_lines(genotypes: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """snp_id, cases, controls: dosages of both groups as text, individuals in order."""
    rows = genotypes.join(phenotypes, "ind_id")
    line = lambda y: F.expr(f"array_join(transform(array_sort(filter(collect_list(struct(ind_id, g, y)), x -> x.y = {y})), x -> x.g), ' ')")
    return rows.groupBy("snp_id").agg(line(1).alias("cases"), line(0).alias("controls"))


def ped_lines(genotypes: DataFrame, people: DataFrame) -> DataFrame:
    """value: one line per individual with allele pairs A/B by dosage of B."""
    pair = F.when(F.col("g").isNull(), "0 0").when(F.col("g") == 0, "A A").when(F.col("g") == 1, "A B").otherwise("B B")
    calls = genotypes.withColumn("c", pair).groupBy("ind_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(snp_id, c))), x -> x.c), ' ')").alias("calls"))
    return people.join(calls, "ind_id").select(F.concat_ws(" ", "fid", "iid", F.lit("0"), F.lit("0"), "sex", F.coalesce(F.col("y") + 1, F.lit(0)), "calls").alias("value"))


def vcf_lines(genotypes: DataFrame, snps: DataFrame) -> DataFrame:
    """value: one line per SNP, calls in order of individuals."""
    call = F.when(F.col("g").isNull(), "./.").when(F.col("g") == 0, "0/0").when(F.col("g") == 1, "0/1").otherwise("1/1")
    calls = genotypes.withColumn("c", call).groupBy("snp_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(ind_id, c))), x -> x.c), '\t')").alias("calls"))
    return snps.join(calls, "snp_id").select(F.concat_ws("\t", "chrom", "pos", "name", F.lit("A"), F.lit("B"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), "calls").alias("value"))


def tped_lines(genotypes: DataFrame, snps: DataFrame) -> DataFrame:
    """value: one line per SNP with allele pairs A/B by dosage of B, individuals in order."""
    pair = F.when(F.col("g").isNull(), "0 0").when(F.col("g") == 0, "A A").when(F.col("g") == 1, "A B").otherwise("B B")
    calls = genotypes.withColumn("c", pair).groupBy("snp_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(ind_id, c))), x -> x.c), ' ')").alias("calls"))
    return snps.join(calls, "snp_id").select(F.concat_ws(" ", "chrom", "name", F.lit("0"), "pos", "calls").alias("value"))


def fam_lines(people: DataFrame) -> DataFrame:
    """value: one line per individual (fid, iid, sex, y: 0 or 1)."""
    return people.select(F.concat_ws(" ", "fid", "iid", F.lit("0"), F.lit("0"), "sex", F.coalesce((F.col("y") + 1).cast("string"), F.lit("-9"))).alias("value"))


def pocos_tables(genotypes: DataFrame, phenotypes: DataFrame, snps: DataFrame) -> dict[str, DataFrame]:
    """genotype (a tab-separated line of dosages per SNP), phenotype (1 or 2 a line) and names (a SNP a line)."""
    line = F.expr("array_join(transform(array_sort(collect_list(struct(ind_id, g))), x -> x.g), '\t')")
    return {
        "genotype": genotypes.groupBy("snp_id").agg(line.alias("value")).orderBy("snp_id").select("value"),
        "phenotype": phenotypes.orderBy("ind_id").select((F.col("y") + 1).cast("string").alias("value")),
        "names": snps.orderBy("snp_id").select(F.col("name").alias("value")),
    }


def save_cells(cell: DataFrame, path: str) -> None:
    """A fitted penetrance model: the cells of its sets. `load_cells` reads it; predictions are the same."""
    cell.write.mode("overwrite").parquet(path)


def load_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
