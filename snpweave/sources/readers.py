"""Readers of genotype datasets, annotations, label networks and SNP sets. All go through Spark's readers, so paths may be
in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snpweave.functions.scalars import split_list
from snpweave.shared import line_numbers

EPIGEN = "num_snps int, num_inds int, model_type string, num_categories int, genotype array<array<int>>, phenotype array<string>, snps array<array<string>>, mafs array<double>, disease_snps array<int>"


def _fail_if(df: DataFrame, message: str) -> None:
    if not df.isEmpty():
        raise ValueError(f"{message}: {df.first()}")


def read_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """genotypes(snp_id, ind_id, g), phenotypes(ind_id, y), snps(snp_id, name, chrom, pos, maf), disease(snp_id). Wrong
    dimensions, dosages beyond 0-2 and repeated names are errors."""
    doc = spark.read.schema(EPIGEN).json(path, multiLine=True)
    _fail_if(doc.where("size(genotype) <> num_snps OR size(phenotype) <> num_inds OR size(snps) <> num_snps OR size(mafs) <> num_snps OR exists(genotype, r -> size(r) <> num_inds)").select("num_snps", "num_inds"), "dimensions do not agree")
    rows = doc.select(F.posexplode("genotype").alias("snp_id", "r"))
    geno = rows.select("snp_id", F.posexplode("r").alias("ind_id", "g"))
    _fail_if(geno.where("g NOT IN (0, 1, 2) OR g IS NULL"), "a dosage is not 0, 1 or 2")
    snps = doc.select(F.posexplode(F.arrays_zip("snps", "mafs")).alias("snp_id", "s")).select("snp_id", F.get("s.snps", F.lit(0)).alias("name"), F.get("s.snps", F.lit(1)).alias("chrom"), F.get("s.snps", F.lit(2)).alias("pos"), F.col("s.mafs").alias("maf"))
    _fail_if(snps.groupBy("name").count().where("count > 1"), "a name is repeated")
    return {"genotypes": geno, "phenotypes": doc.select(F.posexplode("phenotype").alias("ind_id", "y")), "snps": snps, "disease": doc.select(F.explode("disease_snps").alias("snp_id")).distinct()}


def read_matrix_csv(spark: SparkSession, path: str, snps_as: str = "columns", info: str = "first", sep: str = ",") -> dict[str, DataFrame]:
    """A text matrix with SNPs as rows or columns; names first or last, phenotype last. Cells are numbered while reading
    and, for SNPs as rows, turned over."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("row", "line"))
    cells = whole.select("row", F.posexplode(F.split("line", sep)).alias("col", "v")).withColumn("v", F.trim("v"))
    if snps_as == "rows":
        cells = cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")
    last = cells.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    name_row = 0 if info == "first" else last.r
    shift = 1 if info == "first" else 0
    names = cells.where((F.col("row") == name_row) & (F.col("col") < last.c)).select(F.col("col").alias("snp_id"), F.col("v").alias("name"))
    body = cells.where(F.col("row") != name_row).withColumn("ind_id", F.col("row") - shift)
    geno = body.where(F.col("col") < last.c).select(F.col("col").alias("snp_id"), "ind_id", F.col("v").cast("int").alias("g"))
    return {"genotypes": geno, "phenotypes": body.where(F.col("col") == last.c).select("ind_id", F.col("v").alias("y")), "snps": names}


def read_covariates(spark: SparkSession, path: str, id_column: str | None = None) -> DataFrame:
    """ind_id and covs: all numeric columns in order; rows are numbered unless a column holds the ids."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    cols = [c for c in df.columns if c != id_column]
    covs = F.array(*[F.col(c).cast("double") for c in cols]).alias("covs")
    if id_column:
        return df.select(F.col(id_column).alias("ind_id"), covs)
    return line_numbers(df, "ind_id").select("ind_id", covs)


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """snp_id, name, chrom, pos, a1, a2 of a variant table."""
    df = spark.read.csv(path, sep="\t").toDF("chrom", "name", "cm", "pos", "a1", "a2")
    return line_numbers(df, "snp_id").select("snp_id", "name", "chrom", "pos", "a1", "a2")


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """ind_id, fid, iid, sex, y (1 case, 0 control, null unknown) of a sample table."""
    df = line_numbers(spark.read.text(path), "ind_id").withColumn("p", F.split(F.trim("value"), r"\s+"))
    y = F.when(F.col("p")[5] == "2", 1).when(F.col("p")[5] == "1", 0)
    return df.select("ind_id", F.col("p")[0].alias("fid"), F.col("p")[1].alias("iid"), F.col("p")[4].cast("int").alias("sex"), y.alias("y"))


def read_ped(spark: SparkSession, path: str) -> DataFrame:
    """ind_id, snp_id, g, a: dosage of the rarer allele from paired allele columns ('0' is missing)."""
    df = line_numbers(spark.read.text(path), "ind_id").withColumn("p", F.split(F.trim("value"), r"\s+"))
    pairs = df.select("ind_id", F.expr("transform(sequence(0, (size(p) - 6) div 2 - 1), i -> array(p[6 + 2 * i], p[7 + 2 * i]))").alias("calls"))
    return _dosage(pairs.select("ind_id", F.posexplode("calls").alias("snp_id", "c")))


def read_tped(spark: SparkSession, path: str) -> DataFrame:
    """As `read_ped`, SNP by SNP."""
    df = line_numbers(spark.read.text(path), "snp_id").withColumn("p", F.split(F.trim("value"), r"\s+"))
    pairs = df.select("snp_id", F.expr("transform(sequence(0, (size(p) - 4) div 2 - 1), i -> array(p[4 + 2 * i], p[5 + 2 * i]))").alias("calls"))
    return _dosage(pairs.select("snp_id", F.posexplode("calls").alias("ind_id", "c")))


def _dosage(calls: DataFrame) -> DataFrame:
    alleles = calls.select("snp_id", F.explode("c").alias("a")).where("a <> '0'").groupBy("snp_id", "a").agg(F.count("*").alias("n"))
    rare = alleles.groupBy("snp_id").agg(F.min(F.struct("n", "a")).alias("m"), F.count("*").alias("k")).select("snp_id", F.when(F.col("k") > 1, F.col("m.a")).alias("a"))
    g = F.when(F.array_contains("c", "0"), None).otherwise(F.coalesce(F.expr("size(filter(c, x -> x = a))"), F.lit(0)))
    return calls.join(rare, "snp_id", "left").select("snp_id", "ind_id", F.when(F.col("a").isNull() & ~F.array_contains("c", "0"), 0).otherwise(g).cast("int").alias("g"), "a")


def read_vcf(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """snps and genotypes of a variant call file: dosage of alternative alleles, '.' is missing."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    body = line_numbers(lines, "snp_id").withColumn("p", F.split("value", "\t"))
    snps = body.select("snp_id", F.col("p")[2].alias("name"), F.col("p")[0].alias("chrom"), F.col("p")[1].alias("pos"), F.col("p")[3].alias("ref"), F.col("p")[4].alias("alt"))
    calls = body.select("snp_id", F.posexplode(F.expr("slice(p, 10, greatest(size(p) - 9, 0))")).alias("ind_id", "call"))
    alleles = F.split(F.substring_index("call", ":", 1), "[/|]")
    g = F.when(F.array_contains(alleles, "."), None).otherwise(F.size(F.filter(alleles, lambda x: x != "0")))
    return {"snps": snps, "genotypes": calls.select("snp_id", "ind_id", g.cast("int").alias("g"))}


def read_annotations(spark: SparkSession, path: str, snps: DataFrame, snp_col: str, label_col: str, header: bool = True, sep: str = ",", snp_sep: str | None = None, label_sep: str | None = None) -> DataFrame:
    """snp_id, label: every SNP of a cell with every label of its row; unknown SNPs are left out. Columns by name, or by
    number where there is no header. A name rs1 is also known as 1."""
    df = spark.read.csv(path, header=header, sep=sep)
    pick = lambda c: F.col(c) if header else F.col(df.columns[int(c)])
    many = lambda c, s: F.explode(split_list(c, s)) if s else c
    rows = df.select(pick(snp_col).alias("s"), pick(label_col).alias("l")).select(many(F.col("s"), snp_sep).alias("alias"), "l").select("alias", many(F.col("l"), label_sep).alias("label"))
    return rows.select(F.trim("alias").alias("alias"), F.trim("label").alias("label")).join(aliases(snps), "alias").select("snp_id", "label")


def aliases(snps: DataFrame) -> DataFrame:
    """alias, snp_id: names, and names without a leading rs. Repeated ones are an error."""
    out = snps.select(F.col("name").alias("alias"), "snp_id").union(snps.where("name LIKE 'rs%'").select(F.regexp_replace("name", "^rs", ""), "snp_id"))
    _fail_if(out.groupBy("alias").count().where("count > 1"), "a name is repeated")
    return out


def read_dbsnp(spark: SparkSession, path: str, snps: DataFrame) -> DataFrame:
    return read_annotations(spark, path, snps, "1", "0", header=False, sep="\t", snp_sep=";")


def read_label_network(spark: SparkSession, path: str, col1: str, col2: str, header: bool = True, sep: str = "\t", sep1: str | None = None, sep2: str | None = None) -> DataFrame:
    """label1, label2; cells may hold several labels."""
    df = spark.read.csv(path, header=header, sep=sep)
    pick = lambda c: F.col(c) if header else F.col(df.columns[int(c)])
    many = lambda c, s: F.explode(split_list(c, s)) if s else c
    return df.select(pick(col1).alias("a"), pick(col2).alias("b")).select(many(F.col("a"), sep1).alias("label1"), "b").select("label1", many(F.col("b"), sep2).alias("label2"))


def read_biogrid(spark: SparkSession, path: str) -> DataFrame:
    return read_label_network(spark, path, "Official Symbol Interactor A", "Official Symbol Interactor B")


def read_sets(spark: SparkSession, path: str, snps: DataFrame, skip_unknown: bool = False) -> DataFrame:
    """set_id, snps and further columns of a table with RS_IDS (names joined by ';'). Unknown names are an error, or left
    out; sets without members go."""
    df = spark.read.csv(path, header=True, sep="\t")
    df = line_numbers(df, "set_id")
    return _named_sets(df, df.select("set_id", F.explode(split_list(F.col("RS_IDS"), ";")).alias("alias")), snps, skip_unknown).drop("RS_IDS")


def _named_sets(df: DataFrame, members: DataFrame, snps: DataFrame, skip_unknown: bool) -> DataFrame:
    known = aliases(snps)
    if not skip_unknown:
        _fail_if(members.join(known, "alias", "left_anti").select("alias"), "unknown SNP")
    found = members.join(known, "alias").groupBy("set_id").agg(F.array_sort(F.collect_set("snp_id")).alias("snps"))
    return df.join(found, "set_id")


def read_linden(spark: SparkSession, path: str, snps: DataFrame) -> DataFrame:
    """Pairs snp1, snp2; LINDEN_rank numbers the rows."""
    df = spark.read.csv(path, header=True, sep="\t")
    df = line_numbers(df, "set_id").withColumn("LINDEN_rank", (F.col("set_id") + 1).cast("int"))
    return _named_sets(df.select("set_id", "LINDEN_rank"), df.select("set_id", F.explode(F.array("snp1", "snp2")).alias("alias")), snps, False)


def read_macoed(spark: SparkSession, path: str, snps: DataFrame) -> DataFrame:
    """Lines whose first field is 'final'; fields two and three are the pair."""
    df = line_numbers(spark.read.text(path).where("split(value, '\t')[0] = 'final'"), "set_id").withColumn("p", F.split("value", "\t"))
    return _named_sets(df.select("set_id"), df.select("set_id", F.explode(F.array(F.col("p")[1], F.col("p")[2])).alias("alias")), snps, False)


def read_disease_snps(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Distinct names of the first line, comma-separated, quotes stripped; only those of `known` (name), if given."""
    whole = spark.read.text(path, wholetext=True)
    first = F.split(F.get(F.split("value", "\r?\n"), F.lit(0)), ",")
    found = whole.select(F.explode(first).alias("v")).select(F.trim(F.regexp_replace("v", "[\"']", "")).alias("name")).where("name <> ''").distinct()
    return found if known is None else found.join(known.select("name"), "name", "left_semi")


def find_file(spark: SparkSession, folder: str, pattern: str, without: str | None = None) -> str:
    """The path of the one file of a folder whose name matches a glob pattern (and not another, a regular expression); an
    error where there is none or more than one. Only the listing is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    if without:
        found = found.where(~F.regexp_extract("path", "[^/]*$", 0).rlike(without))
    paths = [r[0] for r in found.limit(3).collect()]
    if len(paths) != 1:
        raise FileNotFoundError(f"{'no' if not paths else 'more than one'} file {pattern} in {folder}")
    return paths[0]


def list_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, format, phenotype, categories of the files of a folder called name.format.phenotype[.categories]."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.split(F.regexp_extract("path", "[^/]*$", 0), "\\.").alias("p"))
    part = lambda i: F.get("p", F.lit(i))
    return files.where(F.size("p").between(3, 4)).select("path", part(0).alias("name"), part(1).alias("format"), part(2).alias("phenotype"), part(3).cast("int").alias("categories"))


def read_ld(spark: SparkSession, path: str) -> DataFrame:
    """a, b, r2 (a < b) of a square matrix of numbers; lines before the first that starts with 1 are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("i", "line")).where("trim(line) <> ''")
    start = lines.where(F.trim("line").startswith("1")).agg(F.min("i")).first()[0]
    cells = lines.where(F.col("i") >= start).select((F.col("i") - F.lit(start)).alias("a"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("b", "v"))
    return cells.where("a < b").select("a", "b", F.col("v").cast("double").alias("r2"))
