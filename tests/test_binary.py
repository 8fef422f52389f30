"""Binary files: round trips, several tasks a file, checks of what is read."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from snpweave.sources import binary


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(1)
    g = r.integers(0, 3, (7, 50))
    geno = spark.createDataFrame([(10 * s, 3 * i, int(g[s, i])) for s in range(7) for i in range(50)], "snp_id int, ind_id long, g int").repartition(5)
    people = spark.createDataFrame([(3 * i, i % 4) for i in range(50)], "ind_id long, y int").repartition(3)
    snps = spark.createDataFrame([(10 * s, f"rsé{s}", str(s % 3), s / 8) for s in range(7)], "snp_id int, name string, chrom string, maf double").repartition(3)
    return g, geno, people, snps


def matrix(df, shape):
    out = np.full(shape, -9)
    for r in df.collect():
        out[r.snp_id, r.ind_id] = -1 if r.g is None else r.g
    return out


def plain_instance(g, ys, names, ill=()):
    out = struct.pack("<qq", *g.shape) + g.astype(np.uint8).tobytes() + b"\x02" + struct.pack(f"<{len(ys)}Q", *ys) + b"\0\0"
    return out + b"".join(bytes([len(n.encode())]) + n.encode() for n in names) + struct.pack(f"<{len(ill) + 1}Q", len(ill), *ill)


@pytest.mark.parametrize("people_a_row", [1 << 18, 16])
def test_instance_round_trip(spark, data, tmp_path, monkeypatch, people_a_row):
    monkeypatch.setattr(binary, "PEOPLE", people_a_row)
    monkeypatch.setattr(binary, "NAMES", 3)
    g, geno, people, snps = data
    path = str(tmp_path / "all.bin")
    disease = spark.createDataFrame([(20,), (60,)], "snp_id int")
    binary.write_instance(geno, people, snps, path, disease)
    d = binary.read_instance(spark, path, split=64)
    assert d["genotypes"].rdd.getNumPartitions() == 6 and (matrix(d["genotypes"], g.shape) == g).all()
    assert [r.y for r in d["phenotypes"].orderBy("ind_id").collect()] == [i % 4 for i in range(50)]
    assert [(r.name, r.chrom, r.maf) for r in d["snps"].orderBy("snp_id").collect()] == [(f"rsé{s}", str(s % 3), s / 8) for s in range(7)]
    assert [r[0] for r in d["disease"].collect()] == [2, 6]
    assert os.listdir(tmp_path) == ["all.bin"]


def test_instance_bytes_are_those_of_the_format(spark, data, tmp_path):
    g, geno, people, snps = data
    path = tmp_path / "plain.bin"
    binary.write_instance(geno, people, snps.select("snp_id", "name"), str(path))
    assert path.read_bytes() == plain_instance(g, [i % 4 for i in range(50)], [f"rsé{s}" for s in range(7)])
    binary.write_instance(geno, people.withColumn("y", F.col("y") / 4), snps.select("snp_id", F.col("chrom").alias("name")), str(path), quantitative=True)
    d = binary.read_instance(spark, str(path))
    assert [r.y for r in d["phenotypes"].orderBy("ind_id").collect()] == [i % 4 / 4 for i in range(50)]
    assert d["snps"].where("chrom IS NULL AND maf IS NULL").count() == 7 and d["disease"].count() == 0


def test_instance_checks(spark, data, tmp_path):
    g, geno, people, snps = data
    p = tmp_path / "bad.bin"
    read = lambda raw, part="genotypes": (p.write_bytes(raw), binary.read_instance(spark, str(p))[part].collect())
    good = plain_instance(g, range(50), "abcdefg", [1, 2])
    read(good)
    for raw, part, words in ((good[:100], "genotypes", "no instance"), (b"abc", "genotypes", "too short"), (good[:20] + b"\x07" + good[21:], "genotypes", "is not 0, 1 or 2"), (plain_instance(g, range(50), "abcdefg", [1, 1]), "disease", "repeated")):
        with pytest.raises(Exception, match=words):
            read(raw, part)
    target = tmp_path / "none.bin"
    for calls, words in ((geno.withColumn("g", F.when(F.col("ind_id") != 9, F.col("g"))), "no code"), (geno.where("ind_id <> 9 OR snp_id <> 0"), "no call"), (geno.unionAll(geno.limit(1)), "more than one")):
        with pytest.raises(Exception, match=words):
            binary.write_instance(calls, people, snps, str(target))
    assert not target.exists()


@pytest.mark.parametrize("split", [1 << 25, 5])
def test_bed_round_trip(spark, data, tmp_path, monkeypatch, split):
    monkeypatch.setattr(binary, "PEOPLE", 8)
    g, geno, _, _ = data
    gaps = geno.withColumn("g", F.when((F.col("ind_id") + F.col("snp_id")) % 5 != 0, F.col("g")))
    path = str(tmp_path / "x.bed")
    binary.write_bed(gaps, path)
    want = np.array([[-1 if (3 * i + 10 * s) % 5 == 0 else g[s, i] for i in range(50)] for s in range(7)])
    back = binary.read_bed(spark, path, 50, split=split)
    assert (matrix(back, g.shape) == want).all() and back.rdd.getNumPartitions() == (1 if split > 100 else 19)


def test_a_range_of_markers_reads_its_bytes(spark, data, tmp_path):
    g, geno, people, snps = data
    path = str(tmp_path / "f.bin")
    binary.write_instance(geno, people, snps, path)
    some = binary.read_instance(spark, path, split=50, first_snp=2, stop_snp=4)["genotypes"]
    assert some.rdd.getNumPartitions() == 2 and {(r.snp_id, r.ind_id): r.g for r in some.collect()} == {(s, i): g[s, i] for s in (2, 3) for i in range(50)}
    assert binary.read_instance(spark, path, first_snp=9)["genotypes"].count() == 0
