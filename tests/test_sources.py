"""Readers and writers on small files."""

import json

import numpy as np
import pytest

from snpweave.sources import binary, readers, writers

GENO = [[0, 1, 2, 0], [2, 2, 0, 1]]


@pytest.fixture()
def epigen(tmp_path):
    doc = {"num_snps": 2, "num_inds": 4, "genotype": GENO, "phenotype": ["0", "1", "1", "0"], "snps": [["rs1", "1", "5", "A", "C"], ["rs2", "2", "6", "G", "T"]], "mafs": [0.375, 0.625], "disease_snps": [1]}
    p = tmp_path / "d.json"
    p.write_text(json.dumps(doc))
    return str(p)


def cells(df):
    return {(r.snp_id, r.ind_id): r.g for r in df.collect()}


WANT = {(s, i): g for s, row in enumerate(GENO) for i, g in enumerate(row)}


def test_json_round_trip(spark, epigen, tmp_path):
    d = readers.read_json(spark, epigen)
    assert cells(d["genotypes"]) == WANT and d["disease"].first()[0] == 1
    out = writers.epigen_json(d["genotypes"], d["phenotypes"], d["snps"].select("snp_id", "name"))
    out.write.text(str(tmp_path / "out"))
    again = readers.read_json(spark, str(tmp_path / "out"))
    assert cells(again["genotypes"]) == WANT


def test_json_checks(spark, tmp_path):
    p = tmp_path / "bad.json"
    p.write_text(json.dumps({"num_snps": 1, "num_inds": 2, "genotype": [[0, 3]], "phenotype": ["0", "1"], "snps": [["a", "1"]], "mafs": [0.1]}))
    with pytest.raises(ValueError, match="dosage"):
        readers.read_json(spark, str(p))


@pytest.mark.parametrize("as_, info", [("columns", "first"), ("columns", "last"), ("rows", "first"), ("rows", "last")])
def test_matrix_csv(spark, tmp_path, as_, info):
    names, body = ["rs1", "rs2", "y"], [[str(GENO[0][i]), str(GENO[1][i]), str(i % 2)] for i in range(4)]
    table = [names, *body] if info == "first" else [*body, names]
    if as_ == "rows":
        table = [list(x) for x in zip(*table, strict=True)]
    p = tmp_path / "m.csv"
    p.write_text("\n".join(map(",".join, table)) + "\n")
    d = readers.read_matrix_csv(spark, str(p), as_, info)
    assert cells(d["genotypes"]) == WANT and [r.name for r in d["snps"].orderBy("snp_id").collect()] == ["rs1", "rs2"]


def test_bed(spark, tmp_path):
    code = {2: 0, None: 1, 1: 2, 0: 3}
    rows = [[0, 1, 2, None, 1], [2, 2, 0, 1, None]]
    raw = b"\x6c\x1b\x01"
    for row in rows:
        bits = [code[g] for g in row] + [0] * 3
        raw += bytes(sum(b << 2 * k for k, b in enumerate(bits[i : i + 4])) for i in (0, 4))
    p = tmp_path / "x.bed"
    p.write_bytes(raw)
    assert cells(binary.read_bed(spark, str(p), 5)) == {(s, i): g for s, row in enumerate(rows) for i, g in enumerate(row)}


def test_ped_and_vcf(spark, tmp_path):
    (tmp_path / "a.ped").write_text("f 1 0 0 1 2 A A A B\nf 2 0 0 2 1 A B A A\nf 3 0 0 1 2 A A 0 0\n")
    assert cells(readers.read_ped(spark, str(tmp_path / "a.ped"))) == {(0, 0): 0, (0, 1): 1, (0, 2): 0, (1, 0): 1, (1, 1): 0, (1, 2): None}
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQ\tF\tI\tFORMAT\ts1\ts2\n1\t5\trs1\tA\tC\t.\t.\t.\tGT:DP\t0/1:3\t./.:0\n")
    d = readers.read_vcf(spark, str(tmp_path / "a.vcf"))
    assert cells(d["genotypes"]) == {(0, 0): 1, (0, 1): None} and d["snps"].first().name == "rs1"


def test_annotations_networks_sets(spark, tmp_path):
    snps = spark.createDataFrame([(0, "rs1"), (1, "rs2"), (2, "rs3")], "snp_id int, name string")
    (tmp_path / "db").write_text("G1\t1;2\nG2\t2;9\n")
    assert sorted(map(tuple, readers.read_dbsnp(spark, str(tmp_path / "db"), snps).collect())) == [(0, "G1"), (1, "G1"), (1, "G2")]
    (tmp_path / "net").write_text("a\tb\nG1|G2\tG3\n")
    assert sorted(map(tuple, readers.read_label_network(spark, str(tmp_path / "net"), "a", "b", sep1="|").collect())) == [("G1", "G3"), ("G2", "G3")]
    (tmp_path / "sets").write_text("RS_IDS\tnote\nrs3;rs1\tx\nrs2\ty\n")
    got = readers.read_sets(spark, str(tmp_path / "sets"), snps).orderBy("set_id").collect()
    assert [(list(r.snps), r.note) for r in got] == [([0, 2], "x"), ([1], "y")]
    (tmp_path / "mac").write_text("x\ty\nfinal\trs1\trs2\n")
    assert list(readers.read_macoed(spark, str(tmp_path / "mac"), snps).first().snps) == [0, 1]
    (tmp_path / "lin").write_text("snp1\tsnp2\nrs2\trs3\n")
    assert readers.read_linden(spark, str(tmp_path / "lin"), snps).first().LINDEN_rank == 1
    (tmp_path / "dis").write_text('"rs1",rs2,rs1\nrest\n')
    assert {r[0] for r in readers.read_disease_snps(spark, str(tmp_path / "dis")).collect()} == {"rs1", "rs2"}
    (tmp_path / "ld").write_text("head\n1 0.5\n0.5 1\n")
    assert [tuple(r) for r in readers.read_ld(spark, str(tmp_path / "ld")).collect()] == [(0, 1, 0.5)]
    with pytest.raises(ValueError, match="unknown SNP"):
        (tmp_path / "bad").write_text("RS_IDS\nrs77\n")
        readers.read_sets(spark, str(tmp_path / "bad"), snps)


def test_network_tables(spark):
    e = spark.createDataFrame([(0, 33, "T"), (0, 1, "T"), (0, 1, "U")], "node1 int, node2 int, tag string")
    snps = spark.createDataFrame([(i, f"rs{i}") for i in (0, 1, 33)], "snp_id int, name string")
    ann = spark.createDataFrame([(33, "G")], "snp_id int, label string")
    t = writers.node_edge_tables(e, snps, ann)
    assert {r.id for r in t["nodes"].collect()} == {"0", "1", "11"}
    assert sorted((r.node1, r.node2, r.T, r.U) for r in t["edges"].collect()) == [("0", "1", True, True), ("0", "11", True, False)]
    m = {r.node: (r["0"], r["1"], r["33"]) for r in writers.adjacency_matrix(e).collect()}
    assert m == {0: (0, 1, 1), 1: (1, 0, 0), 33: (1, 0, 0)}
    assert np.sum([r["1"] for r in writers.joint_degree_matrix(e).collect()]) == 2
