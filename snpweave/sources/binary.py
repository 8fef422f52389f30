"""Binary genotype files by byte ranges: data sources that many tasks read and write at once.

Instance file (little-endian): markers and people as 64-bit numbers; one byte a dosage, marker by marker; one byte for the
kind of phenotype (1 doubles, 2 unsigned 64-bit categories) and 8 bytes a person; two bytes that tell whether chromosomes
and frequencies follow; a marker's name (its length in a byte before it), chromosome likewise, frequency as a double; the
number of disease markers and their numbers, 64 bits each. Two-bit (.bed) file: three bytes, then a row a marker, four people
a byte.

Readers split matrices and phenotypes at SPLIT bytes, inside a marker's row too; a range of markers reads its bytes alone. Names have no fixed length and are read by one task, a
buffer at a time. Paths may be anything that pyarrow opens and executors see. The writer takes (at, bytes) rows: tasks write
them at their places in one file under another name, which the commit renames; a task that runs again writes the same bytes.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from snpweave import shared

SPLIT = 32 << 20
CELLS = 1 << 20  # bytes of a file that make one Arrow batch, at most
PEOPLE = 1 << 18  # calls of one row to be written; a multiple of four
NAMES = 4096  # markers whose names make one row to be written
BED = b"\x6c\x1b\x01"


def _open(path: str):
    path = path.removeprefix("file:")
    fs, path = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    return fs.open_input_file(path)


@dataclass
class Span(InputPartition):
    first: int
    stop: int


def _spans(first: int, stop: int, unit: int, split: int) -> list[Span]:
    step = max(unit, split // unit * unit)
    return [Span(a, min(a + step, stop)) for a in range(first, stop, step)] or [Span(first, first)]


# ---------------------------------------------------------------- reading


class _Matrix(DataSourceReader):
    """Rows of a matrix with `width` bytes a marker from byte `first` on."""

    def __init__(self, path: str, first: int, width: int, n_snps: int, options: dict):
        self.path, self.first, self.width = path, first, width
        self.split = int(options.get("split", SPLIT))
        self.low = max(0, int(options.get("first_snp", 0)))
        self.high = min(n_snps, int(options.get("stop_snp", n_snps)))

    def partitions(self) -> list[InputPartition]:
        return _spans(self.low * self.width, max(self.low, self.high) * self.width, 1, self.split)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        with _open(self.path) as f:
            for at in range(partition.first, partition.stop, CELLS):
                size = min(CELLS, partition.stop - at)
                f.seek(self.first + at)
                data = np.frombuffer(f.read(size), np.uint8)
                if len(data) < size:
                    raise ValueError(f"{self.path} ends inside its matrix")
                place = np.arange(at, at + size)
                yield self.cells(place // self.width, place % self.width, data)

    def cells(self, snp: np.ndarray, byte: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        raise NotImplementedError


class _Bytes(_Matrix):
    def cells(self, snp, byte, data):
        bad = np.flatnonzero(data > 2)
        if len(bad):
            raise ValueError(f"dosage {data[bad[0]]} of individual {byte[bad[0]]} at marker {snp[bad[0]]} is not 0, 1 or 2")
        return pa.RecordBatch.from_arrays([pa.array(snp.astype(np.int32)), pa.array(byte), pa.array(data.astype(np.int32))], names=["snp_id", "ind_id", "g"])


class _TwoBits(_Matrix):
    def __init__(self, path: str, n_inds: int, n_snps: int, options: dict):
        super().__init__(path, len(BED), -(-n_inds // 4), n_snps, options)
        self.n_inds = n_inds

    def cells(self, snp, byte, data):
        code = (data[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(-1)
        ind = (byte[:, None] * 4 + np.arange(4)).reshape(-1)
        here = ind < self.n_inds
        g, snp = np.array([2, 0, 1, 0], np.int32)[code[here]], np.repeat(snp, 4)[here]
        return pa.RecordBatch.from_arrays([pa.array(snp.astype(np.int32)), pa.array(ind[here]), pa.array(g, mask=code[here] == 1)], names=["snp_id", "ind_id", "g"])


class _Phenotypes(DataSourceReader):
    def __init__(self, path: str, first: int, n_inds: int, kind: str, split: int):
        self.path, self.first, self.n, self.kind, self.split = path, first, n_inds, kind, split

    def partitions(self):
        return _spans(0, self.n * 8, 8, self.split)

    def read(self, partition: Span):
        with _open(self.path) as f:
            for at in range(partition.first, partition.stop, CELLS):
                f.seek(self.first + at)
                y = np.frombuffer(f.read(min(CELLS, partition.stop - at)), self.kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(y)) + at // 8), pa.array(y.astype(np.float64 if self.kind == "<f8" else np.int64))], names=["ind_id", "y"])


class _Markers(DataSourceReader):
    """The markers' table, or the disease markers behind it."""

    def __init__(self, path: str, first: int, n_snps: int, disease: bool):
        self.path, self.first, self.n, self.disease = path, first, n_snps, disease

    def read(self, partition):
        with _open(self.path) as raw:
            raw.seek(self.first)
            with pa.BufferedInputStream(raw, CELLS) as f:
                yield from self._rows(f)

    def _rows(self, f):
        take = lambda kind: struct.unpack(kind, f.read(struct.calcsize(kind)))[0]
        text = lambda: f.read(take("B")).decode("utf-8")
        chroms, mafs = take("B") == 1, take("B") == 1
        for i in range(self.n):
            row = (i, text(), text() if chroms else None, take("<d") if mafs else None)
            if not self.disease:
                yield row
        if self.disease:
            found = [take("<Q") for _ in range(take("<Q"))]
            if len(set(found)) < len(found):
                raise ValueError("a disease marker is repeated")
            yield from ((v,) for v in found)


class GenotypeInstance(DataSource):
    """Format `genotype_instance`; option `part`: genotypes, phenotypes, snps or disease; options `split`: bytes a task;
    `first_snp`, `stop_snp`: the range of markers whose genotypes are read."""

    @classmethod
    def name(cls) -> str:
        return "genotype_instance"

    def _head(self) -> tuple[int, int, int, int]:
        """Markers, people, first byte of the phenotypes, and their kind."""
        path = self.options["path"]
        with _open(path) as f:
            head = f.read(16)
            if len(head) < 16:
                raise ValueError(f"{path} is too short")
            n_snps, n_inds = struct.unpack("<qq", head)
            if n_snps <= 0 or n_inds <= 0 or f.size() < 17 + n_inds * (n_snps + 8):
                raise ValueError(f"{path} is no instance of {n_snps} markers and {n_inds} people")
            f.seek(16 + n_snps * n_inds)
            kind = f.read(1)[0]
        if kind not in (1, 2):
            raise ValueError(f"unknown kind of phenotype {kind} in {path}")
        return n_snps, n_inds, 17 + n_snps * n_inds, kind

    def schema(self) -> str:
        part = self.options.get("part", "genotypes")
        if part == "phenotypes":
            return "ind_id long, y " + ("double" if self._head()[3] == 1 else "long")
        return {"genotypes": "snp_id int, ind_id long, g int", "snps": "snp_id int, name string, chrom string, maf double", "disease": "snp_id int"}[part]

    def reader(self, schema) -> DataSourceReader:
        n_snps, n_inds, first, kind = self._head()
        path, part = self.options["path"], self.options.get("part", "genotypes")
        if part == "genotypes":
            return _Bytes(path, 16, n_inds, n_snps, self.options)
        if part == "phenotypes":
            return _Phenotypes(path, first, n_inds, "<f8" if kind == 1 else "<u8", int(self.options.get("split", SPLIT)))
        return _Markers(path, first + 8 * n_inds, n_snps, part == "disease")


class TwoBitGenotypes(DataSource):
    """Format `genotype_two_bit`; option `n_inds`: people in the file; options `split`, `first_snp`, `stop_snp`."""

    @classmethod
    def name(cls) -> str:
        return "genotype_two_bit"

    def schema(self) -> str:
        return "snp_id int, ind_id long, g int"

    def reader(self, schema) -> DataSourceReader:
        path, n_inds = self.options["path"], int(self.options["n_inds"])
        width = -(-n_inds // 4)
        with _open(path) as f:
            if f.read(3) != BED:
                raise ValueError("not a SNP-major genotype file")
            if (f.size() - 3) % width:
                raise ValueError(f"{path} holds no whole rows of {n_inds} people")
            n_snps = (f.size() - 3) // width
        return _TwoBits(path, n_inds, n_snps, self.options)


# ---------------------------------------------------------------- writing


class _Ranges(DataSourceWriter):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.draft = f"{path}.{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(self.draft, "wb") as f:
            f.truncate(size)

    def write(self, iterator) -> WriterCommitMessage:
        with open(self.draft, "r+b") as f:
            for row in iterator:
                f.seek(row["at"])
                f.write(bytes(row["bytes"]))
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        os.replace(self.draft, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.draft):
            os.remove(self.draft)


class RangedFile(DataSource):
    """Format `ranged_file`, to write: rows (at, bytes) become one file of `size` bytes on a file system that driver and
    executors mount. Bytes that no row names are 0."""

    @classmethod
    def name(cls) -> str:
        return "ranged_file"

    def schema(self) -> str:
        return "at long, bytes binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Ranges(self.options["path"].removeprefix("file:"), int(self.options["size"]))


def register(spark: SparkSession) -> None:
    for source in (GenotypeInstance, TwoBitGenotypes, RangedFile):
        spark.dataSource.register(source)


def read_instance(spark: SparkSession, path: str, **options: int) -> dict[str, DataFrame]:
    """genotypes(snp_id, ind_id, g), phenotypes(ind_id, y), snps(snp_id, name, chrom, maf), disease(snp_id). A wrong size, a
    dosage beyond 2 and a repeated disease marker are errors. Options: those of GenotypeInstance."""
    register(spark)
    part = lambda p: spark.read.format("genotype_instance").options(part=p, **options).load(path)
    return {p: part(p) for p in ("genotypes", "phenotypes", "snps", "disease")}


def read_bed(spark: SparkSession, path: str, n_inds: int, **options: int) -> DataFrame:
    """snp_id, ind_id, g of a two-bit genotype file: 00 -> 2, 01 -> missing, 10 -> 1, 11 -> 0 copies of the first allele."""
    register(spark)
    return spark.read.format("genotype_two_bit").options(n_inds=n_inds, **options).load(path)


def _placed(genotypes: DataFrame, people: DataFrame, markers: DataFrame, n_inds: int) -> DataFrame:
    """marker, part, calls: dosages (3: missing) of PEOPLE people, by their numbers. Each person must have one call."""
    at = genotypes.join(people, "ind_id").join(markers.select("snp_id", "marker"), "snp_id").withColumn("part", F.floor(F.col("person") / PEOPLE).cast("long"))
    rows = at.groupBy("marker", "part").agg(F.array_sort(F.collect_list(F.struct("person", F.coalesce("g", F.lit(3)).alias("g")))).alias("c"))
    size = F.least(F.lit(PEOPLE), F.lit(n_inds) - F.col("part") * PEOPLE)
    whole = (F.size("c") == size) & (F.size(F.array_distinct(F.transform("c", lambda x: x["person"]))) == size)
    calls = F.transform("c", lambda x: x["g"])
    return rows.select("marker", "part", F.when(whole, calls).otherwise(F.raise_error(F.lit("a marker has no call, or more than one, for some person"))).alias("calls"))


def _numbered(genotypes: DataFrame, phenotypes: DataFrame, snps: DataFrame) -> tuple[DataFrame, int, DataFrame, int]:
    """People (with person) and markers (with marker) numbered from 0 by their ids, and how many."""
    people, a = shared.materialize_and_see(shared.in_order(phenotypes, "ind_id", [], "person"), "people", n=F.count(F.lit(1)))
    markers, b = shared.materialize_and_see(shared.in_order(snps, "snp_id", [], "marker"), "markers", n=F.count(F.lit(1)))
    return people, a["n"], markers, b["n"]


def _write(rows: DataFrame, path: str, size: int) -> None:
    register(rows.sparkSession)
    rows.select(F.col("at").cast("long").alias("at"), "bytes").write.format("ranged_file").mode("overwrite").option("size", size).save(path)


def _packed(values: DataFrame, keys: str, pack) -> DataFrame:
    """`pack` turns a row's array column `calls` into bytes."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pdf.drop(columns="calls").assign(bytes=[pack(np.asarray(v)) for v in pdf["calls"]])

    return values.mapInPandas(run, f"{keys}, bytes binary")


def _byte_each(calls: np.ndarray) -> bytes:
    if len(calls) and (calls.min() < 0 or calls.max() > 2):
        raise ValueError("a dosage is missing or not 0, 1 or 2; the instance file has no code for it")
    return calls.astype(np.uint8).tobytes()


def _two_bits(calls: np.ndarray) -> bytes:
    code = np.array([3, 2, 0, 1], np.uint8)[calls]
    code = np.append(code, np.zeros(-len(code) % 4, np.uint8)).reshape(-1, 4)
    return (code << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def write_bed(genotypes: DataFrame, path: str) -> None:
    """One two-bit file, markers and people in order of their ids; each task writes its rows at their places."""
    people, n_inds, markers, n_snps = _numbered(genotypes, genotypes.select("ind_id").distinct(), genotypes.select("snp_id").distinct())
    width = -(-n_inds // 4)
    rows = _packed(_placed(genotypes, people, markers, n_inds), "marker long, part long", _two_bits)
    rows = rows.select((3 + F.col("marker") * width + F.col("part") * (PEOPLE // 4)).alias("at"), "bytes")
    head = genotypes.sparkSession.createDataFrame([(0, BED)], "at long, bytes binary")
    _write(rows.unionAll(head), path, 3 + n_snps * width)


def write_instance(genotypes: DataFrame, phenotypes: DataFrame, snps: DataFrame, path: str, disease: DataFrame | None = None, quantitative: bool = False) -> None:
    """One instance file of genotypes(snp_id, ind_id, g), phenotypes(ind_id, y), snps(snp_id, name and perhaps chrom, maf) and
    disease(snp_id); markers and people are numbered in order of their ids. Each marker needs one call a person; missing
    dosages, names over 255 bytes and null phenotypes are errors."""
    spark = genotypes.sparkSession
    people, n_inds, markers, n_snps = _numbered(genotypes, phenotypes, snps)
    matrix = _packed(_placed(genotypes, people, markers, n_inds), "marker long, part long", _byte_each)
    matrix = matrix.select((16 + F.col("marker") * n_inds + F.col("part") * PEOPLE).alias("at"), "bytes")
    at = 16 + n_snps * n_inds
    head = [(0, struct.pack("<qq", n_snps, n_inds)), (at, bytes([1 if quantitative else 2]))]
    at += 1
    kind, step = ("<f8", "double") if quantitative else ("<u8", "long")
    y = F.coalesce(F.col("y").cast(step), F.raise_error(F.lit("a phenotype is null")).cast(step))
    rows = people.groupBy(F.floor(F.col("person") / PEOPLE).cast("long").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("person", y.alias("y")))), lambda x: x["y"]).alias("calls"))
    values = _packed(rows, "part long", lambda v: v.astype(kind).tobytes()).select((at + F.col("part") * PEOPLE * 8).alias("at"), "bytes")
    at += 8 * n_inds
    chroms, mafs = "chrom" in snps.columns, "maf" in snps.columns
    head.append((at, bytes([chroms, mafs])))
    at += 2

    def name_bytes(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def short(text: str) -> bytes:
            raw = text.encode()
            if len(raw) > 255:
                raise ValueError(f"more than 255 bytes: {text[:40]}")
            return bytes([len(raw)]) + raw

        for pdf in pdfs:
            out = [b"".join(short(r["name"]) + (short(r["chrom"] or "") if chroms else b"") + (struct.pack("<d", r["maf"]) if mafs else b"") for r in rows) for rows in pdf["rows"]]
            yield pd.DataFrame({"part": pdf["part"], "bytes": out})

    columns = ["marker", "name"] + ["chrom"] * chroms + ["maf"] * mafs
    names = markers.groupBy(F.floor(F.col("marker") / NAMES).cast("long").alias("part")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    names = shared.materialize(names.mapInPandas(name_bytes, "part long, bytes binary"), "names").withColumn("size", F.length("bytes")).withColumn("all", F.lit(0))
    names, seen = shared.materialize_and_see(shared.running_total_in(names, "size", ["all"], "part", ["part"], "before"), "names", n=F.sum("size"))
    names = names.select((at + F.col("before")).alias("at"), "bytes")
    at += seen["n"] or 0
    ill = [] if disease is None else [r[0] for r in disease.join(markers, "snp_id").select("marker").distinct().orderBy("marker").collect()]  # a model's few markers
    head.append((at, struct.pack(f"<{len(ill) + 1}Q", len(ill), *ill)))
    _write(matrix.unionAll(values).unionAll(names).unionAll(spark.createDataFrame(head, "at long, bytes binary")), path, at + 8 * (len(ill) + 1))
