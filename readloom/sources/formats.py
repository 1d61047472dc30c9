"""FASTA, BED, GTF, index, CSV, SAM and VCF text, and sequence archives."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from fnmatch import fnmatch
from typing import BinaryIO

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.columns import fold
from readloom.operators.ordered import ranked
from readloom.sources.files import File, files_of, open_binary, system_of

BED = "chrom string, start_pos bigint, end_pos bigint, name string, score bigint, strand string"
GTF = "chrom string, source string, feature string, left_pos bigint, right_pos bigint, score string, strand string, frame string, attrs string"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq): the whole header and the unwrapped sequence. Plain files are split at records."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>", "")
    return rows.where(F.length(F.trim(body)) > 0).select(
        F.regexp_replace(F.split(body, "\n", 2)[0], "\r$", "").alias("id"),
        F.regexp_replace(F.coalesce(F.get(F.split(body, "\n", 2), F.lit(1)), F.lit("")), r"\s+", "").alias("seq"),
    )


def write_fasta(df: DataFrame, path: str, width: int = 50, compression: str = "gzip") -> None:
    df.select(F.concat(F.lit(">"), "id", F.lit("\n"), fold(F.col("seq"), width)).alias("value")).write.option("compression", compression).text(path)


def in_file_order(df: DataFrame, name: str) -> DataFrame:
    """``name``: the rank of each line, from 1, by file name, split and place in it. Columns _file and _block are used up."""
    return ranked(df, F.col("_file"), F.col("_block"), F.monotonically_increasing_id(), name=name).drop("_file", "_block")


def _place() -> list[Column]:
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED6, plain or gzip; track, browser and comment lines are skipped, a dot is a null."""
    lines = spark.read.text(path).where(~F.col("value").rlike("^(?:track|browser|#)") & (F.col("value") != ""))
    f = F.split("value", "\t", -1)
    cast = {"start_pos": "bigint", "end_pos": "bigint", "score": "bigint"}
    names = [c.split()[0] for c in BED.split(", ")]
    return lines.select(*[F.nullif(F.get(f, F.lit(i)), F.lit(".")).cast(cast.get(n, "string")).alias(n) for i, n in enumerate(names)])


def bed_line() -> Column:
    """The six columns as one line; a null is a dot."""
    return F.concat_ws("\t", *[F.coalesce(F.col(c.split()[0]).cast("string"), F.lit(".")) for c in BED.split(", ")])


def write_bed(df: DataFrame, path: str, compression: str = "gzip", track: tuple[str, str] | None = None) -> None:
    """BED6 in order of chromosome and position; ``track``: name and description of a line that every file begins with."""
    lines = df.orderBy("chrom", "start_pos", "end_pos", "name")
    line = bed_line()
    if track is not None:
        # fixed values of the format: full display, colours of the strands
        head = f'track name={track[0]} description="{track[1]}" visibility=3 colorByStrand="38,139,210 203,75,22"'
        begins = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # first row of a task
        line = F.when(begins, F.concat_ws("\n", F.lit(head), line)).otherwise(line)
    lines.select(line.alias("value")).write.option("compression", compression).text(path)


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns and ``row_id``, the place of the line in file order."""
    rows = spark.read.csv(path, sep="\t", schema=GTF, comment="#", quote="")
    names = [c.split()[0] for c in GTF.split(", ")]
    return in_file_order(rows.select(*names, *_place()), "row_id")


def write_gtf(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """The nine columns as they are, nulls as empty fields; in order of ``row_id`` where there is one."""
    names = [c.split()[0] for c in GTF.split(", ")]
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    ordered = df.orderBy("row_id") if "row_id" in df.columns else df
    ordered.select(line.alias("value")).write.option("compression", compression).text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(f[0].alias("acc"), f[1].cast("bigint").alias("len"))


def read_table(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """CSV with a header; numbers are recognised, headers lowered on demand; quoted cells may hold quotes and line ends."""
    df = spark.read.csv(path, header=True, inferSchema=True, escape='"', multiLine=True)
    return df.toDF(*[c.strip().lower() for c in df.columns]) if lower else df


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """Barcode map without header: (pos, bc, well) in file order."""
    df = spark.read.csv(path, schema="bc string, well string")
    return in_file_order(df.select("bc", "well", *_place()), "pos")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines of SAM text, without the header."""
    return spark.read.text(path).where(~F.col("value").startswith("@"))


def sam_to_bed(sam: DataFrame) -> DataFrame:
    """BED6 of mapped alignments: the reference span from the operations M, D, N, = and X; score is the quality."""
    f = F.split("value", "\t")
    spans = F.regexp_extract_all(f[5], F.lit("([0-9]+)[MDN=X]"), F.lit(1))
    span = F.aggregate(F.transform(spans, lambda x: x.cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    flag = f[1].cast("int")
    start = f[3].cast("bigint") - 1
    return sam.where(flag.bitwiseAND(4) == 0).select(
        f[2].alias("chrom"),
        start.alias("start_pos"),
        (start + span).alias("end_pos"),
        f[0].alias("name"),
        f[4].cast("bigint").alias("score"),
        F.when(flag.bitwiseAND(16) == 0, "+").otherwise("-").alias("strand"),
    )


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt, qual, filter, info, dp: the depths of all samples."""
    f = F.split("value", "\t")
    key = F.array_position(F.split(F.get(f, F.lit(8)), ":"), "DP").cast("int")
    samples = F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0)))
    dp = F.transform(samples, lambda s: F.get(F.split(s, ":"), key - 1).try_cast("int"))
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(
        f[0].alias("chrom"),
        f[1].cast("bigint").alias("pos"),
        f[2].alias("id"),
        f[3].alias("ref"),
        f[4].alias("alt"),
        f[5].try_cast("double").alias("qual"),
        f[6].alias("filter"),
        f[7].alias("info"),
        F.when(key > 0, dp).alias("dp"),
    )


#: Places in a line of the table of known polymorphisms.
_SNP_FIELDS = {"chrom": 1, "start_pos": 2, "end_pos": 3, "name": 4, "strand": 6, "reference": 8, "observed": 9, "class": 11}


def read_snps(spark: SparkSession, path: str) -> DataFrame:
    """The columns that ``aligner_variants`` needs, from tab-separated lines."""
    f = F.split("value", "\t", -1)
    kinds = {"start_pos": "bigint", "end_pos": "bigint"}
    return spark.read.text(path).select(*[F.get(f, F.lit(i)).cast(kinds.get(n, "string")).alias(n) for n, i in _SNP_FIELDS.items()])


def _members(file: File, wanted: Callable[[str], bool]) -> Iterator[tuple[str, BinaryIO]]:
    with open_binary(File(file.path, file.size), plain=True) as raw:
        if file.path.endswith(".zip"):
            with zipfile.ZipFile(raw) as z:
                for name in z.namelist():
                    if wanted(name):
                        with z.open(name) as f:
                            yield name, f
        else:
            with tarfile.open(fileobj=raw, mode="r|*") as t:  # one pass, nothing is kept
                for m in t:
                    if m.isfile() and wanted(m.name):
                        yield m.name, t.extractfile(m)


def _fasta(lines: Iterator[bytes]) -> Iterator[tuple[str, str]]:
    """Records of a FASTA stream; one sequence is held at a time."""
    head, parts = None, []
    for line in lines:
        text = line.decode()
        if text.startswith(">"):
            if head is not None:
                yield head, "".join(parts)
            head, parts = text[1:].rstrip("\r\n"), []
        elif head is not None:
            parts.append("".join(text.split()))
    if head is not None:
        yield head, "".join(parts)


def read_archive(spark: SparkSession, path: str, include: str = "*", exclude: Sequence[str] = ()) -> DataFrame:
    """(member, id, seq): FASTA records of the chosen members of tar, tar.gz or zip archives.

    One task per archive, which streams: it holds one sequence, never a member or the archive.
    """

    def wanted(name: str) -> bool:
        return fnmatch(name, include) and not any(fnmatch(name, e) for e in exclude)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, size in zip(batch["path"], batch["size"]):
                for name, stream in _members(File(p, size), wanted):
                    lines = gzip.open(stream) if name.endswith(".gz") else stream
                    rows, letters = [], 0
                    for head, seq in _fasta(lines):
                        rows.append((name, head, seq))
                        letters += len(seq)
                        if letters > 1 << 24:
                            yield pd.DataFrame(rows, columns=["member", "id", "seq"], dtype=object)
                            rows, letters = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=["member", "id", "seq"], dtype=object)

    files = [(f.path, f.size) for f in files_of(path)]
    listed = spark.createDataFrame(files, "path string, size bigint").repartition(max(1, len(files)))
    return listed.mapInPandas(run, "member string, id string, seq string")


def write_archive(df: DataFrame, path: str, member: str) -> None:
    """A tar.gz archive per task with the records of (id, seq) as one FASTA member ``member``.fa."""
    system, at = system_of(path)
    system.create_dir(at, recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        name = f"{member}-{context.partitionId():05d}.tar.gz"
        store, folder = system_of(path)
        text = "".join(f">{i}\n{s}\n" for b in batches for i, s in zip(b["id"], b["seq"])).encode()
        with store.open_output_stream(f"{folder}/_{context.taskAttemptId()}-{name}", compression=None) as f:
            with tarfile.open(fileobj=f, mode="w|gz") as t:
                info = tarfile.TarInfo(f"{member}.fa")
                info.size = len(text)
                t.addfile(info, io.BytesIO(text))
        store.move(f"{folder}/_{context.taskAttemptId()}-{name}", f"{folder}/{name}")
        yield pd.DataFrame({"n": [len(text)]})

    df.select("id", "seq").mapInPandas(run, "n bigint").agg(F.sum("n")).collect()
