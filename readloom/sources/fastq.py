"""FASTQ and one-line FASTQ: reading with a global order, writing per read or per well."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.operators.reads import restore_fastq
from readloom.sources.files import File, files_of, open_binary, system_of

SCHEMA = "file_no bigint, chunk bigint, file string, n bigint, acc string, seq string, sep string, qual string"
#: Bytes of a plain file that one task reads; compressed files are read whole.
CHUNK = 64 << 20
BATCH = 10_000
#: Bytes looked back at for the line before a chunk; a separator line is shorter.
_SEPARATOR = 1 << 16


@dataclass(frozen=True)
class Chunk:
    file_no: int
    file: File
    start: int
    stop: int


class _Task(InputPartition):
    def __init__(self, chunks: list[Chunk]) -> None:
        super().__init__((chunks[0].file_no, chunks[0].start))
        self.chunks = chunks


def chunks_of(files: Sequence[File], size: int) -> list[Chunk]:
    """Byte ranges of plain files, whole compressed ones."""
    out = []
    for i, f in enumerate(files):
        cuts = range(0, max(f.size, 1), size) if not f.compressed else [0]
        out += [Chunk(i, f, at, f.size if f.compressed else min(at + size, f.size)) for at in cuts]
    return out


def _packed(chunks: list[Chunk], size: int) -> list[_Task]:
    """Small files share a task."""
    tasks: list[list[Chunk]] = []
    room = 0
    for c in chunks:
        own = c.stop - c.start
        if not tasks or own > room:
            tasks.append([])
            room = size
        tasks[-1].append(c)
        room -= own
    return [_Task(t) for t in tasks]


def _records(part: Chunk) -> Iterator[tuple[str, str, str, str]]:
    """Reads that begin within the range; the last one may end behind it.

    In valid FASTQ a line begins a read if it starts with @ and the next but one with +: two lines behind a quality
    line is a sequence, which never does.
    """
    with open_binary(part.file) as f:
        before = b""
        if part.start:
            look_back = max(0, part.start - 1 - _SEPARATOR)
            f.seek(look_back)
            before = f.read(part.start - 1 - look_back).rpartition(b"\n")[2]
            before += f.readline()  # the rest of a line that began before
        at = f.tell() if not part.file.compressed else 0
        ahead: list[bytes] = []

        def line() -> bytes:
            return ahead.pop(0) if ahead else f.readline()

        if part.start:
            while at < part.stop:
                while len(ahead) < 3 and (more := f.readline()):
                    ahead.append(more)
                if len(ahead) == 3 and ahead[0][:1] == b"@" and ahead[2][:1] == b"+":
                    break
                if not ahead:
                    return
                if len(ahead) < 3 and ahead[0][:1] == b"@" and before[:1] != b"+":
                    break  # no quality line: the last read is broken
                before = ahead.pop(0)
                at += len(before)
        while part.file.compressed or at < part.stop:
            four = [line()]
            if not four[0]:
                return
            four += [line() for _ in range(3)]
            at += sum(map(len, four))
            if not four[3]:
                if four[0].strip() == b"" and not four[1]:
                    return  # an empty line at the end
                raise ValueError(f"{part.file.path}: the last read has fewer than four lines")
            yield tuple(x.rstrip(b"\n").removesuffix(b"\r").decode() for x in four)


class _FastqReader(DataSourceReader):
    def __init__(self, files: list[File], size: int) -> None:
        self.files, self.size = files, size

    def partitions(self) -> list[InputPartition]:
        return _packed(chunks_of(self.files, self.size), self.size)

    def read(self, partition: _Task) -> Iterator[pa.RecordBatch]:
        for chunk in partition.chunks:
            records, n = _records(chunk), 0
            while rows := list(islice(records, BATCH)):
                size = len(rows)
                place = [pa.array([x] * size) for x in (chunk.file_no, chunk.start, chunk.file.path)]
                columns = [*place, pa.array(range(n, n + size), pa.int64()), *[pa.array(c, pa.string()) for c in zip(*rows)]]
                n += size
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


class FastqSource(DataSource):
    """``spark.read.format("fastq").load(path)``: four lines per read, plain or gzip.

    Plain files are split into byte ranges of ``chunk`` bytes.  Several paths go into the option ``paths`` as a JSON list.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return _FastqReader(files_of(paths), int(self.options.get("chunk", CHUNK)))


def with_ordinal(df: DataFrame) -> DataFrame:
    """Global, gap-free line order over all files, from the place in the chunk and the sizes of those before it."""
    sizes = df.groupBy("file_no", "chunk").agg(F.count("*").alias("size"))  # a row per chunk
    order = W.orderBy("file_no", "chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("file_no", "chunk", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("before"))
    joined = df.join(F.broadcast(offsets), ["file_no", "chunk"])
    return joined.select((F.col("before") + F.col("n")).alias("ordinal"), "acc", "seq", "sep", "qual", "file")


def read_fastq(spark: SparkSession, paths: str | Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """(ordinal, acc, seq, sep, qual, file), from local, shared or object stores.

    Gzip files cannot be split, so repartition before heavy work.
    """
    spark.dataSource.register(FastqSource)
    listed = json.dumps([paths] if isinstance(paths, str) else list(paths))
    return with_ordinal(spark.read.format("fastq").option("paths", listed).option("chunk", str(chunk)).load())


def read_one_line(spark: SparkSession, path: str) -> DataFrame:
    """One read per line, four tab-separated fields; empty fields stay empty. No order is attached."""
    f = F.split("value", "\t", -1)
    return spark.read.text(path).select(*[F.get(f, F.lit(i)).alias(c) for i, c in enumerate(("acc", "seq", "sep", "qual"))])


def write_one_line(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """Null fields become empty ones."""
    fields = [F.coalesce(c, F.lit("")) for c in ("acc", "seq", "sep", "qual")]
    df.select(F.concat_ws("\t", *fields).alias("value")).write.option("compression", compression).text(path)


def write_fastq(df: DataFrame, path: str, compression: str = "gzip") -> None:
    restore_fastq(df).select("value").write.option("compression", compression).text(path)


def write_demultiplexed(df: DataFrame, path: str, compression: str = "gzip", base: str | None = None) -> None:
    """A folder per well. Hot wells are spread over several files: no well is gathered in one task.

    With ``base`` the files are renamed to BASE.WELL.fq.gz, or BASE.WELL.N.fq.gz where a well has several; joined in
    order of N they are one FASTQ file.
    """
    lines = df.select("well", F.concat_ws("\n", "acc", "seq", "sep", "qual").alias("value"))
    lines.write.partitionBy("well").option("compression", compression).text(path)
    if base is None:
        return
    system, top = system_of(path)
    parts: dict[str, list[str]] = {}
    for file in files_of(path):
        at = system_of(file.path)[1]
        parts.setdefault(os.path.dirname(at), []).append(at)
    for folder, files in parts.items():
        well = unquote(os.path.basename(folder).removeprefix("well="))
        for n, at in enumerate(files, 1):
            name = f"{base}.{well}.fq" if len(files) == 1 else f"{base}.{well}.{n}.fq"
            system.move(at, f"{top}/{name}{'.gz' if at.endswith('.gz') else ''}")
        system.delete_dir(folder)
