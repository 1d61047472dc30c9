"""BAM as a data source: BED6 columns, flag and the NH tag of every mapped alignment."""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from typing import BinaryIO

import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.sources.files import File, files_of, open_binary, system_of

SCHEMA = "file string, chrom string, start_pos bigint, end_pos bigint, name string, score bigint, strand string, flag int, nh int"
#: Fixed values of the format: operations that advance on the reference, and the sizes of tag values.
_ON_REFERENCE = {0, 2, 3, 7, 8}
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
#: Compressed bytes that one task reads.
CHUNK = 64 << 20
_CODES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}


def _nh(data: bytes, at: int) -> int | None:
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            at = data.index(b"\0", at) + 1
        elif kind == "B":
            (count,) = struct.unpack_from("<I", data, at + 1)
            at += 5 + count * _SIZES[chr(data[at])]
        else:
            if tag == b"NH" and kind in _CODES:
                return struct.unpack_from(_CODES[kind], data, at)[0]
            at += _SIZES[kind]
    return None


def _header(read: Callable[[int], bytes], path: str) -> tuple[list[str], int]:
    """Names of the references, and the length of the header before compression."""
    if read(4) != b"BAM\1":
        raise ValueError(f"{path} is not a BAM file")
    (size,) = struct.unpack("<i", read(4))
    read(size)
    (count,) = struct.unpack("<i", read(4))
    refs, length = [], 12 + size
    for _ in range(count):
        (size,) = struct.unpack("<i", read(4))
        refs.append(read(size)[:-1].decode())
        read(4)
        length += 8 + size
    return refs, length


def _alignment(data: bytes, refs: list[str], path: str) -> tuple | None:
    """The row of a record, None if it is not mapped."""
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", data)
    if flag & 4 or ref < 0:
        return None
    name = data[32 : 32 + l_name - 1].decode()
    at = 32 + l_name
    cigar = struct.unpack_from(f"<{n_cigar}I", data, at)
    span = sum(c >> 4 for c in cigar if c & 15 in _ON_REFERENCE)
    nh = _nh(data, at + 4 * n_cigar + (l_seq + 1) // 2 + l_seq)
    return path, refs[ref], pos, pos + span, name, mapq, "-" if flag & 16 else "+", flag, nh


def _block_size(head: bytes) -> int:
    """Bytes of the compressed block that begins with ``head``; 0 if none begins there."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    (extra,) = struct.unpack_from("<H", head, 10)
    at, end = 12, min(12 + extra, len(head) - 5)
    while at <= end - 4:
        (size,) = struct.unpack_from("<H", head, at + 2)
        if head[at : at + 2] == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def _first_block(f: BinaryIO, start: int) -> int | None:
    """Where the first block at or behind ``start`` begins: one that another block or the end of the file follows."""
    f.seek(start)
    data = f.read(3 << 16)  # a block has at most 1 << 16 bytes
    at = data.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        if size := _block_size(data[at : at + 64]):
            behind = data[at + size : at + size + 64]
            if _block_size(behind) or (not behind and len(data) < 3 << 16):
                return start + at
        at = data.find(b"\x1f\x8b\x08\x04", at + 1)
    return None


class _Stream:
    """Decompressed blocks from one on; those that begin before ``stop`` are the task's own."""

    def __init__(self, f: BinaryIO, first: int, stop: int) -> None:
        self.f, self.next, self.stop = f, first, stop
        self.buffer = bytearray()
        self.at = self.own = 0

    def more(self) -> bool:
        self.f.seek(self.next)
        head = self.f.read(64)
        if not (size := _block_size(head)):
            return False
        raw = head[:size] + self.f.read(max(0, size - len(head)))
        (extra,) = struct.unpack_from("<H", raw, 10)
        self.buffer += zlib.decompress(raw[12 + extra : size - 8], wbits=-15)
        if self.next < self.stop:
            self.own = len(self.buffer)
        self.next += size
        return True

    def has(self, size: int) -> bool:
        while len(self.buffer) - self.at < size:
            if not self.more():
                return False
        return True

    def on_own(self) -> bool:
        """Whether the next byte is in a block of the task's own."""
        while self.at >= self.own:
            if self.next >= self.stop or not self.more():
                return False
        return True

    def drop(self) -> None:
        if self.at > 1 << 20:
            del self.buffer[: self.at]
            self.own -= self.at
            self.at = 0


def _looks_like_record(s: _Stream, at: int, refs: int) -> int:
    """Bytes of the record that may begin at a place of the buffer; 0 if none does."""
    if len(s.buffer) - at < 36:
        return 0
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos = struct.unpack_from("<iiiBBHHHiii", s.buffer, at)
    if not (-1 <= ref < refs and -1 <= next_ref < refs and pos >= -1 and next_pos >= -1 and l_name and l_seq >= 0):
        return 0
    if 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > size or size > 1 << 28:
        return 0
    name = s.buffer[at + 36 : at + 36 + l_name]
    if name[-1:] != b"\0" and len(name) == l_name or not all(32 < c < 127 for c in name[: l_name - 1]):
        return 0
    return 4 + size


def _to_first_record(s: _Stream, refs: int) -> bool:
    """Moves to the first place from which whole records follow one another; no record begins before it."""
    while s.on_own():
        s.has(1 << 18)
        at, chain = s.at, 0
        while chain < 20 and (size := _looks_like_record(s, at, refs)):
            at, chain = at + size, chain + 1
            if at >= len(s.buffer):
                break
        if chain and (chain >= 20 or at >= len(s.buffer) or len(s.buffer) - at < 36):
            return True
        s.at += 1
    return False


def _split_alignments(file: File, start: int, stop: int) -> Iterator[tuple]:
    """Alignments whose records begin in the blocks that begin within the range."""
    with open_binary(file) as raw:
        with gzip.open(open_binary(file), "rb") as whole:
            refs, length = _header(whole.read, file.path)
        first = 0 if start == 0 else _first_block(raw, start)
        if first is None or first >= stop:
            return
        s = _Stream(raw, first, stop)
        if start == 0:
            if not s.has(length):
                raise ValueError(f"{file.path}: the header is incomplete")
            s.at = length
        elif not _to_first_record(s, len(refs)):
            return
        while s.on_own():
            if not s.has(4):
                raise ValueError(f"{file.path}: the last record is incomplete")
            (size,) = struct.unpack_from("<i", s.buffer, s.at)
            if not s.has(4 + size):
                raise ValueError(f"{file.path}: the last record is incomplete")
            row = _alignment(bytes(s.buffer[s.at + 4 : s.at + 4 + size]), refs, file.path)
            s.at += 4 + size
            s.drop()
            if row is not None:
                yield row


def read_alignments(file: File) -> Iterator[tuple]:
    """All alignments of a file that is not made of blocks."""
    with open_binary(file) as raw, gzip.open(raw, "rb") as f:
        refs, _ = _header(f.read, file.path)
        while head := f.read(4):
            row = _alignment(f.read(struct.unpack("<i", head)[0]), refs, file.path)
            if row is not None:
                yield row


class _Range(InputPartition):
    def __init__(self, no: int, file: File, start: int, stop: int | None) -> None:
        super().__init__((no, start))
        self.file, self.start, self.stop = file, start, stop


class _BamReader(DataSourceReader):
    def __init__(self, files: list[File], size: int) -> None:
        self.files, self.size = files, size

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for i, f in enumerate(self.files):
            with open_binary(f) as raw:
                blocks = _block_size(raw.read(64))
            if blocks:
                out += [_Range(i, f, at, min(at + self.size, f.size)) for at in range(0, f.size, self.size)]
            else:
                out.append(_Range(i, f, 0, None))
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        whole = partition.stop is None
        rows = read_alignments(partition.file) if whole else _split_alignments(partition.file, partition.start, partition.stop)
        fields = [c.split() for c in SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
        while part := list(islice(rows, 10_000)):
            columns = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*part), fields)]
            yield pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``: blocks of a file are split into byte ranges of ``chunk`` bytes.

    Several paths go into the option ``paths`` as a JSON list.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return _BamReader(files_of(paths), int(self.options.get("chunk", CHUNK)))


def read_bam(spark: SparkSession, path: str | Sequence[str], unique: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Mapped alignments; ``unique`` leaves out those whose NH tag tells of several hits."""
    spark.dataSource.register(BamSource)
    listed = json.dumps([path] if isinstance(path, str) else list(path))
    df = spark.read.format("bam").option("paths", listed).option("chunk", str(chunk)).load()
    return df.where(F.coalesce("nh", F.lit(1)) < 2) if unique else df


def bam_bytes(references: Sequence[tuple[str, int]], alignments: Sequence[tuple[str, int, int, int, int, int]]) -> bytes:
    """A compressed BAM file without bases; alignments are (name, reference number, position, length, flag, hits)."""
    out = [b"BAM\1", struct.pack("<ii", 0, len(references))]
    for name, length in references:
        out += [struct.pack("<i", len(name) + 1), name.encode(), b"\0", struct.pack("<i", length)]
    for name, ref, pos, length, flag, hits in alignments:
        own = name.encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(own), 60, 0, 1, flag, 0, -1, -1, 0)
        body += own + struct.pack("<I", length << 4) + b"NHi" + struct.pack("<i", hits)
        out += [struct.pack("<i", len(body)), body]
    return blocks_of(b"".join(out))


def blocks_of(data: bytes, size: int = 60_000) -> bytes:
    """Compressed blocks with their length in an extra field, and the empty one at the end."""
    out = []
    for at in [*range(0, len(data), size), len(data)]:
        part = data[at : at + size]
        deflate = zlib.compressobj(wbits=-15)
        body = deflate.compress(part) + deflate.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def write_bam(df: DataFrame, path: str) -> None:
    """A BAM file per task from (name, chrom, start_pos, length, flag, hits), without bases, in a folder all executors share."""
    system, at = system_of(path)
    system.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("name", "chrom", "start_pos", "length", "flag", "hits")))]
        chroms = sorted({r[1] for r in rows})
        number = {c: i for i, c in enumerate(chroms)}
        data = bam_bytes([(c, (1 << 31) - 1) for c in chroms], [(n, number[c], s, size, flag, hits) for n, c, s, size, flag, hits in rows])
        name = f"part-{context.partitionId():05d}.bam"
        store, folder = system_of(path)
        # written under the name of the attempt, then renamed: a task that runs again leaves one file
        with store.open_output_stream(f"{folder}/_{context.taskAttemptId()}-{name}") as f:
            f.write(data)
        store.move(f"{folder}/_{context.taskAttemptId()}-{name}", f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    df.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
