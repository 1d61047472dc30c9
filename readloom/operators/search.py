"""Pattern search on both strands of sequences, and sequences in pieces of bounded length."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import shuffle_partitions

#: Letters of a sequence that one row holds; longer sequences are cut.
WINDOW = 1 << 20
BED = "chrom string, start_pos bigint, end_pos bigint, name string, score bigint, strand string"
_COMPLEMENT = str.maketrans("acgtACGT", "tgcaTGCA")


def longest_match(pattern: str) -> int | None:
    """Letters of the longest possible match; None if there is no bound or a match depends on what is around it."""
    parser = re._parser
    parsed = parser.parse(pattern)
    longest = parsed.getwidth()[1]

    def looks_around(items) -> bool:
        for op, arg in items:
            if str(op) in ("AT", "ASSERT", "ASSERT_NOT"):
                return True
            for part in arg if isinstance(arg, (tuple, list)) else [arg]:
                parts = part if isinstance(part, list) else [part]
                if any(looks_around(p) for p in parts if isinstance(p, parser.SubPattern)):
                    return True
        return False

    return None if longest >= WINDOW or looks_around(parsed) else longest


def pieces(df: DataFrame, size: int = WINDOW, margin: int = 0) -> DataFrame:
    """id, n, at, core, seq: consecutive pieces of each sequence, with up to ``margin`` letters more on either side.

    ``at`` is where the core of ``core`` letters begins in the sequence, ``n`` the letters of it before the core in
    ``seq``.  Null sequences have no piece.
    """

    kinds = [pa.int64()] * 3 + [pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, letters = batch.column(0), [], 0

            def ready() -> pa.RecordBatch:
                owners, *columns = zip(*rows)
                arrays = [ids.take(pa.array(owners)), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
                return pa.RecordBatch.from_arrays(arrays, names=["id", "n", "at", "core", "seq"])

            for i, seq in enumerate(batch.column(1).to_pylist()):
                for at in range(0, len(seq) if seq else 0, size):
                    before, core = min(margin, at), min(size, len(seq) - at)
                    rows.append((i, before, at, core, seq[at - before : at + size + margin]))
                    letters += core
                    if letters >= WINDOW:
                        yield ready()
                        rows, letters = [], 0
            if rows:
                yield ready()

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "seq").mapInArrow(cut, f"id {kind}, n bigint, at bigint, core bigint, seq string")


def _finder(pattern: str, name: str, ignore_case: bool):
    """BED rows of (id, n, at, core, seq): matches that begin, in the direction of their strand, in the core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = re.compile(f"(?=({pattern}))", re.DOTALL | (re.IGNORECASE if ignore_case else 0))
        for batch in batches:
            chroms, starts, ends, strands = [], [], [], []
            for chrom, n, at, core, seq in zip(*(batch.column(c).to_pylist() for c in range(5))):
                found = [(at + m.start() - n, at + m.end(1) - n, "+") for m in look.finditer(seq, n) if m.start() < n + core and m.end(1) > m.start()]
                stop = len(seq) - (n + core)  # letters behind the core come first on the other strand
                turned = seq.translate(_COMPLEMENT)[::-1]
                end = at - n + len(seq)
                found += [(end - m.end(1), end - m.start(), "-") for m in look.finditer(turned, stop) if m.start() < stop + core and m.end(1) > m.start()]
                for s, e, strand in found:
                    chroms.append(chrom)
                    starts.append(s)
                    ends.append(e)
                    strands.append(strand)
            size = len(chroms)
            columns = [pa.array(chroms, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array([name] * size, pa.string())]
            columns += [pa.array([0] * size, pa.int64()), pa.array(strands, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BED.split(", ")])

    return run


def find_fragments(df: DataFrame, pattern: str, name: str | None = None, ignore_case: bool = True, window: int = WINDOW) -> DataFrame:
    """BED rows of ``pattern`` in (id, seq): overlapping hits, one per start and strand.

    A look-ahead tries every position; only hits leave the worker.  Sequences
    of more than ``window`` letters are cut into windows that overlap by the
    longest possible match and are dealt out over the tasks; they are searched
    whole where a match has no bound or depends on what is around it.
    Back-references count from 2; matches without letters are not reported,
    nor is anything in null sequences.
    """
    search = _finder(pattern, pattern if name is None else name, ignore_case)
    longest = longest_match(pattern)
    rows = df.select(F.col("id").cast("string").alias("id"), "seq").where("seq is not null")
    whole = rows if longest is None else rows.where(F.length("seq") <= window)
    zero = F.lit(0).cast("bigint")
    found = whole.select("id", zero.alias("n"), zero.alias("at"), F.length("seq").cast("bigint").alias("core"), "seq").mapInArrow(search, BED)
    if longest is None:
        return found
    long = pieces(rows.where(F.length("seq") > window), window, max(0, longest - 1))
    return found.unionByName(long.repartition(shuffle_partitions(df.sparkSession), "id", "at").mapInArrow(search, BED))
