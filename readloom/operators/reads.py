"""Row-wise operators on one-line reads: (ordinal, acc, seq, sep, qual, ...).

Each takes and returns a DataFrame, for use with ``.transform``; further
columns pass through.  Reads with a null ``seq`` match no pattern and are
dropped by trimming and matching; annotating leaves them unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.columns import char_class, pinned, read_line

Step = Callable[[DataFrame], DataFrame]

PRIMERS = ("AGATCGGAAGAGCTCGTATGCCGTCTTCTGCTTG", "CTCGTATGCCGTCTTCTGCTTG")
LOW_QUALITIES = '!"#'


def annotate_index(first: int = 7, last: int = 12) -> Step:
    """Appends cycles ``first``..``last`` of the sequence to the end of the whole accession."""
    return lambda df: df.withColumn("acc", F.concat("acc", F.coalesce(F.substring("seq", first, last - first + 1), F.lit(""))))


def annotate_umi(first: int = 1, last: int = 6) -> Step:
    """Appends ':' and the cycles to the first token of the accession; keeps at most one further token."""

    def run(df: DataFrame) -> DataFrame:
        tokens = F.filter(F.split("acc", " "), lambda t: t != "")
        umi = F.substring("seq", first, last - first + 1)
        named = F.concat(F.coalesce(F.get(tokens, F.lit(0)), F.lit("")), F.lit(":"), umi)
        rest = F.when(F.size(tokens) >= 2, F.concat(F.lit(" "), F.get(tokens, F.lit(1)))).otherwise(F.lit(""))
        return df.withColumn("acc", F.when(F.col("seq").isNull(), F.col("acc")).otherwise(F.concat(named, rest)))

    return run


def _cut(df: DataFrame, keep: Column, minimum: int, exempt: Callable[[Column], Column] | None = None) -> DataFrame:
    """Shortens seq and qual to ``keep`` letters; drops what ends up too short, unless exempt by what was cut."""
    rows = pinned(df.where(F.col("seq").isNotNull()), {"_keep": keep})
    good = F.col("_keep") >= max(1, minimum)
    if exempt is not None:
        good = exempt(F.length("seq") - F.col("_keep")) | good
    cut = {c: F.left(c, F.col("_keep")) for c in ("seq", "qual")}
    return pinned(rows.where(good), cut).drop("_keep")


def trim_3end_length(length: int = 1, minimum: int = 40) -> Step:
    return lambda df: _cut(df, F.length("seq") - length, minimum)


def good_length(low: str = LOW_QUALITIES, qual: str = "qual") -> Column:
    """Letters before the first low-quality character."""
    return F.length(F.regexp_extract(qual, "^" + char_class(low, negate=True) + "*", 0))


def trim_3end_quality(low: str = LOW_QUALITIES, minimum: int = 40) -> Step:
    """Cuts at the first low-quality character; the minimum holds for every read."""
    return lambda df: _cut(df, good_length(low), minimum)


def trim_3end(sequence: str, minimum: int = 40) -> Step:
    """Cuts ``sequence`` where a read ends in it; other reads pass. ``is_trimmed`` tells which."""

    def run(df: DataFrame) -> DataFrame:
        hit = F.col("seq").endswith(sequence)
        keep = F.when(hit, F.length("seq") - len(sequence)).otherwise(F.length("seq"))
        return _cut(df.withColumn("is_trimmed", hit), keep, minimum, lambda cut: cut == 0)

    return run


def split_trimmed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trimmed, other) reads of ``trim_3end``, for two sinks."""
    return df.where("is_trimmed").drop("is_trimmed"), df.where("not is_trimmed").drop("is_trimmed")


def primer_fragments(primers: Sequence[str]) -> tuple[list[str], int]:
    """Primer prefixes to look for, longest first, and the length cut without looking (0: none).

    When all 4 ** L prefixes of a length L exist, any read end is one of them.
    """
    by_length: dict[int, set[str]] = {}
    for primer in primers:
        for i in range(1, len(primer) + 1):
            by_length.setdefault(i, set()).add(primer[:i])
    out: list[str] = []
    for length in sorted(by_length, reverse=True):
        if len(by_length[length]) == 4**length:
            return out, length
        out += sorted(by_length[length], reverse=True)
    return out, 0


def primer_cut(primers: Sequence[str], seq: Column) -> Column:
    """Letters to cut at the 3' end.

    Suffix tests on bytes, longest first; several times faster here than a regular expression.
    """
    fragments, always = primer_fragments(primers)
    cut = F.lit(always)
    if fragments:
        chain = F.when(seq.endswith(fragments[0]), len(fragments[0]))
        for f in fragments[1:]:
            chain = chain.when(seq.endswith(f), len(f))
        cut = chain.otherwise(always)
    return cut


def trim_3end_primer(primers: Sequence[str] = PRIMERS, minimum: int = 40) -> Step:
    """Cuts the longest read suffix that is a prefix of a primer; reads without one pass."""
    keep = F.length("seq") - primer_cut(primers, F.col("seq"))
    return lambda df: _cut(df, keep, minimum, lambda cut: cut == 0)


def trim_5end(pattern: str, minimum: int = 24) -> Step:
    """Cuts a prefix matching ``pattern``; reads that do not match pass without a length check.

    Alternations take the first branch that matches, not the longest.
    """
    anchored = f"^(?:{pattern})"

    def run(df: DataFrame) -> DataFrame:
        hit = F.col("seq").rlike(anchored)
        start = F.length(F.regexp_extract("seq", anchored, 0)) + 1
        short = F.length("seq") - start + 1 < minimum
        return df.where(F.col("seq").isNotNull() & ~(hit & short)).withColumns(
            {c: F.when(hit, F.substr(c, start)).otherwise(F.col(c)) for c in ("seq", "qual")}
        )

    return run


def match_5end(pattern: str, invert: bool = False, whole_line: bool = False) -> Step:
    """Reads whose sequence begins with ``pattern``; ``whole_line`` lets it run on into the next fields."""
    target = read_line("seq", "sep", "qual") if whole_line else F.col("seq")
    hit = target.rlike(f"^(?:{pattern})")
    return lambda df: df.where(F.col("seq").isNotNull() & (~hit if invert else hit))


def match_3end(pattern: str, invert: bool = False) -> Step:
    hit = F.col("seq").rlike(rf"(?:{pattern})\z")
    return lambda df: df.where(F.col("seq").isNotNull() & (~hit if invert else hit))


def slice_reads(nth: int, of: int) -> Step:
    return lambda df: df.where(F.col("ordinal") % of == nth - 1)


def thin_out(draw: int, skip: int) -> Step:
    return lambda df: df.where(F.col("ordinal") % (draw + skip) < draw)


def head_reads(n: int) -> Step:
    return lambda df: df.where(F.col("ordinal") < n)


def without_n() -> Step:
    return lambda df: df.where(~F.col("seq").contains("N"))


def restore_fastq(df: DataFrame) -> DataFrame:
    """One string of four lines per read."""
    return df.select("ordinal", F.concat_ws("\n", "acc", "seq", "sep", "qual").alias("value"))
