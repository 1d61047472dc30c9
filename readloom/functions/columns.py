"""Column expressions on sequences, intervals and annotations; all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAB = "\t"


def reverse_complement(seq: Column) -> Column:
    """Complement of A, C, G, T in either case, read backwards; other letters stay."""
    return F.translate(F.reverse(seq), "acgtACGT", "tgcaTGCA")


def seq_length(seq: Column) -> Column:
    return F.length(seq).cast("bigint")


def ieee_div(n: Column, d: Column) -> Column:
    """Float division where a zero divisor gives infinity or NaN instead of an error."""
    n, d = n.cast("double"), d.cast("double")
    by_zero = (
        F.when(n == 0, F.lit(float("nan"))).when(n < 0, F.lit(float("-inf"))).when(n > 0, F.lit(float("inf")))
    )
    return F.when(d == 0, by_zero).otherwise(F.try_divide(n, d))


def five_prime_start(start: Column, end: Column, strand: Column) -> Column:
    """Start of the one-base interval at the 5' end of a half-open interval."""
    return F.when(strand == "+", start).otherwise(end - 1)


def gtf_attribute(attrs: Column, name: str) -> Column:
    """Quoted attribute; null when it is absent."""
    return F.nullif(F.regexp_extract(attrs, name + r' "([^"]+)"', 1), F.lit(""))


def gtf_number(attrs: Column, name: str) -> Column:
    """Unquoted number; 0 when it is absent."""
    return F.coalesce(F.regexp_extract(attrs, name + r" (\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def first_token(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*(\S*)", 1)


def fold(seq: Column, width: int = 50) -> Column:
    """Lines of ``width`` letters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def char_class(chars: str, negate: bool = False) -> str:
    """A regular-expression class of exactly these characters."""
    return f"[{'^' if negate else ''}{re.sub(r'([\]\[\\^&~-])', r'\\\1', chars)}]"


def read_line(*fields: str) -> Column:
    return F.concat_ws(TAB, *[F.col(f) for f in fields])


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds or replaces columns that are computed once.

    Projections are merged by the optimizer, which repeats a costly expression at every use above it; a
    generator of one row is not merged.
    """
    once = F.inline(F.array(F.struct(*[c.alias(f"_pin_{n}") for n, c in columns.items()])))
    wide = df.select("*", once)
    names = [*df.columns, *[n for n in columns if n not in df.columns]]
    return wide.select(*[F.col(f"_pin_{n}").alias(n) if n in columns else F.col(f"`{n}`") for n in names])
