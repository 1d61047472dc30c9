"""Several values packed in one cell: one row per value, with its place in the cell.

Quoted spans are taken out first and replaced by indexed placeholders made of
two private-use characters; as those characters are separators in the
remaining text, and are blanked there before, no placeholder can collide with
cell content.  The rest is split at everything that is not a value character,
placeholders are turned back through an array lookup, and the values are
exploded with their positions.  All of it stays in JVM expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "\ue000", "\ue001"
#: Possessive, so that it neither backtracks nor recurses on very long cells.
QUOTED = "\"[^\"]*+(?:\"\"[^\"]*+)*+\"|'[^']*+(?:''[^']*+)*+'"


def split_packed(
    df: DataFrame,
    cell: str,
    keep: Sequence[str],
    *,
    value_chars: str = r"A-Za-z0-9_.\-",
    position: str = "item_pos",
    item: str = "item",
) -> DataFrame:
    """One row per value of ``cell``: the columns ``keep``, its position from 1, the value.

    A value is a run of ``value_chars`` or the content of a quoted span (a
    quote doubled inside stands for itself).  Everything else separates.

    Defined results: null, empty and separator-only cells give no row; empty
    values, quoted or not, take no position; a quote without a partner
    separates; equal values in a cell and equal cells are all kept.  Only the
    columns in ``keep`` are carried, under their own names, so further columns
    of the table cannot clash with the two new ones.
    """
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    work = df.select(*kept, F.col(f"`{cell}`").cast("string").alias("cell"))
    work = work.select(
        *[f"k{i}" for i in range(len(keep))],
        F.regexp_extract_all("cell", F.lit(f"({QUOTED})"), 1).alias("spans"),
        F.split("cell", QUOTED, -1).alias("rest"),
    )
    plain = F.transform(
        "rest",
        lambda part, i: F.concat(
            F.regexp_replace(part, f"[{OPEN}{CLOSE}]", " "),
            F.when(i < F.size("rest") - 1, F.concat(F.lit(f" {OPEN}"), i.cast("string"), F.lit(f"{CLOSE} "))).otherwise(
                F.lit("")
            ),
        ),
    )
    tokens = F.split(F.array_join(plain, ""), f"[^{value_chars}{OPEN}{CLOSE}]+", -1)
    restored = F.transform(
        tokens,
        lambda t: F.when(
            t.startswith(OPEN),
            F.transform(
                F.array(F.get("spans", F.substring(t, 2, 10).substr(F.lit(1), F.length(t) - 2).cast("int"))),
                lambda s: F.when(
                    s.startswith('"'), F.replace(s.substr(F.lit(2), F.length(s) - 2), F.lit('""'), F.lit('"'))
                ).otherwise(F.replace(s.substr(F.lit(2), F.length(s) - 2), F.lit("''"), F.lit("'"))),
            )[0],
        ).otherwise(t),
    )
    values = F.filter(restored, lambda t: t != "")
    return work.select(*[f"k{i}" for i in range(len(keep))], F.posexplode(values).alias("p", "v")).select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        (F.col("p") + 1).cast("bigint").alias(position),
        F.col("v").alias(item),
    )
