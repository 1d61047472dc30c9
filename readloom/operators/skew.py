"""Per-key results when a few keys hold most of the rows: multi-level tree aggregation.

Input rows are cut into fixed-size chunks where they are read; a chunk's
partial states carry a leaf number of a tree with ``fan_in`` children per
node.  Each round merges the states of ``fan_in`` sibling nodes, so a key that
occurs in every chunk is merged by log(leaves) rounds of bounded fan-in
instead of by one reducer that receives all partial states.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.session import shuffle_partitions

CHUNK_ROWS = 1 << 16
FAN_IN = 8


@dataclass(frozen=True)
class Agg:
    """One mergeable aggregate: ``kind`` of count, sum, min, max, mean, approx_distinct."""

    name: str
    kind: str
    column: str | None = None


_FIRST = {
    "count": lambda c: {"n": F.count(F.lit(1) if c is None else c)},
    "sum": lambda c: {"s": F.sum(c)},
    "min": lambda c: {"m": F.min(c)},
    "max": lambda c: {"m": F.max(c)},
    "mean": lambda c: {"s": F.sum(c.cast("double")), "n": F.count(c)},
    "approx_distinct": lambda c: {"h": F.hll_sketch_agg(c.cast("string"))},
}
_MERGE = {
    ("count", "n"): F.sum,
    ("sum", "s"): F.sum,
    ("min", "m"): F.min,
    ("max", "m"): F.max,
    ("mean", "s"): F.sum,
    ("mean", "n"): F.sum,
    ("approx_distinct", "h"): F.hll_union_agg,
}
_STATES = {"count": "n", "sum": "s", "min": "m", "max": "m", "mean": "sn", "approx_distinct": "h"}


def _final(kind: str, state: dict[str, Column]) -> Column:
    if kind == "mean":
        return F.when(state["n"] > 0, state["s"] / state["n"])
    if kind == "approx_distinct":
        return F.coalesce(F.hll_sketch_estimate(state["h"]), F.lit(0).cast("bigint"))
    return next(iter(state.values()))


def tree_levels(leaves: int, fan_in: int = FAN_IN) -> int:
    """Rounds needed so that ``fan_in ** rounds`` nodes cover ``leaves``; at least one."""
    levels = 1
    while fan_in**levels < leaves:
        levels += 1
    return levels


def tree_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Sequence[Agg],
    *,
    chunk_rows: int = CHUNK_ROWS,
    fan_in: int = FAN_IN,
    levels: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Aggregates per key, merged through a tree of bounded fan-in.

    The tree has as many rounds as the number of chunks asks for, so that a
    node never merges more than about ``fan_in`` partial states of a key;
    ``rows`` saves the count where it is known.

    Defined results: rows with a null key form the group of the null key;
    null values are ignored by every aggregate but ``count`` without a column;
    a group with only nulls gives null (0 for counts and distinct counts);
    repeated rows count each time; an empty table gives an empty result.
    Columns that are neither key nor aggregated are not read, so their names
    cannot clash with anything.
    """
    if fan_in < 2 or chunk_rows < 1:
        raise ValueError("fan_in must be at least 2 and chunk_rows at least 1")
    if levels is None:
        chunks = -(-(df.count() if rows is None else rows) // chunk_rows)
        levels = tree_levels(max(chunks, shuffle_partitions(df.sparkSession)), fan_in)
    key_cols = [f"k{i}" for i in range(len(keys))]
    row = F.monotonically_increasing_id()
    chunk = F.struct(F.shiftright(row, 33), F.floor(row.bitwiseAND((1 << 33) - 1) / chunk_rows))
    work = df.select(
        *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, key_cols)],
        *[F.col(f"`{a.column}`").alias(f"v{i}") for i, a in enumerate(aggs) if a.column is not None],
        F.pmod(F.xxhash64(chunk), F.lit(fan_in**levels)).alias("leaf"),
    )
    first = [
        expr.alias(f"a{i}{s}")
        for i, a in enumerate(aggs)
        for s, expr in _FIRST[a.kind](None if a.column is None else F.col(f"v{i}")).items()
    ]
    merge = [_MERGE[a.kind, s](f"a{i}{s}").alias(f"a{i}{s}") for i, a in enumerate(aggs) for s in _STATES[a.kind]]
    work = work.groupBy(*key_cols, "leaf").agg(*first)
    for level in range(levels):
        last = level == levels - 1
        node = [] if last else [F.floor(F.col("leaf") / fan_in).alias("leaf")]
        work = work.groupBy(*key_cols, *node).agg(*merge)
    return work.select(
        *[F.col(n).alias(k) for k, n in zip(keys, key_cols)],
        *[
            _final(a.kind, {s: F.col(f"a{i}{s}") for s in _STATES[a.kind]}).alias(a.name)
            for i, a in enumerate(aggs)
        ],
    )


def share_threshold(share: float | str, total: int) -> int:
    """Smallest whole count that makes up at least ``share`` of ``total`` rows."""
    exact = Fraction(str(share)) * total
    return max(1, -(-exact.numerator // exact.denominator))


def heavy_keys(df: DataFrame, key: str, share: float = 0.05, **tree) -> DataFrame:
    """Non-null keys holding at least ``share`` of all rows, with their row counts."""
    total = df.count()
    least = share_threshold(share, total)
    keys = df.select(F.col(f"`{key}`").cast("string").alias("key_value"))
    counts = tree_aggregate(keys, ["key_value"], [Agg("rows", "count")], **{"rows": total, **tree})
    return counts.where(F.col("key_value").isNotNull() & (F.col("rows") >= least))
