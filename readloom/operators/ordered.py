"""Operators that depend on the order of reads, without a single-task window.

``ordinal`` carries the order.  A neighbour is looked up inside blocks of
consecutive ordinals; one summary row per block hands over what crosses its border.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions.columns import read_line
from readloom.session import checkpointed, shuffle_partitions

BLOCK = 1 << 16


def ranked(df: DataFrame, *order: Column, name: str = "rank", keys: Sequence[str] = ()) -> DataFrame:
    """Rows in total order with their rank from 1; sorted by range, never in one task.

    Expressions in ``order`` are evaluated at every comparison; costly ones belong into columns, the ``keys``, which are not returned.
    """
    marked = checkpointed(df.orderBy(*order).drop(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per task
    before = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    joined = marked.withColumn("_part", part).join(F.broadcast(before), "_part")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return joined.withColumn(name, rank.cast("bigint")).drop("_at", "_part", "_before")


def sorted_reads(df: DataFrame) -> DataFrame:
    """Descending by sequence, separator and quality as one string, then by accession."""
    return ranked(df, read_line("seq", "sep", "qual").desc(), F.desc("acc"), F.col("ordinal"))


def index_sorted_reads(df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Ascending from the second blank-separated field of the line on, then by the line; only the columns ``keep``, if given."""
    line = read_line("acc", "seq", "sep", "qual")
    # a tab follows the first value, so the first field ends within it or with it
    first = F.coalesce("acc", "seq", "sep", "qual", F.lit(""))
    n = F.length(F.regexp_extract(first, r"^[^\t\n\f\r ]*", 0))
    # of lines with the same rest, the first fields and the blank behind them have the order of the lines
    rows = df.select(
        *(df.columns if keep is None else keep),
        F.substring(line, n + 1, F.length(line)).alias("_rest"),
        F.substring(line, F.lit(1), n + 1).alias("_field"),
        F.col("ordinal").alias("_ordinal"),
    )
    return ranked(rows, F.col("_rest"), F.col("_field"), F.asc_nulls_last("_ordinal"), keys=["_rest", "_field", "_ordinal"])


def exclude_duplicate_in_order(df: DataFrame, order: str = "ordinal", block: int = BLOCK) -> DataFrame:
    """Drops a read whose sequence equals that of the read before it."""
    reads = df.where(F.col("seq").isNotNull()).withColumn("_block", F.floor(F.col(order) / block))
    last = reads.groupBy("_block").agg(F.max_by("seq", order).alias("_last"))
    carry = last.select("_block", F.lag("_last").over(W.orderBy("_block")).alias("_carry"))  # a row per block
    inside = F.lag("seq").over(W.partitionBy("_block").orderBy(order))
    joined = reads.withColumn("_prev", inside).join(carry, "_block", "left")
    prev = F.coalesce("_prev", "_carry")
    return joined.where(prev.isNull() | (prev != F.col("seq"))).drop("_block", "_prev", "_carry")


def exclude_duplicate(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of sorted reads with one sequence, the first in descending order stays."""
    others = [c for c in df.columns if c not in (*by, "seq")]
    best = F.max_by(
        F.struct(*others), F.struct(read_line("sep", "qual"), F.col("acc"), (-F.col("ordinal")).alias("o"))
    ).alias("_best")
    kept = df.where(F.col("seq").isNotNull()).groupBy(*by, "seq").agg(best)
    return kept.select(*by, "seq", *[F.col("_best")[c].alias(c) for c in others]).select(*df.columns)


def exclude_degenerate(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of sorted reads, drops those that another read (of the same ``by``) strictly extends.

    In sorted order, a sequence that any other extends is extended by the one
    that follows it.  Different sequences are dealt out by range, so no prefix
    and no group of ``by``, however frequent, is in one task; a row at either
    border of a task hands over to the next.
    """
    reads = df.where(F.col("seq").isNotNull())
    keys = [*by, "seq"]
    spark = df.sparkSession
    seqs = reads.select(*keys).distinct().repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    kinds = ", ".join(f"`{c}` {reads.schema[c].dataType.simpleString()}" for c in keys)
    marked = checkpointed(seqs.mapInArrow(_extended, f"{kinds}, _kind string, _part int"))
    # the last row of a task and the first of the next that has any: two rows a task
    border = marked.where("_kind <> 'extended'")
    follower = F.first(F.struct(*keys)).over(W.orderBy("_part", "_kind").rowsBetween(1, 1))
    last = border.withColumn("_next", follower).where("_kind = 'last'")
    same = [F.col(c).eqNullSafe(F.col("_next")[c]) for c in by]
    over = last.where(F.startswith(F.col("_next")["seq"], F.col("seq")))
    for cond in same:
        over = over.where(cond)
    extended = marked.where("_kind = 'extended'").select(*keys).unionByName(over.select(*keys))
    return _join_nulls(reads, extended, keys, "left_anti")


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted different sequences, those that the next one extends; besides the first and the last of the task."""
    part, before = TaskContext.get().partitionId(), None

    def marked(rows: pa.RecordBatch, kind: str) -> pa.RecordBatch:
        n = rows.num_rows
        columns = [*rows.columns, pa.array([kind] * n, pa.string()), pa.array([part] * n, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, "_kind", "_part"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if before is None:
            yield marked(batch.slice(0, 1), "first")
        else:
            batch = pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0]
        seqs = batch.column(batch.schema.get_field_index("seq")).to_pylist()
        hit = [b.startswith(a) for a, b in zip(seqs, seqs[1:])]
        for name in batch.schema.names:
            if name != "seq" and any(hit):
                values = batch.column(batch.schema.get_field_index(name)).to_pylist()
                hit = [h and x == y for h, x, y in zip(hit, values, values[1:])]
        if any(hit):
            yield marked(batch.filter(pa.array([*hit, False])), "extended")
        before = batch.slice(batch.num_rows - 1, 1)
    if before is not None:
        yield marked(before, "last")


def _join_nulls(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join in which null keys equal each other."""
    names = {k: f"_d_{i}" for i, k in enumerate(keys)}
    other = other.select(*[F.col(k).alias(n) for k, n in names.items()])
    return df.join(other, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], how)


def exclude_degenerate_in_order(df: DataFrame, by: Sequence[str], order: str = "ordinal") -> DataFrame:
    """For reads in any order: drops a strict prefix of the read kept last, within each group of ``by``.

    What is kept depends on all that came before, so each group is walked in one task; choose ``by`` such
    that groups are bounded.
    """
    if not by:
        raise ValueError("an unsorted walk needs grouping columns that bound the groups")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        keep, last = [], None
        for seq in group.sort_values(order)["seq"]:
            stays = last is None or len(seq) >= len(last) or not last.startswith(seq)
            keep.append(stays)
            last = seq if stays else last
        return group.sort_values(order)[keep]

    return df.where(F.col("seq").isNotNull()).groupBy(*by).applyInPandas(walk, df.schema)
