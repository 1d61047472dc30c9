"""Continuous stretches of closed integer intervals per entity, and the gaps between them.

The state per entity is an ordered map of disjoint stretches.  An insertion
finds the stretches it overlaps or adjoins by binary search and replaces them
by their union.  The map is kept twice:

1. where rows are read, bounded by ``state_rows`` entries and flushed when full
   (union is associative), so repeated and overlapping rows never travel;
2. after a range partitioning by (entity, left), one map at a time per task.
   An entity with most of the rows spans many tasks this way.

Stretches that continue over a border between tasks are joined by means of one
summary row per entity and task: at most two per task can belong to an entity
that spans tasks, so this table is bounded by the number of partitions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.session import checkpointed, shuffle_partitions

STATE_ROWS = 1 << 18


class IntervalMap:
    """Disjoint closed intervals in order, neighbours that adjoin being one, and the gaps between them.

    Gap i lies between stretches i and i + 1.
    """

    __slots__ = ("gap_lefts", "gap_rights", "lefts", "rights")

    def __init__(self, lefts: Iterable[int] = (), rights: Iterable[int] = ()) -> None:
        self.lefts, self.rights = list(lefts), list(rights)
        self.gap_lefts = [r + 1 for r in self.rights[:-1]]
        self.gap_rights = [left - 1 for left in self.lefts[1:]]

    def add(self, left: int, right: int) -> None:
        lefts, rights = self.lefts, self.rights
        if not lefts or left > rights[-1] + 1:  # behind all others
            if lefts:
                self.gap_lefts.append(rights[-1] + 1)
                self.gap_rights.append(left - 1)
            lefts.append(left)
            rights.append(right)
            return
        first = bisect_left(rights, left - 1)
        last = bisect_right(lefts, right + 1)
        if first < last:
            if lefts[first] <= left and right <= rights[first]:  # nested
                return
            left, right = min(left, lefts[first]), max(right, rights[last - 1])
        lefts[first:last], rights[first:last] = [left], [right]
        # the gaps before, within and behind the new stretch give way to at most two
        fresh = [(rights[first - 1] + 1, left - 1)] if first else []
        if first + 1 < len(lefts):
            fresh.append((right + 1, lefts[first + 1] - 1))
        begin = max(first - 1, 0)
        self.gap_lefts[begin:last] = [g[0] for g in fresh]
        self.gap_rights[begin:last] = [g[1] for g in fresh]

    def take_front(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Removes and returns all stretches but the last, and all gaps."""
        done = list(zip(self.lefts[:-1], self.rights[:-1])), list(self.gaps())
        del self.lefts[:-1], self.rights[:-1]
        self.gap_lefts.clear()
        self.gap_rights.clear()
        return done

    def stretches(self) -> Iterator[tuple[int, int]]:
        return zip(self.lefts, self.rights)

    def gaps(self) -> Iterator[tuple[int, int]]:
        return zip(self.gap_lefts, self.gap_rights)

    def __len__(self) -> int:
        return len(self.lefts)


def _local(state_rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[object, IntervalMap] = {}

        def flush() -> pd.DataFrame:
            rows = [(e, l, r) for e, m in state.items() for l, r in m.stretches()]
            state.clear()
            return pd.DataFrame(rows, columns=["e", "l", "r"])

        for batch in batches:
            for e, l, r in zip(batch["e"], batch["l"].tolist(), batch["r"].tolist()):
                m = state.get(e)
                if m is None:
                    m = state[e] = IntervalMap()
                m.add(l, r)
            if sum(map(len, state.values())) >= state_rows:
                yield flush()
        if state:
            yield flush()

    return run


def _ordered(batches: Iterator[pd.DataFrame], state_rows: int = 1 << 14) -> Iterator[pd.DataFrame]:
    """Rows come sorted by entity and left end; emits stretches and the gaps between them."""
    part = TaskContext.get().partitionId()
    entity, m, out = None, None, []

    def keep(stretches, gaps) -> None:
        out.extend((part, entity, "merged", l, r) for l, r in stretches)
        out.extend((part, entity, "gap", l, r) for l, r in gaps)

    def frame() -> pd.DataFrame:
        ready = pd.DataFrame(out, columns=["part", "e", "kind", "l", "r"])
        out.clear()
        return ready

    for batch in batches:
        for e, l, r in zip(batch["e"], batch["l"].tolist(), batch["r"].tolist()):
            if m is None or e != entity:
                if m is not None:
                    keep(m.stretches(), m.gaps())
                entity, m = e, IntervalMap()
            m.add(l, r)
        if m is not None and len(m) > state_rows:  # sorted input never reaches back behind the last stretch
            keep(*m.take_front())
        if len(out) > 50_000:
            yield frame()
    if m is not None:
        keep(m.stretches(), m.gaps())
    yield frame()


def merge_periods(
    df: DataFrame,
    entity: str,
    left: str,
    right: str,
    *,
    state_rows: int = STATE_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """Merged stretches and gaps per entity: ``entity``, kind, left_pos, right_pos.

    Intervals are closed and unite when they overlap or directly adjoin.

    Defined results: rows with a null entity or end, or with left > right, are
    not intervals and are left out; repeated and nested intervals change
    nothing; an entity with one stretch has no gap; an empty table gives an
    empty result.  Only the three columns are read.
    """
    spark = df.sparkSession
    n = partitions or shuffle_partitions(spark)
    kind = df.schema[entity].dataType.simpleString()
    rows = df.select(
        F.col(f"`{entity}`").alias("e"), F.col(f"`{left}`").cast("bigint").alias("l"), F.col(f"`{right}`").cast("bigint").alias("r")
    ).where(F.col("e").isNotNull() & F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("l") <= F.col("r")))
    # written once: the range partitioning reads it twice, for its sample and for the rows
    local = checkpointed(rows.mapInPandas(_local(state_rows), f"e {kind}, l bigint, r bigint"))
    parts = checkpointed(
        local.repartitionByRange(n, "e", "l")
        .sortWithinPartitions("e", "l")
        .mapInPandas(_ordered, f"part int, e {kind}, kind string, l bigint, r bigint")
    )
    merged = parts.where("kind = 'merged'")
    # One row per entity and task, for entities that span tasks: at most 2 n rows.
    order = W.partitionBy("e").orderBy("part")
    spans = (
        merged.groupBy("e", "part")
        .agg(F.max("r").alias("reach"), F.min("l").alias("first_l"), F.max("l").alias("last_l"))
        .withColumn("tasks", F.count("*").over(W.partitionBy("e")))
        .where("tasks > 1")
        .withColumn("carry", F.max("reach").over(order.rowsBetween(W.unboundedPreceding, -1)))
    )
    # How far stretches that continue an older one reach in each task.
    continued = (
        merged.join(F.broadcast(spans.where("carry is not null").select("e", "part", "carry")), ["e", "part"])
        .where(F.col("l") <= F.col("carry") + 1)
        .groupBy("e", "part")
        .agg(F.max("r").alias("cont"))
    )
    borders = (
        spans.join(continued, ["e", "part"], "left")
        .withColumn("starts", F.col("carry").isNull() | (F.col("last_l") > F.col("carry") + 1))
        .withColumn("period", F.sum(F.col("starts").cast("bigint")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    )
    ends = (
        borders.select("e", "period", F.col("reach").alias("v"))
        .unionByName(borders.where("starts").select("e", (F.col("period") - 1).alias("period"), F.col("cont").alias("v")))
        .groupBy("e", "period")
        .agg(F.max("v").alias("end_of_last"))
    )
    borders = checkpointed(
        borders.join(ends, ["e", "period"]).select("e", "part", "carry", "first_l", "last_l", "starts", "end_of_last")
    )
    placed = parts.join(F.broadcast(borders.drop("first_l")), ["e", "part"], "left")
    periods = placed.where("kind = 'merged' and (carry is null or l > carry + 1)").select(
        "e", "kind", "l", F.when(F.col("starts") & (F.col("l") == F.col("last_l")), F.col("end_of_last")).otherwise(F.col("r")).alias("r")
    )
    gaps = placed.where("kind = 'gap' and (carry is null or r > carry)").select(
        "e", "kind", F.greatest("l", F.col("carry") + 1).alias("l"), "r"
    )
    between = borders.where("first_l > carry + 1").select(
        "e", F.lit("gap").alias("kind"), (F.col("carry") + 1).alias("l"), (F.col("first_l") - 1).alias("r")
    )
    return (
        periods.unionByName(gaps)
        .unionByName(between)
        .select(F.col("e").alias(entity), "kind", F.col("l").alias("left_pos"), F.col("r").alias("right_pos"))
    )
