"""Reads and intervals as streams.

Row-wise operators work on streams unchanged.  Operators on order need a batch.
Counts per time window are kept by event time, with a watermark for late rows;
interval maps per entity are kept in keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from readloom.operators.demux import demultiplex
from readloom.operators.periods import IntervalMap
from readloom.operators.reads import annotate_index, annotate_umi, match_5end, trim_3end_primer, trim_3end_quality, trim_5end


def clean_stream(reads: DataFrame, barcodes: list[tuple[int, str, str]], umi_length: int = 6, minimum: int = 24) -> DataFrame:
    """The row-wise steps of read preparation: match, annotate, demultiplex, trim by quality, primer and 5' pattern."""
    size = min(len(b) for _, b, _ in barcodes)
    tso = "." * (umi_length + size) + "GG"
    named = reads.transform(match_5end(tso)).transform(annotate_index(umi_length + 1, umi_length + size)).transform(annotate_umi(1, umi_length))
    kept = demultiplex(named, barcodes).transform(trim_3end_quality()).transform(trim_3end_primer())
    return kept.transform(trim_5end(tso + "+", minimum))


def reads_per_window(reads: DataFrame, window: str = "1 hour", lateness: str = "3 days", at: str = "run_at") -> DataFrame:
    """Reads per well and time window; rows later than ``lateness`` are left out by the watermark."""
    marked = reads.withWatermark(at, lateness).groupBy(F.window(at, window).alias("w"), "well")
    return marked.agg(F.count("*").alias("reads"), F.sum(F.length("seq")).cast("bigint").alias("bases")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "well", "reads", "bases"
    )


STATE = "lefts array<bigint>, rights array<bigint>"
PERIODS = "acc string, kind string, left_pos bigint, right_pos bigint"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    m = IntervalMap(*state.get) if state.exists else IntervalMap()
    for batch in batches:
        for left, right in zip(batch["left_pos"].tolist(), batch["right_pos"].tolist()):
            m.add(left, right)
    state.update((m.lefts, m.rights))
    rows = [(key[0], "merged", a, b) for a, b in m.stretches()] + [(key[0], "gap", a, b) for a, b in m.gaps()]
    yield pd.DataFrame(rows, columns=["acc", "kind", "left_pos", "right_pos"])


def stream_periods(intervals: DataFrame) -> DataFrame:
    """Stretches and gaps of every entity that got rows in a batch, as they stand after it (update mode).

    Input columns acc, left_pos, right_pos (closed).  The ordered map of an entity is its state; rows without
    entity or ends, or with inverted ends, are left out.
    """
    good = intervals.where("acc is not null and left_pos is not null and right_pos is not null and left_pos <= right_pos")
    return (
        good.select("acc", F.col("left_pos").cast("bigint").alias("left_pos"), F.col("right_pos").cast("bigint").alias("right_pos"))
        .groupBy("acc")
        .applyInPandasWithState(_update, PERIODS, STATE, "update", GroupStateTimeout.NoTimeout)
    )
