"""Composite pipelines: preparation of reads, sequencing-depth curve, reference assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.columns import pinned
from readloom.operators.counts import count_per_base
from readloom.operators.demux import demultiplex
from readloom.operators.ordered import exclude_degenerate, exclude_duplicate
from readloom.operators.reads import (
    LOW_QUALITIES,
    PRIMERS,
    annotate_index,
    annotate_umi,
    good_length,
    head_reads,
    match_5end,
    primer_cut,
    trim_3end_primer,
    trim_3end_quality,
    trim_5end,
    without_n,
)
from readloom.session import checkpointed


def prepare_reads(
    reads: DataFrame,
    barcodes: list[tuple[int, str, str]],
    *,
    umi_length: int = 6,
    minimum: int = 24,
    head: int | None = None,
    distance: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Prepared reads with their well, and the length histogram after each of the eight steps.

    The histogram has the columns step, well (null for the two steps before
    demultiplexing), length, reads.
    """
    bc_length = min(len(b) for _, b, _ in barcodes)
    tso = "." * (umi_length + bc_length) + "GG"
    raw = (head_reads(head)(reads) if head is not None else reads).where(F.col("seq").isNotNull())
    canonical = match_5end(tso)(raw)
    named = canonical.transform(annotate_index(umi_length + 1, umi_length + bc_length)).transform(annotate_umi(1, umi_length))
    s3 = demultiplex(named, barcodes, distance)
    s4 = checkpointed(exclude_duplicate(s3, ["well"]))  # read by both results, and several times by step 7
    s6 = checkpointed(s4.transform(trim_3end_quality()).transform(trim_3end_primer()))
    s7 = exclude_degenerate(s6, ["well"])
    s8 = trim_5end(tso + "+", minimum)(s7)

    size = F.length("seq")
    # steps 1 to 3 leave sequences as they are: one pass counts them
    fits = F.col("seq").rlike(f"^(?:{tso})")
    marked = raw.transform(annotate_index(umi_length + 1, umi_length + bc_length)).transform(annotate_umi(1, umi_length))
    marked = demultiplex(marked.select("seq", "acc"), barcodes, distance)
    # steps 4 to 6 only shorten or drop single reads, so one pass over step 4 counts all three; likewise 7 and 8
    best = pinned(s4, {"kept": F.when(good_length() >= 40, F.left("seq", good_length()))})
    best = pinned(best, {"cut": primer_cut(PRIMERS, F.col("kept"))})
    left = F.length("kept") - F.col("cut")
    primed, head_size = F.col("seq").rlike(f"^(?:{tso}+)"), F.length(F.regexp_extract("seq", f"^(?:{tso}+)", 0))
    rest = F.when(primed, size - head_size).otherwise(size)
    parts = [
        _steps(marked, {1: size, 2: F.when(fits, size), 3: F.when(fits, size)}, whole=(1, 2)),
        _steps(best, {4: size, 5: F.length("kept"), 6: F.when((F.col("cut") == 0) | (left >= 40), left)}),
        _steps(s7, {7: size, 8: F.when(~primed | (rest >= minimum), rest)}),
    ]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return s8, counts


def _steps(df: DataFrame, lengths: dict[int, Column], whole: Sequence[int] = ()) -> DataFrame:
    """Histograms of several steps in one pass; a read that a step drops has a null length there.

    Steps in ``whole`` come before the wells are known.
    """
    none = F.lit(None).cast("string")
    listed = F.array(
        *[
            F.struct(F.lit(n).alias("step"), (none if n in whole else F.col("well")).alias("in_well"), c.cast("bigint").alias("length"))
            for n, c in lengths.items()
        ]
    )
    rows = df.select(F.inline(listed)).where("length is not null")
    return rows.groupBy("step", F.col("in_well").alias("well"), "length").agg(F.count("*").alias("reads"))


def depth_curve(
    reads: DataFrame,
    *,
    umi_length: int = 6,
    barcode_length: int = 6,
    gap_length: int = 3,
    minimum: int = 25,
    low: str = LOW_QUALITIES,
    tss: bool = False,
    levels: int = 12,
) -> DataFrame:
    """Distinct canonical reads at ``levels`` sampling depths: draw, raw, nr.

    All depths are one job: a read carries every depth that draws it.
    """
    head = "." * (umi_length + barcode_length) + "G" * (gap_length - 1)
    whole = minimum + umi_length + barcode_length + gap_length
    usable = reads.where(F.col("seq").isNotNull())
    slot = (F.col("ordinal") % levels).cast("int")
    by_slot = usable.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    draws = F.explode(F.sequence(F.col("slot") + 1, F.lit(levels)))
    raw = by_slot.select("n", draws.alias("draw")).groupBy("draw").agg(F.sum("n").alias("raw"))

    # Which copy of a sequence stays at a depth only matters through its quality, so one value per sequence and
    # slot goes on: the good length of the copy that is first in order. At most ``levels`` per sequence.
    first = F.struct(F.concat_ws("\t", "sep", "qual").alias("q"), "acc", (-F.col("ordinal")).alias("o"), good_length(low).alias("n"))
    fit = usable.transform(match_5end(head)).transform(without_n())
    slots = fit.groupBy("seq", slot.alias("slot")).agg(F.max(first).alias("best"))
    table = slots.groupBy("seq").agg(F.collect_list(F.struct("slot", "best")).alias("slots"))
    at_depth = F.transform(
        F.sequence(F.lit(1), F.lit(levels)),
        lambda d: F.struct(d.alias("draw"), F.array_max(F.transform(F.filter("slots", lambda s: s["slot"] < d), lambda s: s["best"]))["n"].alias("n")),
    )
    drawn = table.select("seq", F.inline(at_depth)).where((F.col("n") > 0) & (F.col("n") >= whole))
    # trimming depends on sequence and length only: done once for all depths that agree
    alike = drawn.groupBy("seq", "n").agg(F.collect_list("draw").alias("draws"))
    alike = pinned(alike.select("draws", F.left("seq", F.col("n")).alias("kept")), {"cut": primer_cut(PRIMERS[:1], F.col("kept"))})
    left = F.length("kept") - F.col("cut")
    fitting = alike.where((F.col("cut") == 0) | (left >= whole))
    trimmed = fitting.select(F.left("kept", left).alias("seq"), F.explode("draws").alias("draw"))
    counted = checkpointed(trimmed.groupBy("draw", "seq").agg(F.count("*").alias("n")))  # read twice
    kept = exclude_degenerate(counted, ["draw"])
    if tss:
        kept = trim_5end(head + "+", minimum)(kept.withColumn("qual", F.lit(None).cast("string"))).groupBy("draw", "seq").agg(F.lit(1).alias("n"))
    nr = kept.groupBy("draw").agg(F.sum("n").cast("bigint").alias("nr"))
    return raw.join(nr, "draw", "left").select(F.col("draw").cast("bigint").alias("draw"), "raw", F.coalesce("nr", F.lit(0)).alias("nr"))


def alignment_counts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Per-base 5'-end counts of the unique alignments in BAM files, each named after its file."""
    from readloom.sources.bam import read_bam

    sample = F.regexp_extract("file", r"([^/]+?)(?:\.bam)?$", 1)
    return count_per_base(read_bam(spark, paths, unique=True).withColumn("sample", sample), F.col("sample"))


def reference_sequences(genome: DataFrame, spikes: DataFrame, ribosome: DataFrame) -> DataFrame:
    """Genome, spike-in and ribosomal sequences in one table."""
    return genome.select("id", "seq").unionByName(spikes.select("id", "seq")).unionByName(ribosome.select("id", "seq"))
