"""Counts per length, base, region and sample, with spike-in normalisation and quality metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.columns import five_prime_start, ieee_div, seq_length
from readloom.operators.intervals import overlap_any, overlap_pairs
from readloom.session import shuffle_partitions

SPIKE = "RNA_SPIKE_"
RIBOSOME = "RIBO_"


def length_histogram(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reads per sequence length: length, reads."""
    return df.where(F.col("seq").isNotNull()).groupBy(*by, seq_length(F.col("seq")).alias("length")).agg(F.count("*").alias("reads"))


def with_histogram(df: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows, kept for two actions, and their length histogram on the side; unpersist the first when done."""
    kept = df.persist()
    return kept, length_histogram(kept, by)


def sum_histograms(*parts: DataFrame) -> DataFrame:
    """Counts per length over several histograms, whatever their second column is called."""
    whole = None
    for p in parts:
        value = next(c for c in p.columns if c != "length")
        p = p.select(F.col("length").cast("bigint").alias("length"), F.col(value).cast("bigint").alias("count"))
        whole = p if whole is None else whole.unionByName(p)
    return whole.groupBy("length").agg(F.sum("count").alias("count"))


def count_per_base(bed: DataFrame, sample: Column) -> DataFrame:
    """Reads per 5'-end base and strand, as BED with the sample as name and the count as score."""
    start = five_prime_start(F.col("start_pos"), F.col("end_pos"), F.col("strand"))
    points = bed.select("chrom", start.alias("start_pos"), sample.alias("name"), "strand")
    counted = points.groupBy("chrom", "start_pos", "name", "strand").agg(F.count("*").alias("score"))
    return counted.select("chrom", "start_pos", (F.col("start_pos") + 1).alias("end_pos"), "name", "score", "strand")


def count_per_region(counts: DataFrame, regions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of the scores of ``counts`` per region name, added once per overlapping pair: ID, COUNT."""
    pairs = overlap_pairs(counts, regions)
    return pairs.groupBy(*[F.col(f"a_{c}").alias(c) for c in by], F.col("b_name").alias("ID")).agg(
        F.sum("a_score").cast("bigint").alias("COUNT")
    )


def count_distinct_per_region(regions: DataFrame, ends: DataFrame, samples: DataFrame) -> DataFrame:
    """Distinct names of overlapping 5' ends per region and sample, long form: ID, sample, n.

    ``ends`` are BED rows with a ``base``; ``samples`` maps sample to base, one row per pair.

    Samples with the same bases have the same counts, and ends that were seen in the same bases count alike: both are
    counted as one, so only the result itself has a row for every region and sample.
    """
    pairs = overlap_pairs(regions, ends).select(F.col("a_name").alias("ID"), F.col("b_name").alias("end_name"), F.col("b_base").alias("base"))
    seen = pairs.where("base is not null").groupBy("ID", "end_name").agg(F.sort_array(F.collect_set("base")).alias("seen"))
    seen = seen.groupBy("ID", "seen").agg(F.count("end_name").alias("k"))
    names = samples.where("base is not null").groupBy("sample").agg(F.sort_array(F.collect_set("base")).alias("bases"))
    sets = names.select("bases").distinct()
    met = _dealt_join(seen.withColumn("base", F.explode("seen")), sets.withColumn("base", F.explode("bases")), "base", "ID")
    met = met.where(F.array_min(F.array_intersect("seen", "bases")) == F.col("base"))  # each once
    counted = met.groupBy("ID", "bases").agg(F.sum("k").alias("n"))
    bundle = F.pmod(F.xxhash64("sample"), F.lit(names.count() // _BUNDLE + 1))
    bundles = names.groupBy("bases", bundle.alias("bundle")).agg(F.collect_list(F.struct("sample")).alias("samples"))
    found = _dealt_join(counted, bundles, "bases", "ID")
    return found.select("ID", F.explode("samples").alias("s"), "n").select("ID", F.col("s.sample").alias("sample"), "n")


#: Samples in a bundle, about; shares in which the rows of one key are dealt out.
_BUNDLE, _SHARES = 4096, 32


def _dealt_join(rows: DataFrame, few: DataFrame, on: str, by: str) -> DataFrame:
    """Join on a column of few values: rows are dealt out by ``by``, and ``few`` goes to every share.

    What comes out is much larger than what is shuffled, so the number of tasks is not left to the sizes of the sides.
    """
    spark = rows.sparkSession
    tasks = max(shuffle_partitions(spark), 8 * spark.sparkContext.defaultParallelism)
    rows = rows.withColumn("_share", F.pmod(F.xxhash64(by), F.lit(_SHARES)).cast("int")).repartition(tasks, on, "_share")
    few = few.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1)))).repartition(tasks, on, "_share")
    return rows.join(few, [on, "_share"]).drop("_share")


def wide(long: DataFrame, key: str, column: str, value: str, names: Sequence[str], prefix: str) -> DataFrame:
    """Pivot for the sink: one column ``prefix|name`` per name, 0 where nothing was counted."""
    table = long.groupBy(key).pivot(column, list(names)).agg(F.first(value))
    return table.select(key, *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(f"{prefix}|{n}") for n in names])


def quantify(counts: DataFrame, regions: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """Long count matrix: ID, base, R (reads), N (reads per 1000 spike-in reads), annotation columns.

    ``counts`` are per-base counts with a ``base``; spike-in regions are those
    whose name starts with RNA_SPIKE_.  Regions without annotations get 'NA'.
    """
    table = count_per_region(counts, regions, ["base"])
    spikes = table.where(F.col("ID").startswith(SPIKE)).groupBy("base").agg(F.sum("COUNT").alias("spike"))
    out = table.join(spikes, "base", "left")
    normal = ieee_div(F.col("COUNT"), F.coalesce("spike", F.lit(0))) * 1000
    out = out.select("ID", "base", F.col("COUNT").alias("R"), normal.alias("N"))
    return out if annotations is None else annotate(out, annotations)


def annotate(df: DataFrame, annotations: DataFrame, key: str = "ID", missing: str = "NA") -> DataFrame:
    """Left lookup of the annotation columns; 'NA' where the key has none."""
    extra = [c for c in annotations.columns if c != key]
    joined = df.join(annotations, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in extra})


def score_sums(counts: DataFrame, regions: dict[str, DataFrame]) -> DataFrame:
    """base, and per kind of regions the sum of the scores that overlap any region of the kind: one join for all kinds."""
    tagged = None
    for kind, df in regions.items():
        df = df.select(F.lit(kind).alias("_kind"), "chrom", "start_pos", "end_pos", "strand")
        tagged = df if tagged is None else tagged.unionByName(df)
    asked = counts.select("base", "score", "chrom", "start_pos", "end_pos", "strand", F.explode(F.array(*map(F.lit, regions))).alias("_kind"))
    hit = overlap_any(asked, tagged, by=["_kind"])
    return hit.groupBy("base").agg(*[F.sum(F.when(F.col("_kind") == k, F.col("score"))).cast("bigint").alias(k) for k in regions])


def qualify(design: DataFrame, totals: DataFrame, counts: DataFrame, regions: dict[str, DataFrame]) -> DataFrame:
    """Twelve quality metrics per design row.

    ``totals``: base, TOTAL_READS.  ``regions``: ribosome, spikein_whole,
    spikein_5end, coding_whole, coding_5end.  Missing counts are 0; zero
    denominators give infinity or NaN.
    """
    sums = {
        "RIBOSOME_READS": regions["ribosome"],
        "SPIKEIN_READS": regions["spikein_whole"],
        "SPIKEIN_5END_READS": regions["spikein_5end"],
        "CODING_READS": regions["coding_whole"],
        "CODING_5END_READS": regions["coding_5end"],
    }
    mapped = counts.groupBy("base").agg(F.sum("score").cast("bigint").alias("MAPPED_READS"))
    out = design.join(totals, "base", "left").join(mapped, "base", "left").join(score_sums(counts, sums), "base", "left")
    sums = ["MAPPED_READS", *sums]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("TOTAL_READS", *sums)})
    c = F.col
    return out.withColumns(
        {
            "MAPPED_RATE": ieee_div(c("MAPPED_READS"), c("TOTAL_READS")),
            "SPIKEIN_5END_RATE": ieee_div(c("SPIKEIN_5END_READS"), c("SPIKEIN_READS")),
            "RELATIVE_POLYA_RNAS": ieee_div(c("MAPPED_READS") - c("RIBOSOME_READS") - c("SPIKEIN_READS"), c("SPIKEIN_5END_READS")),
            "CODING_5END_RATE": ieee_div(c("CODING_5END_READS"), c("CODING_READS")),
            "RELATIVE_MRNAS": ieee_div(c("CODING_5END_READS"), c("SPIKEIN_5END_READS")),
        }
    )


def unique_alignments(sam: DataFrame, line: str = "value") -> DataFrame:
    """Alignments that are mapped and whose NH tag does not tell of several hits."""
    flag = F.split_part(F.col(line), F.lit("\t"), F.lit(2)).try_cast("int")
    many = F.col(line).rlike("NH:i:(?:[2-9][0-9]*|1[0-9]+)")
    return sam.where(~many & (flag.bitwiseAND(4) == 0))


def soft_filter(variants: DataFrame, qual: str = "qual", depths: str = "dp", least_qual: float = 20, least_depth: int = 20) -> DataFrame:
    """Adds ``filter``: LowQual below the least quality or the least depth of any sample, else PASS."""
    low = (F.col(qual) < least_qual) | (F.array_min(depths) < least_depth)
    return variants.withColumn("filter", F.when(low, "LowQual").otherwise("PASS"))
