"""File-to-file workflows: the operators between the sources and sinks, one function per command.

Every function declares its plans and writes them; paths may be on any file
system that Spark reads, but FASTQ, BAM and archives are opened by the
executors and need a folder that all of them share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators import counts as C
from readloom.operators import transcriptome as T
from readloom.operators.demux import barcode_map
from readloom.operators.variants import aligner_variants, own_haplotypes
from readloom.plans.pipelines import alignment_counts, prepare_reads, reference_sequences
from readloom.sources import formats as S
from readloom.sources.fastq import read_fastq, write_demultiplexed
from readloom.sources.fetch import fetched


#: Name and description of the generated tracks.
TRACKS = {
    "coding_5end": ("Coding5end", "5' UTR and the proximal upstream of protein coding genes"),
    "coding_whole": ("CodingWhole", "Exons and the proximal upstream of protein coding genes"),
}


def prepare_reads_files(spark: SparkSession, fastqs: str | Sequence[str], barcodes: str, out: str, base: str | None = None, **options) -> None:
    """``out``/reads: prepared FASTQ per well, as files of library ``base`` if it is given; ``out``/counts: length histograms per step and well."""
    codes = barcode_map(S.read_barcodes(spark, barcodes))
    reads, counts = prepare_reads(read_fastq(spark, fastqs), codes, **options)
    write_demultiplexed(reads, f"{out}/reads", base=base)
    counts.write.csv(f"{out}/counts", header=True)


def count_alignments(spark: SparkSession, bams: str | Sequence[str], out: str) -> None:
    """Per-base counts as BED, a folder per sample."""
    counted = alignment_counts(spark, bams)
    counted.select(F.col("name").alias("base"), S.bed_line().alias("value")).write.partitionBy("base").option("compression", "gzip").text(out)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """What ``count_alignments`` wrote: BED columns and the sample as ``base``."""
    f = F.split("value", "\t", -1)
    names = ("chrom", "start_pos", "end_pos", "name", "score", "strand")
    kinds = {"start_pos": "bigint", "end_pos": "bigint", "score": "bigint"}
    cols = [F.get(f, F.lit(i)).cast(kinds.get(n, "string")).alias(n) for i, n in enumerate(names)]
    return spark.read.text(path).select(*cols, F.col("base").cast("string").alias("base"))


def prepare_genome(spark: SparkSession, archive: str, out: str, *, url: str | None = None, download: str = "no") -> None:
    """Main chromosomes of an archive of FASTA files, without members and names that have an underscore.

    Here and below ``download`` is yes (copy ``url`` to the input first), no, or only (copy and stop).
    """
    if not fetched(url, archive, download):
        return
    seqs = S.read_archive(spark, archive, exclude=["*_*"]).select("id", "seq")
    S.write_fasta(T.normalised_fasta(seqs), out)


def prepare_spikein(spark: SparkSession, archive: str, out: str, member: str = "*.fa", *, url: str | None = None, download: str = "no") -> None:
    if not fetched(url, archive, download):
        return
    S.write_fasta(T.spike_sequences(T.normalised_fasta(S.read_archive(spark, archive, include=member).select("id", "seq"))), out)


def prepare_ribosome(spark: SparkSession, fasta: str, out: str, genome: str = "hg38", *, url: str | None = None, download: str = "no") -> None:
    if not fetched(url, fasta, download):
        return
    S.write_fasta(T.ribosome_sequences(S.read_fasta(spark, fasta), genome), out)


def build_reference(spark: SparkSession, genome: str, spikein: str, ribosome: str, out: str) -> None:
    """``out``/fasta: all sequences; ``out``/index: their lengths, tab-separated."""
    whole = reference_sequences(*[S.read_fasta(spark, p) for p in (genome, spikein, ribosome)])
    S.write_fasta(whole, f"{out}/fasta")
    T.sequence_index(whole).write.csv(f"{out}/index", sep="\t")


def prepare_variation(spark: SparkSession, snps: str, out: str, *, url: str | None = None, download: str = "no") -> None:
    """``out``/snp and ``out``/haplotype for an aligner, tab-separated, in order of chromosome and position."""
    if not fetched(url, snps, download):
        return
    variants = aligner_variants(S.read_snps(spark, snps))
    variants.orderBy("chrom", "start_pos", "id").write.csv(f"{out}/snp", sep="\t")
    own_haplotypes(variants).orderBy("chrom", "left_pos", "id").write.csv(f"{out}/haplotype", sep="\t")


def prepare_transcriptome(spark: SparkSession, gtf: str, index: str, out: str, *, url: str | None = None, download: str = "no") -> None:
    """Region sets as BED in ``out``/NAME, and the accessions of the merged sets in ``out``/NAME_accessions."""
    if not fetched(url, gtf, download):
        return
    sets = T.region_sets(S.read_gtf(spark, gtf)).unionByName(T.index_regions(S.read_index(spark, index)))
    ordered = sets.repartitionByRange("region_set", "chrom", "start_pos").sortWithinPartitions("region_set", "chrom", "start_pos")
    ordered.select("region_set", S.bed_line().alias("value")).write.partitionBy("region_set").option("compression", "gzip").text(f"{out}/sets")
    for name, parts in (("coding_5end", ("coding_promoter", "coding_5utr")), ("coding_whole", ("coding_promoter", "coding_exon"))):
        bed = sets.where(F.col("region_set").isin(*parts))
        S.write_bed(T.merged_by_gene(bed), f"{out}/{name}", track=TRACKS[name])
        T.gene_accessions(bed).write.csv(f"{out}/{name}_accessions", header=True)


def region_set(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A set written by ``prepare_transcriptome``."""
    merged = name in ("coding_5end", "coding_whole")
    return S.read_bed(spark, f"{out}/{name}" if merged else f"{out}/sets/region_set={name}")


def quantify_files(spark: SparkSession, design: str, counts: str, transcriptome: str, out: str, merged: str = "coding_whole") -> None:
    """Count matrix CSV: ID, annotation columns, N|base.., R|base.. for the libraries of the design."""
    bases = [r[0] for r in S.read_table(spark, design).select(F.col("BASE").cast("string")).collect()]  # columns of the matrix
    regions = region_set(spark, transcriptome, merged)
    for name in ("ribosome", "spikein_5end"):
        regions = regions.unionByName(region_set(spark, transcriptome, name))
    long = C.quantify(read_counts(spark, counts).where(F.col("base").isin(*bases)), regions)
    table = C.wide(long, "ID", "base", "N", bases, "N").join(C.wide(long, "ID", "base", "R", bases, "R"), "ID")
    annotations = spark.read.csv(f"{transcriptome}/{merged}_accessions", header=True)
    extra = [c for c in annotations.columns if c != "ID"]
    rest = [c for c in table.columns if c != "ID"]
    annotated = C.annotate(table, annotations)
    annotated.select("ID", *extra, *[F.col(f"`{c}`") for c in rest]).write.csv(out, header=True)


def qualify_files(spark: SparkSession, design: str, counts: str, transcriptome: str, read_counts_csv: str, out: str) -> None:
    """The design with twelve metrics per library. Total reads are those after the last preparation step.

    ``read_counts_csv``: histograms with columns base, length, reads.
    """
    rows = S.read_table(spark, design).withColumnRenamed("BASE", "base").withColumn("base", F.col("base").cast("string"))
    totals = S.read_table(spark, read_counts_csv).groupBy("base").agg(F.sum("reads").alias("TOTAL_READS"))
    names = ("ribosome", "spikein_whole", "spikein_5end", "coding_whole", "coding_5end")
    sets = {n: region_set(spark, transcriptome, n) for n in names}
    C.qualify(rows, totals, read_counts(spark, counts), sets).withColumnRenamed("base", "BASE").write.csv(out, header=True)
