"""Region sets derived from gene annotations, sequence indexes and reference sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.columns import first_token, gtf_attribute, gtf_number
from readloom.operators.counts import RIBOSOME, SPIKE
from readloom.operators.intervals import merge_intervals
from readloom.operators.search import pieces

UPSTREAM = 500
#: Fixed values of the spike-in kit: the prefix of every sequence, and what one of them has in addition.
SPIKE_PREFIX = "AATTC"
SPIKE_EXTRA = {"ERCC-00130": "GAGCTC"}
RIBOSOME_NAME = "RIBO_U13369.1"


def gtf_rows(gtf: DataFrame) -> DataFrame:
    """Positions with the attributes as columns and the joined accession."""
    attrs = F.col("attrs")
    rows = gtf.select(
        "chrom",
        "feature",
        F.col("left_pos").cast("bigint").alias("left_pos"),
        F.col("right_pos").cast("bigint").alias("right_pos"),
        "strand",
        "attrs",
        gtf_attribute(attrs, "gene_name").alias("gene_name"),
        gtf_attribute(attrs, "gene_id").alias("gene_id"),
        gtf_attribute(attrs, "transcript_id").alias("transcript_id"),
        gtf_number(attrs, "exon_number").alias("exon_number"),
        *[c for c in ("row_id",) if c in gtf.columns],
    )
    return rows.withColumn("name", F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("gene_name", "gene_id", "transcript_id")]))


def basic(gtf: DataFrame) -> DataFrame:
    return gtf.where(F.col("attrs").contains('tag "basic"'))


def start_codons(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """transcript_id, atg: the first coding base; the last row of a transcript wins."""
    codons = rows.where("feature = 'start_codon' and transcript_id is not null")
    atg = F.when(F.col("strand") == "+", F.col("left_pos")).otherwise(F.col("right_pos"))
    return codons.groupBy("transcript_id").agg(F.max_by(atg, order).alias("atg"))


def _bed(rows: DataFrame, start: Column, end: Column, kind: Column | str) -> DataFrame:
    return rows.select(
        kind if isinstance(kind, Column) else F.lit(kind).alias("region_set"),
        "chrom",
        start.alias("start_pos"),
        end.alias("end_pos"),
        "name",
        F.lit(0).cast("bigint").alias("score"),
        "strand",
    )


def region_sets(gtf: DataFrame, order: str = "row_id") -> DataFrame:
    """Eight BED sets in one table, told apart by ``region_set``.

    coding_gene, other_gene, coding_exon, other_exon, coding_5utr,
    coding_promoter, other_promoter, other_1st_exon.  Coding is what has a
    start codon.  Promoter starts before the chromosome are set to 0; rows
    without both positions are left out.
    """
    rows = gtf_rows(gtf)
    parts = rows.where("feature in ('exon', 'transcript') and left_pos is not null and right_pos is not null")
    parts = parts.join(start_codons(rows, order), "transcript_id", "left").withColumn("class", F.when(F.col("atg").isNotNull(), "coding").otherwise("other"))
    left, right, atg, plus = F.col("left_pos"), F.col("right_pos"), F.col("atg"), F.col("strand") == "+"
    minus = F.col("strand") == "-"

    def named(suffix: str) -> Column:
        return F.concat("class", F.lit(suffix)).alias("region_set")

    exons = parts.where("feature = 'exon'")
    first = exons.where("exon_number = 1")
    utr_start = F.when((plus & (right < atg)) | (minus & (atg < left)), left - 1).when(plus & (left < atg) & (atg <= right), left - 1).when(minus & (left <= atg) & (atg < right), atg)
    utr_end = F.when((plus & (right < atg)) | (minus & (atg < left)), right).when(plus & (left < atg) & (atg <= right), atg - 1).when(minus & (left <= atg) & (atg < right), right)
    promoter_start = F.when(plus, F.greatest(left - UPSTREAM, F.lit(0))).otherwise(right)
    promoter_end = F.when(plus, left - 1).otherwise(right + UPSTREAM - 1)
    promoters = _bed(first.withColumn("strand", F.when(plus, "+").otherwise("-")), promoter_start, promoter_end, named("_promoter"))
    return (
        _bed(parts.where("feature = 'transcript'"), left - 1, right, named("_gene"))
        .unionByName(_bed(exons, left - 1, right, named("_exon")))
        .unionByName(_bed(exons.where("class = 'coding'"), utr_start, utr_end, "coding_5utr").where("start_pos is not null"))
        .unionByName(promoters)
        .unionByName(_bed(first.where("class = 'other'"), left - 1, right, "other_1st_exon"))
    )


def merged_by_gene(bed: DataFrame) -> DataFrame:
    """BED of merged intervals per gene symbol, chromosome and strand."""
    genes = bed.withColumn("name", F.split_part("name", F.lit("|"), F.lit(1)))
    merged = merge_intervals(genes.where("start_pos < end_pos"), ["name", "chrom", "strand"])
    return merged.select("chrom", "start_pos", "end_pos", "name", F.lit(0).cast("bigint").alias("score"), "strand")


def gene_accessions(bed: DataFrame) -> DataFrame:
    """ID, ACCESSIONS: per gene symbol gene:transcript;transcript|gene:..., each once, in the order met.

    The order is by chromosome, start and the accessions.
    """
    part = [F.split_part("name", F.lit("|"), F.lit(i)) for i in (1, 2, 3)]
    rows = bed.select(part[0].alias("ID"), part[1].alias("gene"), part[2].alias("tx"), "chrom", "start_pos")
    met = rows.groupBy("ID", "gene", "tx").agg(F.min(F.struct("chrom", "start_pos", "gene", "tx")).alias("at"))
    genes = met.groupBy("ID", "gene").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "tx"))).alias("txs"))
    cell = F.concat_ws(":", "gene", F.array_join(F.transform("txs", lambda t: t["tx"]), ";"))
    lists = genes.groupBy("ID").agg(F.array_sort(F.collect_list(F.struct("at", cell.alias("cell")))).alias("cells"))
    return lists.select("ID", F.array_join(F.transform("cells", lambda c: c["cell"]), "|").alias("ACCESSIONS"))


def index_regions(index: DataFrame) -> DataFrame:
    """Region sets from a sequence index (acc, len): ribosome (both strands), spikein_whole, spikein_5end."""
    acc, size = F.col("acc"), F.col("len").cast("bigint")

    def one(rows: DataFrame, kind: str, end: Column, strand: Column) -> DataFrame:
        return rows.select(
            F.lit(kind).alias("region_set"),
            acc.alias("chrom"),
            F.lit(0).cast("bigint").alias("start_pos"),
            end.alias("end_pos"),
            acc.alias("name"),
            F.lit(0).cast("bigint").alias("score"),
            strand.alias("strand"),
        )

    ribosome = index.where(acc.startswith(RIBOSOME))
    spikes = index.where(acc.startswith(SPIKE))
    return (
        one(ribosome, "ribosome", size, F.explode(F.array(F.lit("+"), F.lit("-"))))
        .unionByName(one(spikes, "spikein_whole", size, F.lit("+")))
        .unionByName(one(spikes, "spikein_5end", F.lit(50).cast("bigint"), F.lit("+")))
    )


def normalised_fasta(df: DataFrame) -> DataFrame:
    """Header cut to its first token, sequence in one line."""
    return df.withColumns({"id": first_token(F.col("id")), "seq": F.regexp_replace("seq", r"\s+", "")})


def primary_sequences(df: DataFrame) -> DataFrame:
    """Sequences whose name has no underscore: the main chromosomes."""
    return df.where(~F.col("id").contains("_"))


def spike_sequences(df: DataFrame) -> DataFrame:
    """Spike-in sequences under their prefixed name, with the bases the kit adds in front."""
    extra = F.lit("")
    for name, bases in SPIKE_EXTRA.items():
        extra = F.when(F.col("id") == name, bases).otherwise(extra)
    return df.withColumns({"seq": F.concat(F.lit(SPIKE_PREFIX), extra, "seq"), "id": F.concat(F.lit(SPIKE), "id")})


def ribosome_sequences(df: DataFrame, genome: str = "hg38") -> DataFrame:
    """The ribosomal repeat under its fixed name; genomes other than human have none."""
    return (df if genome.startswith("hg") else df.limit(0)).withColumn("id", F.lit(RIBOSOME_NAME))


def sequence_index(df: DataFrame) -> DataFrame:
    """acc, len of every sequence."""
    return df.select(F.col("id").alias("acc"), F.length("seq").cast("bigint").alias("len"))


def gene_predictions(gtf: DataFrame) -> DataFrame:
    """One row per transcript: its exons as arrays in order, and the coding start where there is one."""
    rows = gtf_rows(gtf).where("transcript_id is not null")
    exons = rows.where("feature = 'exon' and left_pos is not null and right_pos is not null").distinct()
    by_tx = exons.groupBy("transcript_id", "gene_name", "chrom", "strand").agg(
        F.array_sort(F.collect_set(F.struct((F.col("left_pos") - 1).alias("s"), F.col("right_pos").alias("e")))).alias("x")
    )
    return by_tx.join(start_codons(rows), "transcript_id", "left").select(
        "transcript_id",
        "gene_name",
        "chrom",
        "strand",
        F.size("x").cast("bigint").alias("exon_count"),
        F.array_join(F.transform("x", lambda e: e["s"].cast("string")), ",").alias("exon_starts"),
        F.array_join(F.transform("x", lambda e: e["e"].cast("string")), ",").alias("exon_ends"),
        "atg",
    )


def spliced_sequences(predictions: DataFrame, genome: DataFrame, piece: int = 1 << 16) -> DataFrame:
    """Transcript sequences: exons cut from the genome and joined, on the strand of the transcript.

    Exons meet pieces of the genome of bounded length, never a chromosome.  Transcripts of chromosomes that the
    genome does not have are left out; what lies beyond the end of a chromosome is empty.
    """
    at, core = F.col("at"), F.col("core")
    chunks = pieces(genome.select("id", "seq"), piece).select(F.col("id").alias("chrom"), (at / piece).cast("bigint").alias("piece"), at, core, "seq")
    known = predictions.join(genome.where("seq is not null").select(F.col("id").alias("chrom")).distinct(), "chrom", "left_semi")
    starts, ends = (F.transform(F.split(c, ","), lambda x: x.cast("bigint")) for c in ("exon_starts", "exon_ends"))
    exons = known.select("transcript_id", "chrom", "strand", F.posexplode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("exon", "x"))
    s, e = F.col("x.s"), F.col("x.e")
    parts = exons.withColumn("piece", F.explode(F.sequence(F.floor(s / piece), F.floor(F.greatest(s, e - 1) / piece))))
    begin = F.greatest(s - at, F.lit(0).cast("bigint"))
    cut = F.substr("seq", (begin + 1).cast("int"), F.greatest(F.least(e - at, core) - begin, F.lit(0).cast("bigint")).cast("int"))
    joined = parts.join(chunks, ["chrom", "piece"], "left").select("transcript_id", "strand", F.struct("exon", "piece", F.coalesce(cut, F.lit("")).alias("text")).alias("part"))
    by_tx = joined.groupBy("transcript_id", "strand").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    plus = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    minus = F.translate(F.reverse(plus), "acgtACGT", "tgcaTGCA")
    return by_tx.select(F.col("transcript_id").alias("id"), F.when(F.col("strand") == "-", minus).otherwise(plus).alias("seq"))
