"""Round trips through the file formats: tables are written to the shared folder, read back, and compared with themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators import counts as C
from readloom.operators import reads as R
from readloom.operators import transcriptome as T
from readloom.operators.variants import aligner_variants
from readloom.plans.pipelines import alignment_counts
from readloom.sources import bam, fastq, formats
from readloom.session import scratch, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reads").select("ordinal", "acc", "seq", "sep", "qual", "well")


@query("""select row_number() over (order by ordinal) - 1 as ordinal, acc, seq, sep, qual from reads where seq is not null and qual is not null""")
def convert_fastq(spark: SparkSession, d: str) -> DataFrame:
    """Four lines per read in plain files, read in chunks and numbered in file order."""
    out = scratch(spark)
    whole = _reads(spark, d).where("seq is not null and qual is not null")
    fastq.write_fastq(whole.orderBy("ordinal"), out, compression="none")
    return fastq.read_fastq(spark, out, chunk=1 << 20).drop("file")


@query("""select row_number() over (order by ordinal) - 1 as ordinal, acc, seq, sep, qual from reads where seq is not null and qual is not null""")
def convert_fastq_gz(spark: SparkSession, d: str) -> DataFrame:
    out = scratch(spark)
    whole = _reads(spark, d).where("seq is not null and qual is not null")
    fastq.write_fastq(whole.orderBy("ordinal"), out)
    return fastq.read_fastq(spark, out).drop("file")


@query("select acc, coalesce(seq, '') as seq, sep, coalesce(qual, '') as qual from reads")
def one_line_reads(spark: SparkSession, d: str) -> DataFrame:
    """One read per line; a null field is an empty one."""
    out = scratch(spark)
    fastq.write_one_line(_reads(spark, d), out)
    return fastq.read_one_line(spark, out)


@query("select well, acc, seq from reads where seq is not null and qual is not null and well is not null")
def demultiplexed_files(spark: SparkSession, d: str) -> DataFrame:
    """Reads written per well, and read back with the well of their folder."""
    out = scratch(spark)
    fastq.write_demultiplexed(_reads(spark, d).where("seq is not null and qual is not null and well is not null"), out)
    return fastq.read_fastq(spark, out).select(F.regexp_extract("file", "/well=([^/]+)/", 1).alias("well"), "acc", "seq")


@query("select id, seq from contigs where seq is not null")
def fasta_files(spark: SparkSession, d: str) -> DataFrame:
    """Folded records, unfolded again; plain files are split at records."""
    out = scratch(spark)
    formats.write_fasta(table(spark, d, "contigs").where("seq is not null"), out, compression="none")
    return formats.read_fasta(spark, out)


@query("select chrom, start_pos, end_pos, id as name, score, strand from region_hits")
def bed_files(spark: SparkSession, d: str) -> DataFrame:
    """BED with a track line; null names and scores are dots."""
    out = scratch(spark)
    formats.write_bed(table(spark, d, "region_hits").withColumnRenamed("id", "name"), out, track=("hits", "All hits"))
    return formats.read_bed(spark, out)


@query("""select row_number() over (order by row_id) as row_id, chrom, source, feature, left_pos, right_pos, score, strand, frame, attrs from annotations""")
def gtf_files(spark: SparkSession, d: str) -> DataFrame:
    """GTF lines; the number of a row is its place in file order."""
    out = scratch(spark)
    formats.write_gtf(table(spark, d, "annotations"), out)
    return formats.read_gtf(spark, out)


@query("select acc, len from fasta_index")
def index_files(spark: SparkSession, d: str) -> DataFrame:
    out = scratch(spark)
    table(spark, d, "fasta_index").select("acc", "len").write.csv(out, sep="\t")
    return formats.read_index(spark, out)


@query("select sample_id, name, base from samples")
def design_files(spark: SparkSession, d: str) -> DataFrame:
    """A design with a header; packed cells with quotes and delimiters of their own are in the file, too."""
    out = scratch(spark)
    table(spark, d, "samples").select("sample_id", "name", "base", "fivep_beds").write.csv(out, header=True, escape='"')
    return formats.read_table(spark, out).select(F.col("sample_id").cast("bigint").alias("sample_id"), "name", "base")


@query("select row_number() over (order by pos) as pos, bc, well from barcode_map")
def barcode_files(spark: SparkSession, d: str) -> DataFrame:
    out = scratch(spark)
    table(spark, d, "barcode_map").orderBy("pos").select("bc", "well").write.csv(out)
    return formats.read_barcodes(spark, out)


@query("""select chrom, start_pos, start_pos + 1 as end_pos, 'h' || cast(hit_id as varchar) as name, cast(60 as bigint) as score, strand
from region_hits where score is not null and score % 13 < 2""")
def sam_files(spark: SparkSession, d: str) -> DataFrame:
    """Unique alignments of SAM text as BED; hits without a score are unmapped, the others have score % 13 places."""
    out = scratch(spark)
    flag = F.when(F.col("strand") == "-", 16).otherwise(0) + F.when(F.col("score").isNull(), 4).otherwise(0)
    fields = [F.concat(F.lit("h"), F.col("hit_id")), flag.cast("string"), F.col("chrom"), (F.col("start_pos") + 1).cast("string")]
    fields += [F.lit(x) for x in ("60", "1M", "*", "0", "0", "A", "F")]
    fields.append(F.concat(F.lit("NH:i:"), (F.coalesce("score", F.lit(0)) % 13).cast("string")))
    table(spark, d, "region_hits").select(F.concat_ws("\t", *fields).alias("value")).write.text(out)
    return formats.sam_to_bed(C.unique_alignments(formats.read_sam(spark, out)))


@query("""select chrom, case when strand = '+' then start_pos else end_pos - 1 end as start_pos,
  case when strand = '+' then start_pos + 1 else end_pos end as end_pos, strand, count(*) as score
from region_hits where score is not null and score % 13 < 2 group by 1, 2, 3, 4""")
def alignments_per_base(spark: SparkSession, d: str) -> DataFrame:
    """Counts per 5' end of the unique alignments in BAM files, one file per chromosome and part."""
    out = scratch(spark)
    hits = table(spark, d, "region_hits").withColumn("score", F.coalesce("score", F.lit(-1)))
    rows = spread(hits.select("hit_id", "chrom", "start_pos", "end_pos", "strand", "score"), per_core=1)
    bam.write_bam(
        rows.select(
            F.concat(F.lit("h"), F.col("hit_id")).alias("name"),
            "chrom",
            "start_pos",
            (F.col("end_pos") - F.col("start_pos")).alias("length"),
            (F.when(F.col("strand") == "-", 16).otherwise(0) + F.when(F.col("score") < 0, 4).otherwise(0)).alias("flag"),
            (F.col("score") % 13).alias("hits"),
        ),
        out,
    )
    counted = alignment_counts(spark, out)
    return counted.groupBy("chrom", "start_pos", "end_pos", "strand").agg(F.sum("score").alias("score"))


_OBSERVED = """case cast(hit_id % 6 as int) when 0 then 'A/C' when 1 then 'A/G/T' when 2 then '-/ACG' when 3 then '-/AC/T' when 4 then '-/A' else 'A/N' end"""
_CLASS = """case cast(hit_id % 6 as int) when 0 then 'single' when 1 then 'single' when 2 then 'insertion' when 3 then 'insertion' when 4 then 'deletion' else 'single' end"""
_SNP = f"""select hit_id, chrom, start_pos, case when hit_id % 6 in (2, 3) then start_pos else start_pos + 1 end as end_pos, strand, {_OBSERVED} as observed, {_CLASS} as class from region_hits"""


@query(f"""with s as ({_SNP}),
a as (select *, list_filter(list_transform(string_split(observed, '/'), lambda x: case when strand = '-' then translate(x, 'ACGT', 'TGCA') else x end), lambda x: regexp_full_match(x, '[ACGT]+')) as p from s),
v as (select *, case when class = 'deletion' then ['1'] when class = 'insertion' then list_transform(p, lambda x: case when strand = '-' then reverse(x) else x end) else list_filter(p, lambda x: x <> 'A') end as vals from a),
e as (select *, unnest(range(1, len(vals) + 1)) as i from v)
select case when len(vals) > 1 then 'rs' || hit_id || '.' || i else 'rs' || hit_id end as id, class as type, chrom, start_pos, vals[i] as value from e""")
def variation_files(spark: SparkSession, d: str) -> DataFrame:
    """Hits as polymorphisms, written as a table of the known ones and read as variants for an aligner."""
    out = scratch(spark)
    table(spark, d, "region_hits").createOrReplaceTempView("region_hits_as_snps")
    rows = spark.sql(_SNP.replace("from region_hits", "from region_hits_as_snps"))
    zero, empty = F.lit("0"), F.lit("")
    line = [zero, F.col("chrom"), F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), F.concat(F.lit("rs"), F.col("hit_id")), zero, F.col("strand")]
    line += [F.lit("A"), F.lit("A"), F.col("observed"), F.lit("genomic"), F.col("class"), empty]
    rows.select(F.concat_ws("\t", *line).alias("value")).write.text(out)
    return aligner_variants(formats.read_snps(spark, out))


@query("select ordinal, acc, left(seq, length(seq) - 2) as seq from reads where ends_with(seq, 'AG') and length(seq) - 2 >= 40")
def trimmed_apart(spark: SparkSession, d: str) -> DataFrame:
    """Reads that were trimmed go to a file of their own."""
    out = scratch(spark)
    trimmed, _ = R.split_trimmed(R.trim_3end("AG")(_reads(spark, d).drop("well")))
    trimmed.select("ordinal", "acc", "seq").write.parquet(out)
    return spark.read.parquet(out)


@query("""select acc, length(seq) as len from (
  select regexp_extract(id, '^\\s*(\\S*)', 1) as acc, seq from contigs where seq is not null and assembly = 'asm_main'
  union all select 'RNA_SPIKE_' || regexp_extract(id, '^\\s*(\\S*)', 1), 'AATTC' || seq from contigs where seq is not null and assembly = 'asm_draft')""")
def genome_archives(spark: SparkSession, d: str) -> DataFrame:
    """Genome and spike-in members of archives, normalised, as FASTA with an index of lengths.

    Members and sequences with an underscore are left out of the genome.
    """
    out = scratch(spark)
    contigs = table(spark, d, "contigs").where("seq is not null")
    formats.write_archive(contigs.where("assembly = 'asm_main'"), f"{out}/main", "chr")
    formats.write_archive(contigs.where("assembly = 'patch'"), f"{out}/main", "chr_patch")
    formats.write_archive(contigs.where("assembly = 'asm_draft'"), f"{out}/spike", "spikes")
    genome = T.primary_sequences(T.normalised_fasta(formats.read_archive(spark, f"{out}/main", exclude=["*_*"]).select("id", "seq")))
    spikes = T.spike_sequences(T.normalised_fasta(formats.read_archive(spark, f"{out}/spike").select("id", "seq")))
    formats.write_fasta(genome.unionByName(spikes), f"{out}/fasta")
    return T.sequence_index(formats.read_fasta(spark, f"{out}/fasta"))
