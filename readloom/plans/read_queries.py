"""Queries over the reads, intervals, annotations and sequences, each with its SQL on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.columns import first_token, fold, gtf_attribute, gtf_number, reverse_complement
from readloom.operators import counts as C
from readloom.operators import intervals as I
from readloom.operators import ordered as O
from readloom.operators import reads as R
from readloom.operators import transcriptome as T
from readloom.operators.demux import barcode_map, demultiplex
from readloom.operators.search import find_fragments
from readloom.plans.pipelines import depth_curve, prepare_reads, reference_sequences
from readloom.session import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Shared inputs ------------------------------------------------------------------------------------------------------


def reads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reads").select("ordinal", "acc", "seq", "sep", "qual")


def bed(spark: SparkSession, d: str) -> DataFrame:
    """Half-open intervals derived from line items."""
    return table(spark, d, "lineitem").selectExpr(
        "concat('chr', cast(l_suppkey % 5 + 1 as string)) as chrom",
        "cast(l_partkey * 10 + l_linenumber as bigint) as start_pos",
        "cast(l_partkey * 10 + l_linenumber + cast(l_quantity as bigint) as bigint) as end_pos",
        "concat('r', cast(l_orderkey as string)) as name",
        "cast(l_linenumber as bigint) as score",
        "case when l_linestatus = 'O' then '+' else '-' end as strand",
    )


def regions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(
        "concat('chr', cast(p_partkey % 5 + 1 as string)) as chrom",
        "cast(p_partkey * 10 as bigint) as start_pos",
        "cast(p_partkey * 10 + p_size * 20 as bigint) as end_pos",
        "p_brand as name",
        "cast(0 as bigint) as score",
        "case when p_partkey % 2 = 0 then '+' else '-' end as strand",
    )


_BED = """bed as (select 'chr' || cast(l_suppkey % 5 + 1 as varchar) as chrom, cast(l_partkey * 10 + l_linenumber as bigint) as start_pos,
  cast(l_partkey * 10 + l_linenumber + cast(l_quantity as bigint) as bigint) as end_pos, 'r' || cast(l_orderkey as varchar) as name,
  cast(l_linenumber as bigint) as score, case when l_linestatus = 'O' then '+' else '-' end as strand from lineitem)"""
_REGIONS = """regions as (select 'chr' || cast(p_partkey % 5 + 1 as varchar) as chrom, cast(p_partkey * 10 as bigint) as start_pos,
  cast(p_partkey * 10 + p_size * 20 as bigint) as end_pos, p_brand as name, 0 as score,
  case when p_partkey % 2 = 0 then '+' else '-' end as strand from part)"""


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Per-base counts of several samples."""
    return table(spark, d, "region_hits").select("base", "chrom", "start_pos", "end_pos", F.col("hit_id").cast("string").alias("name"), "score", "strand")


def hit_regions(spark: SparkSession, d: str) -> DataFrame:
    """One region per ID, chromosome and strand: what its hits span."""
    return (
        table(spark, d, "region_hits").where("id is not null")
        .groupBy(F.col("id").alias("name"), "chrom", "strand")
        .agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
        .select("chrom", "start_pos", "end_pos", "name", F.lit(0).cast("bigint").alias("score"), "strand")
    )


_HIT_REGIONS = """hit_regions as (select chrom, min(start_pos) as start_pos, max(end_pos) as end_pos, id as name, strand
  from region_hits where id is not null group by id, chrom, strand)"""

# Reads: row-wise ----------------------------------------------------------------------------------------------------

_TSO = "." * 12 + "GG"
_HIST = "select length(seq) as length, count(*) as reads from {} where seq is not null group by 1"


@query(_HIST.format("reads"))
def length_hist(spark, d):
    return C.length_histogram(reads(spark, d))


@query("select length(seq) as length, count(*) as count from reads where seq is not null group by 1")
def sum_counts(spark, d):
    """Histograms of the halves of the reads, summed."""
    all_reads = reads(spark, d)
    return C.sum_histograms(*[C.length_histogram(R.slice_reads(i, 2)(all_reads)) for i in (1, 2)])


@query("select h.length, h.reads, n as rows from (" + _HIST.format("reads") + ") h, (select count(*) as n from reads) t")
def tee_histogram(spark, d):
    """The histogram on the side, and how many rows went on."""
    kept, histogram = C.with_histogram(reads(spark, d))
    rows = kept.count()
    out = histogram.withColumn("rows", F.lit(rows).cast("bigint"))
    return out


_PRIMED = f"""with m as (select seq, regexp_extract(seq, '^(?:{_TSO}+)') as head from reads where regexp_matches(seq, '^(?:{_TSO})')),
t as (select substr(seq, length(head) + 1) as seq from m) select length(seq) as length, count(*) as reads from t where length(seq) >= 24 group by 1"""


@query(_PRIMED)
def primed_length_hist(spark, d):
    kept = reads(spark, d).transform(R.match_5end(_TSO)).transform(R.trim_5end(_TSO + "+", 24))
    return C.length_histogram(kept)


@query("select ordinal, acc || coalesce(substr(seq, 7, 6), '') as acc, seq, sep, qual from reads")
def annotate_index(spark, d):
    return R.annotate_index()(reads(spark, d))


@query("""with t as (select *, list_filter(string_split(acc, ' '), lambda x: x <> '') as k from reads)
select ordinal, case when seq is null then acc else k[1] || ':' || substr(seq, 1, 6) || case when len(k) >= 2 then ' ' || k[2] else '' end end as acc,
seq, sep, qual from t""")
def annotate_umi(spark, d):
    return R.annotate_umi()(reads(spark, d))


@query("select ordinal, acc, left(seq, length(seq) - 3) as seq, sep, left(qual, length(seq) - 3) as qual from reads where length(seq) - 3 >= 40")
def trim_length(spark, d):
    return R.trim_3end_length(3)(reads(spark, d))


_QUAL_SQL = """select ordinal, acc, left(seq, n) as seq, sep, left(qual, n) as qual
from (select *, length(regexp_extract(qual, '^[^!"#]*')) as n from {}) where seq is not null and n >= 40"""


@query(_QUAL_SQL.format("reads"))
def trim_quality(spark, d):
    return R.trim_3end_quality()(reads(spark, d))


@query(f"""with m as (select *, regexp_matches(seq, '^(?:{_TSO}+)') as hit, length(regexp_extract(seq, '^(?:{_TSO}+)')) as n from reads where seq is not null)
select ordinal, acc, case when hit then substr(seq, n + 1) else seq end as seq, sep, case when hit then substr(qual, n + 1) else qual end as qual
from m where not hit or length(seq) - n >= 24""")
def trim_5end(spark, d):
    return R.trim_5end(_TSO + "+")(reads(spark, d))


@query("""select ordinal, acc, case when hit then left(seq, length(seq) - 2) else seq end as seq, sep,
case when hit then left(qual, length(seq) - 2) else qual end as qual, hit as is_trimmed
from (select *, ends_with(seq, 'AG') as hit from reads where seq is not null) where not hit or length(seq) - 2 >= 40""")
def trim_3end(spark, d):
    return R.trim_3end("AG")(reads(spark, d))




def _primer_sql(primers) -> str:
    """A regular expression for the longest suffix that is a prefix of a primer."""
    fragments = sorted({p[:i] for p in primers for i in range(1, len(p) + 1)}, key=lambda f: (-len(f), f))
    return f"(?:{'|'.join(fragments)})$"


_PRIMER_SQL = """select ordinal, acc, left(seq, length(seq) - n) as seq, sep, left(qual, length(seq) - n) as qual
from (select *, length(regexp_extract(seq, '{}')) as n from {} where seq is not null) where n = 0 or length(seq) - n >= {}"""


@query(_PRIMER_SQL.format(_primer_sql(R.PRIMERS), "reads", 40))
def trim_primer(spark, d):
    return R.trim_3end_primer()(reads(spark, d))


@query("""select ordinal, acc, left(seq, length(seq) - n) as seq, sep, left(qual, length(seq) - n) as qual
from (select *, case when ends_with(seq, 'AC') then 2 else 1 end as n from reads where seq is not null) where length(seq) - n >= 40""")
def trim_primer_all_bases(spark, d):
    """All four bases are primer prefixes, so one base always goes."""
    return R.trim_3end_primer(("AC", "C", "G", "T"))(reads(spark, d))


for _name, _make, _cond in (
    ("match_5end", lambda: R.match_5end(_TSO), f"regexp_matches(seq, '^(?:{_TSO})')"),
    ("match_5end_inverted", lambda: R.match_5end(_TSO, invert=True), f"not regexp_matches(seq, '^(?:{_TSO})')"),
    ("match_3end", lambda: R.match_3end("A[CG]|T+G"), r"regexp_matches(seq, '(?:A[CG]|T+G)\z')"),
    ("match_3end_inverted", lambda: R.match_3end("A[CG]|T+G", invert=True), r"not regexp_matches(seq, '(?:A[CG]|T+G)\z')"),
    ("match_5end_whole_line", lambda: R.match_5end("[ACGTN]+\t[+]\t[!-~]*#", whole_line=True), "seq is not null and regexp_matches(concat_ws(chr(9), seq, sep, qual), '^(?:[ACGTN]+\t[+]\t[!-~]*#)')"),
    ("slice_reads", lambda: R.slice_reads(2, 7), "ordinal % 7 = 1"),
    ("thin_out", lambda: R.thin_out(3, 4), "ordinal % 7 < 3"),
    ("head_reads", lambda: R.head_reads(5000), "ordinal < 5000"),
    ("without_n", lambda: R.without_n(), "not contains(seq, 'N')"),
):
    QUERIES[_name] = lambda spark, d, make=_make: make()(reads(spark, d))
    SQL[_name] = f"select ordinal, acc, seq, sep, qual from reads where {_cond}"


@query("select ordinal, acc || chr(10) || seq || chr(10) || sep || chr(10) || qual as value from reads where seq is not null and qual is not null")
def restore_fastq(spark, d):
    return R.restore_fastq(reads(spark, d).where("seq is not null and qual is not null"))


# Reads: ordered -----------------------------------------------------------------------------------------------------

_LINE = "concat_ws(chr(9), seq, sep, qual)"


@query(f"select ordinal, row_number() over (order by {_LINE} desc, acc desc, ordinal) as rank from reads where seq is not null")
def sort_reads(spark, d):
    return O.sorted_reads(reads(spark, d).where("seq is not null")).select("ordinal", "rank")


@query(f"""select ordinal, row_number() over (order by {_LINE} desc, acc desc, ordinal) as rank from reads where seq is not null and ordinal % 3 <> 2""")
def merge_sorted(spark, d):
    """Two sorted inputs merged in order."""
    ok = reads(spark, d).where("seq is not null")
    parts = [O.sorted_reads(R.slice_reads(i, 3)(ok)).drop("rank") for i in (1, 2)]
    return O.sorted_reads(parts[0].unionByName(parts[1])).select("ordinal", "rank")


@query()
def exclude_degenerate_in_order(spark, d):
    """Reads as they come, per library and well."""
    rows = table(spark, d, "reads").select("ordinal", "acc", "seq", "sep", "qual", "base", "well")
    return O.exclude_degenerate_in_order(rows, ["base", "well"])


_WHOLE = "concat_ws(chr(9), acc, seq, sep, qual)"


@query(f"select ordinal, row_number() over (order by regexp_extract({_WHOLE}, '^\\S*([\\s\\S]*)$', 1), {_WHOLE}, ordinal) as rank from reads where seq is not null")
def sort_index(spark, d):
    return O.index_sorted_reads(reads(spark, d).where("seq is not null"), ["ordinal"])


_W1 = "qualify row_number() over (partition by {}seq order by concat_ws(chr(9), sep, qual) desc, acc desc, ordinal) = 1"


@query(f"select ordinal, acc, seq, sep, qual from reads where seq is not null {_W1.format('')}")
def exclude_duplicate(spark, d):
    return O.exclude_duplicate(reads(spark, d))


@query("select ordinal, acc, seq, sep, qual from (select *, lag(seq) over (order by ordinal) as p from reads where seq is not null) where p is null or p <> seq")
def exclude_duplicate_in_order(spark, d):
    return O.exclude_duplicate_in_order(reads(spark, d))


_W2 = """{0}_s as (select distinct {1}seq from {0}), {0}_n as (select *, lead(seq) over ({2}order by seq) as nx from {0}_s)"""


@query("with reads_ok as (select ordinal, acc, seq, sep, qual from reads where seq is not null), "
       + _W2.format("reads_ok", "", "")
       + " select r.* from reads_ok r join reads_ok_n n using (seq) where nx is null or not starts_with(nx, seq)")
def exclude_degenerate(spark, d):
    return O.exclude_degenerate(reads(spark, d))


_NEAR = """obs as (select distinct right(acc, 6) as o from {0}),
near as (select o, well, row_number() over (partition by o order by levenshtein(o, bc), pos) as r from obs join barcode_map on levenshtein(o, bc) <= 1)"""


@query("with " + _NEAR.format("reads") + """ select ordinal, acc, coalesce(n.well, 'NA') as well from reads left join near n on n.o = right(acc, 6) and r = 1""")
def demultiplexed(spark, d):
    barcodes = barcode_map(table(spark, d, "barcode_map"))
    return demultiplex(reads(spark, d), barcodes).select("ordinal", "acc", "well")


# Pipelines ----------------------------------------------------------------------------------------------------------

_CUT_PRIMER = _primer_sql(R.PRIMERS)
_STEPS = f"""
with s1 as (select * from reads where seq is not null),
s2 as (select * from s1 where regexp_matches(seq, '^(?:{_TSO})')),
named as (select ordinal, seq, sep, qual, list_filter(string_split(acc || substr(seq, 7, 6), ' '), lambda x: x <> '') as k from s2),
umi as (select ordinal, k[1] || ':' || substr(seq, 1, 6) || case when len(k) >= 2 then ' ' || k[2] else '' end as acc, seq, sep, qual from named),
{_NEAR.format("umi")},
s3 as (select u.*, coalesce(n.well, 'NA') as well from umi u left join near n on n.o = right(acc, 6) and r = 1),
s4 as (select * from s3 {_W1.format("well, ")}),
s5 as (select ordinal, acc, well, left(seq, n) as seq, sep, left(qual, n) as qual
  from (select *, length(regexp_extract(qual, '^[^!"#]*')) as n from s4) where n >= 40),
s6 as (select ordinal, acc, well, left(seq, length(seq) - n) as seq, sep, left(qual, length(seq) - n) as qual
  from (select *, length(regexp_extract(seq, '{_CUT_PRIMER}')) as n from s5) where n = 0 or length(seq) - n >= 40),
{_W2.format("s6", "well, ", "partition by well ")},
s7 as (select s6.* from s6 join s6_n n on n.well = s6.well and n.seq = s6.seq where nx is null or not starts_with(nx, s6.seq)),
hit as (select *, regexp_matches(seq, '^(?:{_TSO}+)') as hit, length(regexp_extract(seq, '^(?:{_TSO}+)')) as n from s7),
s8 as (select ordinal, acc, well, case when hit then substr(seq, n + 1) else seq end as seq, sep,
  case when hit then substr(qual, n + 1) else qual end as qual from hit where not hit or length(seq) - n >= 24)
"""
_STEP_HISTS = " union all ".join(
    f"select {n} as step, {'null' if n < 3 else 'well'} as well, length(seq) as length, count(*) as reads from s{n} group by 1, 2, 3" for n in range(1, 9)
)


@query(_STEPS + "select ordinal, acc, seq, sep, qual, well from s8")
def prepared_reads(spark, d):
    return prepare_reads(reads(spark, d), barcode_map(table(spark, d, "barcode_map")))[0].select("ordinal", "acc", "seq", "sep", "qual", "well")


@query(_STEPS + _STEP_HISTS)
def prepare_steps(spark, d):
    return prepare_reads(reads(spark, d), barcode_map(table(spark, d, "barcode_map")))[1]


_DEPTH_HEAD = "." * 12 + "GG"
_DEPTH = f"""
with drawn as (select r.*, g.draw from (select * from reads where seq is not null) r, (select unnest(range(1, 13)) as draw) g where r.ordinal % 12 < g.draw),
a as (select * from drawn {_W1.format("draw, ")}),
b as (select * from a where regexp_matches(seq, '^(?:{_DEPTH_HEAD})') and not contains(seq, 'N')),
q as (select draw, left(seq, n) as seq from (select *, length(regexp_extract(qual, '^[^!"#]*')) as n from b) where n >= 40),
p as (select draw, left(seq, length(seq) - n) as seq from (select *, length(regexp_extract(seq, '{_primer_sql(R.PRIMERS[:1])}')) as n from q)
  where n = 0 or length(seq) - n >= 40),
{_W2.format("p", "draw, ", "partition by draw ")},
z as (select p.draw, p.seq from p join p_n n on n.draw = p.draw and n.seq = p.seq where nx is null or not starts_with(nx, p.seq))
"""
_RAW = "(select draw, count(*) as raw from drawn group by draw)"


@query(_DEPTH + f"select draw, raw, coalesce(nr, 0) as nr from {_RAW} left join (select draw, count(*) as nr from z group by draw) using (draw)")
def depth(spark, d):
    return depth_curve(reads(spark, d))


@query(_DEPTH + f"""select draw, raw, coalesce(nr, 0) as nr from {_RAW} left join (
  select draw, count(distinct case when hit then substr(seq, n + 1) else seq end) as nr from (
    select *, regexp_matches(seq, '^(?:{_DEPTH_HEAD}+)') as hit, length(regexp_extract(seq, '^(?:{_DEPTH_HEAD}+)')) as n from z)
  where not hit or length(seq) - n >= 25 group by draw) using (draw)""")
def depth_tss(spark, d):
    return depth_curve(reads(spark, d), tss=True)


# Sequences ----------------------------------------------------------------------------------------------------------


@query("select contig_id, translate(reverse(seq), 'acgtACGT', 'tgcaTGCA') as rc from contigs")
def reverse_complements(spark, d):
    return table(spark, d, "contigs").select("contig_id", reverse_complement(F.col("seq")).alias("rc"))


_FIND = """with p as (select {chrom} as chrom, seq, translate(reverse(seq), 'acgtACGT', 'tgcaTGCA') as rc, length(seq) as n from contigs where seq is not null),
s as (select chrom, n, '+' as strand, i, regexp_extract(substr(seq, i + 1), '^(?i:{pat})') as m from (select *, unnest(range(0, n)) as i from p)
  union all
  select chrom, n, '-', i, regexp_extract(substr(rc, i + 1), '^(?i:{pat})') from (select *, unnest(range(0, n)) as i from p))
select chrom, case when strand = '+' then i else n - i - length(m) end as start_pos,
  case when strand = '+' then i + length(m) else n - i end as end_pos, '{pat}' as name, cast(0 as bigint) as score, strand from s where m <> ''"""


@query(_FIND.format(pat="GA[CT]TC", chrom="cast(contig_id as varchar)"))
def find_motif(spark, d):
    seqs = table(spark, d, "contigs").select(F.col("contig_id").cast("string").alias("id"), "seq")
    return find_fragments(seqs, "GA[CT]TC")


@query("select regexp_extract(id, '^\\s*(\\S*)', 1) as id, regexp_replace(seq, '(.{50})', '\\1' || chr(10), 'g') as folded, contig_id from contigs where length(seq) % 50 <> 0"
       " union all select regexp_extract(id, '^\\s*(\\S*)', 1), rtrim(regexp_replace(seq, '(.{50})', '\\1' || chr(10), 'g'), chr(10)), contig_id from contigs where length(seq) % 50 = 0")  # fmt: skip
def fasta_folded(spark, d):
    seqs = table(spark, d, "contigs").where("seq is not null")
    return seqs.select(first_token(F.col("id")).alias("id"), fold(F.col("seq")).alias("folded"), "contig_id")


@query("select id as acc, length(seq) as len from contigs where seq is not null")
def sequence_index(spark, d):
    return T.sequence_index(table(spark, d, "contigs").where("seq is not null"))


_SPIKE_SEQ = "'AATTC' || case when id = 'ERCC-00130' then 'GAGCTC' else '' end || seq"


@query(f"select 'RNA_SPIKE_' || id as id, {_SPIKE_SEQ} as seq from contigs where seq is not null")
def spike_sequences(spark, d):
    return T.spike_sequences(table(spark, d, "contigs").where("seq is not null").select("id", "seq"))


@query(f"""select acc, length(seq) as len from (
  select regexp_extract(id, '^\\s*(\\S*)', 1) as acc, seq from contigs where seq is not null and not contains(id, '_') and assembly not in ('asm_draft', 'patch')
  union all select 'RNA_SPIKE_' || id, {_SPIKE_SEQ} from contigs where seq is not null and assembly = 'asm_draft'
  union all select 'RIBO_U13369.1', seq from contigs where seq is not null and assembly = 'patch')""")
def reference_index(spark, d):
    """Genome, spike-in and ribosomal sequences joined, with their lengths; the assembly tells the role."""
    seqs = table(spark, d, "contigs").where("seq is not null")
    genome = T.normalised_fasta(T.primary_sequences(seqs.where("assembly not in ('asm_draft', 'patch')")))
    spikes = T.spike_sequences(seqs.where("assembly = 'asm_draft'"))
    ribosome = T.ribosome_sequences(seqs.where("assembly = 'patch'"))
    return T.sequence_index(reference_sequences(genome, spikes, ribosome))


# Intervals ----------------------------------------------------------------------------------------------------------

_OVERLAP = "a.chrom = b.chrom and a.strand = b.strand and a.start_pos < b.end_pos and b.start_pos < a.end_pos"


@query(f"with {_BED}, {_REGIONS} select b.name as \"ID\", cast(sum(a.score) as bigint) as \"COUNT\" from bed a join regions b on {_OVERLAP} group by b.name")
def count_per_region(spark, d):
    return C.count_per_region(bed(spark, d), regions(spark, d))


@query(f"""with {_BED}, {_REGIONS} select b.chrom, b.start_pos, b.end_pos, b.strand, b.name, count(*) as pairs, min(a.start_pos) as first_start,
max(a.end_pos) as last_end, count(distinct a.name) as names from bed a join regions b on {_OVERLAP} group by b.chrom, b.start_pos, b.end_pos, b.strand, b.name""")
def intersect_pairs(spark, d):
    pairs = I.overlap_pairs(bed(spark, d), regions(spark, d))
    keys = [F.col(f"b_{c}").alias(c) for c in ("chrom", "start_pos", "end_pos", "strand", "name")]
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("pairs"),
        F.min("a_start_pos").alias("first_start"),
        F.max("a_end_pos").alias("last_end"),
        F.count_distinct("a_name").alias("names"),
    )


@query(f"""with {_BED}, {_REGIONS} select chrom, strand, count(*) as n, cast(sum(score) as bigint) as score from bed a
where exists (select 1 from regions b where {_OVERLAP}) group by chrom, strand""")
def intersect_any(spark, d):
    hit = I.overlap_any(bed(spark, d), regions(spark, d))
    return hit.groupBy("chrom", "strand").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@query(f"""with {_BED}, {_REGIONS},
t as (select b.name as name1, a.name as name2,
  case when b.strand = '+' then a.end_pos - b.start_pos + 1 else b.end_pos - a.start_pos + 1 end as dist from regions b join bed a on a.chrom = b.chrom
  where (b.strand = '+' and a.end_pos - b.start_pos + 1 >= -20 and a.end_pos - b.start_pos + 1 < 20)
     or (b.strand <> '+' and b.end_pos - a.start_pos + 1 >= -20 and b.end_pos - a.start_pos + 1 < 20))
select * from t""")
def gap_near(spark, d):
    """Pairs within 20 bases, listed."""
    return I.gap_distances(regions(spark, d), bed(spark, d), -20, 20)


@query(f"""with {_BED}, {_REGIONS},
t as (select b.name as name1, a.end_pos - b.start_pos + 1 as dist from regions b join bed a on a.chrom = b.chrom
    and a.end_pos >= b.start_pos - 10001 and a.end_pos < b.start_pos + 2499 where b.strand = '+'
  union all
  select b.name, b.end_pos - a.start_pos + 1 from regions b join bed a on a.chrom = b.chrom
    and a.start_pos > b.end_pos - 2499 and a.start_pos <= b.end_pos + 10001 where b.strand <> '+')
select name1, dist, count(*) as pairs from t group by name1, dist""")
def gap(spark, d):
    """Every pair of the default window -10000..2500, counted per name and distance."""
    return I.gap_distances(regions(spark, d), spread(bed(spark, d))).groupBy("name1", "dist").agg(F.count("*").alias("pairs"))


@query("""with e as (select distinct nullif(regexp_extract(attrs, 'gene_name "([^"]+)"', 1), '') as name, chrom, strand, left_pos - 1 as s, right_pos as e
  from annotations where feature = 'exon' and left_pos <= right_pos),
r as (select *, max(e) over (partition by name, chrom, strand order by s, e rows between unbounded preceding and 1 preceding) as reach from e),
i as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by name, chrom, strand order by s, e rows unbounded preceding) as g from r)
select name, chrom, strand, min(s) as start_pos, max(e) as end_pos from i group by name, chrom, strand, g""")
def merge_by_gene(spark, d):
    rows = T.gtf_rows(table(spark, d, "annotations")).where("feature = 'exon' and left_pos <= right_pos")
    exons = rows.select(F.col("gene_name").alias("name"), "chrom", "strand", (F.col("left_pos") - 1).alias("start_pos"), F.col("right_pos").alias("end_pos"))
    return I.merge_intervals(exons, ["name", "chrom", "strand"])


@query(f"""with {_BED} select chrom, p as start_pos, p + 1 as end_pos, 'lineitem' as name, count(*) as score, strand
from (select chrom, strand, case when strand = '+' then start_pos else end_pos - 1 end as p from bed) group by chrom, p, strand""")
def count_per_base(spark, d):
    return C.count_per_base(bed(spark, d), F.lit("lineitem"))


# Counting -----------------------------------------------------------------------------------------------------------


@query(f"""with {_HIT_REGIONS}
select r.name as "ID", h.base as sample, count(distinct h.hit_id) as n from hit_regions r join region_hits h
  on r.chrom = h.chrom and r.strand = h.strand and r.start_pos < h.end_pos and h.start_pos < r.end_pos
where h.base in (select base from samples) group by r.name, h.base""")
def count_distinct_region(spark, d):
    """Each library is a sample of its own."""
    libraries = table(spark, d, "samples").where("base is not null").select(F.col("base").alias("sample"), "base").distinct()
    return C.count_distinct_per_region(hit_regions(spark, d), hits(spark, d), libraries)


_QUANT = f"""with {_HIT_REGIONS},
t as (select r.name as id, h.base, sum(h.score) as r from hit_regions r join region_hits h
  on r.chrom = h.chrom and r.strand = h.strand and r.start_pos < h.end_pos and h.start_pos < r.end_pos group by r.name, h.base),
s as (select base, sum(r) as spike from t where starts_with(id, 'RNA_SPIKE_') group by base)"""


@query(_QUANT + """ select t.id as "ID", t.base, cast(t.r as bigint) as "R", round(cast(t.r as double) / cast(coalesce(s.spike, 0) as double) * 1000, 6) as "N", coalesce(cast(f.len as varchar), 'NA') as len
from t left join s using (base) left join fasta_index f on f.acc = t.id""")
def quantify(spark, d):
    annotations = table(spark, d, "fasta_index").select(F.col("acc").alias("ID"), "len")
    out = C.quantify(hits(spark, d), hit_regions(spark, d), annotations)
    return out.withColumn("N", F.round("N", 6))


#: Libraries that may become columns.
_MOST_LIBRARIES = 5_000


def libraries(spark: SparkSession, d: str) -> list[str]:
    """Distinct libraries of the design, in order."""
    names = table(spark, d, "samples").where("base is not null").select("base").distinct().limit(_MOST_LIBRARIES + 1)
    found = sorted(r.base for r in names.collect())
    if len(found) > _MOST_LIBRARIES:
        raise ValueError(f"more than {_MOST_LIBRARIES} libraries")
    return found


@query(_QUANT + """, design as (select distinct base from samples where base is not null),
d as (select t.* from t join design using (base)),
cells as (select i.id as "ID", 'R|' || design.base as cell, cast(coalesce(d.r, 0) as bigint) as r
  from (select distinct id from d) i cross join design left join d on d.id = i.id and d.base = design.base)
pivot cells on cell using first(r) group by "ID\"""")
def read_matrix(spark, d):
    """Reads per region in wide form, with a column for every library of the design."""
    bases = libraries(spark, d)
    long = C.count_per_region(hits(spark, d).where(F.col("base").isin(bases)), hit_regions(spark, d), ["base"])
    return C.wide(long, "ID", "base", "COUNT", bases, "R")


_ENDS = f"""with {_HIT_REGIONS},
t as (select r.name as id, h.base, h.hit_id from hit_regions r join region_hits h
  on r.chrom = h.chrom and r.strand = h.strand and r.start_pos < h.end_pos and h.start_pos < r.end_pos)"""


@query(_ENDS + """, design as (select distinct base from samples where base is not null),
d as (select id, base, count(distinct hit_id) as n from t join design using (base) group by id, base),
cells as (select i.id as "ID", 'R|' || design.base as cell, coalesce(d.n, 0) as n
  from (select distinct id from d) i cross join design left join d on d.id = i.id and d.base = design.base)
pivot cells on cell using first(n) group by "ID\"""")
def count_matrix(spark, d):
    """Distinct 5' ends per region in wide form for the sink, with a column for every library of the design."""
    bases = libraries(spark, d)
    design = table(spark, d, "samples").where("base is not null").select(F.col("base").alias("sample"), "base").distinct()
    long = C.count_distinct_per_region(hit_regions(spark, d), hits(spark, d), design)
    return C.wide(long, "ID", "sample", "n", bases, "R")


@query(_ENDS + """ select t.id as "ID", s.name as sample, count(distinct hit_id) as n
from t join (select distinct name, base from samples where name is not null and base is not null) s using (base) group by t.id, s.name""")
def count_per_sample(spark, d):
    """Distinct 5' ends per region and sample name in long form: a name has the ends of all its libraries."""
    design = table(spark, d, "samples").where("name is not null and base is not null").select(F.col("name").alias("sample"), "base").distinct()
    return C.count_distinct_per_region(hit_regions(spark, d), hits(spark, d), design)


_Q_REGIONS = f"""with {_HIT_REGIONS},
q as (select 'ribosome' as k, chrom, strand, start_pos, end_pos from hit_regions where starts_with(name, 'RIBO_')
  union all select 'spikein_whole', chrom, strand, start_pos, end_pos from hit_regions where starts_with(name, 'RNA_SPIKE_')
  union all select 'spikein_5end', chrom, strand, start_pos, start_pos + 200 from hit_regions where starts_with(name, 'RNA_SPIKE_')
  union all select 'coding_whole', chrom, strand, start_pos, end_pos from hit_regions where not starts_with(name, 'RIBO_') and not starts_with(name, 'RNA_SPIKE_')
  union all select 'coding_5end', chrom, strand, start_pos, start_pos + 100 from hit_regions where not starts_with(name, 'RIBO_') and not starts_with(name, 'RNA_SPIKE_')),
m as (select base, hit_id, score, chrom, strand, start_pos, end_pos from region_hits),
h as (select q.k, m.base, m.hit_id, any_value(m.score) as score from m join q
  on m.chrom = q.chrom and m.strand = q.strand and m.start_pos < q.end_pos and q.start_pos < m.end_pos group by q.k, m.base, m.hit_id),
v as (select base, coalesce(sum(score) filter (k = 'ribosome'), 0) as ribo, coalesce(sum(score) filter (k = 'spikein_whole'), 0) as spike,
  coalesce(sum(score) filter (k = 'spikein_5end'), 0) as spike5, coalesce(sum(score) filter (k = 'coding_whole'), 0) as cod,
  coalesce(sum(score) filter (k = 'coding_5end'), 0) as cod5 from h group by base),
w as (select base, sum(score) as mapped from m group by base), t as (select base, count(*) as total from reads where base is not null group by base),
b as (select distinct base from samples where base is not null)
select b.base, total as "TOTAL_READS", cast(mapped as bigint) as "MAPPED_READS", cast(ribo as bigint) as "RIBOSOME_READS",
  cast(spike as bigint) as "SPIKEIN_READS", cast(spike5 as bigint) as "SPIKEIN_5END_READS", cast(cod as bigint) as "CODING_READS",
  cast(cod5 as bigint) as "CODING_5END_READS", round(mapped::double / total::double, 6) as "MAPPED_RATE", round(spike5::double / spike::double, 6) as "SPIKEIN_5END_RATE",
  round((mapped - ribo - spike)::double / spike5::double, 6) as "RELATIVE_POLYA_RNAS", round(cod5::double / cod::double, 6) as "CODING_5END_RATE",
  round(cod5::double / spike5::double, 6) as "RELATIVE_MRNAS"
from b left join t using (base) left join w using (base) left join v using (base)"""


@query(_Q_REGIONS)
def qualify(spark, d):
    all_regions = hit_regions(spark, d)
    ribosome = all_regions.where("startswith(name, 'RIBO_')")
    spikes = all_regions.where("startswith(name, 'RNA_SPIKE_')")
    coding = all_regions.where("not startswith(name, 'RIBO_') and not startswith(name, 'RNA_SPIKE_')")
    sets = {
        "ribosome": ribosome,
        "spikein_whole": spikes,
        "spikein_5end": spikes.withColumn("end_pos", F.col("start_pos") + 200),
        "coding_whole": coding,
        "coding_5end": coding.withColumn("end_pos", F.col("start_pos") + 100),
    }
    design = table(spark, d, "samples").where("base is not null").select("base").distinct()
    totals = table(spark, d, "reads").where("base is not null").groupBy("base").agg(F.count("*").alias("TOTAL_READS"))
    out = C.qualify(design, totals, hits(spark, d), sets)
    rates = ("MAPPED_RATE", "SPIKEIN_5END_RATE", "RELATIVE_POLYA_RNAS", "CODING_5END_RATE", "RELATIVE_MRNAS")
    return out.withColumns({c: F.round(c, 6) for c in rates})


@query("select base, cast(sum(score) as bigint) as total, count(*) as n from region_hits group by base")
def column_totals(spark, d):
    return table(spark, d, "region_hits").groupBy("base").agg(F.sum("score").alias("total"), F.count("*").alias("n"))


@query("""select acc, case when starts_with(acc, 'RIBO_') then 'ribosome' when starts_with(acc, 'RNA_SPIKE_') then 'spikein' else 'other' end as class from fasta_index""")
def name_classes(spark, d):
    acc = F.col("acc")
    kind = F.when(acc.startswith(C.RIBOSOME), "ribosome").when(acc.startswith(C.SPIKE), "spikein").otherwise("other")
    return table(spark, d, "fasta_index").select("acc", kind.alias("class"))


@query("select distinct chrom, start_pos, end_pos, strand from region_hits")
def distinct_points(spark, d):
    return table(spark, d, "region_hits").select("chrom", "start_pos", "end_pos", "strand").distinct()


@query("select hit_id, row_number() over (order by chrom, start_pos, end_pos, id nulls first, hit_id) as rank from region_hits")
def bed_sort(spark, d):
    order = [F.col(c).asc_nulls_first() for c in ("chrom", "start_pos", "end_pos", "id", "hit_id")]
    return O.ranked(table(spark, d, "region_hits"), *order).select("hit_id", "rank")


@query("select acc, seq from reads union all select id, seq from contigs")
def concat_sequences(spark, d):
    contigs = table(spark, d, "contigs").select(F.col("id").alias("acc"), "seq")
    return table(spark, d, "reads").select("acc", "seq").unionByName(contigs)


_SAM = """select hit_id, concat_ws(chr(9), 'h' || cast(hit_id as {text}), cast((case when strand = '-' then 16 else 0 end) + (case when score is null then 4 else 0 end) as {text}),
 chrom, cast(start_pos + 1 as {text}), '60', '1M', '*', '0', '0', 'A', 'F', 'NH:i:' || cast(coalesce(score, 0) % 13 as {text})) as value from {table}"""


@query("with sam as (" + _SAM.format(text="varchar", table="region_hits") + """) select * from sam
where not regexp_matches(value, 'NH:i:(?:[2-9][0-9]*|1[0-9]+)') and hit_id in (select hit_id from region_hits where score is not null)""")
def unique_alignments(spark, d):
    """Alignment lines built from the hits; unmapped and multiply mapped ones go."""
    table(spark, d, "region_hits").createOrReplaceTempView("sam_source")
    sql = _SAM.format(text="string", table="sam_source").replace("chr(9)", "char(9)")
    return C.unique_alignments(spark.sql(sql))


@query("""select hit_id, case when score < 20 or least(score, coalesce(end_pos - start_pos + 25, score)) < 20 then 'LowQual' else 'PASS' end as filter
from region_hits where score is not null""")
def soft_filter(spark, d):
    """Hits as variants: the score as quality and as one of two depths."""
    rows = table(spark, d, "region_hits").where("score is not null")
    rows = rows.withColumn("dp", F.array("score", F.col("end_pos") - F.col("start_pos") + 25))
    return C.soft_filter(rows, "score", "dp").select("hit_id", "filter")


# Annotations --------------------------------------------------------------------------------------------------------

_GTF = """g as (select row_id, chrom, feature, left_pos, right_pos, strand, attrs,
  coalesce(nullif(regexp_extract(attrs, 'gene_name "([^"]+)"', 1), ''), '') || '|' || coalesce(nullif(regexp_extract(attrs, 'gene_id "([^"]+)"', 1), ''), '') || '|'
  || coalesce(nullif(regexp_extract(attrs, 'transcript_id "([^"]+)"', 1), ''), '') as name,
  nullif(regexp_extract(attrs, 'transcript_id "([^"]+)"', 1), '') as tx, coalesce(try_cast(nullif(regexp_extract(attrs, 'exon_number (\\d+)', 1), '') as bigint), 0) as no
  from annotations)"""
_ATG = """atg as (select tx, max_by(case when strand = '+' then left_pos else right_pos end, row_id) as atg from g where feature = 'start_codon' and tx is not null group by tx)"""


@query("""select row_id, nullif(regexp_extract(attrs, 'gene_id "([^"]+)"', 1), '') as gene_id, nullif(regexp_extract(attrs, 'transcript_id "([^"]+)"', 1), '') as transcript_id,
nullif(regexp_extract(attrs, 'gene_name "([^"]+)"', 1), '') as gene_name, coalesce(try_cast(nullif(regexp_extract(attrs, 'exon_number (\\d+)', 1), '') as bigint), 0) as exon_number from annotations""")
def gtf_attributes(spark, d):
    a = F.col("attrs")
    return table(spark, d, "annotations").select(
        "row_id", *[gtf_attribute(a, n).alias(n) for n in ("gene_id", "transcript_id", "gene_name")], gtf_number(a, "exon_number").alias("exon_number")
    )


@query("select row_id, feature from annotations where feature in ('exon', 'transcript') and contains(attrs, 'tag \"basic\"')")
def gtf_basic(spark, d):
    return T.basic(table(spark, d, "annotations")).where("feature in ('exon', 'transcript')").select("row_id", "feature")


_SETS = f"""with {_GTF}, {_ATG},
p as (select g.*, atg from g left join atg using (tx) where feature in ('exon', 'transcript') and left_pos is not null and right_pos is not null),
k as (select *, case when atg is null then 'other' else 'coding' end as c from p),
sets as (
  select c || case feature when 'transcript' then '_gene' else '_exon' end as region_set, chrom, left_pos - 1 as start_pos, right_pos as end_pos, name, strand from k
  union all
  select 'coding_5utr', chrom, s, e, name, strand from (
    select *, case when (strand = '+' and right_pos < atg) or (strand = '-' and atg < left_pos) then left_pos - 1
        when strand = '+' and left_pos < atg and atg <= right_pos then left_pos - 1 when strand = '-' and left_pos <= atg and atg < right_pos then atg end as s,
      case when (strand = '+' and right_pos < atg) or (strand = '-' and atg < left_pos) then right_pos
        when strand = '+' and left_pos < atg and atg <= right_pos then atg - 1 when strand = '-' and left_pos <= atg and atg < right_pos then right_pos end as e
    from k where feature = 'exon' and c = 'coding') where s is not null
  union all
  select c || '_promoter', chrom, case when strand = '+' then greatest(left_pos - 500, 0) else right_pos end,
    case when strand = '+' then left_pos - 1 else right_pos + 499 end, name, case when strand = '+' then '+' else '-' end from k where feature = 'exon' and no = 1
  union all
  select 'other_1st_exon', chrom, left_pos - 1, right_pos, name, strand from k where feature = 'exon' and no = 1 and c = 'other')"""


@query(_SETS + " select region_set, chrom, start_pos, end_pos, name, cast(0 as bigint) as score, strand from sets")
def region_sets(spark, d):
    return T.region_sets(table(spark, d, "annotations"))


def _coding_5end(spark, d):
    return T.region_sets(table(spark, d, "annotations")).where("region_set in ('coding_promoter', 'coding_5utr')")


@query(_SETS + """, e as (select distinct split_part(name, '|', 1) as name, chrom, strand, start_pos as s, end_pos as e from sets
  where region_set in ('coding_promoter', 'coding_5utr') and start_pos < end_pos),
r as (select *, max(e) over (partition by name, chrom, strand order by s, e rows between unbounded preceding and 1 preceding) as reach from e),
i as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by name, chrom, strand order by s, e rows unbounded preceding) as g from r)
select chrom, min(s) as start_pos, max(e) as end_pos, name, cast(0 as bigint) as score, strand from i group by name, chrom, strand, g""")
def coding_5end(spark, d):
    return T.merged_by_gene(_coding_5end(spark, d))


def _coding_whole(spark, d):
    return T.region_sets(table(spark, d, "annotations")).where("region_set in ('coding_promoter', 'coding_exon')")


@query(_SETS + """, e as (select distinct split_part(name, '|', 1) as name, chrom, strand, start_pos as s, end_pos as e from sets
  where region_set in ('coding_promoter', 'coding_exon') and start_pos < end_pos),
r as (select *, max(e) over (partition by name, chrom, strand order by s, e rows between unbounded preceding and 1 preceding) as reach from e),
i as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by name, chrom, strand order by s, e rows unbounded preceding) as g from r)
select chrom, min(s) as start_pos, max(e) as end_pos, name, cast(0 as bigint) as score, strand from i group by name, chrom, strand, g""")
def coding_whole(spark, d):
    return T.merged_by_gene(_coding_whole(spark, d))


_ACCESSIONS = """, m as (select split_part(name, '|', 1) as id, split_part(name, '|', 2) as gene, split_part(name, '|', 3) as tx,
    min(row(chrom, start_pos, split_part(name, '|', 2), split_part(name, '|', 3))) as met
  from sets where region_set in ('coding_promoter', 'coding_exon') group by all),
n as (select id, gene, min(met) as met, gene || ':' || string_agg(tx, ';' order by met) as cell from m group by id, gene)
select id as "ID", string_agg(cell, '|' order by met) as "ACCESSIONS" from n group by id"""


@query(_SETS + _ACCESSIONS)
def coding_whole_accessions(spark, d):
    return T.gene_accessions(_coding_whole(spark, d))


@query(_SETS + _ACCESSIONS.replace("'coding_exon'", "'coding_5utr'"))
def gene_accessions(spark, d):
    return T.gene_accessions(_coding_5end(spark, d))


@query("""select 'ribosome' as region_set, acc as chrom, cast(0 as bigint) as start_pos, len as end_pos, acc as name, cast(0 as bigint) as score, s as strand
from fasta_index, (values ('+'), ('-')) t(s) where starts_with(acc, 'RIBO_')
union all select 'spikein_whole', acc, 0, len, acc, 0, '+' from fasta_index where starts_with(acc, 'RNA_SPIKE_')
union all select 'spikein_5end', acc, 0, 50, acc, 0, '+' from fasta_index where starts_with(acc, 'RNA_SPIKE_')""")
def index_regions(spark, d):
    return T.index_regions(table(spark, d, "fasta_index"))


@query(f"""with {_GTF}, {_ATG}, h as (select *, nullif(regexp_extract(attrs, 'gene_name "([^"]+)"', 1), '') as gene_name from g),
x as (select distinct tx, gene_name, chrom, strand, left_pos - 1 as s, right_pos as e from h where feature = 'exon' and tx is not null and left_pos is not null and right_pos is not null)
select tx as transcript_id, gene_name, chrom, strand, count(*) as exon_count, string_agg(cast(s as varchar), ',' order by s, e) as exon_starts,
  string_agg(cast(e as varchar), ',' order by s, e) as exon_ends, any_value(atg) as atg from x left join atg using (tx) group by tx, gene_name, chrom, strand""")
def gene_predictions(spark, d):
    return T.gene_predictions(table(spark, d, "annotations"))


_CHROM = "'c' || cast(contig_id % 7 as varchar)"
_GENOME = f"""chroms as (select {_CHROM} as chrom, string_agg(seq, '' order by contig_id) as seq from contigs where seq is not null group by 1)"""


def joined_chromosomes(spark: SparkSession, d: str) -> DataFrame:
    """Seven chromosomes, each made of a seventh of the contigs."""
    rows = table(spark, d, "contigs").where("seq is not null")
    parts = rows.groupBy(F.concat(F.lit("c"), (F.col("contig_id") % 7).cast("string")).alias("id")).agg(F.array_sort(F.collect_list(F.struct("contig_id", "seq"))).alias("p"))
    return parts.select("id", F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("seq"))


@query(f"""with {_GENOME}, tx as (select *, 'c' || cast(row_number() over (order by contig_id) % 7 as varchar) as chrom from contigs where seq is not null),
e as (select contig_id, chrom, i, (contig_id * 37 + i * 1001) % 9000 as s, (contig_id * 37 + i * 1001) % 9000 + 20 + i * 13 as e, case when contig_id % 2 = 0 then '+' else '-' end as strand
  from tx, (select unnest(range(0, 4)) as i)),
j as (select contig_id, strand, string_agg(substr(c.seq, cast(s + 1 as bigint), cast(e - s as bigint)), '' order by i) as seq from e join chroms c using (chrom) group by contig_id, strand)
select 't' || cast(contig_id as varchar) as id, case when strand = '-' then translate(reverse(seq), 'acgtACGT', 'tgcaTGCA') else seq end as seq from j""")
def spliced_transcripts(spark, d):
    """Four exons per transcript, cut from chromosomes in pieces of 1,000 letters."""
    ranks = O.ranked(table(spark, d, "contigs").where("seq is not null").select("contig_id"), F.col("contig_id"))
    start = lambda i: ((F.col("contig_id") * 37 + i * 1001) % 9000).cast("bigint")
    tx = ranks.select(
        F.concat(F.lit("t"), F.col("contig_id")).alias("transcript_id"),
        F.concat(F.lit("c"), F.col("rank") % 7).alias("chrom"),
        F.when(F.col("contig_id") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.concat_ws(",", *[start(i).cast("string") for i in range(4)]).alias("exon_starts"),
        F.concat_ws(",", *[(start(i) + 20 + i * 13).cast("string") for i in range(4)]).alias("exon_ends"),
    )
    return T.spliced_sequences(tx, joined_chromosomes(spark, d), piece=1000)


_SEVEN = "concat(c, " + ", ".join(f"lead(c, {k}) over w" for k in range(1, 7)) + ")"


@query(f"""with {_GENOME}, p as (
  select chrom, seq, '+' as strand, length(seq) as n from chroms
  union all select chrom, translate(reverse(seq), 'acgtACGT', 'tgcaTGCA'), '-', length(seq) from chroms),
letters as (select chrom, strand, n, unnest(string_split(seq, '')) as c, unnest(range(0, n)) as i from p),
s as (select chrom, strand, n, i, regexp_extract({_SEVEN}, '^(?i:GGA[CT]{{1,3}}T)') as m from letters window w as (partition by chrom, strand order by i))
select chrom, case when strand = '+' then i else n - i - length(m) end as start_pos,
  case when strand = '+' then i + length(m) else n - i end as end_pos, 'tails' as name, cast(0 as bigint) as score, strand from s where m <> ''""")
def find_on_chromosomes(spark, d):
    """Chromosomes searched in overlapping windows."""
    return find_fragments(joined_chromosomes(spark, d), "GGA[CT]{1,3}T", name="tails", window=5000)
