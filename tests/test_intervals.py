import random
import re

import pytest
from pyspark.sql import functions as F

from readloom.functions.columns import ieee_div
from readloom.operators import counts as C
from readloom.operators import intervals as I
from readloom.operators import transcriptome as T
from readloom.operators.demux import BarcodeIndex, _edits, barcode_map, demultiplex, nearest_well
from readloom.operators.search import find_fragments, longest_match
from readloom.operators.variants import aligner_variants, own_haplotypes
from readloom.plans import read_queries

BED = "chrom string, start_pos bigint, end_pos bigint, name string, score bigint, strand string"


def bed(spark, rows):
    return spark.createDataFrame(rows, BED)


def random_bed(rng, n, span=60):
    out = []
    for i in range(n):
        s = rng.randint(0, 300)
        out.append((rng.choice("ab"), s, s + rng.randint(1, span), f"n{i}", rng.randint(1, 9), rng.choice("+-")))
    return out


@pytest.mark.parametrize("size", [8, 64, 1 << 14])
def test_overlaps_equal_nested_loop(spark, size):
    rng = random.Random(size)
    a, b = random_bed(rng, 80), random_bed(rng, 60)
    hit = lambda x, y: x[0] == y[0] and x[5] == y[5] and x[1] < y[2] and y[1] < x[2]
    pairs = I.overlap_pairs(bed(spark, a), bed(spark, b), bin_size=size).select("a_name", "b_name").collect()
    assert sorted(map(tuple, pairs)) == sorted((x[3], y[3]) for x in a for y in b if hit(x, y))
    a += [(c, s, s + 1, n + "p", 1, d) for c, s, _, n, _, d in a[:40]]
    a += a[:5] + [(None, 1, 9, "m1", 1, "+"), ("a", 1, 9, "m2", 1, None), ("a", None, 9, "m3", 1, "+"), ("z", 1, 9, "m4", 1, "+")]
    b += [("a", 100, 250_000, "long", 1, "+"), ("a", 7, 7, "none", 1, "+"), (None, 1, 9, "m5", 1, "+"), ("a", 5, None, "m6", 1, "+")]
    a += [("a", 249_000 + i, 249_000 + i * 300, f"far{i}", 1, "+") for i in range(1, 9)]
    hit = lambda x, y: None not in (*x, *y) and x[0] == y[0] and x[5] == y[5] and x[1] < y[2] and y[1] < x[2] and y[1] < y[2]
    pairs = I.overlap_pairs(bed(spark, a), bed(spark, b), bin_size=size).select("a_name", "b_name").collect()
    assert sorted(map(tuple, pairs)) == sorted((x[3], y[3]) for x in a for y in b if hit(x, y))
    got = I.overlap_any(bed(spark, a), bed(spark, b), bin_size=size).select("name").collect()
    assert sorted(r[0] for r in got) == sorted(x[3] for x in a if any(hit(x, y) for y in b))


def test_gap_cases(spark):
    b = bed(spark, [("chr1", 10, 120, "x", 0, "-")])
    for strand, dist in (("+", 21), ("-", 141), (None, 141)):
        a = bed(spark, [("chr1", 100, 150, "y", 0, strand)])
        assert [tuple(r) for r in I.gap_distances(a, b).collect()] == [("y", "x", dist)]


@pytest.mark.parametrize("low,high", [(-10, 10), (-200, -50), (5, 6)])
def test_gap_equals_nested_loop(spark, low, high):
    rng = random.Random(high)
    a, b = random_bed(rng, 50), random_bed(rng, 50)
    expected = []
    for x in a:
        for y in b:
            if x[0] == y[0]:
                dist = y[2] - x[1] + 1 if x[5] == "+" else x[2] - y[1] + 1
                if low <= dist < high:
                    expected.append((x[3], y[3], dist))
    got = I.gap_distances(bed(spark, a), bed(spark, b), low, high, bin_size=16).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_merge(spark):
    df = bed(spark, [("c", s, e, "g", 0, "+") for s, e in ((1, 5), (5, 7), (9, 12), (10, 11))])
    got = I.merge_intervals(df, ["chrom", "strand"]).orderBy("start_pos").collect()
    assert [(r.start_pos, r.end_pos) for r in got] == [(1, 7), (9, 12)]
    odd = bed(spark, [(None, 1, 5, "g", 0, "+"), (None, 4, 9, "g", 0, "+"), ('"q\\', 4, 9, "g", 0, "+"), ("c", 5, 5, "g", 0, "+"), ("c", None, 5, "g", 0, "+")])
    got = I.merge_intervals(odd, ["chrom", "strand"]).collect()
    assert sorted((r.chrom or "", r.strand, r.start_pos, r.end_pos) for r in got) == [("", "+", 1, 9), ('"q\\', "+", 4, 9)]
    assert I.merge_intervals(odd.limit(0), ["chrom"]).count() == 0 and I.overlap_any(odd, odd.limit(0)).count() == 0
    assert I.overlap_pairs(odd.limit(0), odd).count() == 0


def test_five_prime_points(spark):
    got = C.count_per_base(bed(spark, [("c", 10, 20, "x", 0, "+"), ("c", 10, 20, "x", 0, "-")]), F.lit("s")).orderBy("start_pos").collect()
    assert [(r.start_pos, r.end_pos, r.score) for r in got] == [(10, 11, 1), (19, 20, 1)]


def test_ieee_division(spark):
    df = spark.createDataFrame([(1, 0), (-1, 0), (0, 0), (1, 4), (None, 2)], "n int, d int")
    got = [r[0] for r in df.select(ieee_div(F.col("n"), F.col("d"))).collect()]
    assert got[0] == float("inf") and got[1] == float("-inf") and got[2] != got[2] and got[3] == 0.25 and got[4] is None


def test_find_both_strands(spark):
    df = spark.createDataFrame([("s", "AATAAA"), ("n", None)], "id string, seq string")
    got = lambda p: sorted((r.strand, r.start_pos, r.end_pos) for r in find_fragments(df, p).collect())
    assert got("AA") == [("+", 0, 2), ("+", 3, 5), ("+", 4, 6)]
    assert got("tt") == [("-", 0, 2), ("-", 3, 5), ("-", 4, 6)]
    assert find_fragments(df, "tt", ignore_case=False).count() == 0


@pytest.mark.parametrize("pattern", ["A[CG]{1,3}T", "AA", "C+A", "(?<=G)A", "^AC", "A|AC|ACG"])
def test_find_in_windows_equals_whole(spark, pattern):
    rng = random.Random(len(pattern))
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 1, 5, 30, 31, 200, 777)]
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(seqs)] + [("n", None)], "id string, seq string")
    look = re.compile(f"(?=({pattern}))", re.I)
    turn = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    expected = [(str(i), m.start(), m.end(1), "+") for i, s in enumerate(seqs) for m in look.finditer(s)]
    expected += [(str(i), len(s) - m.end(1), len(s) - m.start(), "-") for i, s in enumerate(seqs) for m in look.finditer(turn(s))]
    for window in (7, 30, 10_000):
        got = [(r.chrom, r.start_pos, r.end_pos, r.strand) for r in find_fragments(df, pattern, window=window).collect()]
        assert sorted(got) == sorted(expected)


def test_longest_match():
    assert longest_match("GA[CT]TC") == 5 and longest_match("A{2,4}|C") == 4
    assert [longest_match(p) for p in ("A+", "(?=A)C", "A$", r"(A|\bC)", "(?:(?<!G)A)")] == [None] * 5


def test_demultiplex(spark, reads_of):
    codes = barcode_map(spark.createDataFrame([(1, "CAAAGT", "A2")], "pos int, bc string, well string"))
    df = reads_of(*[(f"@r {b}", "A", "I") for b in ("CAAAGT", "CAAAGA", "ACAAGT", "GGGGGG")], (None, "A", "I"))
    got = demultiplex(df, codes).orderBy("ordinal").collect()
    assert [r.well for r in got] == ["A2", "A2", "NA", "NA", "NA"]


def test_demultiplex_ties_and_repeats(spark, reads_of):
    rows = [(1, "AAAA", "x"), (2, "AATT", "y"), (3, "AAAA", "z")]
    codes = barcode_map(spark.createDataFrame(rows, "pos int, bc string, well string"))
    assert codes == [(0, "AAAA", "z"), (1, "AATT", "y")]
    got = demultiplex(reads_of(("AAAT", "A", "I"), ("AATT", "A", "I")), codes).orderBy("ordinal").collect()
    assert [r.well for r in got] == ["z", "y"]


def test_nearest_well_equals_comparison_with_all(spark):
    rng = random.Random(12)
    bars = list({"".join(rng.choice("ACG") for _ in range(rng.randint(3, 5))): None for _ in range(25)})
    codes = [(i, b, f"w{i}") for i, b in enumerate(bars)]
    for distance in (0, 1, 2):
        index = BarcodeIndex(codes, distance)
        for _ in range(800):
            o = "".join(rng.choice("ACGN") for _ in range(rng.randint(0, 6)))
            best = min((_edits(o, b), p, w) for p, b, w in codes)
            assert index.well(o) == (best[2] if best[0] <= distance else "NA")
    assert nearest_well(F.lit("A"), []) is not None


def gtf(spark, rows):
    out = []
    for i, (feature, left, right, strand, tx, no) in enumerate(rows):
        attrs = f'gene_id "g"; transcript_id "{tx}"; gene_name "G";' + (f" exon_number {no};" if no else "")
        out.append((i, "chr1", feature, left, right, strand, attrs))
    return spark.createDataFrame(out, "row_id bigint, chrom string, feature string, left_pos bigint, right_pos bigint, strand string, attrs string")


@pytest.mark.parametrize("strand,utr", [("+", (100, 150)), ("-", (151, 200))])
def test_utr(spark, strand, utr):
    codon = (151, 153) if strand == "+" else (149, 151)
    sets = T.region_sets(gtf(spark, [("exon", 101, 200, strand, "t", 2), ("start_codon", *codon, strand, "t", 0)]))
    got = sets.where("region_set = 'coding_5utr'").collect()
    assert [(r.start_pos, r.end_pos) for r in got] == [utr]


def test_promoters(spark):
    sets = T.region_sets(gtf(spark, [("exon", 1001, 1100, "+", "t", 1), ("exon", 1900, 2000, "-", "u", 1), ("exon", 20, 30, "+", "v", 1)]))
    got = sorted((r.start_pos, r.end_pos) for r in sets.where("region_set = 'other_promoter'").collect())
    assert got == [(0, 19), (501, 1000), (2000, 2499)]


def test_spliced(spark):
    pred = T.gene_predictions(gtf(spark, [("exon", 1, 3, "-", "t", 1), ("exon", 6, 7, "-", "t", 2)]))
    genome = spark.createDataFrame([("chr1", "ACGTTGAC")], "id string, seq string")
    for piece in (1, 2, 3, 100):
        assert T.spliced_sequences(pred, genome, piece).first().seq == "TCCGT"
    beyond = T.gene_predictions(gtf(spark, [("exon", 7, 99, "+", "t", 1), ("exon", 200, 210, "+", "t", 2)]))
    assert T.spliced_sequences(beyond, genome, 3).first().seq == "AC"
    assert T.spliced_sequences(beyond, genome.withColumn("id", F.lit("other"))).count() == 0


def test_reference_sequences(spark):
    df = spark.createDataFrame([("ERCC-00130", "AC"), ("ERCC-00001", "GT")], "id string, seq string")
    got = {r.id: r.seq for r in T.spike_sequences(df).collect()}
    assert got == {"RNA_SPIKE_ERCC-00130": "AATTCGAGCTCAC", "RNA_SPIKE_ERCC-00001": "AATTCGT"}
    assert T.ribosome_sequences(df, "mm10").count() == 0 and T.ribosome_sequences(df).first().id == "RIBO_U13369.1"


def test_count_tables(spark):
    regions = bed(spark, [("c", 0, 10, "RNA_SPIKE_1", 0, "+"), ("c", 20, 30, "g", 0, "+"), ("c", 22, 25, "g", 0, "+")])
    counts = bed(spark, [("c", 5, 6, "x", 4, "+"), ("c", 23, 24, "x", 2, "+"), ("c", 23, 24, "x", 9, "-")]).withColumn("base", F.lit("b"))
    got = {r.ID: (r.R, r.N, r.note) for r in C.quantify(counts, regions, spark.createDataFrame([("g", "n")], "ID string, note string")).collect()}
    assert got == {"RNA_SPIKE_1": (4, 1000.0, "NA"), "g": (4, 1000.0, "n")}


def test_gap_has_the_whole_default_window(spark, tmp_path):
    parts = spark.createDataFrame([(5000, 1, "x"), (5001, 1, "y")], "p_partkey int, p_size int, p_brand string")  # chr1 +, chr2 -
    rows = [(k, n, s) for k in (3000, 4900, 5000, 5100, 5300, 6100) for n in (1, 2) for s in (0, 1)]
    items = spark.createDataFrame(rows, "l_partkey int, l_linenumber int, l_suppkey int")
    items.selectExpr("*", "1L as l_orderkey", "5.0 as l_quantity", "'O' as l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    expected = {}
    for k, n, s in rows:
        name, dist = ("x", k * 10 + n + 5 - 50_000 + 1) if s == 0 else ("y", 50_010 + 20 - (k * 10 + n) + 1)
        if -10_000 <= dist < 2_500:
            expected[name, dist] = expected.get((name, dist), 0) + 1
    assert min(expected)[1] < -20 and max(expected)[1] >= 20
    got = {(r.name1, r.dist): r.pairs for r in read_queries.gap(spark, str(tmp_path)).collect()}
    assert got == expected


def test_matrix_has_every_library_of_the_design(spark, tmp_path):
    rows = [(i, base, "g", "c", 5, 6, score, "+") for i, (base, score) in enumerate([("own-1", 3), ("own-2", 4), ("own-2", 5), ("other", 7)])]
    hits = spark.createDataFrame(rows, "hit_id bigint, base string, id string, chrom string, start_pos bigint, end_pos bigint, score bigint, strand string")
    hits.write.parquet(f"{tmp_path}/region_hits.parquet")
    design = spark.createDataFrame([("own-2",), ("own-1",), ("own-1",), ("empty",), (None,)], "base string")
    design.write.parquet(f"{tmp_path}/samples.parquet")
    got = read_queries.read_matrix(spark, str(tmp_path))
    assert got.columns == ["ID", "R|empty", "R|own-1", "R|own-2"]
    assert [tuple(r) for r in got.collect()] == [("g", 0, 3, 9)]
    got = read_queries.count_matrix(spark, str(tmp_path))
    assert got.columns == ["ID", "R|empty", "R|own-1", "R|own-2"]
    assert [tuple(r) for r in got.collect()] == [("g", 0, 1, 2)]


def test_variants(spark):
    rows = [
        ("c", 5, 6, "r1", "+", "A", "A/G", "single"), ("c", 5, 6, "r2", "-", "A", "T/C/G/C", "single"), ("c", 5, 7, "r3", "+", "AC", "A/G", "single"),
        ("c", 8, 11, "r4", "+", "ACG", "-/ACG", "deletion"), ("c", 8, 8, "r5", "-", "-", "-/AC", "insertion"), ("c", 8, 9, "r6", "+", "A", "(LARGE)", "named"),
        ("c", 1, 2, "r7", "+", None, "a/n", "single"), ("c", 1, 2, "r8", "+", "A", None, "single"),
    ]
    df = spark.createDataFrame(rows, "chrom string, start_pos bigint, end_pos bigint, name string, strand string, reference string, observed string, class string")
    got = aligner_variants(df).orderBy("id").collect()
    assert [tuple(r) for r in got] == [
        ("r1", "single", "c", 5, "G"), ("r2.1", "single", "c", 5, "G"), ("r2.2", "single", "c", 5, "C"), ("r4", "deletion", "c", 8, "3"),
        ("r5", "insertion", "c", 8, "GT"), ("r7", "single", "c", 1, "A"),
    ]
    ends = {r.variants: (r.left_pos, r.right_pos) for r in own_haplotypes(aligner_variants(df)).collect()}
    assert ends["r4"] == (8, 10) and ends["r1"] == (5, 5)


def most_rows(df):
    """Rows that the operator with most of them puts out, of a plan that ran."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        rows = node.metrics().get("numOutputRows")
        inner = node.children()
        return max([rows.get().value() if rows.isDefined() else 0, *(walk(inner.apply(i)) for i in range(inner.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_distinct_ends_of_many_samples_are_not_joined_one_by_one(spark):
    regions = bed(spark, [("c", 0, 5000, "g", 0, "+")])
    at = F.col("id")
    ends = spark.range(3000).select(
        F.lit("b").alias("base"), F.lit("c").alias("chrom"), at.alias("start_pos"), (at + 1).alias("end_pos"), at.cast("string").alias("name"), F.lit(0).alias("score"), F.lit("+").alias("strand")
    )
    samples = spark.range(2000).select(F.concat(F.lit("s"), "id").alias("sample"), F.lit("b").alias("base"))
    out = C.count_distinct_per_region(regions, ends, samples)
    rows = out.collect()
    assert len(rows) == 2000 and {(r.ID, r.n) for r in rows} == {("g", 3000)}
    assert most_rows(out) < 200_000  # a row per end and sample would be 6,000,000


def test_distinct_ends_equal_nested_loop(spark):
    rng = random.Random(11)
    regions = [("c", s, s + rng.randint(1, 300), f"g{i % 9}", 0, "+") for i, s in enumerate(rng.randint(0, 900) for _ in range(14))]
    ends = [(rng.choice(["a", "b", "c", "d", None]), "c", s, s + 1, rng.choice([None, *map(str, range(40))]), 0, "+") for s in (rng.randint(0, 1200) for _ in range(300))]
    samples = [("s0", "a"), ("s1", "a"), ("s2", "b"), ("s2", "a"), ("s3", "a"), ("s3", "b"), ("s3", "d"), ("s4", "none"), (None, "c"), ("s5", None), *((f"t{i}", "d") for i in range(20))]
    design = spark.createDataFrame(samples + samples[:3], "sample string, base string")
    out = C.count_distinct_per_region(bed(spark, regions), spark.createDataFrame(ends, f"base string, {BED}"), design)
    found = {}
    for _, s, e, region, _, _ in regions:
        for base, _, at, _, name, _, _ in ends:
            for sample, b in samples:
                if s <= at < e and base is not None and b == base:
                    found.setdefault((region, sample), set()).update([] if name is None else [name])
    assert out.columns == ["ID", "sample", "n"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((*k, len(v))) for k, v in found.items())
