import random
import re

import duckdb
import pytest

from readloom.operators import ordered as O
from readloom.operators import reads as R
from readloom.plans import read_queries


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("ordinal").collect()]


def seqs(df):
    return [r.seq for r in df.orderBy("ordinal").collect()]


def test_trim_5end(reads_of):
    df = reads_of("ACGTGGGTTT", "ACGTGGGTT", "ACGTACGT", None)
    assert seqs(R.trim_5end("....GG+", 3)(df)) == ["TTT", "ACGTACGT"]


def test_trim_5end_empty_match_is_checked(reads_of):
    assert seqs(R.trim_5end("G*", 5)(reads_of("ACGT", "GACGTA"))) == ["ACGTA"]


def test_trim_3end_quality(reads_of):
    df = reads_of(*[("@", "ACGT", q) for q in ("II#I", "I#II", "IIII", "#III", None)])
    assert seqs(R.trim_3end_quality(minimum=2)(df)) == ["AC", "ACGT"]


def test_low_quality_characters_are_literal(reads_of):
    df = reads_of(("@", "ACGT", "I^]I"), ("@", "ACGT", "II-I"), ("@", "ACGT", r"III\ "[:4]))
    assert seqs(R.trim_3end_quality("^-]\\", 1)(df)) == ["A", "AC", "ACG"]


def test_trim_3end_primer(reads_of):
    df = reads_of("TTTAGC", "TTTAG", "TTTA", "TTT", "AG")
    assert seqs(R.trim_3end_primer(["AGC"], 1)(df)) == ["TTT"] * 4


def chained(seq, primers, minimum):
    fragments, always = R.primer_fragments(primers)
    for f in fragments:
        if seq.endswith(f):
            seq = seq[: len(seq) - len(f)]
            return seq if len(seq) >= max(1, minimum) else None
    if always:
        seq = seq[: len(seq) - always]
        return seq if len(seq) >= max(1, minimum) else None
    return seq


@pytest.mark.parametrize("primers", [["ACG", "CT"], ["AC", "C", "G", "T"], ["AACC"], ["A", "C", "G", "T"]])
def test_trim_primer_equals_chain(reads_of, primers):
    rng = random.Random(5)
    data = ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    df = R.trim_3end_primer(primers, 2)(reads_of(*data))
    assert seqs(df) == [t for s in data if (t := chained(s, primers, 2)) is not None]


def test_trim_3end_and_length(reads_of):
    df = R.trim_3end("AG", 3)(reads_of("TTTAG", "TTAG", "TT"))
    assert rows(df, "seq", "is_trimmed") == [("TTT", True), ("TT", False)]
    assert seqs(R.trim_3end_length(2, 1)(reads_of("ACGT", "AC", "A"))) == ["AC"]


def test_annotations(reads_of):
    df = reads_of(("@r x y", "ACGT", "IIII"), ("@r", "ACGT", "IIII"), ("@r  x", None, None))
    assert [r[0] for r in rows(R.annotate_umi(1, 2)(df), "acc")] == ["@r:AC x", "@r:AC", "@r  x"]
    assert [r[0] for r in rows(R.annotate_index(3, 4)(df), "acc")] == ["@r x yGT", "@rGT", "@r  x"]


def test_sampling(reads_of):
    df = reads_of(*"ACGTACG")
    assert [r[0] for r in rows(R.slice_reads(2, 3)(df), "ordinal")] == [1, 4]
    assert [r[0] for r in rows(R.thin_out(1, 2)(df), "ordinal")] == [0, 3, 6]
    assert [r[0] for r in rows(R.head_reads(2)(df), "ordinal")] == [0, 1]


def test_match(reads_of):
    df = reads_of("ACGT", "CGTA", "ACGT\n", None)
    assert seqs(R.match_3end("GT")(df)) == ["ACGT"]
    assert seqs(R.match_5end("A|G")(df)) == ["ACGT", "ACGT\n"]
    assert seqs(R.match_5end("A|G", invert=True)(df)) == ["CGTA"]
    short = reads_of(("@", "AC", "II"), ("@", "AG", "II"))
    assert seqs(R.match_5end("AC.[+]", whole_line=True)(short)) == ["AC"]


def nr_std(data):
    out, last = [], None
    for s in data:
        if s != last:
            out.append(s)
            last = s
    return out


def nr_deg(data):
    out, last = [], None
    for s in data:
        if last is None or len(s) >= len(last) or not last.startswith(s):
            out.append(s)
            last = s
    return out


def test_duplicates_in_order(reads_of):
    rng = random.Random(2)
    data = [rng.choice(["A", "C", "CG"]) for _ in range(200)]
    assert seqs(O.exclude_duplicate_in_order(reads_of(*data), block=7)) == nr_std(data)
    assert seqs(O.exclude_duplicate_in_order(reads_of("A", "A", "C", "A"))) == ["A", "C", "A"]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_degenerate_equals_walk_over_sorted(spark, reads_of, partitions, monkeypatch):
    monkeypatch.setattr(O, "shuffle_partitions", lambda spark: partitions)
    rng = random.Random(partitions)
    data = ["".join(rng.choice("AC") for _ in range(rng.randint(1, 8))) for _ in range(250)]
    expected = nr_deg(sorted(data, reverse=True))
    got = seqs(O.exclude_degenerate(reads_of(*data)))
    assert sorted(got) == sorted(expected)
    assert seqs(O.exclude_degenerate(reads_of("ACG", "ACG"))) == ["ACG", "ACG"]
    chain = ["A" * i for i in range(1, 60)]  # every sequence extends the one before, over all tasks
    assert seqs(O.exclude_degenerate(reads_of(*chain, "A" * 59, "C", ""))) == ["A" * 59, "A" * 59, "C"]


def test_degenerate_over_small_batches(spark, reads_of, monkeypatch):
    monkeypatch.setattr(O, "shuffle_partitions", lambda spark: 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(3)
        rows = [(i, "@", "".join(rng.choice("AC") for _ in range(rng.randint(1, 6))), "+", "I", rng.choice([None, "x", "y"])) for i in range(120)]
        df = spark.createDataFrame(rows, "ordinal bigint, acc string, seq string, sep string, qual string, well string")
        got = {r.ordinal for r in O.exclude_degenerate(df, ["well"]).collect()}
        assert got == {r[0] for r in rows if not any(o[5] == r[5] and o[2] != r[2] and o[2].startswith(r[2]) for o in rows)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_degenerate_within_null_group(spark):
    df = spark.createDataFrame(
        [(0, "@", "ACGT", "+", "I", None), (1, "@", "AC", "+", "I", None), (2, "@", "AC", "+", "I", "A1")],
        "ordinal bigint, acc string, seq string, sep string, qual string, well string",
    )
    assert [r.ordinal for r in O.exclude_degenerate(df, ["well"]).orderBy("ordinal").collect()] == [0, 2]
    assert [r.ordinal for r in O.exclude_degenerate_in_order(df, ["well"]).orderBy("ordinal").collect()] == [0, 2]
    with pytest.raises(ValueError):
        O.exclude_degenerate_in_order(df, [])


def test_duplicate_keeps_first_of_sorted(reads_of):
    df = reads_of(("@a", "AC", "!!"), ("@b", "AC", "II"), ("@c", "AC", "II"))
    assert rows(O.exclude_duplicate(df), "acc") == [("@c",)]


def test_ranks(reads_of):
    df = reads_of(("@a x", "AC", "II"), ("@b", "CA", "II"), ("@c w", "AC", "JJ"))
    assert [(r.acc, r["rank"]) for r in O.sorted_reads(df).orderBy("rank").collect()] == [("@b", 1), ("@c w", 2), ("@a x", 3)]
    line = lambda a, s, q: re.sub(r"^\S*", "", f"{a}\t{s}\t+\t{q}")
    order = sorted([("@a x", "AC", "II"), ("@b", "CA", "II"), ("@c w", "AC", "JJ")], key=lambda r: line(*r))
    assert [r.acc for r in O.index_sorted_reads(df).orderBy("rank").collect()] == [r[0] for r in order]


def test_index_order_compares_columns(reads_of, monkeypatch):
    plans, cut = [], O.checkpointed
    monkeypatch.setattr(O, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    out = O.index_sorted_reads(reads_of(("@a x", "AC", "II"), ("@b", "CA", "II")))
    assert out.columns == ["ordinal", "acc", "seq", "sep", "qual", "rank"] and out.count() == 2
    sort = next(line for line in plans[0].split("\n") if "Sort [" in line)
    assert "regexp" not in sort and "concat" not in sort  # these would run at every comparison


def test_index_order_of_odd_lines_equals_sql(spark, tmp_path):
    rng = random.Random(5)
    accs = ["@a", "@a x", "@a\x01 x", "@a\x01", "@a\x1f x", "@a\tx", "@a\x0bx", "@a\x0bx y", "@ab x", "@b x", "", " x", "@\u00e9 x", "@\U0001f9ec x", "@a\nx", "@a\u00a0x", None]
    data = [(rng.choice(accs), rng.choice(["AC", "AG", "", "A C"]), rng.choice(["+", None]), rng.choice(["II", None])) for _ in range(600)]
    ordinals = [*range(599), None]
    rng.shuffle(ordinals)
    reads = spark.createDataFrame([(o, *r) for o, r in zip(ordinals, data)], "ordinal bigint, acc string, seq string, sep string, qual string")
    reads.write.parquet(f"{tmp_path}/reads.parquet")
    c = duckdb.connect()
    c.execute(f"create view reads as select * from '{tmp_path}/reads.parquet/*.parquet'")
    got = read_queries.sort_index(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, c.execute(read_queries.SQL["sort_index"]).fetchall()))


def test_empty(reads_of):
    df = reads_of("A").limit(0)
    assert O.sorted_reads(df).count() == 0
    assert O.exclude_degenerate(df).count() == 0
    assert O.exclude_duplicate_in_order(df).count() == 0
