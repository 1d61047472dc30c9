"""The general data problems: every defined result, and brute force on small random tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from readloom.operators.packed import split_packed
from readloom.operators.parsing import BadRecord, failed_records, parse_record, valid_records
from readloom.operators.periods import IntervalMap, merge_periods
from readloom.operators.skew import Agg, heavy_keys, share_threshold, tree_aggregate, tree_levels

# Problem 2


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k string, v bigint, leaf int, a0n string")


@pytest.mark.parametrize("levels,fan_in,chunk", [(1, 2, 1), (3, 2, 7), (2, 8, 65536)])
def test_tree_equals_plain_grouping(spark, levels, fan_in, chunk):
    rng = random.Random(levels)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, 1, 2, 30]), 1, "x") for _ in range(3000)]
    df = keyed(spark, rows).repartition(5)
    aggs = [Agg("n", "count"), Agg("vs", "count", "v"), Agg("s", "sum", "v"), Agg("lo", "min", "v"), Agg("hi", "max", "v"), Agg("m", "mean", "v"), Agg("d", "approx_distinct", "v")]
    got = {r.k: tuple(r)[1:] for r in tree_aggregate(df, ["k"], aggs, levels=levels, fan_in=fan_in, chunk_rows=chunk).collect()}
    for key in {r[0] for r in rows}:
        all_v = [r[1] for r in rows if r[0] == key]
        v = [x for x in all_v if x is not None]
        assert got[key][:5] == (len(all_v), len(v), sum(v), min(v), max(v))
        assert got[key][5] == pytest.approx(sum(v) / len(v)) and got[key][6] == len(set(v))


def test_tree_edges(spark):
    df = keyed(spark, [("a", None, 1, "x"), (None, 2, 1, "x")])
    aggs = [Agg("s", "sum", "v"), Agg("m", "mean", "v"), Agg("d", "approx_distinct", "v"), Agg("n", "count")]
    got = {r.k: tuple(r)[1:] for r in tree_aggregate(df, ["k"], aggs).collect()}
    assert got == {"a": (None, None, 0, 1), None: (2, 2.0, 1, 1)}
    assert tree_aggregate(df.limit(0), ["k"], aggs).count() == 0
    assert [r.leaf for r in tree_aggregate(df, ["leaf"], [Agg("a0n", "count")]).collect()] == [1]
    with pytest.raises(ValueError):
        tree_aggregate(df, ["k"], aggs, fan_in=1)
    assert tree_levels(1) == 1 and tree_levels(64) == 2 and tree_levels(65) == 3


def test_heavy_keys(spark):
    df = keyed(spark, [("a", 1, 1, "x")] * 5 + [("b", 1, 1, "x")] * 4 + [(None, 1, 1, "x")] * 91)
    assert [tuple(r) for r in heavy_keys(df, "k", 0.05).collect()] == [("a", 5)]
    assert heavy_keys(df.limit(0), "k").count() == 0
    assert share_threshold(0.002, 1000) == 2 and share_threshold(0.002, 1001) == 3 and share_threshold(0.05, 0) == 1


# Problem 3


def packed(spark, *cells):
    df = spark.createDataFrame([(i, c, "x") for i, c in enumerate(cells)], "i int, cell string, p string")
    out = [[] for _ in cells]
    for r in split_packed(df, "cell", ["i"]).orderBy("i", "item_pos").collect():
        out[r.i].append(r.item)
        assert r.item_pos == len(out[r.i])
    return out


def by_hand(cell):
    out, i = [], 0
    while i < len(cell):
        if cell[i] in "\"'":
            q, j, value = cell[i], i + 1, ""
            while j < len(cell):
                if cell[j] == q and cell[j + 1 : j + 2] == q:
                    value += q
                    j += 2
                elif cell[j] == q:
                    break
                else:
                    value += cell[j]
                    j += 1
            if j < len(cell):
                out += [value] if value else []
                i = j + 1
                continue
            i += 1
        elif m := re.match(r"[A-Za-z0-9_.\-]+", cell[i:]):
            out.append(m.group())
            i += m.end()
        else:
            i += 1
    return out


def test_split_cases(spark):
    cells = ["a;b", '"a;b", c', "'it''s' \"say \"\"hi\"\"\"", "", None, " ; ,", '"" a', "x\"y z\"w", "a\"b", "0  a 'q'", "é ü", "a\nb\tc"]
    assert packed(spark, *cells) == [
        ["a", "b"], ["a;b", "c"], ["it's", 'say "hi"'], [], [], [], ["a"], ["x", "y z", "w"], ["a", "b"], ["0", "a", "q"], [], ["a", "b", "c"],
    ]


def test_split_random(spark):
    rng = random.Random(4)
    cells = ["".join(rng.choice("ab'\"\"; .,") for _ in range(rng.randint(0, 14))) for _ in range(800)]
    assert packed(spark, *cells) == [by_hand(c) for c in cells]


def test_split_long_and_clashing(spark):
    long = '"' + '""' * 60_000 + '"' + ";" + "a," * 60_000
    got = packed(spark, long)[0]
    assert len(got) == 60_001 and got[0] == '"' * 60_000
    df = spark.createDataFrame([(1, "a b", "keep")], "item int, cell string, spans string")
    row = split_packed(df, "cell", ["spans"], position="at", item="value").first()
    assert tuple(row) == ("keep", 1, "a")
    assert split_packed(df.limit(0), "cell", ["item"], item="v").count() == 0


# Problem 4


def periods(spark, rows, **kw):
    df = spark.createDataFrame(rows, "acc string, left_pos bigint, right_pos bigint, e string, l string")
    return sorted(tuple(r) for r in merge_periods(df, "acc", "left_pos", "right_pos", **kw).collect())


def expected_periods(rows):
    out, by = [], {}
    for acc, l, r, *_ in rows:
        if acc is not None and l is not None and r is not None and l <= r:
            by.setdefault(acc, set()).update(range(l, r + 1))
    for acc, points in by.items():
        last = None
        for p in sorted(points):
            if last is None or p > last + 1:
                if last is not None:
                    out += [(acc, "merged", start, last), (acc, "gap", last + 1, p - 1)]
                start = p
            last = p
        out.append((acc, "merged", start, last))
    return sorted(out)


@pytest.mark.parametrize("seed,partitions,state", [(1, 1, 4), (2, 4, 1000), (3, 13, 3), (4, 7, 50)])
def test_periods_equal_points(spark, seed, partitions, state):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        acc = rng.choice(["hot"] * 6 + ["b", "c", None])
        left = rng.choice([None, rng.randint(1, 900)])
        length = rng.choice([0, 1, 3, 300 if rng.random() < 0.05 else 2, -2])
        rows.append((acc, left, None if left is None else left + length, "x", "y"))
    assert periods(spark, rows, partitions=partitions, state_rows=state) == expected_periods(rows)


def test_periods_edges(spark):
    assert periods(spark, [("a", 1, 5, "", ""), ("a", 6, 9, "", ""), ("a", 1, 5, "", ""), ("a", 11, 11, "", "")]) == [
        ("a", "gap", 10, 10), ("a", "merged", 1, 9), ("a", "merged", 11, 11),
    ]
    assert periods(spark, [("a", 5, 4, "", ""), (None, 1, 2, "", "")]) == []
    one_long = [("a", 1, 1000, "", "")] + [("a", i, i, "", "") for i in range(1, 1000, 2)] + [("a", 2000, 2001, "", "")]
    assert periods(spark, one_long, partitions=9, state_rows=2) == [("a", "gap", 1001, 1999), ("a", "merged", 1, 1000), ("a", "merged", 2000, 2001)]


def test_interval_map():
    m = IntervalMap()
    for iv in ((10, 12), (1, 2), (5, 6), (3, 4), (20, 30), (11, 22)):
        m.add(*iv)
    assert list(m.stretches()) == [(1, 6), (10, 30)] and list(m.gaps()) == [(7, 9)]
    rng = random.Random(4)
    for _ in range(200):
        m, covered = IntervalMap(), set()
        for _ in range(rng.randint(1, 25)):
            left = rng.randint(0, 60)
            right = left + rng.randint(0, 6)
            m.add(left, right)
            covered |= set(range(left, right + 1))
        inside = {x for a, b in m.stretches() for x in range(a, b + 1)}
        between = {x for a, b in m.gaps() for x in range(a, b + 1)}
        assert inside == covered and between == set(range(min(covered), max(covered) + 1)) - covered
        assert len(list(m.gaps())) == len(m) - 1
        again = IntervalMap(m.lefts, m.rights)
        assert list(again.gaps()) == list(m.gaps())


# Problem 7


def reason(line, dialect="plain"):
    try:
        return parse_record(line, dialect)
    except BadRecord as bad:
        return str(bad)


def test_line_ends_in_records_that_hold_the_usual_stand_ins():
    odd = "@r\ue000\n\ue001\r\ue002"
    assert reason(f'"{odd}"\tACGT\t+\tIIII', "quoted") == [odd, "ACGT", "+", "IIII"]
    assert reason(f"{odd}\tACGT\t+\tIIII") == [odd, "ACGT", "+", "IIII"]
    assert reason(f'"{odd}\tACGT\t+\tIIII', "quoted") == "quoting"


def test_record_reasons():
    good = ["@r", "ACGT", "+", "IIII"]
    assert reason("@r\tACGT\t+\tIIII") == good
    assert reason('"@r"\tACGT\t"+"\t"I""II"', "quoted") == ["@r", "ACGT", "+", 'I"II']
    assert reason('"@r\tx"\tacgtn\t+\tIIIII', "quoted")[0] == "@r\tx"
    for line in ('"@r\tACGT\t+\tIIII', '"@r"x\tACGT\t+\tIIII', '@"r\tACGT\t+\tIIII', '@r\tACGT\t+\t"', '"@r" \tA'):
        assert reason(line, "quoted") == "quoting", line
    for line in ("", None, "@r", "@r\tACGT\t+\tIIII\t", "a\tb\tc"):
        assert reason(line) == "columns" and reason(line, "quoted") == "columns"
    assert reason("@r\t\t+\t") == "seq" and reason("@r\tACGU\t+\tIIII") == "seq" and reason("@r\tA\nC\t+\tIII") == "seq"
    assert reason("@r\tACGT\t+\tIII") == "qual" and reason("@r\tACGT\t+\tII I") == "qual" and reason("@r\tACGT\t+\tIIII\r") == "qual"
    assert reason('@r\tACGT\t+\tI"II') == ["@r", "ACGT", "+", 'I"II'] and reason('@r\tA\t+\t"', None)[3] == '"'
    assert reason("@r\nx\tACGT\t+\tIIII")[0] == "@r\nx" and reason("\n\tA\t+\tI")[0] == "\n"
    assert reason('"\n""\t"\tA\t+\tI', "quoted")[0] == '\n"\t'


def test_records_in_spark(spark):
    rows = [(1, "plain", "@r\tAC\t+\tII", "x"), (1, "plain", "@r\tAC\t+\tII", "x"), (2, "plain", None, "x"), (3, "quoted", '"@', "x"), (4, None, "@r\t" + "A" * 300_000 + "\t+\t" + "I" * 300_000, "x")]
    df = spark.createDataFrame(rows, "line_id bigint, dialect string, line string, reason string")
    assert sorted(map(tuple, failed_records(df).collect())) == [(2, "columns"), (3, "quoting")]
    assert sorted(len(r.seq) for r in valid_records(df).collect()) == [2, 2, 300_000]
    assert failed_records(df.limit(0)).count() == 0
    renamed = df.withColumnRenamed("line_id", "n").withColumn("seq", F.lit(1))
    assert failed_records(renamed, line_id="n").count() == 2
