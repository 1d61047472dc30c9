import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import canonical as K
from readloom.llm import heavy as H

# Problem 5


def test_code_is_linear_with_distance_four():
    words = H.encode(np.arange(1 << 12))
    weight = (words[1:] != 0).sum(axis=1)
    assert weight.min() == H.CHECKS + 1
    assert (H.encode(np.array([5 ^ 9 << 8])) == (H.encode(np.array([5])) ^ H.encode(np.array([9 << 8])))).all()


def test_decoding_lists():
    message = np.array([0x123456, 0xABCDEF, 0x000001])
    heavy = [np.unique(H.encode(message)[:, p]) for p in range(H.LENGTH)]
    got = H.decode(heavy)
    assert set(message) <= set(got) and len(got) < 50
    assert len(H.decode([np.arange(16)] * (H.LENGTH - 1) + [np.zeros(0, int)])) == 0


@pytest.mark.parametrize("share", [0.002, 0.01, 0.1, 0.5])
def test_frequent_values_are_complete(spark, share):
    rng = random.Random(int(share * 1000))
    data = [f"rare{i}" for i in range(4000)]
    for i, n in enumerate((2, 8, 9, 10, 40, 41, 400, 3000)):
        data += [f"hot{i}"] * n
    data += [None] * 50 + [""] * 30
    rng.shuffle(data)
    df = spark.createDataFrame([(v, 1, 2) for v in data], "seq string, g int, v int").repartition(5)
    count = Counter(v for v in data if v is not None)
    expected = {(v, n) for v, n in count.items() if n >= share * len(data)}
    rows = H.frequent_values(df, "seq", share).collect()
    assert {(r.seq, r.exact_rows) for r in rows} == expected
    assert all(r.approx_rows >= r.exact_rows for r in rows)


def test_frequent_values_with_more_counters_than_a_task_keeps(spark, monkeypatch):
    monkeypatch.setattr(H, "DENSE", 100)
    df = spark.createDataFrame([(str(i % 7 if i % 2 else i),) for i in range(3000)], "seq string").repartition(3)
    count = Counter(r.seq for r in df.collect())
    assert {(r.seq, r.exact_rows) for r in H.frequent_values(df, "seq", 0.01).collect()} == {(v, n) for v, n in count.items() if n >= 30}


def test_frequent_edges(spark):
    df = spark.createDataFrame([("a" * 300_000,)] * 3 + [(None,)] * 2, "seq string")
    assert [(len(r.seq), r.exact_rows) for r in H.frequent_values(df, "seq", 0.5).collect()] == [(300_000, 3)]
    assert H.frequent_values(df.limit(0), "seq").count() == 0
    assert H.frequent_values(df.where("seq is null"), "seq").count() == 0
    numbers = spark.range(10).select((F.col("id") % 2).alias("n"))
    assert sorted(r.n for r in H.frequent_values(numbers, "n", 0.3).collect()) == [0, 1]


# Problem 6


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2])
def test_nearest_name_equals_brute_force(most):
    rng = random.Random(most)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    names = list(dict.fromkeys(names))
    table = K.NameList(names, most)
    for _ in range(1500):
        v = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 8)))
        best = min((distance(v, n), i) for i, n in enumerate(names))
        assert table.best(v) == (best if best[0] <= most else None), v


def test_token_sets_rank_the_candidates(monkeypatch):
    checked, exact = [], K.edits
    monkeypatch.setattr(K, "edits", lambda a, b, most: checked.append(b) or exact(a, b, most))
    table = K.NameList(["abcdpqrs", "abcdtuvw", "abcdefgh"], 1)
    assert table.best("abcdefgx") == (1, 2) and checked == ["abcdefgh"]


def test_longest_mentions():
    many = [(i, i + 2, "x") for i in range(0, 200_000)]
    assert len(K.longest_mentions(many)) == 100_000
    assert K.longest_mentions([(0, 2, "a"), (1, 5, "b"), (4, 6, "c"), (6, 8, "d")]) == [(1, 5, "b"), (6, 8, "d")]


@pytest.mark.parametrize(
    "value,well",
    [
        ("b5", "B5"), ("5B", "B5"), (" b05 ", "B5"), ("B-005.", "B5"), ("row B, column 5", "B5"), ("col 5 / row b", "B5"), ("Ｂ５", "B5"),
        ("well-B05", "B5"), ("pos. B5,", "B5"), ("B", None), ("5", None), ("B5/B6", None), ("B55", None), ("AB5", None), ("I5", None), ("", None),
    ],
)
def test_plate_layouts(value, well):
    names = [f"{r}{c}" for c in range(1, 7) for r in "ABCDEFGH"]
    hit = K.PlateList(names).best(value)
    assert (names[hit[1]] if hit else None) == well


def test_each_way_decides(monkeypatch):
    ways = []
    real = K.NameList.similar
    monkeypatch.setattr(K.NameList, "similar", lambda self, v: ways.append(v) or real(self, v))
    table = K.NameList(["CAAAGT", "GATTACA"], 1)
    assert table.best("caa-agt") == (0, 0) and ways == []  # a mention that covers the value
    assert table.best("caaaggt") == (1, 0) and ways == ["caaaggt"]  # token sets and edits
    assert table.best("well CAAAGT sample") is None
    inside = K.NameList(["CAAAGT", "GATTACA", "AGT", "CAAAGT 2"], 1, embedded=True)
    ways.clear()
    assert inside.best("barcode: CAAAGT") == (7, 0) and inside.best("agt / gattaca") == (3, 1) and ways == []
    assert inside.best("well caaagt-2!") == (4, 3)  # the longest mention wins
    assert inside.best("xcaaagty") is None and ways == ["xcaaagty"]  # not between word borders
    plate = K.PlateList(["A1", "B1"], embedded=True)
    assert plate.best("plate 3 well A01") == (6, 0) and plate.best("row b, col. 1 (again)") == (5, 1) and plate.best("xa1y") is None


def test_embedded_entries(spark):
    df = entries(spark, ("bc", "well CATCCG sample"), ("bc", "catcg"), ("well", "plate 7, B01"), ("bc", "ggttaa catccg ggttaa"), ("bc", None))
    assert mapped(spark, df) == {0: "NA", 1: "CATCCG", 2: "NA", 3: "NA", 4: "NA"}
    for block in (1, 100):
        assert mapped(spark, df, embedded=True, block_entries=block) == {0: "CATCCG", 1: "CATCCG", 2: "B1", 3: "CATCCG", 4: "NA"}


def test_blocks_change_nothing_with_repeated_ids(spark):
    rng = random.Random(9)
    names = sorted({"".join(rng.choice("ACG") for _ in range(5)) for _ in range(30)})
    typed = ["".join(rng.choice("ACG") for _ in range(rng.randint(4, 6))) for _ in range(60)]
    df = spark.createDataFrame([(i // 3, "bc", t) for i, t in enumerate(typed)], "entry_id bigint, field string, typed string")
    table = spark.createDataFrame([(n,) for n in names], "bc string").orderBy("bc")
    one, many = (
        sorted((r.entry_id, r.canonical, r.edits if r.edits is not None else -1) for r in K.map_to_canonical(df, {"bc": (table, "bc", 1)}, block_entries=size).collect())
        for size in (1000, 7)
    )
    assert one == many and len(one) == 60


def entries(spark, *rows):
    return spark.createDataFrame([(i, f, t, "x") for i, (f, t) in enumerate(rows)], "entry_id bigint, field string, typed string, canonical string")


def mapped(spark, df, **kw):
    bars = spark.createDataFrame([(1, "CATCCG", "A1"), (2, "GGTTAA", "B1"), (3, None, None)], "pos int, bc string, well string").orderBy("pos")
    lists = {"bc": (bars, "bc", 1), "well": (bars, "well", None)}
    return {r.entry_id: r.canonical for r in K.map_to_canonical(df, lists, **kw).collect()}


@pytest.mark.parametrize("block", [1, 100])
def test_entries(spark, block):
    rows = [("bc", "cat-ccg"), ("bc", "catcg"), ("bc", "catccgtt"), ("bc", None), ("bc", ""), ("bc", "?!"), ("well", "1a"), ("zz", "A1"), (None, "A1"), ("bc", "GGTTAA"), ("bc", "a" * 100_000), ("well", "a1" * 100_000)]
    got = mapped(spark, entries(spark, *rows), block_entries=block)
    assert [got[i] for i in range(len(rows))] == ["CATCCG", "CATCCG", "NA", "NA", "NA", "NA", "A1", "NA", "NA", "GGTTAA", "NA", "NA"]


def test_entries_without_rows(spark):
    df = entries(spark, ("bc", "CATCCG"))
    assert mapped(spark, df.limit(0)) == {}
    empty = spark.createDataFrame([], "bc string")
    assert K.map_to_canonical(df, {"bc": (empty, "bc", 1)}).first().canonical == "NA"
