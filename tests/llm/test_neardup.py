import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import neardup as N


def contigs(spark, rows):
    return spark.createDataFrame(rows, "contig_id bigint, seq string, rep string, key bigint")


def grams(s, n=12):
    s = s.upper()
    return {s[i : i + n] for i in range(len(s) - n + 1)}


def brute(rows, threshold):
    sets = {i: grams(s) for i, s, *_ in rows if s is not None and len(s) >= 12}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                out.add((a, b))
    return out


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        s[i : i + rng.choice([0, 1, 1])] = rng.choice(["A", "C", "GT", ""])
    return "".join(s)


def family(rng, count=120):
    rows, i = [], 0
    while len(rows) < count:
        base = "".join(rng.choice("ACGT") for _ in range(rng.randint(60, 200)))
        for _ in range(rng.choice([1, 2, 5])):
            i += 1
            text = edited(rng, base, rng.choice([0, 0, 1, 2, 4]))
            rows.append((i, text.lower() if rng.random() < 0.2 else text, "x", 1))
    return rows


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 2**63, 50).astype(np.uint64)
    w1 = rng.uniform(0, 4, 50)
    w2 = np.where(rng.random(50) < 0.6, w1, rng.uniform(0, 4, 50))
    w2[:5] = 0
    s, filled = N.dart_signatures(np.concatenate([elements, elements]), np.concatenate([w1, w2]), np.repeat([0, 1], 50), 3, 3000)
    assert list(filled) == [True, True, False]
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum(), abs=0.03)


def test_signature_does_not_depend_on_company():
    a, owner, often = N.shingle_hashes(["ACGTACGTACGTAAAA", "TTTTTTTTTTTTTTTTTTTTTTTT", "short"], 12)
    assert sorted(often[owner == 0].tolist()) == [1] * 5 and often[owner == 1].tolist() == [13]
    assert np.bincount(owner, minlength=3).tolist() == [5, 1, 0]
    both, filled = N.dart_signatures(a, np.ones(len(a)), owner, 3, 60)
    assert filled.tolist() == [True, True, False]
    for i in (0, 1):
        own = a[owner == i]
        s, _ = N.dart_signatures(own, np.ones(len(own)), np.zeros(len(own), np.int64), 1, 60)
        assert (s[0] == both[i]).all()


def test_pairs_equal_brute_force(spark):
    rows = family(random.Random(8))
    got = {(r.left_id, r.right_id) for r in N.similar_pairs(contigs(spark, rows), "contig_id", "seq").collect()}
    assert got == brute(rows, 0.5)


def test_weighted_pairs_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):  # repeats of one unit: the sets are equal, the weights are not
        unit = "".join(rng.choice("ACGT") for _ in range(15)) if i % 6 == 0 else unit
        rows.append((i, unit * rng.randint(1, 12) + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40))), "x", 1))

    def bag(s):
        return Counter(s[i : i + 12] for i in range(len(s) - 11))

    bags = {i: bag(s) for i, s, *_ in rows}
    expected = {
        (a, b) for a in bags for b in bags if a < b and sum((bags[a] & bags[b]).values()) >= 0.5 * sum((bags[a] | bags[b]).values())
    }
    got = {(r.left_id, r.right_id) for r in N.similar_pairs(contigs(spark, rows), "contig_id", "seq", weighted=True).collect()}
    assert got == expected and got != brute(rows, 0.5)


def test_hot_copies_meet_in_shares(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARE", 2)
    monkeypatch.setattr(N, "BLOCK", 3)
    rng = random.Random(2)
    base = "".join(rng.choice("ACGT") for _ in range(100))
    rows = [(i, base if i % 3 else base[:90] + "ACGTA" * 2, "x", 1) for i in range(24)] + [(99, base + "A", "x", 1)]
    df = contigs(spark, rows)
    found = [(r.left_id, r.right_id) for r in N.similar_pairs(df, "contig_id", "seq").collect()]
    assert set(found) == brute(rows, 0.5) and len(set(found)) == len(found) == 25 * 24 // 2
    groups = N.similar_groups(df, "contig_id", "seq").collect()
    assert len(groups) == 25 and {r.group_id for r in groups} == {0}


def test_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 3)
    rng = random.Random(1)
    base = "".join(rng.choice("ACGT") for _ in range(300))
    rows = [(i, base[:290] + format(i, "b").replace("0", "A").replace("1", "C"), "x", 1) for i in range(1, 15)]
    got = {(r.left_id, r.right_id) for r in N.similar_pairs(contigs(spark, rows), "contig_id", "seq").collect()}
    assert got == brute(rows, 0.5) and len(got) == 14 * 13 // 2


def test_groups(spark):
    rng = random.Random(5)
    rows = family(rng, 60) + [(901, "ACGTACGTACGTA", "x", 1), (902, "acgtacgtacgta", "x", 1), (903, None, "x", 1), (904, "ACGT", "x", 1), (905, "", "x", 1)]
    got = {r.contig_id: r for r in N.similar_groups(contigs(spark, rows), "contig_id", "seq").collect()}
    links = brute(rows, 0.5)
    root = {i: i for i, s, *_ in rows if s is not None and len(s) >= 12}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {i: r.group_id for i, r in got.items()} == {i: find(i) for i in root}
    text = {i: s.upper() for i, s, *_ in rows if i in root}
    for i, r in got.items():
        near = {text[b] if a == i else text[a] for a, b in links if i in (a, b)}
        assert r.links == len(near - {text[i]}) and r.copies == sum(t == text[i] for t in text.values())


def test_chain_of_links_is_one_group(spark):
    nodes = spark.range(1, 41).select(F.col("id").alias("node"))
    links = spark.range(1, 40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in N.components(nodes, links).collect()} == {1}
    alone = N.components(nodes, links.limit(0)).collect()
    assert all(r.node == r.root for r in alone)


def test_empty_long_and_repeated(spark):
    df = contigs(spark, [(1, "A" * 50_000, "x", 1), (2, "A" * 40_000 + "CCCC", "x", 1), (1, "A" * 50_000, "x", 1)])
    assert N.similar_pairs(df, "contig_id", "seq", threshold=0.05).count() == 1
    assert N.similar_pairs(df.limit(0), "contig_id", "seq").count() == 0
    assert N.similar_groups(df.limit(0), "contig_id", "seq").count() == 0
    assert N.similar_pairs(df.withColumn("seq", F.lit(None).cast("string")), "contig_id", "seq").count() == 0
    assert N.bands_for(0.8) < N.bands_for(0.5)
