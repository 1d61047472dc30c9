import random

import pytest

from readloom.llm import leakage as L
from readloom.llm import privacy as V

# Problem 9


def shares(a, b, n):
    x, y = L.words_of(a or ""), L.words_of(b or "")
    return bool({tuple(x[i : i + n]) for i in range(len(x) - n + 1)} & {tuple(y[i : i + n]) for i in range(len(y) - n + 1)})


@pytest.mark.parametrize("block", [3, 100])
def test_leaks_equal_brute_force(spark, block):
    rng = random.Random(block)
    vocabulary = ["Ä", "b", "C", "d1", "é"]
    text = lambda: rng.choice([" ", ", ", " - "]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))
    items = [(i, text(), "x") for i in range(9)] + [(50, None, "x"), (51, "", "x")]
    docs = [(i, text(), 7) for i in range(60)] + [(90, None, 7)]
    got = L.find_leaks(
        spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"),
        spark.createDataFrame(items, "item_id bigint, text string, doc_id string"),
        words=4,
        block_windows=block,
    ).collect()
    assert sorted((r.doc_id, r.item_id) for r in got if r.passage == 1) == sorted((d, i) for d, t, _ in docs for i, s, _ in items if shares(t, s, 4))


def test_leak_offsets(spark):
    index = L.PassageIndex([(1, "one two three"), (2, "ONE, two; three!"), (3, "two words")], 3)
    text = "¿Zero: One  TWO\nthree… four one two three"
    spans = sorted(index.spans(text))
    assert [(i, p, n) for i, p, _, _, n in spans] == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 1)]
    assert [text[a:b] for i, _, a, b, _ in spans if i == 1] == ["One  TWO\nthree", "one two three"]
    assert L.PassageIndex([], 3).spans("a b c") == [] and index.spans("İ one") == []
    long = "x " * 200_000 + "one two three"
    assert index.spans(long)[0][3] == len(long)


def test_passages_far_apart_are_apart():
    item = " ".join(f"w{i}" for i in range(30))
    index = L.PassageIndex([(1, item)], 13)
    text = " ".join([*item.split()[:15], *["x"] * 1000, *item.split()[14:], *item.split()[:13]])
    spans = index.spans(text)
    # the last two passages adjoin and are one
    assert [(p, n) for _, p, _, _, n in spans] == [(1, 3), (2, 5)] and spans[0][3] < 80 and spans[1][2] > 2000


def test_more_words_than_codes(monkeypatch):
    monkeypatch.setattr(L, "CODES", 6)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(rng.choice(words) for _ in range(8))) for i in range(5)]
    index = L.PassageIndex(items, 3)
    assert index.width == 2 and len(set(index.codes.values())) == 9
    for _ in range(300):
        text = " ".join(rng.choice([*words, "zz"]) for _ in range(rng.randint(0, 12)))
        assert set(index.hits(text)) == {i for i, t in items if shares(text, t, 3)}


# Problem 10

GIVEN, FAMILY = {"lavis", "reva", "tomas"}, {"bexwell", "nalström", "koxquist", "dosmont"}


@pytest.fixture(scope="module")
def finder():
    return V.NameFinder(GIVEN, FAMILY)


@pytest.fixture(scope="module")
def model(finder):
    return V.fit(TRAINING, finder)


TRAINING = [
    f"{lead} {label} {value}{tail}"
    for lead in ("Please contact", "Signed by", "The badge reads")
    for tail in (" first.", ", unverified.", " on file.")
    for label, value in (
        ("tel.", "020 7946 0991"), ("phone", "+44 7700 900123"), ("", "(202) 555-0101"), ("phone", "555-0123"), ("ID", "666-12-3456"),
        ("identity no.", "QQ 12 34 56 A"), ("Ausweis-Nr.", "00123456789"), ("e-mail", "a.b@x.example"), ("home address", "12 Old Palm Row"),
        ("", "Lavis Bexwell"), ("", "R. Nalström"), ("", "Koxquist, Reva"),
    )
]
TRAINING += ["Use the Bexwell buffer.", "The Koxquist protocol failed.", "Lot 000-12-34567-B.", "Catalogue no. 5550-14277."] * 4


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Write to a_b+c@mail.x.example.", [("email", "a_b+c@mail.x.example")]),
        ("Write to a-b [at] x [dot] co [dot] example now", [("email", "a-b [at] x [dot] co [dot] example")]),
        ("Write to A.B(at)x-lab.test", [("email", "A.B(at)x-lab.test")]),
        ("Index @lane3 was empty. Tag v@2 is old. Version 2.14.0-rc1@stable.", []),
        ("Please contact tel. 0049 30 23125154 first.", [("phone", "0049 30 23125154")]),
        ("phone (030) 23125948, unverified", [("phone", "(030) 23125948")]),
        ("le 01.99.00.24.59 ou +33199008138", [("phone", "01.99.00.24.59"), ("phone", "+33199008138")]),
        ("call 1-303-555-0190.", [("phone", "1-303-555-0190")]),
        ("national number: 000-12-3456 (QQ123456D)", [("id_number", "000-12-3456"), ("id_number", "QQ123456D")]),
        ("n° de sécu 9 87 11 99 938 087 19", [("id_number", "9 87 11 99 938 087 19")]),
        ("personnr 19980219-0004, documento 00001905Y", [("id_number", "19980219-0004"), ("id_number", "00001905Y")]),
        ("Lot 000-12-34567-B. Order 99-00-12. Plate 7700-9. See chr5:1203554-1203990. Reads 120199-120555", []),
        ("home address 37B Belv Rd., then", [("address", "37B Belv Rd.")]),
        ("Anschrift: Laminastr. 78. wohnhaft Kalvsorweg 86b", [("address", "Laminastr. 78"), ("address", "Kalvsorweg 86b")]),
        ("domicilié 44 bis, avenue Solasell ou 235, rue de Hamil", [("address", "44 bis, avenue Solasell"), ("address", "235, rue de Hamil")]),
        ("dirección: Plaza Nalwick, 25, domicilio C/ Takell 228", [("address", "Plaza Nalwick, 25"), ("address", "C/ Takell 228")]),
        ("bosatt Sormwickvägen 100 B, adress Ganak torg 145", [("address", "Sormwickvägen 100 B"), ("address", "Ganak torg 145")]),
        ("Thanks to Dr. LAVIS BEXWELL, R.T. Nalström", [("name", "LAVIS BEXWELL"), ("name", "R.T. Nalström")]),
        ("Reva B. Koxquist-Dosmont or Dosmont, Tomas", [("name", "Reva B. Koxquist-Dosmont"), ("name", "Dosmont, Tomas")]),
        ("Use the Bexwell buffer. The Koxquist protocol failed.", []),
        ("", []),
    ],
)
def test_found(model, finder, text, expected):
    (found,) = V.detect(model, finder, [text])
    assert [(c.kind, text[c.start : c.end]) for c in found] == expected


def test_marginals_are_exact_on_a_chain():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    n = len(V.LABELS)
    nodes = V.Nodes([0] * 3, [0] * 3, [1] * 3, [[f"k={k}:B" for k in V.KINDS] + [f"f{i}"] for i in range(3)], [(0, 1), (1, 2)], [], [[]])
    features = {f"f{i}": i for i in range(3)}
    model = V.Model(features, rng.normal(size=(3, n)), rng.normal(size=(n, n)), rng.normal(size=(n, n)))
    table = np.zeros((3, n))
    theta = model.scores(nodes)
    for y in itertools.product(range(n), repeat=3):
        p = np.exp(sum(theta[i, y[i]] for i in range(3)) + model.chain[y[0], y[1]] + model.chain[y[1], y[2]])
        for i in range(3):
            table[i, y[i]] += p
    assert np.allclose(np.exp(V.marginals(model, nodes)), table / table.sum(axis=1, keepdims=True))


def test_skip_links_join_repeated_tokens(finder):
    nodes = V.build_nodes(["tel. 0701740618 and later 0701740618"], finder)
    assert len(nodes.skip) == 1
    a, b = nodes.skip[0]
    assert nodes.start[a] < nodes.start[b]


def test_tables(spark):
    names = spark.createDataFrame([("given", n.title()) for n in GIVEN] + [("family", n.title()) for n in FAMILY] + [(None, None)], "name_part string, name_text string")
    texts = TRAINING + [None, "", "tel. 020 7946 0991 and 020 7946 0991", "x" * 300_000]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, kind string")
    rows = [tuple(r) for r in V.find_personal(docs, names).collect()]
    assert len(rows) == len(set(rows))
    assert [r for r in rows if r[0] == len(TRAINING) + 2] == [(len(TRAINING) + 2, "phone", "020 7946 0991")]
    assert not [r for r in rows if r[0] in (len(TRAINING), len(TRAINING) + 1, len(TRAINING) + 3)]
    red = {r.doc_id: r for r in V.redact_personal(docs, names).collect()}
    assert red[len(TRAINING)].redacted is None and red[len(TRAINING) + 1].redacted == ""
    assert red[len(TRAINING) + 2].redacted == "tel. [PHONE] and [PHONE]" and red[len(TRAINING) + 2].replaced == 2
    assert V.find_personal(docs.limit(0), names).count() == 0
    assert V.find_personal(docs.limit(5), names.limit(0)).count() == V.find_personal(docs.limit(5), names.limit(0)).distinct().count()


def test_cheap_tests_lose_no_match():
    """The grammars over whole texts against those tried only where a number, a street or an @ may be."""
    rng = random.Random(6)
    parts = "+46 (0) 8-12 34 ( ) . / a@b.se [at] 12 rue C/ Calle Str. STRAßE strasſe weg 1A 19850102-1234 X-1234567L AB 12 34 56 C \n - x ring Gata 44".split(" ")
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " ", "-"]) for _ in range(rng.randint(1, 25)))
        every = sorted((k, s, m.span()) for k, s, p in V.GRAMMARS for m in p.finditer(text))
        found = sorted((k, s, m.span()) for k, s, m in V._matches(text))
        short = [(k, s, span) for k, s, span in every if (k, s, span) not in found]
        # what is left out has too few digits for a phone number
        assert set(found) <= set(every) and all(k == "phone" and sum(c.isdigit() for c in text[a:b]) < 7 for k, _, (a, b) in short), text


def test_sample_is_that_of_the_least_hashes(spark):
    df = spark.range(500).selectExpr("id as doc", "if(id % 7 = 0, null, concat('t', id)) as text")
    from pyspark.sql import functions as F

    want = [r.text for r in df.where("text is not null").orderBy(F.xxhash64("doc"), "doc").limit(40).collect()]
    assert V._sample(df, 40) == want and len(V._sample(df, 4000)) == df.where("text is not null").count()
    assert V._sample(df.limit(0), 10) == []
