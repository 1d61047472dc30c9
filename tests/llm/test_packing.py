import random

import pytest

from readloom.llm import packing as P


def optimum(sizes, capacity):
    """Exact least number of containers, by subsets."""
    n = len(sizes)
    best = [(0, 0)] + [(n + 1, 0)] * ((1 << n) - 1)
    for mask in range(1, 1 << n):
        for i in range(n):
            if mask >> i & 1:
                bins, used = best[mask ^ (1 << i)]
                cand = (bins, used + sizes[i]) if bins and used + sizes[i] <= capacity else (bins + 1, sizes[i])
                best[mask] = min(best[mask], cand)
    return best[-1][0]


def check(sizes, capacity, bins):
    assert sorted(x for b in bins for x in b) == sorted(sizes) and all(sum(b) <= capacity for b in bins)


@pytest.mark.parametrize("seed", range(25))
def test_small_cases_are_optimal(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(5, 60) for _ in range(rng.randint(1, 11))]
    bins = P.bin_completion(sizes, 100)
    check(sizes, 100, bins)
    assert len(bins) == optimum(sizes, 100)


def test_never_worse_than_best_fit_and_close_to_the_bound():
    rng = random.Random(9)
    for n in (50, 500, 5000):
        sizes = [min(512, int(rng.lognormvariate(4, 1)) + 1) for _ in range(n)]
        bins, fit = P.bin_completion(sizes, 512), P.best_fit(sizes, 512)
        check(sizes, 512, bins)
        check(sizes, 512, fit)
        assert len(bins) <= len(fit) and len(bins) <= -(-sum(sizes) // 512) + 1
    assert P.bin_completion([], 512) == [] and P.bin_completion([512] * 3, 512) == [[512]] * 3


def test_fillings():
    stock = P._Stock([50, 30, 20, 20, 5], 100)
    assert P.completions(stock, 50) == [(50,)]
    assert P.completions(stock, 4) == [()]
    assert sum(P.completions(stock, 45)[0]) == 45 and stock.left == 5
    assert P._dominates((30, 20), (30, 10, 10)) and not P._dominates((25, 25), (30, 10))


@pytest.fixture(scope="module")
def encoding():
    return P.load_tokenizer(P.default_tokenizer())


@pytest.mark.parametrize("text", ["", "short", "word " * 3000, "é漢😀" * 900, "a" * 120_000, "x\ud800y" * 700])
def test_pieces_join_to_the_text(encoding, text):
    pieces = P.pieces_of(text, encoding, 512)
    assert "".join(text[a:b] for a, b, _ in pieces) == text
    assert all(0 < n <= 512 and n == len(P.token_lengths(text[a:b], encoding)) for a, b, n in pieces)
    assert len(pieces) <= 1 or len(P.token_lengths(text, encoding)) > 512


def test_packed_table(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["word"] * rng.choice([3, 40, 200, 480, 900])), 1, "x") for i in range(60)]
    rows += [(100, None, 1, "x"), (101, "", 1, "x"), (1, rows[1][1], 1, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, block int, container_id string")
    for block in (10, 1000):
        got = P.pack_texts(df, block_items=block).collect()
        by_doc = {}
        for r in got:
            by_doc.setdefault(r.doc_id, []).append(r)
        assert not {100, 101} & set(by_doc)
        for i, text, *_ in rows[:60]:
            copies = 2 if i == 1 else 1
            assert sum(r.end_pos - r.start_pos for r in by_doc[i]) == copies * len(text)
        places = {(r.container_id, r.slot) for r in got}
        assert len(places) == len(got)
        used = {}
        for r in got:
            used[r.container_id] = used.get(r.container_id, 0) + r.tokens
        assert max(used.values()) <= 512
        fill = {r.container_id: (r.used, r.unused) for r in P.container_fill(P.pack_texts(df, block_items=block)).collect()}
        assert fill == {c: (u, 512 - u) for c, u in used.items()}
    assert P.pack_texts(df.limit(0)).count() == 0


def test_fillings_of_any_number_of_items():
    stock = P._Stock([*range(62, 70), 48, 27, 25], 200)
    assert P.completions(stock, 100)[0] == (48, 27, 25)


def dealt(rooms, items):
    """Whether the items fit into the rooms, by trying everything."""
    if not items:
        return True
    return any(r >= items[0] and dealt(rooms[:i] + (r - items[0],) + rooms[i + 1 :], items[1:]) for i, r in enumerate(rooms))


@pytest.mark.parametrize("seed", range(40))
def test_fillings_are_all_that_nothing_dominates(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(2, 30) for _ in range(rng.randint(1, 9))]
    room = rng.randint(5, 45)
    every = {tuple(sorted((s for i, s in enumerate(sizes) if m >> i & 1), reverse=True)) for m in range(1 << len(sizes))}
    every = {f for f in every if sum(f) <= room}
    best = {f for f in every if not any(g != f and dealt(g, f) for g in every)}
    got = P.completions(P._Stock(sizes, 50), room)
    assert len(got) == len(set(got)) and set(got) == best
    assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)
    least = room - 2
    full = {f for f in best if sum(f) >= least}
    assert set(P.completions(P._Stock(sizes, 50), room, least)) - {()} == full - {()}


@pytest.mark.parametrize("sizes", [[6, 2, 2], [6, 4, 2], [9], [9, 9, 1], []])
def test_items_above_the_capacity_are_alone(sizes):
    container, slot = P.fill(sizes, 4)
    held = {}
    for s, c in zip(sizes, container.tolist()):
        held.setdefault(c, []).append(s)
    assert all(len(h) == 1 if max(h) > 4 else sum(h) <= 4 for h in held.values())
    assert len(set(zip(container.tolist(), slot.tolist()))) == len(sizes)
    assert len(held) == len([s for s in sizes if s > 4]) + -(-sum(s for s in sizes if s <= 4) // 4)


@pytest.mark.parametrize("capacity", [2, 4])
def test_small_capacities(spark, encoding, capacity):
    texts = ["a few plain words here", "é漢😀" * 5, "\U0001f9ec\U0001fac0", "x", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = P.pack_texts(df, capacity=capacity).collect()
    for i, text in enumerate(texts):
        pieces = sorted((r.start_pos, r.end_pos) for r in rows if r.doc_id == i)
        assert "".join((text or "")[a:b] for a, b in pieces) == (text or "")
    held = {}
    for r in rows:
        held.setdefault(r.container_id, []).append(r)
    for group in held.values():
        assert sum(r.tokens for r in group) <= capacity or (len(group) == 1 and group[0].end_pos - group[0].start_pos == 1)
    bound = P.packing_bound(P.pack_texts(df, capacity=capacity), capacity).first()
    assert bound.pieces == len(rows) and bound.lower_bound <= bound.containers == len(held)
    assert P.packing_bound(P.pack_texts(df.limit(0)), capacity).first().lower_bound == 0


def test_sizes_of_a_long_text_are_those_of_the_tokenizer(encoding):
    text = "sequencing reads of 12 wells,  " * 6500 + "z" * 500
    assert len(text) > 200_000
    whole = encoding.encode_ordinary(text)
    assert P.token_lengths(text, encoding).tolist() == [len(b) for b in encoding.decode_tokens_bytes(whole)]
    pieces = P.pieces_of(text, encoding, 512)
    assert "".join(text[a:b] for a, b, _ in pieces) == text and max(n for *_, n in pieces) <= 512
    assert len(pieces) <= -(-len(whole) // 512) * 1.02 + 1
