"""Texts in containers of fixed token capacity with little unused space: bin completion.

Sizes are tokens of a public tokenizer.  Items are spread over blocks of
bounded size by hash, and each block is solved on its own by branch and bound:
the largest open item starts a container, the undominated fillings of the
space around it are enumerated (fullest first, of any number of items, from a
table of the sums within reach), and a branch is cut when its waste exceeds
what the number of containers aimed at allows.  Every filling looked at counts
as a node.  Best-fit decreasing gives the first incumbent.  The search for one container fewer goes
on until the lower bound is met or the node budget is spent; a block of many
small items usually meets the bound at the first descent.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import checkpointed

CAPACITY = 512
BLOCK_ITEMS = 20_000
NODES = 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(text: str, encoding) -> np.ndarray:
    """Bytes of each token of the text, in order."""
    tokens = encoding.encode_ordinary(text.encode("utf-8", "replace").decode("utf-8"))
    return np.array([len(b) for b in encoding.decode_tokens_bytes(tokens)], np.int64)


def pieces_of(text: str, encoding, capacity: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece in characters; one piece unless the text exceeds the capacity.

    A text is cut where a token and a character end together.  A piece holds
    at most ``capacity`` tokens also when it is tokenized by itself, unless it
    is one character that takes more than that.
    """
    if not text:
        return []
    lengths = token_lengths(text, encoding)
    if len(lengths) <= capacity:
        return [(0, len(text), len(lengths))]
    ends = np.cumsum(lengths)
    data = text.encode("utf-8", "replace")
    starts_char = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    chars_before = np.concatenate([[0], np.cumsum(starts_char)])  # characters that begin before a byte offset
    at_char = np.append(starts_char, True)
    out, token, char = [], 0, 0
    while token < len(ends):
        stop = min(token + capacity, len(ends))
        while True:
            while stop > token + 1 and not at_char[ends[stop - 1]]:
                stop -= 1
            least = token + 1  # the piece's first character, which may be made of many tokens, is never cut
            while not at_char[ends[least - 1]]:
                least += 1
            stop = max(stop, least)
            end = int(chars_before[ends[stop - 1]])
            size = len(token_lengths(text[char:end], encoding))
            if size <= capacity or stop <= least:
                break
            stop = max(token + 1, stop - (size - capacity))
        out.append((char, end, size))
        token, char = stop, end
    return out


class _Stock:
    """Multiset of sizes up to the capacity, with the next available size at or below any bound."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.count = [0] * (capacity + 1)
        for s in sizes:
            self.count[s] += 1
        self.kinds = sorted({*sizes})
        self.left = len(sizes)

    def take(self, s: int) -> None:
        self.count[s] -= 1
        self.left -= 1
        if not self.count[s]:
            del self.kinds[bisect_left(self.kinds, s)]

    def put(self, s: int) -> None:
        if not self.count[s]:
            insort(self.kinds, s)
        self.count[s] += 1
        self.left += 1

    def below(self, bound: int) -> int:
        """Largest available size that is at most ``bound``; 0 if none."""
        i = bisect_left(self.kinds, bound + 1)
        return self.kinds[i - 1] if i else 0


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of b can be dealt to the items of a, each of which holds its share."""
    if sum(a) < sum(b):
        return False
    room = list(a)
    for x in b:  # largest first into the tightest room; exact for the small sets used here
        fit = [i for i, r in enumerate(room) if r >= x]
        if not fit:
            return False
        room[min(fit, key=lambda i: room[i])] -= x
    return True


def _fillings(stock: _Stock, room: int, least: int) -> Iterator[tuple[tuple[int, ...], bool]]:
    """All fillings of ``room`` with at least ``least`` units, the fullest first, and whether each is undominated.

    Of equally full ones those with larger items come first, so none is dominated by a later one and the first by
    none.  ``reach[i]``: bit t is set if items of the first i kinds can add up to t; branches without a filling are
    never entered.  The stock is read once, at the first filling.
    """
    kinds = stock.kinds[: bisect_left(stock.kinds, room + 1)]
    if not kinds:
        yield (), True
        return
    if kinds[-1] == room:  # an item that fits exactly dominates every other filling
        yield (room,), True
        return
    have = [stock.count[s] for s in kinds]
    mask = (2 << room) - 1
    reach = [1]
    for s, n in zip(kinds, have):
        bits, step, n = reach[-1], 1, min(n, room // s)
        while n:
            k = min(step, n)
            bits |= bits << k * s & mask
            n -= k
            step *= 2
        reach.append(bits)
    for total in range(room, max(least, 1) - 1, -1):
        if not reach[-1] >> total & 1:
            continue
        branches: list[tuple[int, int, tuple[int, ...]]] = [(len(kinds), total, ())]  # kinds and units left, items
        while branches:
            i, rest, items = branches.pop()
            while rest:
                i = bisect_left(kinds, rest + 1, 0, i) - 1
                s, before = kinds[i], reach[i]
                ways = [k for k in range(min(have[i], rest // s) + 1) if before >> (rest - k * s) & 1]
                branches += [(i, rest - k * s, items + (s,) * k) for k in ways[:-1]]
                items, rest = items + (s,) * ways[-1], rest - ways[-1] * s
            yield items, _undominated(items, room - total, kinds, have)


def _undominated(items: tuple[int, ...], gap: int, kinds: list[int], have: list[int]) -> bool:
    """Whether no open item, put in place of some of the items or of none, holds their share within the room."""
    sums, single, several = 1, 0, 0  # totals of any items, of one and of at least two
    held: dict[int, int] = {}
    for s in items:
        several |= (several | single) << s
        single |= 1 << s
        sums |= sums << s
        held[s] = held.get(s, 0) + 1
    for d in range(1, gap + 1):
        several |= sums << d
    return not any(several >> s & 1 and n > held.get(s, 0) for s, n in zip(kinds, have))


def completions(stock: _Stock, room: int, least: int = 0) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` with at least ``least`` units, the fullest first; each is maximal in the stock."""
    return [items for items, keep in _fillings(stock, room, least) if keep]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing, the incumbent."""
    rooms: list[tuple[int, int]] = []  # room, container; ordered
    bins: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        i = bisect_left(rooms, (s, -1))
        if i < len(rooms):
            room, b = rooms.pop(i)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(s)
        insort(rooms, (room - s, b))
    return bins


def bin_completion(sizes: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Containers as lists of sizes; never worse than best-fit decreasing."""
    if not sizes:
        return []
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    lower = max(-(-total // capacity), sum(s * 2 > capacity for s in sizes))
    while len(best) > lower and nodes > 0:
        better, used = _search(sizes, capacity, len(best) - 1, total, nodes)
        nodes -= used
        if better is None:
            break
        best = better
    return best


def _search(sizes: list[int], capacity: int, aim: int, total: int, nodes: int) -> tuple[list[list[int]] | None, int]:
    stock = _Stock(sizes, capacity)
    waste = aim * capacity - total  # unused space that ``aim`` containers may have in all
    stack: list[_Level] = []
    done: list[list[int]] = []
    used = 0
    stack.append(_Level(stock.kinds[-1]))
    while stack:
        level = stack[-1]
        if len(done) == len(stack):  # back here: undo this level's choice
            for s in done.pop():
                stock.put(s)
            waste += level.gap
        if used >= nodes:
            return None, used
        option = level.next(stock, capacity, waste)
        if option is None:
            stack.pop()
            continue
        used += 1
        items, keep = option
        gap = capacity - level.largest - sum(items)
        if not keep or gap > waste:
            continue
        choice = [level.largest, *items]
        for s in choice:
            stock.take(s)
        done.append(choice)
        waste -= gap
        level.gap = gap
        if not stock.left:
            return done, used
        stack.append(_Level(stock.kinds[-1]))
    return None, used


class _Level:
    """A container of the search: the largest open item and the fillings around it.

    Most levels are never returned to, so the enumeration is dropped after its first filling and begun again, on the
    same stock, when the search comes back.
    """

    def __init__(self, largest: int) -> None:
        self.largest = largest
        self.gap = 0
        self.tried = 0
        self.options: Iterator[tuple[tuple[int, ...], bool]] | None = None

    def next(self, stock: _Stock, capacity: int, waste: int) -> tuple[tuple[int, ...], bool] | None:
        room = capacity - self.largest
        again = self.options is None
        if again:
            stock.take(self.largest)
            self.options = _fillings(stock, room, room - waste)
            for _ in range(self.tried):
                next(self.options)
        option = next(self.options, None)
        if again:
            stock.put(self.largest)
        self.tried += 1
        if self.tried == 1:
            self.options = None
        return option


def _tokenize(path: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_tokenizer(path)
        for batch in batches:
            rows = [
                (doc, n, start, end, size)
                for doc, text in zip(batch["doc"].tolist(), batch["text"])
                if isinstance(text, str)
                for n, (start, end, size) in enumerate(pieces_of(text, encoding, capacity))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "start_pos", "end_pos", "tokens"]).astype(
                {"piece_no": "int64", "start_pos": "int64", "end_pos": "int64", "tokens": "int64"}
            )

    return run


def fill(sizes: list[int], capacity: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Container and slot of each item; one above the capacity has a container of its own."""
    container, slot = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    waiting: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        waiting.setdefault(sizes[i], []).append(i)
    bins = bin_completion([s for s in sizes if s <= capacity], capacity, nodes)
    bins += [[s] for s in sizes if s > capacity]
    for b, items in enumerate(bins):
        for k, s in enumerate(items):
            at = waiting[s].pop()
            container[at], slot[at] = b, k
    return container, slot


def _fill_block(capacity: int, nodes: int):
    """One block per task: its items, a bounded number of sizes and offsets, are packed together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        whole = pd.concat(parts)
        for block, group in whole.groupby("block", sort=True):
            group = group.sort_values(["tokens", "doc_id", "piece_no"], kind="stable").reset_index(drop=True)
            container, slot = fill(group["tokens"].tolist(), capacity, nodes)
            group["container_id"] = (int(block) << 32) + container
            group["slot"] = slot
            yield group[["container_id", "slot", "doc_id", "piece_no", "start_pos", "end_pos", "tokens"]]

    return run


def pack_texts(
    docs: DataFrame,
    *,
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    block_items: int = BLOCK_ITEMS,
    nodes: int = NODES,
) -> DataFrame:
    """One row per text or piece of a text: container_id, slot, doc_id, piece_no, start_pos, end_pos, tokens.

    ``start_pos`` and ``end_pos`` are characters of the text; the pieces of a
    text join to exactly the text.  Only offsets are shuffled, never texts.

    Defined results: null and empty texts need no space and have no row; a
    text is split only if it alone exceeds the capacity; texts of equal size
    are interchangeable and take places in order of doc_id; repeated texts
    take a place each; a single character of more tokens than the capacity has
    a container of its own; an empty table gives an empty result.
    """
    path = tokenizer or default_tokenizer()
    source = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["doc"].dataType.simpleString()
    fields = f"doc_id {kind}, piece_no bigint, start_pos bigint, end_pos bigint, tokens bigint"
    pieces = checkpointed(source.mapInPandas(_tokenize(path, capacity), fields))
    blocks = max(1, -(-pieces.count() // block_items))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(7)), F.lit(blocks)).cast("int"))
    return dealt.repartitionById(blocks, F.col("block")).mapInPandas(  # a task per block, never merged into fewer
        _fill_block(capacity, nodes),
        f"container_id bigint, slot bigint, doc_id {kind}, piece_no bigint, start_pos bigint, end_pos bigint, tokens bigint",
    )


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """container_id, pieces, used, unused."""
    return packed.groupBy("container_id").agg(
        F.count("*").alias("pieces"), F.sum("tokens").alias("used"), (F.lit(capacity) - F.sum("tokens")).alias("unused")
    )


def packing_bound(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: pieces, tokens, containers, and the least number that could hold them."""
    used = F.sum(F.least("tokens", F.lit(capacity)))
    return packed.agg(
        F.count("*").alias("pieces"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.count_distinct("container_id").alias("containers"),
        F.coalesce(F.greatest(F.ceil(used / capacity), F.count_if(F.col("tokens") * 2 > capacity)), F.lit(0)).alias("lower_bound"),
    )
