"""Free-entered values mapped to the closest entry of a canonical list.

A value is normalised (full-width forms, case, spacing, punctuation).  One
Aho-Corasick automaton per list, over the canonical names and their aliases,
finds the mentions in it; they are reduced to the longest non-overlapping
ones.  A mention that covers the value decides it, and so does the longest
embedded one that stands between word borders, if the caller accepts text
around a name.  The remaining values go to the similarity of token sets: an
edit changes at most two pairs of neighbouring letters, so the entries that
share enough of them are the candidates, the most similar first, and an exact
check by edits decides.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import zip_longest

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import checkpointed

UNMATCHED = "NA"
#: Entries per automaton; longer lists are matched in blocks and the best entry of all blocks wins.
BLOCK_ENTRIES = 50_000


def plain(value: str) -> str:
    """Lower-case letters and digits only; full-width characters count as plain ones."""
    return "".join(c for c in unicodedata.normalize("NFKC", value).casefold() if c.isalnum())


def with_borders(value: str) -> tuple[str, set[int]]:
    """The plain form, and the places in it where a run of letters or digits begins or ends in the value."""
    out: list[str] = []
    borders, inside = {0}, False
    for c in unicodedata.normalize("NFKC", value).casefold():
        if c.isalnum():
            out.append(c)
        elif inside:
            borders.add(len(out))
        inside = c.isalnum()
    borders.add(len(out))
    return "".join(out), borders


def edits(a: str, b: str, most: int) -> int:
    """Single-character edits between a and b, or ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new, low = [i], i
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            new.append(v)
            low = min(low, v)
        if low > most:
            return most + 1
        row = new
    return min(row[-1], most + 1)


def token_set(value: str, n: int = 2) -> frozenset[str]:
    return frozenset(value[i : i + n] for i in range(len(value) - n + 1)) or frozenset([value])


def longest_mentions(mentions: list[tuple[int, int, object]]) -> list[tuple[int, int, object]]:
    """Longest non-overlapping mentions (start, end, entry); of equally long ones the least entry, then the leftmost."""
    starts: list[int] = []
    taken: list[tuple[int, int, object]] = []
    for m in sorted(mentions, key=lambda m: (m[0] - m[1], m[2], m[0])):
        i = bisect_left(starts, m[0])
        free_before = i == 0 or taken[i - 1][1] <= m[0]
        free_after = i == len(starts) or m[1] <= starts[i]
        if free_before and free_after:
            starts.insert(i, m[0])
            taken.insert(i, m)
    return taken


def _mentioned(mentions: list[tuple[int, int, int]], size: int, borders: set[int] | None) -> tuple[int, int] | None:
    """(letters around it, entry) of the mention that decides: it covers the value or, given borders, is the longest between them."""
    fit = [m for m in mentions if (m[0] == 0 and m[1] == size) or (borders is not None and m[0] in borders and m[1] in borders)]
    return min(((size - (end - start), entry) for start, end, entry in longest_mentions(fit)), default=None)


@dataclass
class NameList:
    """Canonical names compared by edits: at most ``most`` of them, the fewest win, then list order."""

    names: Sequence[str]
    most: int
    embedded: bool = False
    machine: ahocorasick.Automaton = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.keys = [plain(n) for n in self.names]
        whole: dict[str, int] = {}
        owners: dict[str, list[int]] = {}
        tokens = [token_set(k) if k else frozenset() for k in self.keys]
        for i, k in enumerate(self.keys):
            if k:
                whole.setdefault(k, i)
                for t in tokens[i]:
                    owners.setdefault(t, []).append(i)
        self.owners = {t: np.array(o, np.int64) for t, o in owners.items()}
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.lengths = np.array([len(k) or -(1 << 40) for k in self.keys], np.int64)
        self.machine = ahocorasick.Automaton()
        for k, i in whole.items():
            self.machine.add_word(k, (len(k), i))
        if len(self.machine):
            self.machine.make_automaton()

    def best(self, value: str) -> tuple[int, int] | None:
        """(edits, place in the list) of the closest entry within the bound."""
        v, borders = with_borders(value)
        if not v or not len(self.machine):
            return None
        mentions = [(end - size + 1, end + 1, entry) for end, (size, entry) in self.machine.iter(v)]
        return _mentioned(mentions, len(v), borders if self.embedded else None) or self.similar(v)

    def similar(self, v: str) -> tuple[int, int] | None:
        """By token sets: an entry within the edits lacks two tokens an edit at most."""
        own = token_set(v)
        seen = [o for o in map(self.owners.get, own) if o is not None]
        shared = np.bincount(np.concatenate(seen), minlength=len(self.keys)) if seen else np.zeros(len(self.keys), np.int64)
        near = (self.sizes - shared <= 2 * self.most) & (abs(self.lengths - len(v)) <= self.most)
        places = np.flatnonzero(near)
        likeness = shared[places] / (len(own) + self.sizes[places] - shared[places])
        found = (self.most + 1, -1)  # sorts before any entry beyond the bound
        for i in places[np.lexsort((places, -likeness))].tolist():  # a close entry leaves few edits to the others
            bound = min(found[0], self.most)
            if self.sizes[i] - shared[i] <= 2 * bound:
                found = min(found, (edits(v, self.keys[i], bound), i))
        return found if found[1] >= 0 else None


_WELL = re.compile(r"([A-Za-z]+)0*([0-9]+)\Z")
#: Words that say which part of a plate position follows, or that one follows.
ROW_WORDS = ("row",)
COLUMN_WORDS = ("column", "col")
POSITION_WORDS = ("well", "position", "pos")


@dataclass
class PlateList:
    """Plate positions: the same row letters and column number in whatever layout they are written."""

    names: Sequence[str]
    embedded: bool = False
    machine: ahocorasick.Automaton = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.machine = ahocorasick.Automaton()
        for i, name in enumerate(self.names):
            if not (m := _WELL.match(plain(name))):
                continue
            row, column = m.groups()
            aliases = {f"{row}{column}", f"{column}{row}"}
            for r in ROW_WORDS:
                for c in COLUMN_WORDS:
                    aliases |= {f"{r}{row}{c}{column}", f"{c}{column}{r}{row}"}
                aliases |= {f"{r}{row}{column}", f"{column}{r}{row}"}
            for c in COLUMN_WORDS:
                aliases |= {f"{row}{c}{column}", f"{c}{column}{row}"}
            for alias in sorted(aliases | {f"{p}{a}" for p in POSITION_WORDS for a in aliases}):
                self.machine.add_word(alias, (len(alias), i))
        if len(self.machine):
            self.machine.make_automaton()

    def best(self, value: str) -> tuple[int, int] | None:
        v, borders = with_borders(value)
        if not v or not len(self.machine):
            return None
        for zeros in reversed(list(re.finditer(r"(?<![0-9])0+(?=[0-9])", v))):  # leading zeros count for nothing
            a, b = zeros.span()
            v, borders = v[:a] + v[b:], {x - (b - a) if x >= b else min(x, a) for x in borders}
        mentions = [(end - size + 1, end + 1, entry) for end, (size, entry) in self.machine.iter(v)]
        hit = _mentioned(mentions, len(v), borders if self.embedded else None)
        return hit


def _match(recipe: dict[str, tuple[list[str], int | None, int]], embedded: bool):
    """``recipe``: per kind the names of a block, the edits allowed, and the place of the first name in the whole list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists = {k: PlateList(names, embedded) if most is None else NameList(names, most, embedded) for k, (names, most, _) in recipe.items()}

        @lru_cache(maxsize=100_000)
        def best(kind: str, value: str) -> tuple[int, int, str] | None:
            if kind not in lists or (hit := lists[kind].best(value)) is None:
                return None
            return hit[0], hit[1] + recipe[kind][2], recipe[kind][0][hit[1]]

        for batch in batches:
            before = zip(batch["cost"], batch["place"], batch["canonical"])
            hits = []
            for k, v, old in zip(batch["field"], batch["typed"], before):
                new = best(k, v) if isinstance(k, str) and isinstance(v, str) else None
                if isinstance(old[2], str) and (new is None or (old[0], old[1]) <= new[:2]):
                    new = (int(old[0]), int(old[1]), old[2])
                hits.append(new)
            yield batch.assign(
                cost=pd.array([h[0] if h else None for h in hits], dtype="Int64"),
                place=pd.array([h[1] if h else None for h in hits], dtype="Int64"),
                canonical=pd.Series([h[2] if h else None for h in hits], dtype=object, index=batch.index),
            )

    return run


def _in_blocks(df: DataFrame, column: str, size: int) -> Iterator[list[str]]:
    block: list[str] = []
    for (name,) in df.select(column).toLocalIterator():
        if name is not None:
            block.append(name)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def map_to_canonical(
    entries: DataFrame,
    lists: dict[str, tuple[DataFrame, str, int | None]],
    *,
    entry_id: str = "entry_id",
    kind: str = "field",
    typed: str = "typed",
    block_entries: int = BLOCK_ENTRIES,
    embedded: bool = False,
) -> DataFrame:
    """One row per entry: entry_id, canonical, edits (null where unmatched).

    ``lists``: for each value of ``kind`` the canonical table (in its order),
    its column, and the edits allowed; None for plate positions.
    ``embedded``: a name between word borders decides a value with text
    around it, the longest first, then the leftmost; ``edits`` then counts the
    letters around it.

    One narrow pass over the entries where every list fits one block.  Lists
    of more blocks are read block by block; an entry carries its best hit so
    far from one pass to the next, which is written before the next block is
    read, so the driver and the tasks hold one block at a time.  The number of
    blocks changes nothing in the result.

    Defined results: null or empty values, values without letters or digits,
    unknown kinds and values that fit nothing give 'NA'; of equally close
    entries the first in the list wins; repeated entries give a row each;
    values of any length are compared whole; empty tables give empty results.
    Further columns are not carried.
    """
    source = entries.select(
        F.col(f"`{entry_id}`").alias("entry_id"), F.col(f"`{kind}`").cast("string").alias("field"), F.col(f"`{typed}`").cast("string").alias("typed")
    )
    id_type = source.schema["entry_id"].dataType.simpleString()
    nothing = F.lit(None)
    out = source.select("*", nothing.cast("bigint").alias("cost"), nothing.cast("bigint").alias("place"), nothing.cast("string").alias("canonical"))
    schema = f"entry_id {id_type}, field string, typed string, cost bigint, place bigint, canonical string"
    blocks = zip_longest(*[_in_blocks(df, column, block_entries) for df, column, _ in lists.values()])
    for n, block in enumerate(blocks):
        if n:
            out = checkpointed(out)
        recipe = {
            name: (names, most, n * block_entries) for (name, (_, _, most)), names in zip(lists.items(), block) if names is not None
        }
        out = out.mapInPandas(_match(recipe, embedded), schema)
    return out.select("entry_id", F.coalesce("canonical", F.lit(UNMATCHED)).alias("canonical"), F.col("cost").alias("edits"))
