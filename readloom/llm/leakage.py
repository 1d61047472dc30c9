"""Evaluation passages inside corpus documents: one automaton, one scan of each text.

Texts are normalised to words (maximal runs of letters or digits, lower-cased).
Every distinct word of the evaluation items gets a code of its own, so a text
becomes a string with one code per word, and a word that no item has becomes
one common filler.  The patterns are all windows of ``words`` consecutive words
of the items; a single Aho-Corasick automaton over them reads each document
once.  Positions in the coded string index the word offsets, which lead back to
the original text.

A code is one character, or two from separate alphabets where the items have
more words than there are characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import checkpointed

WORDS = 13
#: Word windows per automaton, about 200 MB; further items are scanned in further blocks, each against all documents.
BLOCK_WINDOWS = 250_000
_WORD = regex.compile(r"[\p{L}\p{Nd}]+")
_FILL = chr(0x10FFFF)


#: Characters that stand for words: all but the surrogates and the filler.
CODES = 0x10FFFF - 0x800 - 1


def _code(n: int) -> str:
    """The n-th usable code point: surrogates are left out."""
    return chr(n + 1 if n + 1 < 0xD800 else n + 1 + 0x800)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class PassageIndex:
    """The automaton over all word windows of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]], words: int = WORDS) -> None:
        self.words = words
        texts = [(item_id, words_of(text or "")) for item_id, text in items]
        numbers: dict[str, int] = {}
        for _, own in texts:
            for w in own:
                numbers.setdefault(w, len(numbers))
        if len(numbers) <= CODES:
            self.width, self.codes, self.fill = 1, {w: _code(n) for w, n in numbers.items()}, _FILL
        else:
            half = CODES // 2
            self.width, self.fill = 2, _FILL * 2
            self.codes = {w: _code(n // half) + _code(half + n % half) for w, n in numbers.items()}
        owners: dict[str, set[int]] = {}
        step, size = self.width, words * self.width
        for item_id, own in texts:
            coded = "".join([self.codes[w] for w in own])
            for i in range(0, len(coded) - size + 1, step):
                owners.setdefault(coded[i : i + size], set()).add(item_id)
        self.machine = ahocorasick.Automaton()
        for window, ids in owners.items():
            self.machine.add_word(window, tuple(sorted(ids)))
        self.empty = not owners
        if owners:
            self.machine.make_automaton()

    def hits(self, text: str) -> dict[int, list[list[int]]]:
        """item -> passages as [first word, last word, windows]: runs of shared windows that overlap or adjoin."""
        found: dict[int, list[list[int]]] = {}
        if self.empty:
            return found
        codes, fill = self.codes, self.fill
        coded = "".join([codes.get(w, fill) for w in words_of(text)])
        for at, ids in self.machine.iter(coded):
            end = at // self.width
            start = end - self.words + 1
            for i in ids:
                runs = found.setdefault(i, [])
                if runs and start <= runs[-1][1] + 1:
                    runs[-1][1] = end
                    runs[-1][2] += 1
                else:
                    runs.append([start, end, 1])
        return found

    def spans(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, passage number from 1, start, end, windows), as offsets in the original text."""
        found = self.hits(text)
        if not found:
            return []
        at = [m.span() for m in _WORD.finditer(text)]
        return [(i, n, at[a][0], at[b][1], windows) for i, runs in found.items() for n, (a, b, windows) in enumerate(runs, 1)]


def _scan(items: list[tuple[int, str | None]], words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = PassageIndex(items, words)
        for batch in batches:
            rows = [
                (doc, *span)
                for doc, text in zip(batch["doc"].tolist(), batch["text"])
                if isinstance(text, str)
                for span in index.spans(text)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "passage", "start_pos", "end_pos", "windows"]).astype("int64")

    return run


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    words: int = WORDS,
    block_windows: int = BLOCK_WINDOWS,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document, item and passage of at least ``words`` consecutive words in common.

    Columns doc_id, item_id, passage (from 1 per document and item), start_pos
    and end_pos (from the first to the last word of the passage, in characters
    of the original), windows (shared word windows in it).  The scan is narrow:
    documents are neither shuffled nor joined.  Items are read in blocks of
    about ``block_windows`` word windows, each block is one automaton; with
    more than one, the rows of a block are written before the next is read, so
    the driver and the tasks hold one block at a time.

    Defined results: null and empty texts share nothing; items or documents
    with fewer than ``words`` words share nothing; repeated items are reported
    each, repeated documents too; tables without rows give an empty result.
    """
    source = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text"))
    wanted = items.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t is not null")
    schema = "doc_id bigint, item_id bigint, passage bigint, start_pos bigint, end_pos bigint, windows bigint"
    out = None
    for block in _blocks(wanted, words, block_windows):
        found = source.mapInPandas(_scan(block, words), schema)
        out = found if out is None else checkpointed(out).unionByName(found)
    return source.mapInPandas(_scan([], words), schema) if out is None else out


def _blocks(items: DataFrame, words: int, most: int) -> Iterator[list[tuple[int, str]]]:
    """Items with any window, in blocks that end when they have ``most`` windows."""
    block, windows = [], 0
    for row in items.toLocalIterator():
        own = len(_WORD.findall(row.t)) - words + 1
        if own > 0:
            block.append((row.i, row.t))
            windows += own
            if windows >= most:
                yield block
                block, windows = [], 0
    if block:
        yield block
