"""Barcode lookup with a bounded number of edits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "NA"
#: The map travels with the tasks; a plate has at most a few thousand wells.
MAX_BARCODES = 5000
#: Different observed barcodes whose wells a task remembers at once.
MEMORY = 1 << 18


def barcode_map(df: DataFrame, pos: str = "pos", barcode: str = "bc", well: str = "well") -> list[tuple[int, str, str]]:
    """(place, barcode, well) in map order; of a repeated barcode the first place and the last well count."""
    rows = df.select(pos, barcode, well).where(F.col(barcode).isNotNull()).orderBy(pos).limit(MAX_BARCODES + 1).collect()
    if len(rows) > MAX_BARCODES:
        raise ValueError(f"more than {MAX_BARCODES} barcodes")
    place: dict[str, int] = {}
    wells: dict[str, str] = {}
    for n, r in enumerate(rows):
        place.setdefault(r[1], n)
        wells[r[1]] = r[2]
    return [(place[b], b, wells[b]) for b in place]


def _shortened(text: str, most: int) -> Iterator[str]:
    """The text without any ``most`` letters or fewer: texts within ``most`` edits share one of these."""
    for n in range(min(most, len(text)) + 1):
        for gone in combinations(range(len(text)), n):
            yield "".join(c for i, c in enumerate(text) if i not in gone)


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


class BarcodeIndex:
    """Nearest barcode by its shortened forms; each observed barcode is looked for once and remembered."""

    def __init__(self, barcodes: list[tuple[int, str, str]], distance: int) -> None:
        self.distance = distance
        self.known: dict[str, str | None] = {b: w for _, b, w in barcodes}
        self.exact = dict(self.known)
        self.forms: dict[str, list[tuple[int, str, str]]] = {}
        for entry in barcodes:
            for form in set(_shortened(entry[1], distance)):
                self.forms.setdefault(form, []).append(entry)

    def well(self, observed: str) -> str | None:
        near = {e for form in set(_shortened(observed, self.distance)) for e in self.forms.get(form, ())}
        found = ((_edits(observed, b), p, w) for p, b, w in near)
        return min((f for f in found if f[0] <= self.distance), key=lambda f: f[:2], default=(0, 0, UNDETERMINED))[2]

    def wells(self, observed: pd.Series) -> pd.Series:
        known = self.known
        if len(known) > MEMORY:
            known = self.known = dict(self.exact)
        for o in observed.unique():
            if o is not None and o not in known:
                known[o] = self.well(o)
        return observed.map(known).astype(object)


def nearest_well(observed: Column, barcodes: list[tuple[int, str, str]], distance: int = 1) -> Column:
    """Well of the nearest barcode within ``distance`` edits, the first in map order on ties; else 'NA'.

    Only the observed letters leave the JVM, in Arrow batches; the work is done once per different value and task.
    """
    if not barcodes:
        return F.lit(UNDETERMINED)
    index: list[BarcodeIndex] = []  # made in the worker

    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not index:
            index.append(BarcodeIndex(barcodes, distance))
        for batch in batches:
            yield index[0].wells(batch)

    return F.coalesce(F.pandas_udf(look_up, "string")(observed), F.lit(UNDETERMINED))


def demultiplex(df: DataFrame, barcodes: list[tuple[int, str, str]], distance: int = 1, name: str = "well") -> DataFrame:
    """Adds the well of the barcode at the end of each accession; a narrow pass."""
    length = min((len(b) for _, b, _ in barcodes), default=0)
    observed = F.right(F.coalesce("acc", F.lit("")), F.lit(length))
    return df.withColumn(name, nearest_well(observed, barcodes, distance))
