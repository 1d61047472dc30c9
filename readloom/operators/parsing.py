"""Raw tab-separated records: valid ones typed, failing ones kept apart with the reason.

Each record is assembled quote-aware, parsed by Python's strict ``csv``
reader inside ``mapInPandas``; structural exceptions are captured before the
typed field checks run.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

csv.field_size_limit(sys.maxsize)

FIELDS = ("acc", "seq", "sep", "qual")
_SEQ = re.compile(r"[ACGTNacgtn]+\Z")
_QUAL = re.compile(r"[!-~]*\Z")


def _stand_ins(line: str) -> list[str]:
    """Two characters that the record does not hold.

    csv treats line ends outside quotes as the end of a record; here a record is one cell, so they are data, and
    go through the reader under other names.
    """
    used = set(line)
    return list(islice((c for c in map(chr, range(0xE000, sys.maxunicode)) if c not in used), 2))


class BadRecord(ValueError):
    """A record that does not parse; its message is the reason."""


def _assemble(line: str) -> None:
    """Walks the record field by field; a quote inside an unquoted field or an open span is an error."""
    at, end = 0, len(line)
    while at <= end:
        if line.startswith('"', at):
            at += 1
            while True:
                at = line.find('"', at)
                if at < 0:
                    raise BadRecord("quoting")
                if not line.startswith('""', at):
                    break
                at += 2
            at += 1
            if at < end and line[at] != "\t":
                raise BadRecord("quoting")
        else:
            stop = line.find("\t", at)
            stop = end if stop < 0 else stop
            if line.find('"', at, stop) >= 0:
                raise BadRecord("quoting")
            at = stop
        at += 1


def parse_record(line: str | None, dialect: str | None) -> list[str]:
    """The four fields of a record, or BadRecord with the first reason that applies."""
    if line is None:
        raise BadRecord("columns")
    quoted = dialect == "quoted"
    if quoted and '"' in line:
        _assemble(line)
    stand_ins = _stand_ins(line) if "\n" in line or "\r" in line else None
    text = line.replace("\n", stand_ins[0]).replace("\r", stand_ins[1]) if stand_ins else line
    try:
        rows = list(
            csv.reader(
                [text],
                delimiter="\t",
                quotechar='"' if quoted else None,
                quoting=csv.QUOTE_MINIMAL if quoted else csv.QUOTE_NONE,
                doublequote=True,
                strict=True,
            )
        )
    except csv.Error:
        raise BadRecord("quoting" if quoted else "columns") from None
    fields = rows[0] if rows else []
    if stand_ins:
        fields = [f.replace(stand_ins[0], "\n").replace(stand_ins[1], "\r") for f in fields]
    if len(fields) != len(FIELDS):
        raise BadRecord("columns")
    if not _SEQ.match(fields[1]):
        raise BadRecord("seq")
    if len(fields[3]) != len(fields[1]) or not _QUAL.match(fields[3]):
        raise BadRecord("qual")
    return fields


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = {"line_id": batch["line_id"], "reason": [], **{f: [] for f in FIELDS}}
        for line, dialect in zip(batch["line"], batch["dialect"]):
            try:
                fields, reason = parse_record(line, dialect), None
            except BadRecord as bad:
                fields, reason = [None] * len(FIELDS), str(bad)
            out["reason"].append(reason)
            for name, value in zip(FIELDS, fields):
                out[name].append(value)
        yield pd.DataFrame(out).astype({"reason": object, **{f: object for f in FIELDS}})


def parse_records(df: DataFrame, line_id: str = "line_id", line: str = "line", dialect: str = "dialect") -> DataFrame:
    """Every record with either its four fields or the reason it fails; one narrow pass, no shuffle.

    Defined results: a null line fails with 'columns', like an empty one; a
    null or unknown dialect counts as 'plain'; line ends inside a record are
    data; records of any length are parsed whole; repeated lines give a row
    each; an empty table gives none.  Further columns are not carried.
    """
    source = df.select(
        F.col(f"`{line_id}`").alias("line_id"),
        F.col(f"`{line}`").alias("line"),
        F.col(f"`{dialect}`").alias("dialect"),
    )
    kind = source.schema["line_id"].dataType.simpleString()
    return source.mapInPandas(_parse_batches, f"line_id {kind}, reason string, " + ", ".join(f"{f} string" for f in FIELDS))


def failed_records(df: DataFrame, **columns: str) -> DataFrame:
    return parse_records(df, **columns).where(F.col("reason").isNotNull()).select("line_id", "reason")


def valid_records(df: DataFrame, **columns: str) -> DataFrame:
    return parse_records(df, **columns).where(F.col("reason").isNull()).drop("reason")
