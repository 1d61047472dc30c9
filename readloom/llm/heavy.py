"""Most frequent values of a column with very many distinct ones, in bounded memory.

Code-based identification.  The 64-bit hash of a value picks one of G groups
and a message of K symbols of four bits; a systematic Reed-Solomon code over
GF(16) adds R check symbols.  For every group, position and symbol one counter
is kept: G * (K + R) * 16 counters, whatever the number of distinct values.

A value with at least ``least`` rows leaves a counter of at least ``least`` at
every position of its group, since counters only add up.  So all its symbols
are among the heavy symbols of its group, and decoding the heavy symbols of
each position (keeping only true code words) finds every frequent value: no
false negatives.  False candidates, which the check symbols make rare, fall
away when the candidates are counted exactly.

With G >= 1 / share, at most ``(K + R) / share`` counters are heavy, which
bounds what the driver sees and what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = 6  # symbols of four bits
CHECKS = 3
LENGTH = MESSAGE + CHECKS
#: Counters that a task keeps in one table; with more, each batch of rows sends its own.
DENSE = 1 << 22


def _gf16() -> tuple[np.ndarray, np.ndarray]:
    """Exponent and logarithm tables of GF(16) with x^4 + x + 1."""
    exp, log, x = np.zeros(30, np.int64), np.zeros(16, np.int64), 1
    for i in range(15):
        exp[i] = exp[i + 15] = x
        log[x] = i
        x = (x << 1) ^ (0x13 if x & 8 else 0)
    return exp, log


_EXP, _LOG = _gf16()


def _times(a: int, b: int) -> int:
    return int(_EXP[_LOG[a] + _LOG[b]]) if a and b else 0


def _generator() -> list[int]:
    """Coefficients, highest first, of the product of (x - a^i) for i = 1..CHECKS."""
    g = [1]
    for i in range(1, CHECKS + 1):
        root = int(_EXP[i])
        g = [a ^ _times(b, root) for a, b in zip([*g, 0], [0, *g])]
    return g


def _check_of(message: list[int]) -> list[int]:
    rest = [*message, *[0] * CHECKS]
    g = _generator()
    for i in range(MESSAGE):
        lead = rest[i]
        for j, c in enumerate(g):
            rest[i + j] ^= _times(lead, c)
    return rest[MESSAGE:]


def _unit_checks() -> np.ndarray:
    """Check symbols of each symbol value at each message position; the code is linear."""
    out = np.zeros((MESSAGE, 16, CHECKS), np.int64)
    for p in range(MESSAGE):
        for s in range(16):
            message = [0] * MESSAGE
            message[p] = s
            out[p, s] = _check_of(message)
    return out


_UNITS = _unit_checks()


def encode(message: np.ndarray) -> np.ndarray:
    """Code words, one row of LENGTH symbols per 24-bit message."""
    out = np.empty((len(message), LENGTH), np.int64)
    checks = np.zeros((len(message), CHECKS), np.int64)
    for p in range(MESSAGE):
        symbol = (message >> (4 * p)) & 15
        out[:, p] = symbol
        checks ^= _UNITS[p, symbol]
    out[:, MESSAGE:] = checks
    return out


def decode(heavy: list[np.ndarray]) -> np.ndarray:
    """All messages whose code words take each symbol from the heavy ones of its position."""
    if any(len(h) == 0 for h in heavy):
        return np.zeros(0, np.int64)
    messages, checks = np.zeros(1, np.int64), np.zeros((1, CHECKS), np.int64)
    for p in range(MESSAGE):
        symbols = heavy[p].astype(np.int64)
        messages = (messages[:, None] | (symbols << (4 * p))[None, :]).ravel()
        checks = (checks[:, None, :] ^ _UNITS[p, symbols][None, :, :]).reshape(-1, CHECKS)
    keep = np.ones(len(messages), bool)
    for r in range(CHECKS):
        keep &= np.isin(checks[:, r], heavy[MESSAGE + r])
    return messages[keep]


def groups_for(share: float | str) -> int:
    """The least power of two that is at least 1 / share, and 16."""
    groups = 16
    while groups * Fraction(str(share)) < 1:
        groups *= 2
    return groups


def _least(share: float | str, total: int) -> int:
    exact = Fraction(str(share)) * total
    return max(1, -(-exact.numerator // exact.denominator))


def _message(h: Column) -> Column:
    return h.bitwiseAND((1 << (4 * MESSAGE)) - 1)


def _group(h: Column, groups: int) -> Column:
    return F.shiftrightunsigned(h, 4 * MESSAGE).bitwiseAND(groups - 1)


def _counters(groups: int):
    size = groups * LENGTH * 16

    def emit(cells: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(n.astype(np.int64))], names=["cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size if size <= DENSE else 0, np.int64)
        base = np.arange(LENGTH, dtype=np.int64) * 16
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = encode(h & ((1 << (4 * MESSAGE)) - 1))
            group = (h >> (4 * MESSAGE)) & (groups - 1)
            cells = ((group * (LENGTH * 16))[:, None] + base[None, :] + words).ravel()
            if size > DENSE:
                yield emit(*np.unique(cells, return_counts=True))
            else:
                counts += np.bincount(cells, minlength=size)
        used = np.flatnonzero(counts)
        yield emit(used, counts[used])

    return run


def symbol_counts(df: DataFrame, column: str, share: float | str) -> DataFrame:
    """The counters that are not zero: cell, n.  Eight bytes per row reach Python, one table per task leaves it."""
    hashed = df.where(F.col(f"`{column}`").isNotNull()).select(F.xxhash64(F.col(f"`{column}`")).alias("h"))
    counters = hashed.mapInArrow(_counters(groups_for(share)), "cell bigint, n bigint")
    return counters.groupBy("cell").agg(F.sum("n").alias("n"))


def candidates(df: DataFrame, column: str, share: float | str, least: int) -> list[tuple[int, int, int]]:
    """(group, message, upper bound of the count) of every value that may have ``least`` rows."""
    heavy = symbol_counts(df, column, share).where(F.col("n") >= least).collect()  # at most LENGTH / share rows
    by_group: dict[int, list[dict[int, int]]] = {}
    for cell, n in heavy:
        group, rest = divmod(cell, LENGTH * 16)
        position, symbol = divmod(rest, 16)
        by_group.setdefault(group, [{} for _ in range(LENGTH)])[position][symbol] = n
    out = []
    for group, positions in sorted(by_group.items()):
        messages = decode([np.array(sorted(p), np.int64) for p in positions])
        for message, word in zip(messages.tolist(), encode(messages).tolist()):
            out.append((group, message, min(positions[p][s] for p, s in enumerate(word))))
    return out


def frequent_values(df: DataFrame, column: str, share: float | str = 0.002) -> DataFrame:
    """Values making up at least ``share`` of all rows: ``column``, approx_rows, exact_rows.

    ``approx_rows`` is the smallest counter of the value's code word: never
    below the true count.  ``exact_rows`` is from the second pass, over the
    rows whose group and message are candidates.

    Defined results: null is no value, but its rows count in the total; values
    are compared exactly as written, an empty string or a very long one like
    any other; an empty table gives an empty result.  Only ``column`` is read.
    """
    spark = df.sparkSession
    total = df.count()
    least = _least(share, total)
    found = candidates(df, column, share, least) if total else []
    kind = df.schema[column].dataType
    schema = T.StructType(
        [
            T.StructField("g", T.LongType()),
            T.StructField("m", T.LongType()),
            T.StructField("approx_rows", T.LongType()),
        ]
    )
    if not found:
        none = T.StructType(
            [T.StructField(column, kind), T.StructField("approx_rows", T.LongType()), T.StructField("exact_rows", T.LongType())]
        )
        return spark.createDataFrame([], none)
    # One candidate per true frequent value, and the few false ones that pass all check symbols.
    small = spark.createDataFrame(found, schema)
    groups = groups_for(share)
    values = df.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").alias("v"))
    h = F.xxhash64("v")
    counted = (
        values.withColumn("g", _group(h, groups))
        .withColumn("m", _message(h))
        .join(F.broadcast(small), ["g", "m"])
        .groupBy("v", "approx_rows")
        .agg(F.count("*").alias("exact_rows"))
    )
    return counted.where(F.col("exact_rows") >= least).select(F.col("v").alias(column), "approx_rows", "exact_rows")
