"""Joins and merges of half-open intervals: (chrom, start_pos, end_pos, name, score, strand).

Range predicates become equi-joins on bins whose size follows the data: every
interval belongs to the level of bins that are as long as itself or longer, up
to four times, so it touches two of them at most, and is also listed on those
higher levels on which the other side has intervals.  A pair meets on the level
of the longer one, in the bin where the later of the two begins, so it comes
out once.  Which levels there are is counted before the join: a handful of
numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from readloom.operators.periods import merge_periods

#: Bases in a bin of the lowest level; those of the next one are four times as long.
BIN = 64
_NO_END = (1 << 62) - 1


def _level(start: Column, end: Column, bin_size: int, bits: int = 2) -> Column:
    """The bins of a level are ``2 ** bits`` times as long as those of the one below."""
    return F.greatest(F.lit(0), F.ceil(F.log2((end - start) / bin_size) / bits)).cast("int")


def _bin(position: Column, level: Column, bin_size: int, bits: int = 2) -> Column:
    return F.floor(position / F.call_function("shiftleft", F.lit(bin_size).cast("bigint"), level * bits))


def _levels(bin_size: int, bits: int = 2, **sides: DataFrame) -> dict[str, list[int]]:
    """Levels on which each side has intervals."""
    rows = None
    for name, df in sides.items():
        own = df.select(F.lit(name).alias("side"), _level(F.col("start_pos"), F.col("end_pos"), bin_size, bits).alias("level"))
        rows = own if rows is None else rows.unionByName(own)
    found: dict[str, list[int]] = {name: [] for name in sides}
    for r in rows.distinct().collect():
        found[r.side].append(r.level)
    return found


def _listed(df: DataFrame, start: str, end: str, level: str, others: Sequence[int], name: str, bin_size: int, bits: int = 2) -> DataFrame:
    """A row per level and bin: on the own level, and on the higher ones of ``others``."""
    higher = F.filter(F.array(*[F.lit(k) for k in others]).cast("array<int>"), lambda k: k > F.col(level))
    rows = df.withColumn(f"{name}_on", F.explode(F.concat(F.array(level), higher)))
    on = F.col(f"{name}_on")
    return rows.withColumn(
        f"{name}_bin", F.explode(F.sequence(_bin(F.col(start), on, bin_size, bits), _bin(F.col(end) - 1, on, bin_size, bits)))
    )


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}_{c}") for c in df.columns])


def overlap_pairs(a: DataFrame, b: DataFrame, stranded: bool = True, bin_size: int = BIN) -> DataFrame:
    """All overlapping pairs; columns of ``a`` get the prefix a_, those of ``b`` b_.

    Null positions, chromosomes or strands overlap nothing, nor do intervals without a base.
    """
    on = ["chrom", "strand"] if stranded else ["chrom"]
    a, b = a.where("start_pos < end_pos"), b.where("start_pos < end_pos")
    levels = _levels(bin_size, a=a, b=b)
    sides = []
    for p, df, others in (("a", a, levels["b"]), ("b", b, levels["a"])):
        side = _prefixed(df, p)
        side = side.withColumn(f"{p}__level", _level(F.col(f"{p}_start_pos"), F.col(f"{p}_end_pos"), bin_size))
        sides.append(_listed(side, f"{p}_start_pos", f"{p}_end_pos", f"{p}__level", others, f"{p}_", bin_size))
    left, right = sides
    cond = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in (*on, "_on", "_bin")]
    joined = left.join(right, cond).where(
        (F.col("a_start_pos") < F.col("b_end_pos"))
        & (F.col("b_start_pos") < F.col("a_end_pos"))
        & ((F.col("a__level") == F.col("a__on")) | (F.col("b__level") == F.col("a__on")))
        & (F.col("a__bin") == _bin(F.greatest("a_start_pos", "b_start_pos"), F.col("a__on"), bin_size))
    )
    return joined.drop(*[f"{p}_{c}" for p in "ab" for c in ("_level", "_on", "_bin")])


def overlap_any(a: DataFrame, b: DataFrame, stranded: bool = True, bin_size: int = BIN, by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``a`` that overlap any of ``b``, each as often as it is in ``a``; further columns ``by`` must agree, too.

    The united stretches of ``b``, the gaps between them and the open space behind the last divide the axis, so the
    last base of a row lies in one of these at most: rows need no numbers and no de-duplication.  A row that ends in
    a gap overlaps if it begins before the gap.  A bin meets a few of these disjoint pieces only, whatever their number.
    """
    on = [*by, "chrom", "strand"] if stranded else [*by, "chrom"]
    known = b.where(" and ".join(f"{c} is not null" for c in on))
    pieces = _united(known, on, gaps=True)
    last = pieces.where("_piece = 'merged'").groupBy(*on).agg(F.max("end_pos").alias("start_pos"))
    pieces = pieces.unionByName(last.select(*on, F.lit("gap").alias("_piece"), "start_pos", F.lit(_NO_END).alias("end_pos")))
    # the pieces are disjoint, so even bins 16 times as long meet few of them, and rows are listed on half the levels
    levels = _levels(bin_size, 4, b=pieces)["b"]
    pieces = pieces.select(
        *[F.col(c).alias(f"b_{c}") for c in (*on, "_piece", "start_pos", "end_pos")],
        _level(F.col("start_pos"), F.col("end_pos"), bin_size, 4).alias("b_level"),
    )
    pieces = _listed(pieces, "b_start_pos", "b_end_pos", "b_level", [], "b", bin_size, 4)
    at = F.col("end_pos") - 1
    rows = a.where("start_pos < end_pos").withColumn("_on", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    rows = rows.withColumn("_bin", _bin(at, F.col("_on"), bin_size, 4))
    cond = [F.col(c) == F.col(f"b_{c}") for c in on] + [F.col("_on") == F.col("b_on"), F.col("_bin") == F.col("b_bin")]
    cond += [F.col("b_start_pos") <= at, at < F.col("b_end_pos"), (F.col("b__piece") == "merged") | (F.col("start_pos") < F.col("b_start_pos"))]
    return rows.join(pieces, cond, "left_semi").drop("_on", "_bin")


def _united(df: DataFrame, by: Sequence[str], gaps: bool = False) -> DataFrame:
    """Columns of ``by``, _piece (merged or gap), start_pos, end_pos: united stretches and, if asked for, the gaps between them."""
    kinds = StructType([df.schema[c] for c in by])
    rows = df.select(
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in by])).alias("e") if by else F.lit("{}").alias("e"),
        F.col("start_pos").cast("bigint").alias("l"),
        (F.col("end_pos") - 1).cast("bigint").alias("r"),
    )
    out = merge_periods(rows, "e", "l", "r")
    if not gaps:
        out = out.where("kind = 'merged'")
    out = out.withColumn("e", F.from_json("e", kinds)) if by else out
    return out.select(
        *[F.col("e")[c].alias(c) for c in by], F.col("kind").alias("_piece"), F.col("left_pos").alias("start_pos"), (F.col("right_pos") + 1).alias("end_pos")
    )


def merge_intervals(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Union of overlapping or touching half-open intervals within ``by``; one key may have any share of the rows.

    Intervals with a null end or without a base are left out; nulls in ``by`` are one key.
    """
    return _united(df, by).drop("_piece")


def gap_distances(a: DataFrame, b: DataFrame, minimum: int = -10_000, maximum: int = 2_500, bin_size: int | None = None) -> DataFrame:
    """name1, name2, dist from the 5' end of ``a`` to the 3' end of ``b`` with minimum <= dist < maximum.

    For + rows of ``a`` dist = end of b - start of a + 1, otherwise end of a - start of b + 1; the strand of
    ``b`` does not count.
    """
    size = bin_size or max(64, maximum - minimum)
    plus = F.coalesce(F.col("strand") == "+", F.lit(False))
    probe = a.select(
        F.col("chrom").alias("chrom1"),
        F.col("name").alias("name1"),
        plus.alias("plus"),
        F.when(plus, F.col("start_pos") - 1).otherwise(F.col("end_pos") + 1).alias("at"),
    )
    # dist = target - at (plus), at - target (otherwise)
    low = F.when(F.col("plus"), F.col("at") + minimum).otherwise(F.col("at") - maximum + 1)
    probe = probe.withColumn("bin", F.explode(F.sequence(F.floor(low / size), F.floor((low + (maximum - minimum) - 1) / size))))
    target = b.select("chrom", F.col("name").alias("name2"), F.explode(F.array(F.struct(F.lit(True).alias("p"), F.col("end_pos").alias("t")), F.struct(F.lit(False).alias("p"), F.col("start_pos").alias("t")))).alias("x"))
    target = target.select("chrom", "name2", F.col("x.p").alias("p"), F.col("x.t").alias("t"), F.floor(F.col("x.t") / size).alias("tbin"))
    dist = F.when(F.col("plus"), F.col("t") - F.col("at")).otherwise(F.col("at") - F.col("t"))
    joined = probe.join(
        target, (F.col("chrom1") == F.col("chrom")) & (F.col("plus") == F.col("p")) & (F.col("bin") == F.col("tbin"))
    )
    return joined.select("name1", "name2", dist.alias("dist")).where((F.col("dist") >= minimum) & (F.col("dist") < maximum))
