"""Queries of the training-data problems; their SQL is in ``sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.canonical import map_to_canonical
from readloom.llm.heavy import frequent_values
from readloom.llm.leakage import find_leaks
from readloom.llm.neardup import similar_groups, similar_pairs
from readloom.llm.packing import container_fill, pack_texts, packing_bound
from readloom.llm.privacy import find_personal, redact_personal
from readloom.llm.sql import SQL  # noqa: F401
from readloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similar_pairs(table(spark, d, "contigs"), "contig_id", "seq", threshold=0.5)
    return pairs.selectExpr("left_id as contig_a", "right_id as contig_b")


def p1_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Every substring counts as often as it occurs."""
    pairs = similar_pairs(table(spark, d, "contigs"), "contig_id", "seq", threshold=0.5, weighted=True)
    return pairs.selectExpr("left_id as contig_a", "right_id as contig_b")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return similar_groups(table(spark, d, "contigs"), "contig_id", "seq", threshold=0.5)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent_values(table(spark, d, "reads"), "seq", 0.002).select("seq")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequent_values(table(spark, d, "reads"), "seq", 0.002).select("seq", "exact_rows")


def _typed(spark: SparkSession, d: str, embedded: bool = False) -> DataFrame:
    barcodes = table(spark, d, "barcode_map").orderBy("pos")
    lists = {
        "bc": (barcodes, "bc", 1),
        "well": (barcodes, "well", None),
        "acc": (table(spark, d, "fasta_index").orderBy("acc"), "acc", 2),
    }
    return map_to_canonical(table(spark, d, "typed_entries"), lists, embedded=embedded)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).select("entry_id", "canonical")


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).where("canonical = 'NA'").select("entry_id")


def p6_embedded(spark: SparkSession, d: str) -> DataFrame:
    """Names with other words around them count, too."""
    return _typed(spark, d, embedded=True).select("entry_id", "canonical")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return container_fill(pack_texts(table(spark, d, "documents")))


def p8_bound(spark: SparkSession, d: str) -> DataFrame:
    return packing_bound(pack_texts(table(spark, d, "documents")))


def p8_covered(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each text that are in containers: all of them."""
    packed = pack_texts(table(spark, d, "documents"))
    return packed.groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("chars"), F.max("end_pos").alias("last"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """A document and an item once, by their first passage."""
    return p9_leaks(spark, d).where("passage = 1").select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_windows(spark: SparkSession, d: str) -> DataFrame:
    """Passages and shared word windows of each document and item."""
    return p9_leaks(spark, d).groupBy("doc_id", "item_id").agg(F.count("*").alias("passages"), F.sum("windows").alias("windows"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_personal(table(spark, d, "documents"), table(spark, d, "known_names"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact_personal(table(spark, d, "documents"), table(spark, d, "known_names"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found,
        p1_weighted,
        p1_groups,
        p5_found,
        p5_counts,
        p6_found,
        p6_unmatched,
        p6_embedded,
        p8_packed,
        p8_containers,
        p8_bound,
        p8_covered,
        p9_found,
        p9_leaks,
        p9_windows,
        p10_found,
        p10_redacted,
    )
}
