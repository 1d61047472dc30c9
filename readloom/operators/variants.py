"""Variants of a table of known polymorphisms, in the form that a graph aligner takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.columns import reverse_complement


def aligner_variants(snps: DataFrame) -> DataFrame:
    """id, type (single, deletion, insertion), chrom, start_pos (0-based), value: a row per alternative allele.

    ``snps``: chrom, start_pos, end_pos (0-based half-open), name, strand, reference, observed (alleles with slashes
    between), class.  The value is the base, the deleted length, or the inserted bases, on the forward strand.
    Alternatives of one name are told apart by .1, .2 and so on where there are several.

    Defined results: other classes, extents that do not fit the class, and alleles with letters other than ACGT give
    no row; the reference allele is no alternative; repeated alleles count once.
    """
    alleles = F.transform(F.split(F.upper("observed"), "/"), lambda a: F.when(F.col("strand") == "-", reverse_complement(a)).otherwise(a))
    plain = F.array_distinct(F.filter(alleles, lambda a: a.rlike("^[ACGT]+$")))
    width = F.col("end_pos") - F.col("start_pos")
    none = F.array().cast("array<string>")
    values = (
        F.when((F.col("class") == "single") & (width == 1), F.filter(plain, lambda a: (F.length(a) == 1) & (a != F.coalesce(F.upper("reference"), F.lit("")))))
        .when((F.col("class") == "deletion") & (width > 0) & F.array_contains(alleles, "-"), F.array(width.cast("string")))
        .when((F.col("class") == "insertion") & (width == 0), plain)
        .otherwise(none)
    )
    rows = snps.select("name", F.col("class").alias("type"), "chrom", "start_pos", values.alias("values"))
    rows = rows.select("*", F.posexplode("values").alias("n", "value"))
    several = F.size("values") > 1
    number = F.concat_ws(".", "name", (F.col("n") + 1).cast("string"))
    return rows.select(F.when(several, number).otherwise(F.col("name")).alias("id"), "type", "chrom", F.col("start_pos").cast("bigint").alias("start_pos"), "value")


def own_haplotypes(variants: DataFrame) -> DataFrame:
    """id, chrom, left_pos, right_pos (closed), variants: each variant by itself, as nothing is known of their phase."""
    length = F.when(F.col("type") == "deletion", F.col("value").try_cast("bigint")).otherwise(F.lit(1).cast("bigint"))
    return variants.select(
        F.concat(F.lit("ht_"), "id").alias("id"), "chrom", F.col("start_pos").alias("left_pos"), (F.col("start_pos") + length - 1).alias("right_pos"), F.col("id").alias("variants")
    )
