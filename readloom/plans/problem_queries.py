"""Queries and SQL of the general data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.packed import split_packed
from readloom.operators.parsing import failed_records, valid_records
from readloom.operators.periods import merge_periods
from readloom.operators.skew import Agg, heavy_keys, tree_aggregate
from readloom.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        heavy_keys(table(spark, d, name), key, 0.05).select(F.lit(name).alias("table_name"), "key_value")
        for name, key in (("reads", "well"), ("region_hits", "id"))
    ]
    return parts[0].unionByName(parts[1])


def p2_per_well(spark: SparkSession, d: str) -> DataFrame:
    reads = table(spark, d, "reads").select(
        "well", F.length("seq").cast("bigint").alias("len"), "run_at", "loaded_at", "base", "seq"
    )
    return tree_aggregate(
        reads,
        ["well"],
        [
            Agg("rows", "count"),
            Agg("seqs", "count", "seq"),
            Agg("bases", "sum", "len"),
            Agg("shortest", "min", "len"),
            Agg("longest", "max", "len"),
            Agg("first_run", "min", "run_at"),
            Agg("last_load", "max", "loaded_at"),
        ],
    )


def p2_per_region(spark: SparkSession, d: str) -> DataFrame:
    return tree_aggregate(
        table(spark, d, "region_hits"),
        ["id"],
        [Agg("hits", "count"), Agg("score_sum", "sum", "score"), Agg("score_max", "max", "score")],
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "samples"), "fivep_beds", ["sample_id"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    exons = table(spark, d, "annotations").where("feature = 'exon'")
    return merge_periods(exons, "acc", "left_pos", "right_pos")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return failed_records(table(spark, d, "raw_reads"))


def p7_valid(spark: SparkSession, d: str) -> DataFrame:
    return valid_records(table(spark, d, "raw_reads"))


QUERIES = {
    f.__name__: f for f in (p2_found, p2_per_well, p2_per_region, p3_found, p4_found, p7_found, p7_valid)
}

_QUOTED = r"""("(?:[^"]|"")*"|'(?:[^'']|'''')*')""".replace("[^'']", "[^'']")
_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t]*)'

_RAW = rf"""
with raw as (select line_id, coalesce(dialect, 'plain') as dialect, coalesce(line, '') as line from raw_reads),
structure as (
  select *, dialect <> 'quoted' or regexp_full_match(line, '{_FIELD}(?:\t{_FIELD})*', 's') as sound from raw),
cut as (
  select *, case when dialect = 'quoted' and sound
    then list_transform(regexp_extract_all(chr(9) || line, '\t({_FIELD})', 1, 's'),
                        lambda f: case when starts_with(f, '"') then replace(f[2:-2], '""', '"') else f end)
    else string_split(line, chr(9)) end as fields from structure),
judged as (
  select *, case when not sound then 'quoting'
    when len(fields) <> 4 then 'columns'
    when not regexp_full_match(fields[2], '[ACGTNacgtn]+') then 'seq'
    when not regexp_full_match(fields[4], '[!-~]*') or length(fields[4]) <> length(fields[2]) then 'qual' end as reason
  from cut)
"""

SQL = {
    "p2_found": """
        select 'reads' as table_name, well as key_value from reads where well is not null
        group by well having count(*) * 20 >= (select count(*) from reads)
        union all
        select 'region_hits', id from region_hits where id is not null
        group by id having count(*) * 20 >= (select count(*) from region_hits)""",
    "p2_per_well": """
        select well, count(*) as rows, count(seq) as seqs, cast(sum(length(seq)) as bigint) as bases,
               min(length(seq)) as shortest, max(length(seq)) as longest,
               min(run_at) as first_run, max(loaded_at) as last_load from reads group by well""",
    "p2_per_region": """
        select id, count(*) as hits, cast(sum(score) as bigint) as score_sum, max(score) as score_max
        from region_hits group by id""",
    "p3_found": r"""
        with tokens as (
          select sample_id, regexp_extract_all(fivep_beds, '("(?:[^"]|"")*"|''(?:[^'']|'''')*''|[A-Za-z0-9_.\-]+)', 1, 's') as t
          from samples),
        vals as (
          select sample_id, list_filter(list_transform(t, lambda x:
            case when starts_with(x, '"') then replace(x[2:-2], '""', '"')
                 when starts_with(x, '''') then replace(x[2:-2], '''''', '''') else x end), lambda x: x <> '') as v from tokens)
        select sample_id, cast(unnest(range(1, len(v) + 1)) as bigint) as item_pos, unnest(v) as item from vals""",
    "p4_found": """
        with iv as (select distinct acc, left_pos as l, right_pos as r from annotations
                    where feature = 'exon' and acc is not null and left_pos is not null and right_pos is not null
                      and left_pos <= right_pos),
        reach as (select *, max(r) over (partition by acc order by l, r rows between unbounded preceding and 1 preceding) as before from iv),
        isl as (select *, sum(case when before is null or l > before + 1 then 1 else 0 end)
                  over (partition by acc order by l, r rows unbounded preceding) as g from reach),
        merged as (select acc, g, min(l) as l, max(r) as r from isl group by acc, g),
        nexts as (select acc, l, r, lead(l) over (partition by acc order by l) as nl from merged)
        select acc, 'merged' as kind, l as left_pos, r as right_pos from merged
        union all
        select acc, 'gap', r + 1, nl - 1 from nexts where nl is not null""",
    "p7_found": _RAW + "select line_id, reason from judged where reason is not null",
    "p7_valid": _RAW
    + "select line_id, fields[1] as acc, fields[2] as seq, fields[3] as sep, fields[4] as qual from judged where reason is null",
}
