"""SQL for the queries that SQL can express, on whole tables."""

_PAIRS = """
with k as (
  select distinct contig_id as c, substr(upper(seq), i, 12) as m
  from (select contig_id, seq, unnest(range(1, length(seq) - 10)) as i from contigs where length(seq) >= 12)),
n as (select c, count(*) as n from k group by c),
joint as (select a.c as a, b.c as b, count(*) as common from k a join k b on a.m = b.m and a.c < b.c group by a.c, b.c),
pairs as (select a, b from joint join n x on x.c = a join n y on y.c = b where common >= 0.5 * (x.n + y.n - common))
"""

_WEIGHTED = """
with k as (
  select c, m, count(*) as often from (
    select contig_id as c, substr(upper(seq), i, 12) as m
    from (select contig_id, seq, unnest(range(1, length(seq) - 10)) as i from contigs where length(seq) >= 12)) group by c, m),
n as (select c, sum(often) as n from k group by c),
joint as (select a.c as a, b.c as b, sum(least(a.often, b.often)) as common from k a join k b on a.m = b.m and a.c < b.c group by a.c, b.c)
select a as contig_a, b as contig_b from joint join n x on x.c = a join n y on y.c = b where common >= 0.5 * (x.n + y.n - common)
"""

_GROUPS = (
    _PAIRS.replace("with k as", "with recursive k as", 1).rstrip()
    + """,
t as (select contig_id as c, upper(seq) as s from contigs where length(seq) >= 12),
e as (select a as x, b as y from pairs union all select b, a from pairs),
reach(c, r) as (select c, c from t union select e.y, reach.r from reach join e on e.x = reach.c),
root as (select c, min(r) as g from reach group by c),
near as (select e.x as c, count(distinct v.s) as links from e join t u on u.c = e.x join t v on v.c = e.y where u.s <> v.s group by e.x),
same as (select s, count(*) as copies from t group by s)
select t.c as contig_id, g as group_id, coalesce(links, 0) as links, copies from t join root using (c) left join near using (c) join same using (s)
"""
)

_TYPED = r"""
with e as (
  select entry_id, field, lower(translate(coalesce(typed, ''),
    '０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ＿－．，／',
    '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-.,/')) as t from typed_entries),
v as (select entry_id, field, regexp_replace(t, '[^a-z0-9]', '', 'g') as v from e),
names as (
  select 'bc' as field, pos, bc as canonical, lower(bc) as k, 1 as most from barcode_map
  union all
  select 'acc', row_number() over (order by acc), acc, regexp_replace(lower(acc), '[^a-z0-9]', '', 'g'), 2 from fasta_index),
dv as (select distinct field, v from v where field in ('bc', 'acc') and v <> ''),
near as (
  select d.field, d.v, n.canonical, row_number() over (partition by d.field, d.v order by levenshtein(d.v, n.k), n.pos) as r
  from dv d join names n on n.field = d.field and abs(length(d.v) - length(n.k)) <= n.most and levenshtein(d.v, n.k) <= n.most),
plate as (
  select entry_id, regexp_replace(regexp_replace(v, '^(well|position|pos)', ''), '(column|col|row)', '', 'g') as w from v where field = 'well'),
cell as (
  select entry_id, upper(regexp_extract(w, '[a-z]')) || cast(cast(regexp_extract(w, '[0-9]+') as bigint) as varchar) as well
  from plate where regexp_full_match(w, '[a-z][0-9]+|[0-9]+[a-z]')),
hit as (
  select v.entry_id, n.canonical from v join near n on n.field = v.field and n.v = v.v and n.r = 1
  union all
  select c.entry_id, b.well from cell c join barcode_map b on b.well = c.well)
"""

_LEAKS = r"""
with d as (
  select doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}]+'), lambda w: lower(w)) as w from documents where text is not null),
i as (
  select item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}]+'), lambda w: lower(w)) as w from eval_items where text is not null),
dw as (select doc_id, s, array_to_string(w[s:s+12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as s from d where len(w) >= 13)),
iw as (select distinct item_id, array_to_string(w[s:s+12], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 11)) as s from i where len(w) >= 13)),
shared as (select doc_id, item_id, s, lag(s) over (partition by doc_id, item_id order by s) as before from dw join iw using (g))
"""

_FREQUENT = "from reads where seq is not null group by seq having count(*) * 500 >= (select count(*) from reads)"

SQL = {
    "p1_found": _PAIRS + "select a as contig_a, b as contig_b from pairs",
    "p1_weighted": _WEIGHTED,
    "p1_groups": _GROUPS,
    "p5_found": f"select seq {_FREQUENT}",
    "p5_counts": f"select seq, count(*) as exact_rows {_FREQUENT}",
    "p6_found": _TYPED + "select v.entry_id, coalesce(h.canonical, 'NA') as canonical from v left join hit h using (entry_id)",
    "p6_unmatched": _TYPED + "select v.entry_id from v left join hit h using (entry_id) where h.canonical is null",
    "p8_covered": "select doc_id, length(text) as chars, length(text) as last from documents where text <> ''",
    "p9_found": _LEAKS + "select distinct doc_id, item_id from shared",
    "p9_windows": _LEAKS
    + """select doc_id, item_id, count(*) filter (before is null or s > before + 13) as passages, count(*) as windows
from shared group by doc_id, item_id""",
}
