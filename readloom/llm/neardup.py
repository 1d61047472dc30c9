"""Near-equal records by weighted minwise signatures (DartMinHash) and banded joins.

Each weighted element owns the region [0, weight) x [0, rank).  Hash functions
throw darts into unit cells of that region (their number per cell is Poisson
with mean 1, a function of element and cell only), and every dart falls on one
of K coordinates.  The dart with the least rank on a coordinate is its
signature value: two sets agree there with probability equal to their weighted
Jaccard similarity.  Only ranks below t / total weight are explored, t = K ln K
+ 2 K darts in expectation; sets with an empty coordinate go on with the next
window of ranks, so each signature is complete.

Records whose signatures agree on all rows of a band are candidates; every
candidate pair is verified exactly.  Exact copies are collapsed first, so a
group of copies costs one signature and no pairs among itself.

Elements are the distinct substrings of a text, of weight 1 or, if the caller
asks for it, of a weight equal to how often the text holds them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.session import checkpointed, spread

SHINGLE = 12
ROWS = 3
#: Chance that a pair exactly at the threshold is in no common band.
MISS = 1e-5
#: A bucket of more records is cut into blocks of this size; all block pairs are still compared.
BLOCK = 256
#: Exact copies of one text are dealt out in shares of about this many records before they meet anything by key.
SHARE = 4096
#: Texts with more than one share of copies are at most this many; they are the only ones sent to all tasks.
HOT_TEXTS = 10_000
SEED = 0x9E3779B97F4A7C15

#: Darts in a cell: Poisson with mean 1, as bounds on a 64-bit hash.
_CDF = np.array([math.ceil(c * (1 << 53)) << 11 for c in np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)]).tolist()], np.uint64)


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed so that a pair at ``threshold`` is missed with chance ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; works on uint64 with wrap-around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


def shingle_hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct substrings of ``size`` characters of each text, the text each is from, and how often it is there."""
    data = "".join(texts).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(data, np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], np.int64)
    n = len(codes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, np.uint64(SEED))
    for i in range(size):
        h = (h ^ codes[i : i + n]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    owner = np.repeat(np.arange(len(texts)), lengths)[:n]
    inside = np.arange(n) + size <= np.cumsum(lengths)[owner]  # not across two texts
    h, owner = _mix(h[inside]), owner[inside]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return h[first], owner[first], np.diff(np.append(first, len(h)))


def dart_signatures(
    elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of many weighted sets at once.

    ``owner`` gives the set (0..sets-1) of each element.  An element listed
    twice with the same weight counts once, as its darts are the same.
    Returns the values, ``sets`` x ``k`` of uint64, and which sets have any
    element.
    """
    total = np.bincount(owner, weights=weights, minlength=sets)
    best = np.zeros(sets * k, np.uint64)
    empty = np.ones(sets * k, bool)
    filled = total > 0
    todo = filled.copy()
    darts = k * math.log(k) + 2 * k
    start = np.zeros(sets)
    stop = np.divide(darts, total, out=np.zeros(sets), where=filled)
    strips = np.ceil(weights).astype(np.int64)
    whole = bool((strips == weights).all())  # then no dart lies beyond its element's weight
    single = whole and bool((strips <= 1).all())
    live = np.flatnonzero(strips > 0)
    while todo.any():
        live = live[todo[owner[live]]]
        own = owner[live]
        lo = np.floor(start[own]).astype(np.int64)
        cells = (np.ceil(stop[own]).astype(np.int64) - lo) * strips[live]
        # one row per (element, weight strip, rank cell)
        e = np.repeat(live, cells)
        number = np.arange(len(e)) - np.repeat(np.cumsum(cells) - cells, cells)
        if single:
            strip, cell = None, number + np.repeat(lo, cells)
            place = cell.astype(np.uint64) + np.uint64(1)
        else:
            strip, cell = number % strips[e], number // strips[e] + np.repeat(lo, cells)
            place = (strip.astype(np.uint64) << np.uint64(32)) + cell.astype(np.uint64) + np.uint64(1)
        h = _mix(elements[e] + place * np.uint64(0xD1B54A32D192ED03))
        count = (h >= _CDF[0]).astype(np.int64)
        rest = np.flatnonzero(h >= _CDF[1])
        count[rest] = np.searchsorted(_CDF, h[rest], side="right")
        d = np.repeat(np.arange(len(e)), count)
        nth = (np.arange(len(d)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
        dart = _mix(h[d] + (nth + np.uint64(1)) * np.uint64(0x8CB92BA72F3D8DD7))
        # the upper bits of a dart give its rank, the lower ones its coordinate
        rank = cell[d] + (dart >> np.uint64(24)).astype(np.float64) * (1.0 / (1 << 40))
        own = owner[e[d]]
        hit = (rank >= start[own]) & (rank < stop[own])
        if not whole:
            weight = strip[d] + _unit(_mix(dart ^ np.uint64(0xE7037ED1A0B428DB)))
            hit &= weight < weights[e[d]]
        own, rank, dart = own[hit], rank[hit], dart[hit]
        slot = own * k + (((dart & np.uint64(0xFFFFFF)) * np.uint64(k)) >> np.uint64(24)).astype(np.int64)
        fresh = empty[slot]  # a later window never beats an earlier one
        slot, rank, dart = slot[fresh], rank[fresh], dart[fresh]
        least = np.full(sets * k, np.inf)
        np.minimum.at(least, slot, rank)
        first = rank == least[slot]
        best[slot[first]] = dart[first]
        empty[slot] = False
        todo &= empty.reshape(sets, k).any(axis=1)
        start, stop = np.where(todo, stop, start), np.where(todo, 2 * stop, stop)
    return best.reshape(sets, k), filled


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band."""
    keys = np.zeros((len(signatures), bands), np.uint64)
    for r in range(rows):
        keys = _mix(keys * np.uint64(0x9FB21C651E98DF25) + signatures[:, r::rows][:, :bands] + np.uint64(r + 1))
    return _mix(keys + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(SEED))


def _signer(size: int, bands: int, rows: int, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                # as many texts as keep the arrays small, whatever their length
                end, letters = at, 0
                while end < len(texts) and (end == at or letters < 20_000):
                    letters += len(texts[end])
                    end += 1
                elements, owner, often = shingle_hashes(texts[at:end], size)
                weights = often.astype(np.float64) if weighted else np.ones(len(elements))
                signatures, filled = dart_signatures(elements, weights, owner, end - at, bands * rows)
                keys = band_keys(signatures[filled], bands, rows)
                rows_of = np.flatnonzero(filled) + at
                if len(rows_of):
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(np.repeat(rows_of, bands))),
                            pa.array(keys.ravel().view(np.int64)),
                        ],
                        names=["rep", "key"],
                    )
                at = end

    return run


def _bag(text: str, size: int, weighted: bool) -> Counter | frozenset:
    parts = (text[i : i + size] for i in range(len(text) - size + 1))
    return Counter(parts) if weighted else frozenset(parts)


def _verifier(threshold: float, size: int, weighted: bool):
    """Links among rows (a, na, b, nb, ta, tb); rows of one b come together, so its bag is made once."""
    names = ["a", "na", "b", "nb", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, whole = None, None, 0
        for batch in batches:
            kept, found = [], []
            for i, (b, ta, tb) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("b", "ta", "tb")))):
                if b != last:
                    last, own = b, _bag(tb, size, weighted)
                    whole = len(tb) - size + 1 if weighted else len(own)
                other = _bag(ta, size, weighted)
                if weighted:
                    both = whole + len(ta) - size + 1
                    common = sum(min(n, own[x]) for x, n in other.items() if x in own)
                else:
                    both, common = whole + len(other), len(own & other)
                if common >= threshold * (both - common):
                    kept.append(i)
                    found.append(common / (both - common))
            picked = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(picked.column(c) for c in names[:4]), pa.array(found, pa.float64())], names=names)

    return run


def _records(df: DataFrame, record_id: str, text: str, size: int) -> DataFrame:
    """id, text, digest of every record long enough to compare; the 128-bit digest stands for the text where keys are enough."""
    records = df.select(F.col(f"`{record_id}`").cast("bigint").alias("id"), F.upper(f"`{text}`").alias("text"))
    return records.where(F.length("text") >= size).withColumn("digest", F.unhex(F.md5("text")))


def copies(df: DataFrame, record_id: str, text: str, size: int = SHINGLE) -> DataFrame:
    """digest, text, rep, members: each different text once, with the least id and the number of its exact copies."""
    records = _records(df, record_id, text, size)
    return records.groupBy("digest", "text").agg(F.min("id").alias("rep"), F.count("*").alias("members"))


def _shares(members: Column) -> Column:
    return F.ceil(members / SHARE).cast("int")


def _share_of(record: str, members: Column) -> Column:
    """The share of its text's copies that a record belongs to."""
    return F.pmod(F.xxhash64(F.lit("share"), record), _shares(members)).cast("int")


def _all_shares(members: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), _shares(members) - 1))


def block_pairs(member: DataFrame) -> DataFrame:
    """p, q: all pairs of different members of a bucket; ``member`` is key, rep, n with n rows per key.

    A bucket of n members has ceil(n / BLOCK) blocks; block i meets blocks i.. through replicated rows, so no task
    holds a bucket.
    """
    member = member.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    member = member.withColumn("block", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int"))
    left = member.withColumn("to", F.explode(F.sequence("block", F.col("blocks") - 1)))
    left = left.select("key", F.col("block").alias("x"), F.col("to").alias("y"), F.col("rep").alias("p"))
    right = member.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("block"))))
    right = right.select("key", F.col("from").alias("x"), F.col("block").alias("y"), F.col("rep").alias("q"))
    met = left.join(right, ["key", "x", "y"]).where((F.col("x") < F.col("y")) | (F.col("p") < F.col("q")))
    return met.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))


def candidate_pairs(reps: DataFrame, threshold: float, size: int, rows: int, miss: float, weighted: bool = False) -> DataFrame:
    """Distinct pairs (a < b) of representatives sharing a band; buckets of any size are compared in blocks."""
    bands = bands_for(threshold, rows, miss)
    keyed = spread(reps.select("rep", "text")).mapInArrow(_signer(size, bands, rows, weighted), "rep bigint, key bigint")
    keyed = keyed.repartition("key")  # dealt out by key once, for the count and for the join: both read the same columns
    sized = keyed.groupBy("key").agg(F.count("rep").alias("n")).where("n > 1")
    shared = checkpointed(keyed.join(sized.hint("shuffle_hash"), "key"))  # few keys are shared: no sort of the many
    return block_pairs(shared).select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()


def similar_representatives(
    reps: DataFrame, threshold: float, size: int = SHINGLE, rows: int = ROWS, miss: float = MISS, weighted: bool = False
) -> DataFrame:
    """a < b, their numbers of copies na and nb, similarity: verified links between different texts."""
    pairs = candidate_pairs(reps, threshold, size, rows, miss, weighted)
    one = reps.select(F.col("rep").alias("a"), F.col("members").alias("na"), F.col("text").alias("ta"))
    other = reps.select(F.col("rep").alias("b"), F.col("members").alias("nb"), F.col("text").alias("tb"))
    both = pairs.join(one, "a").join(other, "b")
    return both.mapInArrow(_verifier(threshold, size, weighted), "a bigint, na bigint, b bigint, nb bigint, similarity double")


def similar_pairs(
    df: DataFrame,
    record_id: str,
    text: str,
    *,
    threshold: float = 0.5,
    size: int = SHINGLE,
    rows: int = ROWS,
    miss: float = MISS,
    weighted: bool = False,
) -> DataFrame:
    """All pairs of records, exact copies included: left_id < right_id, similarity.

    The similarity is the number of distinct substrings of ``size`` letters
    that two upper-cased texts share, divided by those in either; ``weighted``:
    each substring counts as often as it occurs (least by greatest number).

    Defined results: null texts, and texts shorter than ``size``, have no such
    substring and are in no pair; copies that differ in case are at 1.0;
    repeated rows count once; an id with several texts stands for each of
    them; an empty table gives an empty result.  Pairs between copies are expanded only here; groups need no such expansion.
    """
    reps, members = _with_members(df, record_id, text, size)
    links = similar_representatives(reps, threshold, size, rows, miss, weighted)
    m = members.withColumn("share", _share_of("id", F.col("members")))
    across = (
        links.withColumn("share", _all_shares(F.col("na")))
        .join(m.select(F.col("rep").alias("a"), "share", F.col("id").alias("ia")), ["a", "share"])
        .withColumn("share", _all_shares(F.col("nb")))
        .join(m.select(F.col("rep").alias("b"), "share", F.col("id").alias("ib")), ["b", "share"])
        .where("ia <> ib")
        .select(F.least("ia", "ib").alias("left_id"), F.greatest("ia", "ib").alias("right_id"), "similarity")
    )
    twins = members.where("members > 1").select(F.col("rep").alias("key"), F.col("id").alias("rep"), F.col("members").alias("n"))
    within = block_pairs(twins).select(F.col("p").alias("left_id"), F.col("q").alias("right_id"), F.lit(1.0).alias("similarity"))
    return across.unionByName(within)


def _with_members(df: DataFrame, record_id: str, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Representatives (digest, text, rep, members) and membership (rep, id, members).

    Texts with a share of copies or more, at most HOT_TEXTS of them, are known to all tasks, so that their copies meet
    the representative in shares.
    """
    reps = checkpointed(copies(df, record_id, text, size))
    records = reps.agg(F.sum("members")).first()[0] or 0
    hot = reps.where(F.col("members") > max(SHARE, records // HOT_TEXTS)).select("digest", F.col("members").alias("many"))
    ids = _records(df, record_id, text, size).select("id", "digest").distinct()
    ids = ids.join(F.broadcast(hot), "digest", "left").withColumn("share", _share_of("id", F.coalesce("many", F.lit(1))))
    known = reps.join(F.broadcast(hot), "digest", "left").withColumn("share", _all_shares(F.coalesce("many", F.lit(1))))
    members = ids.join(known.select("digest", "share", "rep", "members"), ["digest", "share"]).select("rep", "id", "members")
    return reps, checkpointed(members)


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node, root: the least node connected to each, by alternating star contraction.

    Every round halves the depth of the trees at least; the state is written
    to the shared checkpoint folder each round, and only counts reach the driver.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: all larger neighbours of a node are hung on its least neighbour
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours are hung on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # the edges are a set: count and two sums of hashes tell whether it changed
        now = edges.agg(F.count("*"), *[F.bit_xor(F.xxhash64(F.lit(i), "u", "v")) for i in (1, 2)]).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )


def similar_groups(
    df: DataFrame,
    record_id: str,
    text: str,
    *,
    threshold: float = 0.5,
    size: int = SHINGLE,
    rows: int = ROWS,
    miss: float = MISS,
    weighted: bool = False,
) -> DataFrame:
    """One row per comparable record: record_id, group_id (least id of its group), links, copies.

    ``links`` counts the different texts its own text is linked to, ``copies``
    the rows with exactly its text.  Defined results as in ``similar_pairs``.
    """
    reps, members = _with_members(df, record_id, text, size)
    links = checkpointed(similar_representatives(reps, threshold, size, rows, miss, weighted))
    degree = (
        links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    )
    roots = components(reps.select(F.col("rep").alias("node")), links)
    return (
        members.join(roots.select(F.col("node").alias("rep"), F.col("root").alias("group_id")), "rep")
        .join(degree, "rep", "left")
        .select(
            F.col("id").alias(record_id),
            "group_id",
            F.coalesce("links", F.lit(0).cast("bigint")).alias("links"),
            F.col("members").alias("copies"),
        )
    )
