"""Exact Jaccard join of shingle sets by universe partition and pigeonhole.

Sets are banded by size; a band's universe (the hash range) is cut into m
segments.  Two sets whose Jaccard similarity reaches the threshold differ in at
most H elements, so of m segments with tolerances v (1: equal, 2: equal up to
one element) with sum(v) > H one segment agrees.  Segments are indexed by a
hash of their elements, those with v = 2 also by their one-deletion
neighbourhood; m and the number of v = 2 segments are chosen for each band by
estimated cost.  A set is indexed in its own band and, where a larger partner
can lie there, in the next.

Sets that share a key are candidates, but never all pairs of a key: each set is
compared with the keys' least sets first.  What is not connected then is
compared across components: pair by pair in keys of at most SMALL sets; the
members of larger keys (common passages) are joined by their rarest shingles
(prefix filter with positions), which is exact as well.  A parity bitmap of each
set bounds the difference of a pair from below and drops most false candidates
before their sets are read; the rest are verified exactly.
"""

from __future__ import annotations

from bisect import bisect_right
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, keep_ids, map_arrow, materialize, release, scratch, sweep
from .textscan import long_lists, mix, powers, shingle_hashes, shingle_set, text_views, words

#: Ratio of a band's upper to its lower size.
BAND = 1.3
#: Cost model: chance that an element agrees between unrelated sets of a topic, and their weight.
AGREE, WEIGHT = 0.6, 1000.0
#: Keys of at most so many sets are compared pair by pair.
SMALL = 16
#: Of the least sets of its keys, so many are compared with a set first: those that share most keys with it.
LEADERS = 3
#: Documents sampled for frequent shingles (those in FREQUENT of them or more; the LISTED most frequent); any list gives right results.
SAMPLE, FREQUENT, LISTED = 8000, 3, 200_000
#: Of the index rows one in so many is looked at for hot keys: the HOTTEST that come up SEEN times or more; any list gives right results.
LOOK, SEEN, HOTTEST = 64, 32, 10_000
#: Pairs of one leader verified in one task; more are dealt to several.
TOGETHER = 4096
#: Counters of shingles (by hash) from which their rarity is read; any counts give right results.
COUNTERS = 1 << 18


def max_difference(size: int, t: Fraction) -> int:
    """The most elements in which two sets of at most ``size`` elements and similarity t or more differ."""
    return int((1 - t) / (1 + t) * 2 * size)


class Bands:
    """Size bands and their allocation ``(segments, of them with one-deletion)``."""

    def __init__(self, t: Fraction):
        self.t, self.lows, self.plans = t, [1], []

    def _grow(self, size: int) -> None:
        while self.lows[-1] <= size:
            low = self.lows[-1]
            # a partner of a set of this band is at most one band away
            high = max(low + 1, int(low * BAND), -(-low * self.t.denominator // self.t.numerator))
            self.plans.append(self.allocate(high - 1))
            self.lows.append(high)

    def allocate(self, top: int) -> tuple[int, int]:
        need = max_difference(top, self.t) + 1
        best = None
        for d in range(need // 2 + 1):
            m = need - d
            cost = m + d * top / m + WEIGHT * AGREE ** (top / m)
            if best is None or cost < best[0]:
                best = (cost, m, d)
            elif d > 8 and cost > 2 * best[0]:
                break
        return best[1], best[2]

    def of(self, size: int) -> list[int]:
        """The band of a size and the next, if a partner of similarity t can lie there."""
        self._grow(int(size / self.t) + 1)
        b = bisect_right(self.lows, size) - 1
        return [b, b + 1] if self.lows[b + 1] * self.t <= size else [b]


def _segments(u: np.ndarray, m: int, tag: int):
    """Of the sorted set u by m segments: first elements, element weights, hash sums and tags of the segments."""
    weight = mix(u + np.uint64(0xA0761D6478BD642F))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight, dtype=np.uint64)])
    place = ((u >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # grows with u
    cuts = np.searchsorted(place, np.arange(m + 1, dtype=np.uint64))
    tags = (np.arange(m, dtype=np.uint64) + np.uint64(tag)) * np.uint64(0xE7037ED1A0B428DB)
    return cuts, weight, run[cuts[1:]] - run[cuts[:-1]], tags


def segment_keys(u: np.ndarray, bands: Bands, frequent: np.ndarray) -> np.ndarray:
    """Index keys of a sorted set of 64-bit hashes; ``frequent``: sorted hashes of frequent elements."""
    if not len(u):
        return u
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, u), len(frequent) - 1)
        rare = u[frequent[at] != u]
    else:
        rare = u
    out = []
    for b in bands.of(len(u)):
        m, d = bands.plans[b]
        need = m + d
        spare = max(1, need // 6)
        cuts, _, sums, tags = _segments(rare, need + spare, (2 * b + 1) << 32)
        filled = np.flatnonzero(cuts[1:] > cuts[:-1])
        out.append(mix(sums[filled] + tags[filled]))
        if need + spare - len(filled) > spare:
            cuts, weight, sums, tags = _segments(u, m, (2 * b + 2) << 32)
            out.append(mix(sums + tags))
            if d:
                at = np.repeat(np.arange(d), np.diff(cuts[: d + 1]))
                out.append(mix(sums[at] - weight[: int(cuts[d])] + tags[at]))
    return np.concatenate(out)


def parity_bitmap(u: np.ndarray) -> np.ndarray:
    """Parities of the number of elements in each of 64 * 2**k classes, k growing with the size.

    Two sets differ in at least as many elements as their bitmaps in bits.
    """
    size = 64
    while size < len(u):
        size *= 2
    n = np.bincount((u & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    # class c is bit c % 64 of word c // 64: halves folded by xor are the bitmap of half the size
    return (n.reshape(-1, 64).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def _sets(batches, k: int):
    """Ids and shingle sets, some thousand rows at a time."""
    for batch in batches:
        for first, count, data, offs in text_views(batch.column(1)):
            _, _, h, cut = words(data, offs, lower=True)
            sh = shingle_hashes(h, k)
            yield batch.column(0).slice(first, count), [shingle_set(h, sh, int(cut[i]), int(cut[i + 1]), k) for i in range(count)]


def _scan_keys(k: int, t: Fraction, frequent):
    """id, set size, set hash, bitmap and index keys."""

    def run(batches):
        bands, common = Bands(t), frequent.value
        for ids, sets in _sets(batches, k):
            n = np.array([len(s) for s in sets], np.int64)
            both = [(int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64))) for s in sets]
            h1, h2 = (np.array([x[j] for x in both], np.uint64).view(np.int64) for j in (0, 1))
            yield pa.RecordBatch.from_pydict(
                {
                    "id": ids, "n": pa.array(n), "h1": pa.array(h1), "h2": pa.array(h2), "bitmap": long_lists([parity_bitmap(s) for s in sets]),
                    "keys": long_lists([segment_keys(s, bands, common) for s in sets]),
                }
            )

    return run


def _scan_sets(k: int):
    def run(batches):
        for ids, sets in _sets(batches, k):
            yield pa.RecordBatch.from_pydict({"id": ids, "elements": long_lists(sets)})

    return run


def frequent_shingles(base: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of shingles in FREQUENT or more of about SAMPLE documents."""
    n = base.count()
    part = base.where(F.pmod(F.xxhash64("id", F.lit("frequent")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(1, n))))
    each = map_arrow(part, _scan_sets(k), "id bigint, elements array<bigint>").select(F.explode("elements").alias("e"))
    found = each.groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "e").limit(LISTED).select("e").toPandas()
    return np.sort(found["e"].to_numpy(np.int64).view(np.uint64))


def _counter(u: np.ndarray) -> np.ndarray:
    return (mix(u) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _scan_counts(k: int):
    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for _, sets in _sets(batches, k):
            total += np.bincount(_counter(np.concatenate(sets)), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"counter": pa.array(some), "n": pa.array(total[some])})

    return run


def _scan_prefixes(k: int, t: Fraction, counts):
    """The rarest shingles of each set, so many that two sets of similarity t share one: shingle, id, size and position."""

    def run(batches):
        rarity = counts.value
        for ids, sets in _sets(batches, k):
            cut, place = [], []
            for s in sets:
                n = len(s)
                p = n - -(-n * t.numerator // t.denominator) + 1
                cut.append(s[np.lexsort((s, rarity[_counter(s)]))[:p]] if n else s)
                place.append(np.arange(len(cut[-1])))
            sizes = np.array([len(c) for c in cut])
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array(np.concatenate(cut).view(np.int64)), "id": pa.array(np.repeat(ids.to_numpy(), sizes)),
                    "n": pa.array(np.repeat([len(s) for s in sets], sizes)), "at": pa.array(np.concatenate(place)),
                }
            )

    return run


def _bitmaps_differ(t: Fraction):
    """Bits in which ``ba`` and ``bb`` differ; the longer is folded to the shorter's size (of sets whose sizes have a ratio of t or more)."""
    fold = lambda x: F.zip_with(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    a, b = F.col("ba"), F.col("bb")
    for _ in range((-(-t.denominator // t.numerator) - 1).bit_length()):
        a, b = F.when(F.size(a) > F.size("bb"), fold(a)).otherwise(a), F.when(F.size(b) > F.size("ba"), fold(b)).otherwise(b)
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)


class _Verifier:
    """Verifies pairs ``(src, dst)``: bitmaps first, then exact intersections."""

    def __init__(self, base: DataFrame, scanned: DataFrame, k: int, t: Fraction):
        self.base, self.k, self.t = base, k, t
        self.maps = scanned.select("id", "n", "bitmap")

    @staticmethod
    def _joined(pairs: DataFrame, n_pairs: int, a: DataFrame, b: DataFrame) -> DataFrame:
        """``pairs(src, dst)`` with the columns of a (by src) and b (by dst).

        Many sets share a leader: the pairs of one dst are dealt to several
        tasks, and its row of b goes to those that have some.
        """
        parts = max(1, -(-n_pairs // TOGETHER))
        with_a = pairs.join(a, "src")
        if parts == 1:
            return with_a.join(b, "dst")
        part = F.pmod(F.xxhash64("src"), F.lit(parts))
        spread = pairs.select("dst", part.alias("part")).distinct().join(b, "dst")
        return with_a.withColumn("part", part).join(spread, ["dst", "part"]).drop("part")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        num, den = self.t.numerator, self.t.denominator
        pairs = materialize(pairs, "pairs")
        a = self.maps.select(F.col("id").alias("src"), F.col("n").alias("na"), F.col("bitmap").alias("ba"))
        b = self.maps.select(F.col("id").alias("dst"), F.col("n").alias("nb"), F.col("bitmap").alias("bb"))
        sized = F.least("na", "nb") * F.lit(den) >= F.greatest("na", "nb") * F.lit(num)
        maybe = self._joined(pairs, pairs.count(), a, b).where(sized).where(_bitmaps_differ(self.t) * F.lit(den + num) <= (F.col("na") + F.col("nb")) * F.lit(den - num))
        maybe = materialize(maybe.select("src", "dst").distinct(), "maybe")
        ids = materialize(maybe.select(F.col("src").alias("id")).union(maybe.select("dst")).distinct(), "ids")
        sets = map_arrow(keep_ids(self.base, ids, "id", ids.count()), _scan_sets(self.k), "id bigint, elements array<bigint>")
        sets = materialize(sets, "elements")
        ea = sets.select(F.col("id").alias("src"), F.col("elements").alias("ea"))
        eb = sets.select(F.col("id").alias("dst"), F.col("elements").alias("eb"))
        both, total = F.size(F.array_intersect("ea", "eb")), F.size("ea") + F.size("eb")
        counted = self._joined(maybe, maybe.count(), ea, eb).select("src", "dst", both.alias("i"), total.alias("s"))
        out = materialize(counted.where(F.col("i") * F.lit(den) >= (F.col("s") - F.col("i")) * F.lit(num)).select("src", "dst"), "links")
        release(sets)
        return out


def _across(rows: DataFrame, extra: list[str], fits) -> DataFrame:
    """Pairs ``(src, dst)`` of ``rows(key, id, c, ...)`` that share a key and lie in different components.

    One of the two at least is outside the key's largest component, so the
    larger part of a key is never compared with itself.
    """
    parts = rows.groupBy("key", "c").agg(F.count("*").alias("m"))
    main = parts.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    rows = rows.join(materialize(main.select("key", "main"), "main"), "key")
    a = rows.where("c <> main").select("key", F.col("id").alias("a"), F.col("c").alias("ca"), *(F.col(x).alias(f"a_{x}") for x in extra))
    b = rows.select("key", F.col("id").alias("b"), F.col("c").alias("cb"), *(F.col(x).alias(f"b_{x}") for x in extra))
    joined = a.join(b, "key").where(F.col("ca") != F.col("cb"))
    if fits is not None:
        joined = joined.where(fits)
    return joined.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def _shared_keys(rows: DataFrame) -> DataFrame:
    """``key, id, leader, rows`` of the index rows ``(key, id)`` whose key several ids have; leader: the least of them.

    Rows of one key meet in a window, but for the hottest keys: theirs are
    summed up where they are and get the sums by a broadcast of bounded size.
    """
    told = rows.where(F.pmod(F.xxhash64("id", "key"), F.lit(LOOK)) == 0).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    hot = F.broadcast(materialize(told.orderBy(F.desc("n"), "key").limit(HOTTEST).select("key"), "hot"))
    w = Window.partitionBy("key")
    cold = rows.join(hot, "key", "left_anti").select("key", "id", F.min("id").over(w).alias("leader"), F.max("id").over(w).alias("last"), F.count("*").over(w).alias("rows"))
    warm = rows.join(hot, "key", "left_semi")
    sums = warm.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"), F.count("*").alias("rows"))
    warm = warm.join(F.broadcast(materialize(sums, "sums")), "key").select("key", "id", "leader", "last", "rows")  # at most HOTTEST rows
    return cold.union(warm).where("leader < last").select("key", "id", "leader", "rows")


def jaccard_components(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of documents.

    A document's set: its distinct shingles of k words (A-Z lower-cased); with
    fewer words the whole sequence; without words (or text) empty and linked
    with nothing.  Documents whose sets have Jaccard similarity ``threshold`` or
    more are linked; component_id is the smallest id reachable.  Repeated
    rows share their component; rows of one id with different texts each have
    their n_shingles, but are one node: what any of them links with is in the
    component of all.  A null id is not linked and has a null component.  An
    empty table gives no row.  Shingles are 64-bit hashes, in verification too:
    of n different shingles in two sets about n**2 / 2**65 count as equal.
    """
    with scratch(docs.sparkSession):
        return materialize(_components(docs, k, Fraction(threshold), id_col), "jaccard", outer=True)


def _same_ids(real: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` from every id that has several sets to the classes of all of them."""
    part = ("h1", "h2", "n")
    differ = " or ".join(f"l_{c} < m_{c}" for c in part)
    several = real.groupBy("id").agg(*(f(c).alias(f"{x}_{c}") for c in part for x, f in (("l", F.min), ("m", F.max)))).where(differ).select("id")
    return real.join(several, "id", "left_semi").join(classes, list(part)).where("id <> rep").select(F.col("id").alias("src"), F.col("rep").alias("dst")).distinct()


def _components(docs: DataFrame, k: int, t: Fraction, id_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(base, k))
    whole = materialize(map_arrow(base, _scan_keys(k, t, frequent), "id bigint, n bigint, h1 bigint, h2 bigint, bitmap array<bigint>, keys array<bigint>"), "keys")
    scanned = materialize(whole.drop("keys"), "sets")
    real = scanned.where("n > 0 and id is not null")
    # equal sets become one class, named by its least id
    classes = materialize(real.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("id")).distinct()
    rows = keep_ids(whole.where("n > 0 and id is not null"), reps, "id", classes.count()).select("id", F.explode("keys").alias("key"))
    shared = materialize(_shared_keys(rows), "shared")
    release(whole)
    del rows, whole
    sweep(spark)
    verify = _Verifier(base.where("id is not null"), keep_ids(real, reps, "id", classes.count()), k, t)
    # each set and the least sets of its keys
    often = shared.where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("times"))
    best = Window.partitionBy("id").orderBy(F.desc("times"), "leader")
    pairs = often.withColumn("r", F.row_number().over(best)).where(F.col("r") <= LEADERS).select(F.col("id").alias("src"), F.col("leader").alias("dst"))
    same = materialize(_same_ids(real, classes), "same-ids")
    links = verify(pairs).union(same)
    # the rest across components
    label = materialize(connected_components(links), "labels").select(F.col("node").alias("id"), F.col("component").alias("c"))
    named = shared.join(label, "id", "left").select("key", "id", F.coalesce("c", "id").alias("c"), "rows")
    mixed = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    named = materialize(named.join(materialize(mixed, "mixed"), "key"), "named")
    direct = _across(named.where(F.col("rows") <= SMALL).drop("rows"), [], None)
    crowd = materialize(named.where(F.col("rows") > SMALL).select("id", "c").distinct(), "crowd")
    members = keep_ids(base, crowd.select("id"), "id", crowd.count())
    counts = map_arrow(members, _scan_counts(k), "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    rarity = np.zeros(COUNTERS, np.int64)
    rarity[counts["counter"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    held = spark.sparkContext.broadcast(rarity)
    prefixes = map_arrow(members, _scan_prefixes(k, t, held), "key bigint, id bigint, n bigint, at bigint").join(crowd, "id")
    both = F.lit(1) + F.least(F.col("a_n") - F.col("a_at") - 1, F.col("b_n") - F.col("b_at") - 1)  # the most they can share from here on
    near = F.least("a_n", "b_n") * F.lit(t.denominator) >= F.greatest("a_n", "b_n") * F.lit(t.numerator)
    enough = both * F.lit(t.denominator + t.numerator) >= (F.col("a_n") + F.col("b_n")) * F.lit(t.numerator)
    far = _across(materialize(prefixes, "prefixes"), ["n", "at"], near & enough)
    links = links.union(verify(direct.union(far).distinct()))
    comps = materialize(connected_components(links), "components")
    named = scanned.join(classes, ["h1", "h2", "n"], "left")
    return (
        named.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
    )
