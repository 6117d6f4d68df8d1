"""Document fingerprints from prefix polynomial hashes.

For a text the prefix arrays ``S[i] = sum(c[j] * B**j for j < i) mod p`` (two
bases, p = 2**31 - 1) give the hash of any span in constant time; equal spans
are recognised by their hashes and the longest common extension of two
positions is found by binary search over the span length.

A fingerprint is a string ``length:whole:prefixes:suffixes:sketch``.  ``whole``
is the 62-bit hash, ``prefixes``/``suffixes`` are 16-bit hashes of the spans at
either end with lengths on a geometric ladder, ``sketch`` the least span hash
of GRAM code points in each of BINS classes.  Equal texts have equal
fingerprints.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

P = np.int64(2**31 - 1)
BASES = (1_000_003 * 977 % (2**31 - 1), 1_618_033_989)
GRAM = 12
BINS = 64
_EMPTY = np.uint16(0xFFFF)


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & P) + (x >> 31)
    x = (x & P) + (x >> 31)
    x[x >= P] -= P
    return x


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _TABLES.get(base)
    if have is None:
        have = np.ones(1, np.int64)
    while len(have) < n:
        have = np.concatenate([have, _mod(have * np.int64(pow(base, len(have), int(P))))])
    _TABLES[base] = have
    return have[:n]


_INVERSES = tuple(pow(b, -1, int(P)) for b in BASES)


class Prefixes:
    """Prefix arrays of one text (an array of code points)."""

    def __init__(self, points: np.ndarray, like: Prefixes | None = None, same: int = 0):
        """``like``: a text that has the first ``same`` code points in common; its arrays are reused."""
        self.points, self.n = points, len(points)
        self.sums = []
        for k, base in enumerate(BASES):
            s = np.empty(self.n + 1, np.int64)
            s[0] = 0
            if same:
                s[: same + 1] = like.sums[k][: same + 1]
            if self.n > same:
                tail = _mod((points[same:].astype(np.int64) + 1) * _powers(base, self.n)[same:])
                s[same + 1 :] = _mod(s[same] + np.cumsum(tail))
            self.sums.append(s)

    def span(self, i: int, j: int) -> int:
        """The 62-bit hash of code points i..j-1; equal for equal spans at any place."""
        out = 0
        for s, inverse in zip(self.sums, _INVERSES, strict=True):
            h = int((s[j] - s[i]) % P) * int(_powers(inverse, i + 1)[i]) % int(P)
            out = out << 31 | h
        return out

    def grams(self, k: int, start: int = 0) -> np.ndarray:
        """Hashes of all spans of k code points from ``start`` on (one base)."""
        s, n = self.sums[0], self.n
        if n - start < k:
            return np.empty(0, np.int64)
        d = s[start + k :] - s[start : n - k + 1]
        d[d < 0] += P
        return _mod(d * _powers(_INVERSES[0], n)[start : n - k + 1])


def spans_equal(a: Prefixes, i: int, b: Prefixes, j: int, n: int) -> bool:
    return i + n <= a.n and j + n <= b.n and a.span(i, i + n) == b.span(j, j + n)


def longest_common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common span that starts at a[i] and b[j]; binary search on span hashes."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if spans_equal(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


LADDER = np.unique(np.ceil(2 ** (np.arange(0, 80) / 2)).astype(np.int64))


@dataclass
class Fingerprint:
    n: int
    whole: int
    heads: np.ndarray
    tails: np.ndarray
    sketch: np.ndarray

    def __str__(self) -> str:
        hexed = lambda x, kind: x.astype(kind).tobytes().hex()
        return f"{self.n:x}:{self.whole:016x}:{hexed(self.heads, '>u2')}:{hexed(self.tails, '>u2')}:{hexed(self.sketch, '>u2')}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, whole, *rest = text.split(":")
        return cls(int(n, 16), int(whole, 16), *(np.frombuffer(bytes.fromhex(x), ">u2") for x in rest))


def _fold(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return ((h1 * 40503 + h2 * 30011) >> 13 & 0xFFFF).astype(np.uint16)


def _sketch(grams: np.ndarray) -> np.ndarray:
    x = grams.astype(np.uint32)
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(13)
    x.sort()
    out = np.full(BINS, _EMPTY, np.uint16)
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(26)
    at = np.searchsorted(x, edges.astype(np.uint32))
    ok = at < len(x)
    found = x[at[ok]]
    ok[ok] = (found >> np.uint32(26)) == np.flatnonzero(ok)
    least = x[at[ok]]
    out[ok] = ((least ^ (least >> np.uint32(11))) % np.uint32(0xFFFF)).astype(np.uint16)
    return out


def fingerprint(p: Prefixes, grams: np.ndarray | None = None) -> Fingerprint:
    n = p.n
    steps = LADDER[: int(np.searchsorted(LADDER, n))]
    s1, s2 = p.sums
    heads = _fold(s1[steps], s2[steps])
    at = n - steps
    tails = _fold(*(_mod(((s[n] - s[at]) % P) * _powers(inv, n + 1)[at]) for s, inv in zip(p.sums, _INVERSES, strict=True)))
    if grams is None:
        grams = p.grams(min(GRAM, n)) if n else np.empty(0, np.int64)
    return Fingerprint(n, p.span(0, n), heads, tails, _sketch(grams))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """The longest ladder length at which both agree, by binary search (a longer span agrees only if all shorter do)."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        if x[mid - 1] == y[mid - 1]:
            low = mid
        else:
            high = mid - 1
    return int(LADDER[low - 1]) if low else 0


def likeness(a: Fingerprint | str, b: Fingerprint | str) -> float:
    """0 to 1: 1 for equal texts, else the larger of the common ends' share and the sketches' agreement."""
    a, b = (Fingerprint.parse(x) if isinstance(x, str) else x for x in (a, b))
    if (a.n, a.whole) == (b.n, b.whole):
        return 1.0
    if not a.n or not b.n:
        return 0.0
    filled = (a.sketch != _EMPTY) | (b.sketch != _EMPTY)
    agree = float(np.count_nonzero((a.sketch == b.sketch) & filled)) / max(1, int(np.count_nonzero(filled)))
    ends = min(_common(a.heads, b.heads) + _common(a.tails, b.tails), min(a.n, b.n)) / max(a.n, b.n)
    return min(max(agree, ends), 0.9999)


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_prefix bigint"
)


def _edited_rows(batches):
    """Rows ordered by bucket, own rows before borrowed ones, descending id: each row's next is the row after it."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows: dict[str, list] = {n: [] for n in names}
    wait = None  # (bucket, doc_id, text, prefixes, grams, fingerprint) of the row whose next is to come

    def flush():
        out = pa.RecordBatch.from_pydict(
            {n: pa.array(rows[n], {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for n, x in zip(names, SCHEMA.split(", "), strict=True)}
        )
        for v in rows.values():
            v.clear()
        return out

    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)) for c in ("bucket", "borrowed", "doc_id", "text")]
        for bucket, borrowed, doc_id, text in zip(*cols, strict=True):
            bucket, borrowed, doc_id, text = bucket.as_py(), borrowed.as_py(), doc_id.as_py(), text.as_py() or ""
            if borrowed and (wait is None or wait[0] != bucket):
                continue
            p = Prefixes(_points(text))
            grams = p.grams(min(GRAM, p.n)) if p.n else np.empty(0, np.int64)
            f = fingerprint(p, grams)
            if wait is not None and wait[0] == bucket:
                _, own_id, own_text, q, own_grams, g = wait
                cut = q.n - q.n // 3
                edited_points = np.concatenate([q.points[:cut], p.points[: q.n // 3]])
                e = Prefixes(edited_points, q, cut)
                if q.n >= GRAM and e.n >= GRAM:
                    kept = max(0, cut - GRAM + 1)
                    eg = np.concatenate([own_grams[:kept], e.grams(GRAM, kept)])
                else:
                    eg = None
                ef = fingerprint(e, eg)
                edited = own_text[:cut] + text[: q.n // 3]
                values = (
                    own_id, q.n, hashlib.sha256(edited.encode()).hexdigest(), str(g), str(ef),
                    likeness(g, ef), likeness(g, f), longest_common_extension(q, 0, e, 0),
                )
                for n, v in zip(names, values, strict=True):
                    rows[n].append(v)
                if len(rows["doc_id"]) >= 2000:
                    yield flush()
            wait = None if borrowed else (bucket, doc_id, text, p, grams, f)
    yield flush()


def _bucket(column, bounds: list[int]):
    """Index of the first bound not below the column (a null: 0), in two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    tops = F.array(*[F.lit(g[-1]).cast("bigint") for g in groups])
    fine = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in g]) for g in groups])
    g = F.size(F.filter(tops, lambda t: t < column))
    return F.when(g >= len(groups), F.lit(len(bounds))).otherwise(
        g * step + F.size(F.filter(F.get(fine, g), lambda t: t < column))
    )


def edited_fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text (see the contract of op1).

    Edited text: the last ``n_chars // 3`` code points replaced by the first as
    many of the next document in descending doc_id (null ids come last, ties by
    text, descending); after the last comes the first.  A null text is empty.
    Repeated rows each give a row; an empty table gives none.  Only doc_id and
    text are read.

    The ids alone are cut into ``buckets`` ranges; every text moves once, to its
    range.  The highest document of each range is also sent to the range above,
    as the last next.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, max(2, n))]), F.lit(max(1000, 20 * n)))).first()[0] or []
    rough = _bucket(F.col("doc_id"), sorted(set(cuts)))
    tops = [r[1] for r in ids.groupBy(rough.alias("b")).agg(F.max("doc_id")).collect() if r[1] is not None]
    tops.sort()  # one value for each range: as many as partitions
    bucket = _bucket(F.col("doc_id"), tops[:-1])
    last = tops[-1] if tops else None
    above = F.when(F.col("doc_id").eqNullSafe(F.lit(last).cast("bigint")), F.lit(0)).when(
        F.col("doc_id").isin(tops[:-1]) if tops[:-1] else F.lit(False), bucket + 1
    )
    placed = docs.withColumn("own", bucket).withColumn("above", above)
    routed = placed.select(
        "doc_id",
        "text",
        F.explode(
            F.when(F.col("above").isNull(), F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("borrowed")))).otherwise(
                F.array(
                    F.struct(F.col("own").alias("bucket"), F.lit(False).alias("borrowed")),
                    F.struct(F.col("above").alias("bucket"), F.lit(True).alias("borrowed")),
                )
            )
        ).alias("to"),
    ).select("doc_id", "text", "to.bucket", "to.borrowed")
    dealt = routed.repartitionById(max(1, len(tops)), F.col("bucket").cast("int"))
    ordered = dealt.sortWithinPartitions("bucket", "borrowed", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())
    return map_arrow(ordered, _edited_rows, SCHEMA)
