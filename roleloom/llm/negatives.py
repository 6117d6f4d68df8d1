"""Hard-negative mining over a pivot table.

A row's score for an anchor is an integer inner product.  Rows are augmented by
one component, sqrt(M^2 - |x|^2) with M the largest norm, anchors by a zero:
then |q - x|^2 = |q|^2 + M^2 - 2 q.x, and the largest inner product is the
smallest Euclidean distance.  The distances of all rows and anchors to a few
pivots are stored.  By the triangle inequality they bracket every distance, and
with it every score; only rows whose bracket reaches what an anchor still looks
for are scored exactly.

Rows and anchors are packed in blocks, and each block of rows meets each block
of anchors in a shuffle: the anchors are a stated query set.  A task keeps the
best rows of each anchor that it has seen, so that its bounds tighten as it
goes; Spark joins the tasks' lists.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, scratch

#: Components are multiplied by this and rounded down.
SCALE = 256
#: Rows packed in a block, blocks of rows that meet an anchor block in one group, anchors expected in a block.
ROWS, TOGETHER, ANCHORS = 1024, 4, 4096
#: Pivots of each dimension, chosen among so many rows of it.
PIVOTS, PIVOT_SAMPLE = 8, 512
#: Anchor lists that a task keeps before it hands them on.
KEPT = 1 << 20
#: Anchor-row pairs looked at together.
PAIRS = 1 << 19

_BLOCK = "dim int, many int, ids binary, labels binary, keys binary, vecs binary, norm double"


def usable_rows(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """``vec_id, key, label, dim, vec``: rows that can be scored, ``vec`` the integer components.

    Left out: null vec_id or label, null vectors, null or non-finite components,
    and rows whose squared integer norm is 2^61 or more (their scores might not
    fit a long).  ``key`` is a hash of the row's own columns and tells rows of
    one id apart.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & (F.abs(v * F.lit(float(SCALE))) < F.lit(float("inf"))))  # NaN is the largest value
    rows = embeddings.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("old"),
        (F.col("label").cast("bigint") if label is None else label.cast("bigint")).alias("label"),
        x.alias("x"),
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("y", F.transform("x", lambda v: F.floor(v * F.lit(float(SCALE)))))
    norm = F.aggregate(F.transform("x", lambda v: v * F.lit(float(SCALE))), F.lit(0.0), lambda a, v: a + v * v)
    return rows.where(norm + F.lit(4.0) * F.size("x") < F.lit(2.0**61)).select("vec_id", F.xxhash64("vec_id", "old", "x").alias("key"), "label", F.size("x").alias("dim"), F.col("y").alias("vec"))


def _pack(limit: int):
    """Blocks of at most ``limit`` rows of one dimension, numbered within the task: ``spot`` is the same when a task runs again."""

    def run(batches):
        context, number = TaskContext.get(), 0
        part = context.partitionId() if context else 0
        waiting: dict[int, list] = {}

        def block(dim, parts):
            nonlocal number
            ids, labels, keys, vecs = (np.concatenate([p[i] for p in parts]) for i in range(4))
            norm = float((vecs.astype(np.float64) ** 2).sum(1).max(initial=0.0))
            spot, number = (part << 32) + number // TOGETHER, number + 1
            row = {"dim": [dim], "many": [len(ids)], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "keys": [keys.tobytes()], "vecs": [vecs.astype(np.int32).tobytes()], "norm": [norm], "spot": [spot]}
            return pa.RecordBatch.from_pydict(row, schema=_arrow_block(spot=pa.int64()))

        for batch in batches:
            ids, keys, labels, dims = (batch.column(i).to_numpy() for i in range(4))
            lists = batch.column(4)
            flat, offs = lists.values.to_numpy(), lists.offsets.to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                vecs = flat[offs[rows][:, None] + np.arange(dim)]
                for at in range(0, len(rows), limit):
                    cut = rows[at : at + limit]
                    waiting.setdefault(int(dim), []).append((ids[cut], labels[cut], keys[cut], vecs[at : at + limit]))
                    if sum(len(p[0]) for p in waiting[int(dim)]) >= limit:
                        ready = [np.concatenate([p[i] for p in waiting[int(dim)]]) for i in range(4)]
                        yield block(int(dim), [[r[:limit] for r in ready]])
                        waiting[int(dim)] = [[r[limit:] for r in ready]] if len(ready[0]) > limit else []
        for dim, parts in waiting.items():
            if parts:
                yield block(dim, parts)

    return run


def _arrow_block(**more):
    kinds = {"dim": pa.int32(), "many": pa.int32(), "ids": pa.binary(), "labels": pa.binary(), "keys": pa.binary(), "vecs": pa.binary(), "norm": pa.float64()}
    return pa.schema(list((kinds | more).items()))


def _choose_pivots(rows: pd.DataFrame) -> pd.DataFrame:
    """Farthest-first pivots of one dimension's sampled rows."""
    dim = int(rows["dim"].iloc[0])
    x = np.array(rows.sort_values("key")["vec"].tolist(), np.float64).reshape(len(rows), dim)
    chosen, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(PIVOTS, len(x)):
        far = int(near.argmax())
        if near[far] == 0:
            break
        chosen.append(far)
        near = np.minimum(near, ((x - x[far]) ** 2).sum(1))
    return pd.DataFrame({"dim": [dim], "pivots": [x[chosen].tobytes()]})


def _distances(vecs: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    """Distances of augmented vectors to augmented pivots: one row for each pivot."""
    x = vecs.astype(np.float64)
    return np.stack([np.sqrt(((x - p) ** 2).sum(1) + (extra - e) ** 2) for p, e in zip(pivots, pivot_extra, strict=True)]) if len(pivots) else np.empty((0, len(x)))


def _with_distances(anchors: bool):
    """Adds the stored pivot distances to blocks joined with their dimension's ``pivots`` and largest squared norm ``m2``."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                dim = row["dim"]
                vecs = np.frombuffer(row["vecs"], np.int32).reshape(row["many"], dim)
                pivots = np.frombuffer(row["pivots"], np.float64)
                pivots = pivots.reshape(-1, dim) if dim else np.empty((0, 0))
                lift = lambda v: np.sqrt(np.maximum(row["m2"] - (v.astype(np.float64) ** 2).sum(1), 0.0))  # noqa: B023, E731
                extra = np.zeros(len(vecs)) if anchors else lift(vecs)
                out.append(_distances(vecs, extra, pivots, lift(pivots)).tobytes())
            dropped = [batch.column(n) for n in batch.schema.names if n != "pivots"]
            names = [n for n in batch.schema.names if n != "pivots"]
            yield pa.RecordBatch.from_arrays([*dropped, pa.array(out, pa.binary())], [*names, "far"])

    return run


class _Block:
    def __init__(self, row: dict, prefix: str, dim: int):
        get = lambda n: row[prefix + n]
        self.n = get("many")
        self.ids, self.labels, self.keys = (np.frombuffer(get(n), np.int64) for n in ("ids", "labels", "keys"))
        self.vecs = np.frombuffer(get("vecs"), np.int32).reshape(self.n, dim)
        self.far = np.frombuffer(get("far"), np.float64)
        self.far = self.far.reshape(-1, self.n) if self.n else self.far.reshape(0, 0)
        self.norms = (self.vecs.astype(np.float64) ** 2).sum(1)
        self.top = int(np.abs(self.vecs.astype(np.int64)).max(initial=0))


def bracket(a: _Block, ai: np.ndarray, r: _Block, ri: np.ndarray, m2: float):
    """Least and largest score that the pivot distances allow, anchors by rows; with room for rounding."""
    shape = (len(ai), len(ri))
    low, high = np.zeros(shape), np.full(shape, np.inf)
    for da, dr in zip(a.far, r.far, strict=True):
        np.maximum(low, np.abs(da[ai][:, None] - dr[ri][None, :]), out=low)
        np.minimum(high, da[ai][:, None] + dr[ri][None, :], out=high)
    whole = (a.norms[ai] + m2)[:, None]
    room = 1.0 + 1e-9 * whole
    return (whole - high**2) / 2 - room, (whole - low**2) / 2 + room


def exact(a: _Block, ai: np.ndarray, r: _Block, ri: np.ndarray) -> np.ndarray:
    """Integer scores, anchors by rows."""
    x, y = a.vecs[ai], r.vecs[ri]
    if a.vecs.shape[1] * a.top * r.top < 2**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T  # wraps modulo 2^64 on its way to a sum below 2^62


class _Best:
    """For each list (a number) the first ``keep`` entries by score, id and key."""

    def __init__(self, lists: int, keep: int):
        self.keep = keep
        self.rows = [np.empty(0, np.int64)] * 4  # list, score, id, key
        self.bound = np.full(lists, -np.inf)  # an entry below it cannot be among the first

    def add(self, lists, scores, ids, keys) -> None:
        ok = scores >= self.bound[lists]
        if not ok.any():
            return
        g, s, i, k = (np.concatenate([old, new[ok]]) for old, new in zip(self.rows, (lists, scores, ids, keys), strict=True))
        order = np.lexsort((k, i, -s, g))
        g, s, i, k = g[order], s[order], i[order], k[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        start = np.flatnonzero(new)
        rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
        self.bound[g[rank == self.keep - 1]] = s[rank == self.keep - 1]
        ok = rank < self.keep
        self.rows = [g[ok], s[ok], i[ok], k[ok]]


def _ranges(n: int, step: int):
    return (np.arange(at, min(n, at + step)) for at in range(0, n, step))


def _near_same(a: _Block, r: _Block, m2: float, best: _Best) -> None:
    """Offers each anchor the rows of its label."""
    for label in np.intersect1d(a.labels, r.labels):
        ri, mine = np.flatnonzero(r.labels == label), np.flatnonzero(a.labels == label)
        for cut in _ranges(len(mine), max(1, PAIRS // len(ri))):
            ai = mine[cut]
            low, high = bracket(a, ai, r, ri, m2)
            if len(ri) >= best.keep:  # so many rows reach at least this
                sure = np.partition(low, len(ri) - best.keep, axis=1)[:, len(ri) - best.keep]
                best.bound[ai] = np.maximum(best.bound[ai], np.floor(sure))
            _offer(a, ai, r, ri, ~(high < best.bound[ai][:, None]), lambda rows, s, ai=ai: best.add(ai[rows[0]], s, r.ids[ri[rows[1]]], r.keys[ri[rows[1]]]))  # noqa: B023


def _offer(a, ai, r, ri, mask, give) -> None:
    """Scores what the brackets leave and gives it on."""
    some_a, some_r = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    if len(some_a):
        scores = exact(a, ai[some_a], r, ri[some_r])
        x, y = np.nonzero(mask[np.ix_(some_a, some_r)])
        give((some_a[x], some_r[y]), scores[x, y])


def _near_other(a: _Block, r: _Block, m2: float, best: _Best, scores: np.ndarray, share: tuple[int, int]) -> None:
    """Offers each anchor and positive the rows of other labels whose score lies in the positive's range."""
    num, den = share
    slots = scores.shape[1]
    real = scores != _NONE
    least = np.where(real & (scores >= 0), -((-num * scores.astype(object)) // den), _NONE).astype(np.int64)  # a range below zero is empty
    ok = real & (scores >= 0)
    for ai in _ranges(a.n, max(1, PAIRS // max(1, r.n))):
        ai = ai[ok[ai].any(1)]
        if not len(ai):
            continue
        ri = np.arange(r.n)
        low, high = bracket(a, ai, r, ri, m2)
        bound = best.bound.reshape(a.n, slots)[ai]
        wanted = np.zeros(low.shape, bool)
        for j in range(slots):
            need = np.maximum(least[ai, j], bound[:, j])
            wanted |= ok[ai, j][:, None] & ~(high < need[:, None]) & ~(low > scores[ai, j][:, None])
        wanted &= a.labels[ai][:, None] != r.labels[None, :]

        def give(rows, s, ai=ai):
            x, y = ai[rows[0]], rows[1]
            for j in range(slots):
                fits = ok[x, j] & (s >= least[x, j]) & (s <= scores[x, j])
                best.add(x[fits] * slots + j, s[fits], r.ids[y[fits]], r.keys[y[fits]])

        _offer(a, ai, r, ri, wanted, give)


_NONE = np.iinfo(np.int64).min


def _search(keep: int, slots: int, share: tuple[int, int] | None):
    """A task over joined blocks: best rows of each anchor (and slot) of what it has seen."""

    def told(anchors: _Block, best: _Best):
        g, s, i, k = best.rows
        x = g // slots
        return pa.RecordBatch.from_pydict({"anchor_id": anchors.ids[x], "anchor_key": anchors.keys[x], "slot": (g % slots).astype(np.int32), "score": s, "vec_id": i, "key": k})

    def run(batches):
        have: dict[tuple, tuple] = {}
        for batch in batches:
            for row in batch.to_pylist():
                name = (row["dim"], row["ab"])
                if name not in have:
                    if have and sum(len(b.bound) for _, b, _ in have.values()) * keep > KEPT:
                        yield from (told(a, b) for a, b, _ in have.values())
                        have.clear()
                    a = _Block(row, "a_", row["dim"])
                    scores = np.frombuffer(row["a_scores"], np.int64).reshape(a.n, slots)
                    have[name] = (a, _Best(a.n * slots, keep), scores)
                a, best, scores = have[name]
                rows = _Block(row, "", row["dim"])
                if share is None:
                    _near_same(a, rows, row["m2"], best)
                else:
                    _near_other(a, rows, row["m2"], best, scores, share)
        yield from (told(a, b) for a, b, _ in have.values())

    return run


def _anchor_blocks(anchors: DataFrame, table: DataFrame, slots: int) -> DataFrame:
    """Blocks of ``anchors(dim, bucket, vec_id, key, label, vec, scores)`` with their pivot distances."""

    def pack(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rows = sorted(row["rows"], key=lambda x: (x["vec_id"], x["key"]))
                ids, keys, labels = (np.array([x[c] for x in rows], np.int64) for c in ("vec_id", "key", "label"))
                vecs = np.array([x["vec"] for x in rows], np.int32).reshape(len(rows), row["dim"])
                scores = np.full((len(rows), slots), _NONE, np.int64)
                for i, x in enumerate(rows):
                    got = x["scores"] or []
                    scores[i, : len(got)] = got
                norm = float((vecs.astype(np.float64) ** 2).sum(1).max(initial=0.0))
                out.append({"dim": row["dim"], "many": len(rows), "ids": ids.tobytes(), "labels": labels.tobytes(), "keys": keys.tobytes(), "vecs": vecs.tobytes(), "norm": norm, "ab": row["bucket"], "scores": scores.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=_arrow_block(ab=pa.int64(), scores=pa.binary()))

    grouped = anchors.groupBy("dim", "bucket").agg(F.collect_list(F.struct("vec_id", "key", "label", "vec", "scores")).alias("rows"))  # about ANCHORS each
    blocks = map_arrow(grouped, pack, _BLOCK + ", ab bigint, scores binary").join(table, "dim")
    return map_arrow(blocks, _with_distances(True), "dim int, many int, ids binary, labels binary, keys binary, vecs binary, norm double, ab bigint, scores binary, m2 double, far binary")


def _compared(blocks: DataFrame, groups: int, anchor_blocks: DataFrame, keep: int, slots: int, share) -> DataFrame:
    """``anchor_id, anchor_key, slot, score, vec_id, key``: the best rows that each task found.

    A block of rows goes to each anchor block of its dimension; the anchor block
    to as many places as there are groups of row blocks, so that no key is hot.
    """
    anchor_blocks = materialize(anchor_blocks, "anchor-blocks")
    salt = F.pmod(F.xxhash64("spot"), F.lit(groups))
    have = F.broadcast(anchor_blocks.select("dim", "ab"))  # one small row for ANCHORS anchors
    rows = blocks.join(have, "dim").withColumn("salt", salt)
    names = ("many", "ids", "labels", "keys", "vecs", "far", "scores")
    side = anchor_blocks.select("dim", "ab", F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("salt"), *(F.col(c).alias(f"a_{c}") for c in names))
    met = rows.join(side.hint("merge"), ["dim", "ab", "salt"]).drop("spot", "salt")
    return map_arrow(met, _search(keep, slots, share), "anchor_id bigint, anchor_key bigint, slot int, score bigint, vec_id bigint, key bigint")


def mine_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), label: Column | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose vec_id is divisible by ``every``; an anchor's
    positives its first ``positives`` other rows of the same label; for each of
    them come the first ``negatives`` rows of other labels with
    ``share * positive_score <= negative_score <= positive_score``.  Higher
    scores come first, ties by smaller vec_id (then by a hash of the row).
    ``label`` replaces the label column.

    Which rows take part is told in ``usable_rows``; only vectors of one
    dimension are compared.  Repeated rows count one by one, as rows and as
    anchors; an anchor is never its own positive, a repetition of it is.  A
    negative positive_score leaves an empty range.  An empty table gives no row.
    """
    with scratch(embeddings.sparkSession):
        return materialize(_mined(embeddings, every, positives, negatives, share, label), "negatives", outer=True)


def _mined(embeddings, every, positives, negatives, share, label) -> DataFrame:
    rows = usable_rows(embeddings, label)
    blocks = materialize(map_arrow(rows.select("vec_id", "key", "label", "dim", "vec"), _pack(ROWS), _BLOCK + ", spot bigint"), "blocks")
    # a bounded sample of each dimension gives its pivots
    few = Window.partitionBy("dim").orderBy("key", "vec_id")
    sample = rows.withColumn("r", F.row_number().over(few)).where(F.col("r") <= PIVOT_SAMPLE).select("dim", "key", "vec")
    pivots = sample.groupBy("dim").applyInPandas(_choose_pivots, "dim int, pivots binary")
    table = materialize(blocks.groupBy("dim").agg(F.max("norm").alias("m2")).join(pivots, "dim"), "pivots")
    fields = "dim int, many int, ids binary, labels binary, keys binary, vecs binary, norm double, spot bigint, m2 double, far binary"
    blocks = materialize(map_arrow(blocks.join(table, "dim"), _with_distances(False), fields), "pivot-table")
    groups = max(1, blocks.select("spot").distinct().count())
    # equal anchor rows are searched for once
    mine = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "key").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.count("*").alias("times"))
    mine = materialize(mine, "anchors")
    # a round number of blocks for each dimension
    sizes = mine.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(ANCHORS)).alias("b"))
    mine = mine.join(sizes, "dim").withColumn("bucket", F.pmod(F.xxhash64("key"), F.col("b"))).drop("b")
    none = F.lit(None).cast("array<bigint>")
    found = _compared(blocks, groups, _anchor_blocks(mine.withColumn("scores", none), table, 1), positives + 1, 1, None)
    first = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("score"), "vec_id", "key")
    found = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives + 1)
    own = F.min(F.when((F.col("vec_id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key")), F.col("r"))).over(Window.partitionBy("anchor_id", "anchor_key"))
    found = found.withColumn("own", F.coalesce(own, F.lit(1 << 30))).where("r <> own").withColumn("slot", F.col("r") - F.when(F.col("r") > F.col("own"), 1).otherwise(0) - 1)
    good = materialize(found.where(F.col("slot") < positives).select("anchor_id", "anchor_key", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    lists = good.groupBy("anchor_id", "anchor_key").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("l"))
    lists = lists.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("key"), F.col("l.positive_score").alias("scores"))
    hard = _compared(blocks, groups, _anchor_blocks(mine.join(lists, ["vec_id", "key"]), table, positives), negatives, positives, share)
    order = Window.partitionBy("anchor_id", "anchor_key", "slot").orderBy(F.desc("score"), "vec_id", "key")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = hard.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").drop("key").join(good, ["anchor_id", "anchor_key", "slot"])
    times = mine.select(F.col("vec_id").alias("anchor_id"), F.col("key").alias("anchor_key"), "times")
    out = out.join(times, ["anchor_id", "anchor_key"]).withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
