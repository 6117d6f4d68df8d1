"""Near-duplicate embeddings by a forest of random-projection trees.

Trees split by random directions at the median, down to leaves of a bounded
expected size; vectors near a split go to both sides (spill).  Vectors are
compared within leaves only.  A pair found in several leaves counts once: in
the first leaf that both share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, map_arrow, materialize, scratch

TREES = 6
#: Vectors sampled to fit the trees, and the leaf size aimed at in the whole table.
SAMPLE, LEAF = 20_000, 400
#: Vectors on both sides of a split: those within so much of it (unit vectors; a linked pair's projections differ by 0.2 / sqrt(dim) or so).
SPILL = 0.02
#: Rows of a leaf compared in one task; larger leaves are compared block by block.
BLOCK = 1024
#: Leaves looked at together when a pair's first common leaf is found.
LEAVES = 512
SEED = 7


class Forest:
    """Random-projection trees over unit vectors of one dimension."""

    def __init__(self, sample: np.ndarray, leaf: float, trees: int = TREES, spill: float = SPILL):
        rng = np.random.default_rng(SEED)
        self.spill, self.trees, self.dirs, self.leaves = spill, [], [], 0
        for _ in range(trees):
            self.trees.append(self._grow(sample, np.arange(len(sample)), leaf, rng, 0))
        self.dirs = np.array(self.dirs) if self.dirs else np.zeros((0, sample.shape[1]))

    def _grow(self, x, rows, leaf, rng, depth):
        if len(rows) > max(leaf, 4) and depth < 40:
            # of a few directions the one that spreads these vectors most
            dirs = rng.standard_normal((8, x.shape[1]))
            dirs /= np.linalg.norm(dirs, axis=1, keepdims=True)
            proj = x[rows] @ dirs.T
            d = int(proj.std(0).argmax())
            p = proj[:, d]
            cut = float(np.median(p))
            low, high = rows[p <= cut + self.spill], rows[p > cut - self.spill]
            if max(len(low), len(high)) <= 0.9 * len(rows):
                at = len(self.dirs)
                self.dirs.append(dirs[d])
                return (at, cut, self._grow(x, low, leaf, rng, depth + 1), self._grow(x, high, leaf, rng, depth + 1))
        self.leaves += 1
        return self.leaves - 1

    def leaves_of(self, x: np.ndarray) -> list[np.ndarray]:
        """For each vector the sorted numbers of its leaves.

        A split projects the vectors that come to it and no others: the splits grow with the table, so a matrix of all
        vectors and all splits would too.
        """
        rows, numbers = [], []

        def down(node, at):
            if not len(at):
                return
            if isinstance(node, int):
                rows.append(at)
                numbers.append(np.full(len(at), node))
                return
            d, cut, low, high = node
            p = x[at] @ self.dirs[d]
            down(low, at[p <= cut + self.spill])
            down(high, at[p > cut - self.spill])

        for t in self.trees:
            down(t, np.arange(len(x)))
        r, v = np.concatenate(rows), np.concatenate(numbers)
        order = np.lexsort((v, r))
        r, v = r[order], v[order]
        return np.split(v.astype(np.int32), np.searchsorted(r, np.arange(1, len(x))))


def _unit(values: pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(values.values.cast(pa.float64()).buffers()[1], np.float64)
    offs = values.offsets.to_numpy()
    x = x[values.values.offset + offs[0] : values.values.offset + offs[-1]].reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _router(held):
    def run(batches):
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                part = pa.Table.from_batches([batch]).filter(pa.array(dims == dim)).combine_chunks().to_batches()
                for b in part:
                    forest = held.value.get(int(dim))
                    leaves = forest.leaves_of(_unit(b.column(1), int(dim))) if forest else [np.zeros(1, np.int32)] * len(b)
                    offs = np.concatenate([[0], np.cumsum([len(v) for v in leaves])]).astype(np.int32)
                    yield pa.RecordBatch.from_pydict(
                        {"vec_id": b.column(0), "v": b.column(1), "label": b.column(2), "dim": b.column(3), "leaves": pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(leaves)))}
                    )

    return run


def _shared(flat: np.ndarray, offs: np.ndarray, one: np.ndarray, two: np.ndarray, below: int):
    """0/1 matrices of the rows ``one`` and ``two`` by the leaves under ``below`` that hold rows of both, LEAVES at a time.

    Rows of one leaf meet in more and more others as the table grows, so the matrices of all would too.
    """
    lists = [[flat[offs[i] : offs[i + 1]] for i in at] for at in (one, two)]
    known = np.intersect1d(*(np.concatenate(own) for own in lists))
    known = known[known < below]
    places = []
    for own in lists:
        row, inner = np.repeat(np.arange(len(own)), [len(v) for v in own]), np.concatenate(own)
        kept = np.isin(inner, known)
        places.append((len(own), row[kept], np.searchsorted(known, inner[kept])))
    for k in range(0, len(known), LEAVES):
        out = []
        for n, row, at in places:
            here = (at >= k) & (at < k + LEAVES)
            held = np.zeros((n, min(LEAVES, len(known) - k)), np.float32)
            held[row[here], at[here] - k] = 1
            out.append(held)
        yield out


def _compare(threshold: float):
    """One group: the rows of a leaf in blocks a and b (a <= b); links owned by this leaf, counted for each vector."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, dim, leaf, a, b = (k.as_py() for k in key)
        table = table.combine_chunks()
        block = table["block"].to_numpy()
        ids = table["vec_id"].to_numpy()
        x = _unit(table["v"].chunk(0), dim)
        lists = table["leaves"].chunk(0)
        offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        ia, ib = np.flatnonzero(block == a), np.flatnonzero(block == b)
        near = np.zeros((len(ia), len(ib)), bool)
        for r in range(0, len(ia), 256):
            near[r : r + 256] = x[ia[r : r + 256]] @ x[ib].T >= threshold
        near &= ids[ia][:, None] != ids[ib][None, :]
        # components of these links by least labels
        label, top = ids.copy(), np.iinfo(np.int64).max
        while near.any():
            new = label.copy()
            np.minimum.at(new, ia, np.where(near, label[ib][None, :], top).min(1))
            np.minimum.at(new, ib, np.where(near, new[ia][:, None], top).min(0))
            if (new == label).all():
                break
            label = new
        # a pair counts where no leaf of a smaller number holds both
        if near.any():
            ra, rb = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            for held_a, held_b in _shared(flat, offs, ia[ra], ib[rb], leaf):
                near[np.ix_(ra, rb)] &= (held_a @ held_b.T) == 0
        links = np.zeros(len(ids), np.int64)
        links[ia] += near.sum(1)
        if a != b:
            links[ib] += near.sum(0)
        some = (links > 0) | (label < ids)
        return pa.table({"vec_id": ids[some], "links": links[some], "low": label[some]})

    return run


def embedding_links(vectors: DataFrame, threshold: float = 0.98, sample: int = SAMPLE, leaf: int = LEAF, trees: int = TREES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector of ``vectors(vec_id, embedding, label)``.

    Vectors with equal labels and dimension are linked at cosine >= threshold,
    computed in double precision within leaves.  Null labels, null or zero
    vectors and those with null or non-finite components link with nothing.
    Repeated rows of a vec_id are one vector (the least by label and
    components); a null vec_id is not linked and gives a row with null component.
    Trees are fitted on at most ``sample`` vectors; every row is indexed.
    """
    with scratch(vectors.sparkSession):
        return materialize(_links(vectors, threshold, sample, leaf, trees), "embedding-links", outer=True)


def _links(vectors: DataFrame, threshold: float, sample: int, leaf: int, trees: int) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("bigint").alias("label"))
    first = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1.7e308)) & F.exists("v", lambda c: c != 0)
    good = first.where(F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    # scaled by the largest component, so that no norm overflows
    good = good.select("vec_id", F.transform("v", lambda c: c / F.array_max(F.transform("v", lambda e: F.abs(e)))).alias("v"), "label", F.size("v").alias("dim"))
    good = materialize(good, "vectors")
    sizes = {r[0]: r[1] for r in good.groupBy("dim").count().orderBy(F.desc("count")).limit(64).collect()}
    forests = {}
    for dim, n in sizes.items():
        picked = good.where(F.col("dim") == dim)
        if n > sample:
            picked = picked.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1_000_000)) < int(1_000_000 * sample / n))
        got = picked.select("v").limit(2 * sample).toArrow()["v"].combine_chunks()
        if len(got):
            got = got.chunk(0) if isinstance(got, pa.ChunkedArray) else got
            forests[dim] = Forest(_unit(got, dim), max(16.0, leaf * len(got) / n), trees)
    held = spark.sparkContext.broadcast(forests)
    routed = materialize(map_arrow(good, _router(held), "vec_id bigint, v array<double>, label bigint, dim int, leaves array<int>"), "routed")
    placed = routed.withColumn("leaf", F.explode("leaves"))
    counts = placed.groupBy("label", "dim", "leaf").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    placed = placed.join(counts.where("count > 1").drop("count"), ["label", "dim", "leaf"])
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("a"), F.greatest(o, F.col("block")).alias("b"))
    )
    grouped = placed.withColumn("block", block).withColumn("to", F.explode(pairs)).select("label", "dim", "leaf", "to.a", "to.b", "vec_id", "v", "leaves", "block")
    found = grouped.groupBy("label", "dim", "leaf", "a", "b").applyInArrow(_compare(threshold), "vec_id bigint, links bigint, low bigint")
    found = materialize(found, "found")
    comps = materialize(connected_components(found.where("low < vec_id").select(F.col("vec_id").alias("src"), F.col("low").alias("dst"))), "components")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    ids = first.select("vec_id").union(rows.where("vec_id is null").select("vec_id"))
    return (
        ids.join(links, "vec_id", "left")
        .join(comps.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
