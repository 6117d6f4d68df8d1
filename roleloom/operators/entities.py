"""Entity resolution, greedy in order or by hashed candidates and components (PIP-06)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from .graph import equivalence, stored


def resolve_in_order(mentions: DataFrame, threshold: float = 0.85, within: str = "scope") -> DataFrame:
    """Greedy: each mention of ``within, seq, mention, vector`` joins the most similar canonical name so far if its
    cosine reaches ``threshold``, else it becomes one.  Depends on the order, so a scope is one task; use
    ``resolve_by_components`` where scopes are not bounded.  Null mentions or vectors resolve to themselves."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        known, names, rows, out = {}, [], [], []
        for m, v in part.sort_values(["seq", "mention"])[["mention", "vector"]].itertuples(index=False):
            name = m.strip() if m is not None else None
            got = known.get(name, known.get(name.lower())) if name is not None else None
            unit = np.asarray(v, dtype=float) if v is not None and got is None and name is not None else np.zeros(0)
            norm = np.linalg.norm(unit)
            if got is None and norm > 0 and rows:
                scores = np.stack(rows) @ (unit / norm)
                best = int(scores.argmax())
                got = names[best] if scores[best] >= threshold else None
            if got is None and name is not None:
                got = name
                if norm > 0:
                    names.append(name)
                    rows.append(unit / norm)
            if name is not None:
                known[name] = got
            out.append((m, got))
        return pd.DataFrame({within: part[within].iloc[0], "mention": [a for a, _ in out], "canonical": [b for _, b in out]})

    kind = mentions.schema[within].dataType.simpleString()
    return mentions.groupBy(within).applyInPandas(run, f"{within} {kind}, mention string, canonical string").distinct()


def buckets(dim: int, bits: int, tables: int, seed: int = 7):
    """Sides of ``bits`` random hyperplanes in each of ``tables`` tables as one number a table."""
    planes = np.random.default_rng(seed).standard_normal((dim, bits * tables))
    weights = 1 << np.arange(bits)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(vectors: pd.Series) -> pd.Series:
        m = np.stack([np.asarray(v, dtype=float) for v in vectors]) if len(vectors) else np.zeros((0, dim))
        sides = (m @ planes > 0).reshape(len(m), tables, bits)
        return pd.Series(list((sides * weights).sum(axis=2)), dtype=object)

    return run


#: Rows of a bucket compared in one task by as many others, and how far a product's rounding may be off.
BLOCK, SURE = 1024, 1e-9


def _near_pairs(threshold: float):
    """``src, dst`` that join what is near in the blocks a and b of a bucket: each row and the least one it hangs together with.

    Cosines close to the threshold are summed component by component, like ``text.cosine``.
    """

    def run(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, b = group[2].as_py(), group[3].as_py()
        table = table.combine_chunks().sort_by("key")
        block, v = table["block"].to_numpy(), table["vector"].combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        n = np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
        ia, ib = np.flatnonzero(block == a), np.flatnonzero(block == b)
        cos = (x[ia] @ x[ib].T) / (n[ia][:, None] * n[ib])
        near = ~(cos < threshold)  # what is no number counts as near, as in Spark's comparison
        for i, j in np.argwhere(np.abs(cos - threshold) <= SURE):
            one, two = ia[i], ib[j]
            near[i, j] = np.cumsum(x[one] * x[two])[-1] / (n[one] * n[two]) >= threshold
        label = np.arange(len(x))
        while True:
            new = label.copy()
            np.minimum.at(new, ia, np.where(near, label[ib], len(x)).min(1, initial=len(x)))
            np.minimum.at(new, ib, np.where(near, new[ia][:, None], len(x)).min(0, initial=len(x)))
            if (new == label).all():
                break
            label = new
        some = np.flatnonzero(label < np.arange(len(x)))
        return pa.table({"src": table["key"].take(some), "dst": table["key"].take(label[some])})

    return run


def resolve_by_components(mentions: DataFrame, dim: int, threshold: float = 0.85, bits: int = 8, tables: int = 20) -> DataFrame:
    """Scalable: ``mention, canonical`` where names that share a key or a verified cosine are one entity.

    ``mentions(seq, mention, vector)``; the canonical name is the earliest.  Names are reduced to one row a key before
    they are compared, candidates share a hyperplane bucket, and only distinct vectors are verified, in blocks of at most
    BLOCK rows of a bucket by BLOCK; of what is near in a block only links that hold it together are kept.  At a cosine
    of 0.85 a pair shares one of the default buckets with probability 0.99; raise ``bits`` with the logarithm of the
    number of names to keep buckets small, and ``tables`` with it to keep that probability.
    """
    named = mentions.where("mention is not null").select("seq", text.strip(F.col("mention")).alias("mention"), text.key(F.col("mention")).alias("key"), "vector")
    first = named.groupBy("key").agg(F.min(F.struct("seq", "mention")).alias("first"), F.min_by("vector", F.struct("seq", "mention")).alias("vector"))
    usable = first.where((F.size("vector") == dim) & (text.dot(F.col("vector"), F.col("vector")) > 0))
    # equal vectors are one: a copy shares all buckets of the least key's, and a cosine of about 1 with it
    alike = usable.groupBy("vector").agg(F.min("key").alias("key"))
    if threshold > 1 - SURE:
        alike = usable.select("vector", "key")
    alike = stored(alike)
    copies = usable.join(alike.withColumnRenamed("key", "dst"), "vector").where("key <> dst").select(F.col("key").alias("src"), "dst")
    hashed = alike.select("key", "vector", F.posexplode(buckets(dim, bits, tables)("vector")).alias("table", "bucket"))
    counts = hashed.groupBy("table", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = hashed.join(F.broadcast(counts), ["table", "bucket"]).withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("a"), F.greatest(o, "block").alias("b")))
    grouped = dealt.select("table", "bucket", "key", "vector", "block", F.explode(meets).alias("m")).select("*", "m.a", "m.b").groupBy("table", "bucket", "a", "b")
    pairs = grouped.applyInArrow(_near_pairs(threshold), "src string, dst string").union(copies).distinct()
    classes = equivalence(pairs).select(F.col("node").alias("key"), F.col("canonical").alias("class"))
    whole = first.join(classes, "key", "left").withColumn("class", F.coalesce("class", "key"))
    heads = whole.groupBy("class").agg(F.min("first").alias("head"))
    names = whole.join(heads, "class").select("key", F.col("head.mention").alias("canonical"))
    return named.select("key", "mention").distinct().join(names, "key").select("mention", "canonical")
