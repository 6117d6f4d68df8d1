"""Frames that queries read together: pairs by support, clusters, coherence (AGG-21, AGG-20)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import equivalence, stored

#: Pairs that one task counts.
PAIRS = 250_000


def _reads(accesses: DataFrame) -> DataFrame:
    return accesses.where("query is not null and frame is not null").select("query", "frame").distinct()


def _pairs(reads: DataFrame, keys: list[str]) -> DataFrame:
    """``a, b, n``: how many queries read both frames, of those that agree in ``keys``; ``a < b``.

    Pairs are counted in as many parts as their number asks for, so a task holds about PAIRS of them at any size.
    """
    conf = reads.sparkSession.conf.get("spark.sql.shuffle.partitions")
    per = reads.groupBy(*keys).agg(F.count("*").alias("n"))
    total = per.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    parts = max(int(conf), math.ceil(total / PAIRS))
    dealt = reads.repartition(parts, *keys)
    other = dealt.select(*keys, F.col("frame").alias("b"))
    both = dealt.select(*keys, F.col("frame").alias("a")).join(other, keys).where("a < b")
    named = [*(k for k in keys if k != "query"), "a", "b"]
    # few pairs repeat within a task: they are dealt as they are, not summed up before
    return both.select(*named).repartition(parts, *named).groupBy(*named).agg(F.count("*").alias("n"))


def co_accesses(accesses: DataFrame, least: int) -> DataFrame:
    """``a, b, n`` of the frames ``a < b`` that at least ``least`` queries of ``accesses(query, frame)`` read both.

    A frame read twice by a query counts once; rows with a null are left out.  A pair cannot have more queries than
    its rarer frame, so frames with too few are dropped before rows meet: the result is the same, the join smaller.
    Pairs arise within one query only, so the work grows with the square of the frames a single query reads.
    """
    reads = _reads(accesses)
    often = reads.groupBy("frame").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("frame")
    return _pairs(stored(reads.join(often, "frame", "left_semi")), ["query"]).where(F.col("n") >= least)


def clusters(accesses: DataFrame, least: int, evict: float) -> DataFrame:
    """``cluster, n_frames, coherence, kept`` of the clusters that pairs of ``co_accesses`` join together.

    ``cluster`` is the least of its frames.  Coherence is the mean over all ordered pairs of its frames, a frame with
    itself included (1), of the share of queries reading one of both that read both.  ``kept`` unless it is below
    ``evict``.  Frames in no pair have no cluster.
    """
    reads = stored(_reads(accesses))
    pairs = stored(co_accesses(reads, least).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    members = stored(equivalence(pairs).select(F.col("node").alias("frame"), F.col("canonical").alias("cluster")))
    inside = stored(reads.join(members, "frame"))
    support = inside.groupBy("frame").agg(F.count("*").alias("n"))
    of = lambda x: support.select(F.col("frame").alias(x), F.col("n").alias(f"n_{x}"))
    alike = _pairs(inside, ["cluster", "query"]).join(of("a"), "a").join(of("b"), "b")
    # rounded sums do not depend on the order of rows
    share = (F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))).cast("decimal(20,15)")
    sums = alike.groupBy("cluster").agg(F.sum(share).cast("double").alias("alike"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n_frames"))
    coherence = (F.col("n_frames") + 2 * F.col("alike")) / (F.col("n_frames") * F.col("n_frames"))
    return sizes.join(sums, "cluster").select("cluster", "n_frames", F.round(coherence, 9).alias("coherence"), (F.round(coherence, 9) >= evict).alias("kept"))
