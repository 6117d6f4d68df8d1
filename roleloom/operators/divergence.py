"""What two points of view make of the paths between two nodes (PIP-32)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chains
from .graph import stored


def _reached(edges: DataFrame, start: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """``pair, node`` of what each pair's start reaches, itself included; only nodes of ``within(pair, node)`` if given."""
    front = start if within is None else start.join(within, ["pair", "node"], "left_semi")
    front = seen = stored(front.distinct())
    while not front.isEmpty():
        new = front.join(edges, front.node == edges.src).select("pair", F.col("dst").alias("node")).distinct()
        if within is not None:
            new = new.join(within, ["pair", "node"], "left_semi")
        front = stored(new.join(seen, ["pair", "node"], "left_anti"))
        seen = stored(seen.union(front))
    return seen


def on_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pair, node``: the nodes on some path of ``edges(src, dst)`` from ``src`` to ``dst`` of ``pairs(pair, src, dst)``.

    A pair's ends count among them if there is a path; a node is on the path from itself to itself.  Chains count as
    one step, the way back only enters what the way forth has reached.  Null ends have no path.
    """
    p = stored(pairs.where("src is not null and dst is not null").select("pair", "src", "dst"))
    ends = p.select(F.col("src").alias("node")).union(p.select("dst"))
    c = chains.contract(chains._simple(edges), keep=ends)
    core = stored(c.core.select("src", "dst").distinct())
    ahead = _reached(core, p.select("pair", F.col("src").alias("node")))
    both = _reached(core.toDF("dst", "src"), p.select("pair", F.col("dst").alias("node")), within=ahead)
    inside = c.members.join(both.withColumnRenamed("node", "head"), "head").join(both.withColumnRenamed("node", "tail"), ["pair", "tail"]).select("pair", "node")
    return both.union(inside)


def divergences(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """PIP-32: ``pair, n_identities, n_differing, verdict`` for each of ``pairs(pair, src, dst)``.

    ``edges(src, dst, identity, one, two)``: whether the edge is an identity and whether either point of view accepts it.
    A pair diverges if the points of view differ on an identity on some path between its ends.  Null flags count as
    false.  Parallel edges count each.  Without a path, or without an identity on one, the verdict is CONVERGENCE.
    """
    nodes = stored(on_paths(edges, pairs))
    e = edges.where(F.coalesce("identity", F.lit(False))).select("src", "dst", (F.coalesce("one", F.lit(False)) != F.coalesce("two", F.lit(False))).cast("bigint").alias("differs"))
    on = e.join(nodes.withColumnRenamed("node", "src"), "src").join(nodes.withColumnRenamed("node", "dst"), ["pair", "dst"])
    sums = on.groupBy("pair").agg(F.count("*").alias("n_identities"), F.sum("differs").alias("n_differing"))
    told = pairs.select("pair").distinct().join(sums, "pair", "left").fillna(0, ["n_identities", "n_differing"])
    return told.withColumn("verdict", F.when(F.col("n_differing") > 0, "DIVERGENCE").otherwise("CONVERGENCE"))
