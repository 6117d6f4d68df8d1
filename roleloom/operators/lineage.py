"""Trees and chains given by a parent in each row: traces, refinements, versions (JN-21, JN-22)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import stored

#: A parent's rows meet it in so many parts, however many there are.
PARTS = 64


def _met(rows: DataFrame, key: str, at: DataFrame) -> DataFrame:
    """``rows`` joined with ``at`` (one row a ``key``); rows of one key are reduced to at most PARTS before they meet ``at``."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))
    asked = dealt.groupBy(key, "part").agg(F.lit(True).alias("asked")).drop("asked")
    return dealt.join(asked.join(at, key), [key, "part"]).drop("part")


def ancestry(links: DataFrame) -> DataFrame:
    """``node, parent, root, depth, state`` for each node of ``links(node, parent)``, in the logarithm of the depth rounds.

    ``state``: ``ROOT`` without a parent, ``ORPHAN`` with a parent that is no node (also its own root, depth 0),
    ``CHILD``, or ``CYCLE`` where the way up never ends (root and depth null).  Rows without a node are left out; of
    several parents of a node the least counts.  Extra columns are ignored; an empty table gives no row.

    Every pointer jumps to where its target points, so a chain of 10,000 takes 14 rounds.  A node that has found its
    root is written once and not moved again.
    """
    one = links.where("node is not null").groupBy("node").agg(F.min("parent").alias("parent"))
    one = stored(one)
    known = _met(one.where("parent is not null"), "parent", one.select(F.col("node").alias("parent"))).select("node", F.col("parent").alias("to"))
    tops = one.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("to"), F.lit(0).cast("bigint").alias("far"), F.lit(True).alias("done"))
    active = stored(known.withColumn("far", F.lit(1).cast("bigint")).withColumn("done", F.lit(False)))
    done, left, limit = [stored(tops)], active.count(), one.count().bit_length() + 1
    for _ in range(limit):
        if not left:
            break
        at = reduce(DataFrame.union, [*done, active]).select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("done").alias("done2"))
        moved = stored(_met(active.select("node", "to", "far"), "to", at).select("node", F.col("to2").alias("to"), (F.col("far") + F.col("far2")).alias("far"), F.col("done2").alias("done")))
        done, active = [*done, moved.where("done")], moved.where("not done")
        left = active.count()
    found = reduce(DataFrame.union, done).select("node", F.col("to").alias("root"), F.col("far").alias("depth"))
    state = F.when(F.col("root").isNull(), "CYCLE").when(F.col("depth") > 0, "CHILD").when(F.col("parent").isNull(), "ROOT").otherwise("ORPHAN")
    return one.join(found, "node", "left").select("node", "parent", "root", "depth", state.alias("state"))


def versions(links: DataFrame) -> DataFrame:
    """JN-22: ``node, root, version, latest`` of refinements ``links(node, parent)``.

    A root is version 1, what refines it version 2, and so on; ``latest`` where nothing refines the node.  Nodes on or
    behind a cycle have neither root nor version.
    """
    refined = links.where("node is not null and parent is not null").select(F.col("parent").alias("node")).distinct().withColumn("refined", F.lit(True))
    return ancestry(links).join(refined, "node", "left").select("node", "root", (F.col("depth") + 1).alias("version"), F.col("refined").isNull().alias("latest"))


def trace_sizes(links: DataFrame) -> DataFrame:
    """JN-21: ``root, n_nodes, n_levels`` of each trace of ``links(node, parent)``; rings without a root are left out."""
    return ancestry(links).where("root is not null").groupBy("root").agg(F.count("*").alias("n_nodes"), (F.max("depth") + 1).alias("n_levels"))
