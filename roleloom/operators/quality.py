"""Integrity validators: each returns the rows that violate a rule (VAL-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """VAL-09: key values with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """VAL-10: values without a parent."""
    return df.where(F.col(col).isNotNull()).join(parent.select(F.col(parent_col).alias(col)), col, "left_anti")


def bad_types(rows: DataFrame, col: str, allowed: list[str]) -> DataFrame:
    """VAL-08/FLT-26: rows of a type that is not on the list."""
    return rows.where(~F.coalesce(F.col(col).isin(allowed), F.lit(False)))


def without_participants(frames: DataFrame, parts: DataFrame) -> DataFrame:
    """VAL-02/JN-07."""
    return frames.join(parts, "frame_id", "left_anti")


def several_roles(parts: DataFrame) -> DataFrame:
    """VAL-11: one entity in more than one role of a frame."""
    return parts.groupBy("frame_id", "filler_key").agg(F.count("*").alias("n")).where("n > 1")


def ungrounded(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """VAL-05/STR-20: fillers that do not occur in the frame's sentence ``texts(frame_id, sentence)``."""
    return parts.join(texts, "frame_id").where(~F.contains(F.lower("sentence"), F.lower("filler"))).drop("sentence")


def illegal_moves(history: DataFrame, legal: list[tuple[str, str]]) -> DataFrame:
    """VAL-13: status changes of ``history(id, seq, status)`` that are not on the list."""
    w = Window.partitionBy("id").orderBy("seq")
    moves = history.select("id", F.lag("status").over(w).alias("before"), F.col("status").alias("after")).where("before is not null and before <> after")
    ok = F.lit(False)
    for a, b in legal:
        ok = ok | ((F.col("before") == a) & (F.col("after") == b))
    return moves.where(~ok)


def entity_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """VAL-01: edges of ``edges(src, dst)`` whose ends are both entities by ``nodes(node, kind)``."""
    entities = nodes.where("kind = 'entity'").select("node").distinct()
    first = edges.join(entities.withColumnRenamed("node", "src"), "src", "left_semi")
    return first.join(entities.withColumnRenamed("node", "dst"), "dst", "left_semi")


def stray_causes(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """VAL-03: causal links with an end that is not an event; an unknown end counts as none."""
    events = nodes.where("kind = 'event'").select("node", F.lit(True).alias("ok")).distinct()
    ends = links.join(events.select(F.col("node").alias("src"), F.col("ok").alias("a")), "src", "left").join(events.select(F.col("node").alias("dst"), F.col("ok").alias("b")), "dst", "left")
    return ends.where("a is null or b is null").drop("a", "b")


def unmarked_views(edges: DataFrame) -> DataFrame:
    """VAL-04: view edges not marked as derived; null counts as unmarked."""
    return edges.where(~F.coalesce("is_derived", F.lit(False)))


def missing_roles(frames: DataFrame, needed: DataFrame, parts: DataFrame) -> DataFrame:
    """VAL-06: ``frame_id, role`` that ``needed(kriya, role)`` asks for and ``parts(frame_id, role)`` does not hold."""
    return frames.select("frame_id", "kriya").join(needed, "kriya").select("frame_id", "role").join(parts.select("frame_id", "role"), ["frame_id", "role"], "left_anti")


def incompatible(parts: DataFrame, wanted: DataFrame, features: DataFrame) -> DataFrame:
    """VAL-07: fillers without all features that a role of an action wants.

    ``parts(frame_id, kriya, role, filler_key)``, ``wanted(kriya, role, wants)``, ``features(filler_key, has)``; both
    hold arrays.  A filler of unknown features fails every restriction.
    """
    lacks = F.array_except("wants", F.coalesce("has", F.array().cast("array<string>")))
    joined = parts.join(wanted, ["kriya", "role"]).join(features, "filler_key", "left").withColumn("lacks", lacks)
    return joined.where(F.size("lacks") > 0).select("frame_id", "role", "filler_key", "lacks")


def illegal_retractions(retractions: DataFrame, atoms: DataFrame, retractable: list[str]) -> DataFrame:
    """VAL-14: ``retractions(id)`` of atoms ``atoms(id, kind)`` whose kind may not be retracted."""
    return retractions.join(atoms.where(~F.col("kind").isin(retractable)).select("id", "kind"), "id")


def without_origin(states: DataFrame, origins: DataFrame, kinds: list[str]) -> DataFrame:
    """VAL-15: states of ``kinds`` in ``states(state_id, category)`` without an event in ``origins(state_id)``."""
    return states.where(F.col("category").isin(kinds)).join(origins, "state_id", "left_anti")


def metrics(measures: dict[str, DataFrame]) -> DataFrame:
    """AGG-24: ``metric, value`` from one-row, one-column measures, as one tall table."""
    rows = [df.select(F.lit(name).alias("metric"), F.col(df.columns[0]).cast("double").alias("value")) for name, df in measures.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
