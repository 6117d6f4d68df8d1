"""Passes over finished graphs: coreference, metaphors, entity types, causal links (PIP-08..11).

``turns(doc_id, line, frame_id, entity, sentence)`` holds one entity mention a row.  The default judgement is by rule;
any DataFrame of accepted links with the same columns may take its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# What marks the second of two sentences as effect or cause of the first.
EFFECT_CUES = r"\b(therefore|thus|hence|consequently|as a result|so that)\b"
CAUSE_CUES = r"\b(because|due to|owing to|caused by|as a consequence of)\b"


def _previous(turns: DataFrame, doubtful: Column, reach: int) -> DataFrame:
    """Links each doubtful mention to the last sure one before it, at most ``reach`` lines back."""
    before = Window.partitionBy("doc_id").orderBy("line", "frame_id", "entity").rowsBetween(Window.unboundedPreceding, -1)
    sure = F.when(~doubtful & (text.key(F.col("entity")) != ""), F.struct("line", "entity"))
    seen = turns.withColumn("target", F.last(sure, ignorenulls=True).over(before))
    gap = F.col("line") - F.col("target.line")
    return (
        seen.where(doubtful & (gap <= reach) & (text.key(F.col("entity")) != text.key(F.col("target.entity"))))
        .select("doc_id", "frame_id", F.col("entity").alias("src"), F.col("target.entity").alias("dst"), F.when(gap <= 1, "high").otherwise("medium").alias("confidence"))
        .withColumn("relation", F.lit("IS_SAME_AS"))
    )


def coreferences(turns: DataFrame, reach: int = 5, doubtful: Column | None = None) -> DataFrame:
    """PIP-08: pronouns to the entity named last before them; high confidence within a line, else medium.
    ``doubtful`` replaces the English pronouns as what needs a referent."""
    return _previous(turns, F.coalesce(text.is_pronoun(F.col("entity")), F.lit(False)) if doubtful is None else doubtful, reach)


def metaphors(turns: DataFrame, reach: int = 3) -> DataFrame:
    """PIP-09: names that speak of someone by a relation or a quality (STR-22) to the plain name before them; never to themselves, nor to a pronoun."""
    named = turns.where(~F.coalesce(text.is_pronoun(F.col("entity")), F.lit(False)))
    return _previous(named, F.coalesce(text.is_metaphor(F.col("entity")), F.lit(False)), reach)


ROLE_TYPES = {"karta": "Agent", "sampradana": "Agent", "locus_time": "Time", "locus_space": "Place", "locus_topic": "Concept"}


def entity_types(parts: DataFrame) -> DataFrame:
    """PIP-10: ``entity, type, n`` from the role that an entity fills most often (the first by name on a tie).
    All entities but pronouns are typed; nothing is cut off."""
    counts = parts.where(~text.is_pronoun(F.col("filler"))).groupBy("filler_key", "role").agg(F.count("*").alias("n"))
    top = counts.groupBy("filler_key").agg(F.min_by("role", F.struct(-F.col("n"), "role")).alias("role"), F.max("n").alias("n"))
    kind = F.lit("Thing")
    for role, name in ROLE_TYPES.items():
        kind = F.when(F.col("role") == role, name).otherwise(kind)
    return top.select(F.col("filler_key").alias("entity"), kind.alias("type"), "n")


def causal_links(lines: DataFrame, reach: int = 3, effect: str = EFFECT_CUES, cause: str = CAUSE_CUES) -> DataFrame:
    """PIP-11: ``src CAUSES dst`` between consecutive frames at most ``reach`` lines apart, by cue words of the second:
    an effect cue points forward, a cause cue backward; the effect cue decides if both occur."""
    w = Window.partitionBy("doc_id").orderBy("line", "frame_id")
    nxt = lines.select("doc_id", "line", "frame_id", F.lead(F.struct("line", "frame_id", "sentence")).over(w).alias("next")).where(F.col("next.line") - F.col("line") <= reach)
    said = F.lower("next.sentence")
    forward, backward = said.rlike(effect), said.rlike(cause)
    a, b = F.col("frame_id"), F.col("next.frame_id")
    return nxt.where(forward | backward).select(F.when(forward, a).otherwise(b).alias("src"), F.when(forward, b).otherwise(a).alias("dst"))
