"""The service's reads and writes as methods over tables (SRC-10, PIP-25, 36, 40); no server is involved."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Frame-to-frame relations by class.
RELATION_CLASSES = {
    "causal": ["caused_by", "enabled_by", "prevented_by"],
    "temporal": ["before", "after", "during", "overlaps"],
    "epistemic": ["described_by", "reported_by", "inferred_from"],
    "structural": ["part_of", "elaborates", "contradicts"],
    "identity": ["is_same_as", "replaces", "version_of"],
}


def relation_class(relation: Column) -> Column:
    """PIP-40: class of a frame-to-frame relation; null for unknown ones."""
    out = F.lit(None).cast("string")
    for name, members in RELATION_CLASSES.items():
        out = F.when(F.lower(relation).isin(members), name).otherwise(out)
    return out


class QueryOp(StrEnum):
    """PIP-36: what is asked of frames; a role, or a relation class to follow, or the negative ones."""

    WHO = "karta"
    WHAT = "karma"
    HOW = "karana"
    WHOM = "sampradana"
    WHENCE = "apadana"
    WHEN = "locus_time"
    WHERE = "locus_space"
    PROPERTY = "locus_topic"
    PROVENANCE = "epistemic"
    CAUSATION = "causal"
    NEGATION = "negative"


def ask(op: QueryOp, frames: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``frame_id, answer``: a role's fillers, the frames linked by the class, or frames of negative polarity (what is
    said not to have happened, not what is not said)."""
    if op is QueryOp.NEGATION:
        return frames.where("polarity = 'negative'").select("frame_id", F.col("kriya").alias("answer"))
    if op.value in RELATION_CLASSES:
        follow = links.where(relation_class(F.col("relation")) == op.value)
        return follow.join(frames.select(F.col("frame_id").alias("src")), "src", "left_semi").select(F.col("src").alias("frame_id"), F.col("dst").alias("answer"))
    return frames.where(text.filled(F.col(op.value)).isNotNull()).select("frame_id", F.col(op.value).alias("answer"))


class Engine:
    """Documents, their state and their frames.

    ``documents(doc_id, text, created_at, status)``, ``frames(doc_id, line, frame_id, ...)``, ``log(doc_id, seq, status)``.
    """

    def __init__(self, documents: DataFrame, frames: DataFrame, log: DataFrame):
        self.documents, self.frames, self.log = documents, frames, log
        self._paths: dict[str, DataFrame] = {}

    def docs(self) -> DataFrame:
        """TOP-12: the newest first; documents without a date come last."""
        return self.documents.orderBy(F.desc_nulls_last("created_at"), "doc_id")

    def status(self, doc_id) -> DataFrame:
        return self.documents.where(F.col("doc_id") == doc_id).select("doc_id", text.status(F.col("status")).alias("status"))

    def processing_chain(self, doc_id) -> DataFrame:
        return self.log.where(F.col("doc_id") == doc_id).orderBy("seq")

    def sentence_chain(self, sentence_hash: str) -> DataFrame:
        return self.frames.where(text.sentence_hash(F.col("sentence")) == sentence_hash)

    def query(self, op: QueryOp, links: DataFrame | None = None) -> DataFrame:
        return ask(op, self.frames, links)

    def cached(self, df: DataFrame) -> DataFrame:
        """PIP-25: one cached result for each plan; forgetting it changes no answer."""
        key = str(df.semanticHash())
        held = self._paths.get(key)
        if held is None or not held.sameSemantics(df):
            held = self._paths[key] = df.cache()
        return held

    def forget(self) -> None:
        for df in self._paths.values():
            df.unpersist()
        self._paths.clear()
