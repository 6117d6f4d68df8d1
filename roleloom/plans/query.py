"""Query templates, points of view and question answering (PIP-12..14, FLT-19/20, PIP-24)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frames import find_by_role, keyword_rank, role_name
from ..sources.views import RELATIONS


@dataclass(frozen=True)
class PointOfView:
    """FLT-19: filters that restrict a graph; composed by ``&`` (FLT-20)."""

    filters: tuple[Column, ...] = field(default=())

    def __and__(self, other: PointOfView) -> PointOfView:
        return PointOfView(self.filters + other.filters)

    def apply(self, frames: DataFrame) -> DataFrame:
        for f in self.filters:
            frames = frames.where(F.coalesce(f, F.lit(False)))
        return frames


@dataclass(frozen=True)
class Template:
    """PIP-24: an action, known roles and the role that is asked for."""

    kriya: str | None
    roles: dict[str, str]
    hole: str

    def run(self, frames: DataFrame) -> DataFrame:
        if self.kriya:
            frames = frames.where(F.lower("kriya") == self.kriya.lower())
        for role, value in self.roles.items():
            frames = find_by_role(frames, role, value)
        return frames.select("frame_id", F.col(role_name(self.hole)).alias("answer")).where("answer is not null")


@dataclass(frozen=True)
class Step:
    roles: dict[str, str]


def run_steps(edges: DataFrame, steps: list[Step]) -> DataFrame:
    """PIP-12: frames that match each step; steps are independent, the union is a bag over steps."""
    out = None
    for i, s in enumerate(steps):
        hit = edges.select("src").distinct()
        for role, entity in s.roles.items():
            part = edges.where((F.col("relation") == F.lit(RELATIONS.get(role))) & (F.col("dst") == entity)).select("src").distinct()
            hit = hit.join(part, "src", "left_semi")
        hit = hit.select(F.lit(i + 1).alias("step"), F.col("src").alias("frame_id"))
        out = hit if out is None else out.union(hit)
    return out


def ask(frames: DataFrame, links: DataFrame, kriya_words: list[str], entity_words: list[str]) -> DataFrame:
    """PIP-14 without a language model: ranked frames, then causal neighbours one hop away (JN-12), with citations."""
    hits = keyword_rank(frames, kriya_words, entity_words, fallback=True).select("frame_id", "score", F.lit(0).alias("hop"))
    both = links.union(links.select("dst", "src"))
    near = both.join(hits, both.src == hits.frame_id).select(F.col("dst").alias("frame_id"), F.lit(0).alias("score"), F.lit(1).alias("hop")).distinct()
    near = near.join(hits, "frame_id", "left_anti")
    cited = hits.union(near).join(frames.select("frame_id", "karta", "kriya", "locus_space", "locus_time"), "frame_id")
    said = F.concat_ws(" ", "karta", "kriya", F.concat(F.lit("in "), "locus_space"), F.concat(F.lit("on "), "locus_time"))
    return cited.select("frame_id", "score", "hop", F.concat(F.lit("["), "frame_id", F.lit("] "), said).alias("citation"))
