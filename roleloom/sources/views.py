"""Event frames and graphs over the structured tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

ROLES = ["karta", "karma", "karana", "sampradana", "apadana", "locus_time", "locus_space", "locus_topic"]
# Accepted names of a role and the relation of its edges.
ALIASES = {
    "karta": ["karta", "kartā", "agent"], "karma": ["karma", "object"], "karana": ["karana", "karaṇa", "instrument"], "sampradana": ["sampradana", "sampradāna", "recipient"],
    "apadana": ["apadana", "apādāna", "source"], "locus_time": ["time", "locus_time"], "locus_space": ["space", "locus_space", "place"], "locus_topic": ["topic", "locus_topic"],
}
RELATIONS = {"karta": "HAS_KARTĀ", "karma": "HAS_KARMA", "karana": "USES_KARANA", "sampradana": "TARGETS_SAMPRADĀNA", "apadana": "FROM_APĀDĀNA", "locus_space": "LOCATED_IN", "locus_time": "OCCURS_AT"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_frames(spark: SparkSession, sf: str) -> DataFrame:
    """One frame for each order: the customer acts, the segment receives, the nation is the place."""
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    none = F.lit(None).cast("string")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .select(
            F.concat(F.lit("O"), "o_orderkey").alias("frame_id"),
            "o_orderkey",
            F.when(F.col("o_orderstatus") == "F", "fulfil").when(F.col("o_orderstatus") == "O", "open").otherwise("process").alias("kriya"),
            F.col("c_name").alias("karta"),
            none.alias("karma"),
            none.alias("karana"),
            F.col("c_mktsegment").alias("sampradana"),
            none.alias("apadana"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("locus_time"),
            F.col("n_name").alias("locus_space"),
            F.col("o_orderpriority").alias("locus_topic"),
            "n_regionkey",
            F.col("o_totalprice").alias("price"),
        )
    )


def participations(frames: DataFrame) -> DataFrame:
    """Long form ``frame_id, role, filler, filler_key``; empty roles are absent."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("filler")) for r in ROLES])).alias("p")
    return frames.select("frame_id", pairs).select("frame_id", "p.role", "p.filler", text.key(F.col("p.filler")).alias("filler_key")).where("filler <> ''")


def item_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Multigraph ``src, dst, relation``: order frames to parts (object) and suppliers (source); parallel edges stay."""
    li, p, s = table(spark, sf, "lineitem"), table(spark, sf, "part"), table(spark, sf, "supplier")
    src = F.concat(F.lit("O"), "l_orderkey").alias("src")
    karma = li.join(p, li.l_partkey == p.p_partkey).select(src, F.col("p_name").alias("dst"), F.lit(RELATIONS["karma"]).alias("relation"))
    return karma.union(li.join(s, li.l_suppkey == s.s_suppkey).select(src, F.col("s_name").alias("dst"), F.lit(RELATIONS["apadana"]).alias("relation")))


def event_frames(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("E"), "event_id").alias("frame_id"),
        "event_id",
        F.col("event_type").alias("kriya"),
        F.concat(F.lit("U"), "user_id").alias("karta"),
        "ts",
        F.get_json_object("props", "$.k").alias("karma"),
        "value",
    )


def adjacent(frames: DataFrame, gap: str = "3 HOURS") -> DataFrame:
    """WIN-01: consecutive frames of one agent within ``gap``."""
    w = Window.partitionBy("karta").orderBy("ts", "event_id")
    nxt = frames.select("frame_id", "ts", F.lead("frame_id").over(w).alias("dst"), F.lead("ts").over(w).alias("dst_ts"))
    return nxt.where(F.col("dst").isNotNull() & (F.col("dst_ts") <= F.col("ts") + F.expr(f"INTERVAL {gap}"))).select(F.col("frame_id").alias("src"), "dst")


def document_sentences(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("line", "sentence"))
