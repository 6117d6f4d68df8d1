"""Frames into graph tables: one scan, several outputs, written whole or not at all (PIP-07)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.views import ALIASES, RELATIONS, ROLES
from .extract import FAILED
from .graph import stored

CITED = "CITED_IN"
FIELDS = ["kind", "id", "type", "label", "relation", "dst", "note"]
#: Bytes of rows in a part, and rows of a written file (a task reads several files).
PART, ROWS = 32 << 20, 100_000


def parts_of(rows: DataFrame) -> int:
    """In how many parts ``rows`` go, so that a task holds about PART bytes at any size; never fewer than the session's."""
    size = rows.agg(F.sum(100 + F.octet_length(F.to_json(F.struct(*rows.columns))))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART))


def _dealt(rows: DataFrame, by: str, parts: int) -> DataFrame:
    """``rows`` in ``parts`` by ``deal``, a hash of ``by``: what is grouped by ``deal`` and more stays where it is."""
    return rows.withColumn("deal", F.pmod(F.xxhash64(by), F.lit(8 * parts))).repartition(parts, "deal")


def relation_of(role):
    """The relation of a role under any of its accepted names; null for others."""
    pairs = [(name, RELATIONS[r]) for r, names in ALIASES.items() if r in RELATIONS for name in names]
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), text.key(role))


def role_map(frames: DataFrame):
    """The role columns of frames as a map of the filled ones."""
    entries = F.array(*[F.struct(F.lit(r).alias("key"), F.col(r).cast("string").alias("value")) for r in ROLES if r in frames.columns])
    return F.map_from_entries(F.filter(entries, lambda e: F.coalesce(text.strip(e["value"]) != "", F.lit(False))))


def graph_records(frames: DataFrame) -> DataFrame:
    """``kind, id, type, label, relation, dst, note`` of ``frames(frame_id, doc_id, line, kriya, roles, hints)``.

    ``roles`` is a map from role name to filler; ``hints`` an array of
    ``(pronoun, referent, context)`` (either may be null).  Kinds:

    * node: the frame itself (type Kriya), its entities, pronouns (Entity) and its line (Document); equal ones once;
    * edge: from the frame to each filled role's entity, and CITED_IN to its line;
    * hint: a pronoun, what it is likely to mean (dst) and the context (note);
    * quarantine: a frame without a verb, or with a filled role that has no relation (note says which).  Nothing else
      of such a frame is written.

    Entities are named by the lower-cased, stripped filler.  ``frames`` is read twice: it is measured first, and
    equal records meet within a part before they are shuffled.
    """
    parts = parts_of(frames)
    frames = _dealt(frames, "frame_id", parts)
    filled = F.filter(F.map_entries(F.coalesce("roles", F.create_map().cast("map<string,string>"))), lambda e: F.coalesce(text.strip(e["value"]) != "", F.lit(False)))
    rows = frames.select("deal", "frame_id", F.col("doc_id").cast("string").alias("doc_id"), "line", "kriya", filled.alias("filled"), F.coalesce("hints", F.array().cast("array<struct<pronoun:string,referent:string,context:string>>")).alias("hints"))
    strange = F.filter("filled", lambda e: relation_of(e["key"]).isNull())
    verb = F.coalesce((text.strip(F.col("kriya")) != "") & (F.col("kriya") != FAILED), F.lit(False))
    note = F.when(~verb, "NO_VERB").when(F.size(strange) > 0, F.concat(F.lit("UNKNOWN_ROLE:"), F.array_join(F.array_sort(F.transform(strange, lambda e: e["key"])), ",")))
    rows = rows.withColumn("bad", note).withColumn("place", F.concat("doc_id", F.lit("_L"), F.col("line").cast("string")))
    none = F.lit(None).cast("string")

    def record(kind, id_, type_=none, label=none, relation=none, dst=none, about=none):
        return F.struct(F.lit(kind).alias("kind"), id_.alias("id"), type_.alias("type"), label.alias("label"), relation.alias("relation"), dst.alias("dst"), about.alias("note"))

    me = F.concat("kriya", F.lit("@"), "frame_id")
    name = lambda x: text.key(x)
    entity = lambda x: record("node", name(x), F.lit("Entity"), F.initcap(name(x)))
    said = F.filter("hints", lambda h: F.coalesce(text.strip(h["pronoun"]) != "", F.lit(False)))
    place = F.col("place")
    good = F.flatten(
        F.array(
            F.array(record("node", me, F.lit("Kriya"), F.col("kriya")), record("node", place, F.lit("Document"), place), record("edge", me, relation=F.lit(CITED), dst=place)),
            F.transform("filled", lambda e: entity(e["value"])),
            F.transform("filled", lambda e: record("edge", me, relation=relation_of(e["key"]), dst=name(e["value"]))),
            F.transform(said, lambda h: entity(h["pronoun"])),
            F.transform(said, lambda h: record("hint", name(h["pronoun"]), dst=h["referent"], about=h["context"])),
        )
    )
    out = rows.select("deal", F.explode(F.when(F.col("bad").isNull(), good).otherwise(F.array(record("quarantine", F.col("frame_id"), label=F.col("kriya"), about=F.col("bad"))))).alias("r")).select("deal", "r.*")
    return out.dropDuplicates().select(*FIELDS).repartition(parts, *FIELDS).dropDuplicates()


def write_graph(frames: DataFrame, path: str, batch: str) -> None:
    """PIP-07: writes the records of a batch of frames under ``path``.

    All kinds come out of one job, whose commit makes them visible together.  A
    batch that is written again takes the place of its former version.  The
    frames are stored first, so that what extracts them runs once.
    """
    graph_records(stored(frames, ROWS)).write.mode("overwrite").option("maxRecordsPerFile", ROWS).partitionBy("kind").parquet(f"{path}/batch={batch}")


def read_graph(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The records of all batches (of one ``kind``); nodes that several batches hold come once."""
    schema = ", ".join(f"{c} string" for c in [*FIELDS[1:], "kind", "batch"])
    rows = spark.read.schema(schema).parquet(path)
    rows = rows.where(F.col("kind") == kind) if kind else rows
    rows = rows.select(*FIELDS)
    return rows.repartition(parts_of(rows), *FIELDS).dropDuplicates()


def tally(records: DataFrame) -> DataFrame:
    """``kind, type, relation, n, ids, dsts``: the records of a kind, and how many ids and ends they name."""
    kinds, parts = ["kind", "type", "relation"], parts_of(records)
    named = F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in ("id", "dst")])
    each = _dealt(records, "id", parts).select("deal", *kinds, F.explode(named).alias("v")).select("deal", *kinds, "v.*")
    keys = [*kinds, "what", "value"]
    near = each.groupBy("deal", *keys).agg(F.count("*").alias("n"))  # a frequent end is summed up within a part first
    once = near.select(*keys, "n").repartition(parts, *keys).groupBy(*keys).agg(F.sum("n").alias("n"))
    of = lambda c, x: F.when(F.col("what") == c, F.col(x))
    return once.groupBy(*kinds).agg(F.sum(of("id", "n")).alias("n"), F.count(of("id", "value")).alias("ids"), F.count(of("dst", "value")).alias("dsts"))


def graph_edges(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst, relation`` for the graph lookups and searches (FLT-10..14, JN-11..14)."""
    return read_graph(spark, path, "edge").select(F.col("id").alias("src"), "dst", "relation")
