"""Readers and writers: text folders, frame JSON, graph snapshots (SRC-*)."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

# Fixed value: what marks a prompt that is kept elsewhere.
PLACEHOLDER = "LOAD_FROM_PROMPTS_JSON"
LINK = "struct<cause_frame:string,effect_frame:string,type:string,negated:boolean>"
FRAME = (
    "doc_id string, frame_id string, sentence_id int, sentence_text string, kriya string, kriya_surface string, karta string, karma string, karana string, "
    f"sampradana string, apadana string, locus_time string, locus_space string, locus_topic string, causal_links array<{LINK}>"
)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-01: one row for each non-blank line of the .txt and .md files; a .md file hides a .txt file of its name."""
    raw = spark.read.option("pathGlobFilter", "*.{txt,md}").text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    doc = raw.select(F.regexp_extract("name", r"^(.*)\.(txt|md)$", 1).alias("doc_id"), F.regexp_extract("name", r"\.(txt|md)$", 1).alias("kind"), "value")
    one = doc.groupBy("doc_id").agg(F.max_by("value", F.col("kind") == "md").alias("value"))
    lines = one.select("doc_id", F.filter(F.transform(F.split("value", r"\R"), text.strip), lambda x: x != "").alias("lines"))
    return lines.select("doc_id", F.posexplode("lines").alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("line_number"), "text")


def read_frames(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """SRC-02/03: a JSON array of frames; ``strict`` fails on malformed input, else it is left out."""
    df = spark.read.schema(FRAME).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return df.where("frame_id is not null and kriya is not null")


def write_frames(frames: DataFrame, path: str) -> None:
    """SRC-04."""
    frames.write.mode("overwrite").json(path)


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SRC-05: nodes, edges (by relation) and one row of counts."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")
    counts = nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))  # one row each
    counts.write.mode("overwrite").json(f"{path}/metadata")


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SRC-06: the elements of a GEXF file, one a row, made on the executors; ``section`` orders them."""
    esc = F.udf(lambda x: quoteattr(x or ""), "string")
    n = nodes.select(F.lit(1).alias("section"), F.concat(F.lit("<node id="), esc("id"), F.lit("/>")).alias("line"))
    return n.union(edges.select(F.lit(2), F.concat(F.lit("<edge source="), esc("src"), F.lit(" target="), esc("dst"), F.lit("/>"))))


def unwrap_typed_json(col):
    """SRC-11: ``{"S": x}``, ``{"N": x}``, ``{"BOOL": x}`` values of a flat item."""
    v = F.try_parse_json(col)
    return F.coalesce(F.try_variant_get(v, "$.S", "string"), F.try_variant_get(v, "$.N", "string"), F.try_variant_get(v, "$.BOOL", "string"))


def report(rows: DataFrame) -> DataFrame:
    """SRC-14: a markdown line for each row; pipes are escaped, line ends made spaces."""
    cells = [F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " ") for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def byte_range(raw: Column, start: Column, stop: Column) -> Column:
    """SRC-09: the text of bytes ``start`` to ``stop`` (exclusive) of a UTF-8 text; characters cut at either end go
    (as do replacement characters there)."""
    part = F.substring(F.encode(raw, "UTF-8"), (start + 1).cast("int"), (stop - start).cast("int"))
    return F.regexp_replace(F.make_valid_utf8(part.cast("string")), "^\ufffd+|\ufffd+$", "")


def write_log(stats: DataFrame, log: DataFrame, path: str) -> None:
    """SRC-12: statistics and log as JSON lines in two folders."""
    stats.write.mode("overwrite").json(f"{path}/stats")
    log.write.mode("overwrite").json(f"{path}/log")


def read_prompts(path: str) -> dict[str, str]:
    """SRC-08: prompts of a small ``name: |`` file; placeholder values are dropped."""
    found, name = {}, None
    with open(path, encoding="utf-8") as f:
        for line in f.read().splitlines():
            head, sep, value = line.partition(":")
            if sep and head and not line[0].isspace() and not line.startswith("#"):
                name = head.strip()
                found[name] = "" if value.strip() in ("|", ">", "|-", ">-") else value.strip().strip("\"'")
            elif name is not None and (line.startswith(" ") or not line):
                found[name] += ("\n" if found[name] else "") + line.strip()
    return {k: v.strip() for k, v in found.items() if v.strip() != PLACEHOLDER}
