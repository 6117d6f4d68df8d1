"""Graph navigation: bounded search, components, provenance, cycles (JN-*, PIP-21/22)."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in that of ``spark.checkpoint.dir``, else in the warehouse.

    Its files go when the application ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_roleloom"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex[:16]}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)  # keeps in mind only what exists
    return path.toString()


def stored(df: DataFrame, most: int = 0) -> DataFrame:
    """Cuts the lineage of a loop by a table in a shared folder, which also tells later joins its size.

    ``most`` rows a file (0: any) keep the tasks that read it small.
    """
    path = f"{shared_folder(df.sparkSession, 'stored')}/table"
    df.write.option("maxRecordsPerFile", most).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def neighbours(edges: DataFrame, node: Column, direction: str = "both") -> DataFrame:
    """FLT-11: out- then in-neighbours; parallel edges and self-loops count each time."""
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("node"), "relation", F.lit("out").alias("way"))
    into = edges.where(F.col("dst") == node).select(F.col("src").alias("node"), "relation", F.lit("in").alias("way"))
    return out if direction == "out" else into if direction == "in" else out.union(into)


def expanded(edges: DataFrame, start: DataFrame, relation: str | None = None) -> DataFrame:
    """JN-13: ``start(question, node)`` with the nodes one edge away in either direction, each once a question.

    ``relation`` takes only those edges.  Nodes without an edge stay; null nodes have no neighbour.
    """
    e = edges if relation is None else edges.where(F.col("relation") == relation)
    ways = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("w")
    near = start.join(e.select(ways).select("w.*"), "node").select("question", F.col("other").alias("node"))
    return start.select("question", "node").union(near).distinct()


def traverse(edges: DataFrame, start: DataFrame, max_hops: int | None, direction: str = "out") -> DataFrame:
    """JN-11: nodes at distance up to ``max_hops - 1`` (None: any) of ``start(node)``, the start included, with their distance."""
    step = edges.select("src", "dst")
    if direction != "out":
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        step = back if direction == "in" else step.union(back)
    seen = stored(start.select("node", F.lit(0).alias("hops")).distinct())
    front = seen
    for h in itertools.count(1) if max_hops is None else range(1, max_hops):
        new = front.join(step, front.node == step.src).select(F.col("dst").alias("node")).distinct()
        front = stored(new.join(seen, "node", "left_anti").select("node", F.lit(h).alias("hops")))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def equivalence(edges: DataFrame) -> DataFrame:
    """JN-16: ``node, canonical`` (the least of its class) by min-label propagation with pointer jumping."""
    sym = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    sym = stored(sym)
    labels = stored(sym.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("label")).withColumnRenamed("src", "node"))
    while True:
        via = sym.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(via, "node").select("node", F.least("label", "near").alias("new"), "label")
        up = labels.select(F.col("node").alias("new"), F.col("label").alias("jump"))
        new = stored(new.join(up, "new", "left").select("node", F.coalesce(F.least("new", "jump"), "new").alias("new"), "label"))
        done = new.where("new <> label").isEmpty()
        labels = new.select("node", F.col("new").alias("label"))
        if done:
            return labels.select("node", F.col("label").alias("canonical"))


def cycle_nodes(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """PIP-21/VAL-12: nodes that peeling sources and sinks leaves: those on cycles or between them."""
    left = stored(edges.select("src", "dst").distinct())
    n = left.count()
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        left = stored(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        m = left.count()
        if m in (0, n):
            return left.select(F.col("src").alias("node")).distinct()
        n = m
    raise RuntimeError(f"a chain is longer than {max_rounds} rounds of peeling")


def provenance(derives: DataFrame, target: DataFrame, max_depth: int | None = None) -> DataFrame:
    """JN-18: ``node, depth`` under ``target(node)`` along ``derives(conclusion, evidence)``, down to ``max_depth`` (None: all)."""
    tree = derives.select(F.col("conclusion").alias("src"), F.col("evidence").alias("dst"))
    return traverse(tree, target, None if max_depth is None else max_depth + 1).withColumnRenamed("hops", "depth")


def upper_bounds(before: DataFrame, times: DataFrame) -> DataFrame:
    """PIP-22: the latest time of each event from ``before(e1, e2)`` and known ``times(event, at)``; is_derived marks bounds."""
    known = times.select("event", F.col("at").alias("bound"), F.lit(False).alias("is_derived"))
    rest = before.select(F.col("e1").alias("event")).union(before.select("e2")).distinct().join(known, "event", "left_anti")
    cur = stored(known.union(rest.select("event", F.lit(None).cast(times.schema["at"].dataType), F.lit(True))))
    while True:  # bounds only fall, to one of the known times
        via = before.join(cur.select(F.col("event").alias("e2"), F.col("bound").alias("b2")), "e2").groupBy(F.col("e1").alias("event")).agg(F.min("b2").alias("via"))
        nxt = cur.join(via, "event", "left").select("event", F.when(F.col("is_derived"), F.least("bound", "via")).otherwise(F.col("bound")).alias("new"), "is_derived", "bound")
        nxt = stored(nxt)
        done = nxt.where("not (new <=> bound)").isEmpty()
        cur = nxt.select("event", F.col("new").alias("bound"), "is_derived")
        if done:
            return cur
