"""Shared plumbing: table readers, shared-folder tables, components.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir`` (visible to all executors), so that a lost executor
costs a re-read and not a recomputation.
"""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textscan import tidied

#: Rows up to which an id list may be broadcast (8 bytes a row); larger lists are joined by shuffle.
BROADCAST_ROWS = 1_000_000


#: Bytes of an Arrow batch, where the session has Spark's default: several copies of a batch are in a worker's memory.
BATCH_BYTES, DEFAULT_BYTES = "4m", ("64m", "67108864b", "67108864")


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow in batches of bounded bytes that leaves no unused memory in the workers.

    Spark reads the bound when the plan runs, which may be after this returns,
    so it is set for the session; one that the user has set stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name).lower() in DEFAULT_BYTES:
        conf.set(name, BATCH_BYTES)
    return df.mapInArrow(tidied(run), schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one in the warehouse, which executors share as well."""
    found = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_roleloom"
    return found.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_SCOPES: list[list[DataFrame]] = []


def materialize(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The files go with the innermost ``scratch`` block (with ``outer``: the one
    around it), else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    p, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    depth = len(_SCOPES) - outer
    if depth > 0:
        _SCOPES[depth - 1].append(out)
    return out


def release(df: DataFrame | None) -> None:
    """Drop the files of a materialized table that nothing reads any more."""
    if df is not None and getattr(df, "_shared_path", None):
        p, fs = _hadoop_path(df.sparkSession, df._shared_path)
        fs.delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Have Spark's cleaner drop the shuffle files and broadcasts of finished steps (it follows the driver's garbage
    collection), and the driver hand back what its many short-lived threads have left in the C heap."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    try:
        _trim_driver(spark)
    except Py4JError:  # a JVM that does not offer it
        pass


def _trim_driver(spark: SparkSession) -> None:
    """The JVM's diagnostic command System.trim_native_heap (through reflection: the bean server's own class is not open)."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName
    call = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    types, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, name in enumerate(call):
        types[i] = named(name)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    named("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


@contextmanager
def scratch(spark: SparkSession):
    """Tables materialized inside are dropped at the end, but for those made with ``outer``."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for df in _SCOPES.pop():
            release(df)
        sweep(spark)


def keep_ids(df: DataFrame, ids: DataFrame, key: str, n_ids: int) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids``: broadcast up to BROADCAST_ROWS ids, by shuffle beyond."""
    side = F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids
    return df.join(side, key, "left_semi")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of ``edges(src, dst)`` as ``(node, component)``, component = smallest node.

    Alternating large-star and small-star rounds until nothing changes
    (logarithmically many in practice), every round written to the shared
    folder.  Self-loops and nulls are ignored.  Minima are pre-aggregated and
    joined back: no node's edges are gathered for them, and the joins' hot
    nodes are split by Spark where its skew handling is on.
    """
    cur = materialize(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        "cc",
    )

    def signature(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = signature(cur)
    while before[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        ).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        new = materialize(small, "cc")
        release(cur)
        cur, after = new, signature(new)
        if after == before:
            break
        before = after
    tops = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)


def numbered(df: DataFrame) -> list:
    """All columns of ``df`` as c0, c1, ...: no name of theirs can clash with one of ours."""
    return [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]


def renamed_back(df: DataFrame, like: DataFrame, *more) -> DataFrame:
    """c0, c1, ... under the names of ``like`` again, and the columns ``more`` as they are."""
    return df.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(like.columns)), *more)


def column_at(df: DataFrame, name: str) -> str:
    return f"c{df.columns.index(name)}"


def ddl(df: DataFrame) -> str:
    return ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields))
