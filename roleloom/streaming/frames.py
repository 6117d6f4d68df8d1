"""Structured Streaming: incremental ingest, routing, running statistics, quarantine (STM-*)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions import text
from ..operators.graph import shared_folder

#: Message types that the router accepts.
MESSAGES = ["process_text", "ask_question", "get_frames", "get_graph", "clear", "load_demo", "load_stress_test"]


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table's Parquet files as a stream: one file or a folder of files."""
    path = f"{sf}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def sentence_stream(docs: DataFrame) -> DataFrame:
    """STM-01: sentences of arriving documents, with what the eventive check says."""
    s = docs.select("doc_id", F.posexplode(text.smart_sentences(F.col("text"))).alias("line", "sentence"))
    return s.withColumn("eventive", F.coalesce(text.eventive(F.col("sentence")), F.lit(True)))


def routed(messages: DataFrame) -> DataFrame:
    """STM-02/05: ``route`` of each message; unknown types go to quarantine."""
    return messages.withColumn("route", F.when(F.col("type").isin(MESSAGES), F.col("type")).otherwise(F.lit("quarantine")))


def frame_counts(frames: DataFrame) -> DataFrame:
    """STM-03: running number of frames by action."""
    return frames.groupBy("kriya").agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """STM-06: sessions of a user that end after a quiet gap; events more than a gap late are left out."""
    return events.withWatermark("ts", gap).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def landing(path: str, problem: Column | None = None) -> Callable[[DataFrame, int], None]:
    """STM-05: a ``foreachBatch`` function that writes every batch under ``path``.

    Rows for which ``problem`` is not null go to ``kind=quarantine`` with it, all others to ``kind=accepted``, in one
    job.  A batch has a folder of its own and takes the place of what an earlier try of it left, so that after a
    restart every row is there once.
    """

    def write(rows: DataFrame, batch: int) -> None:
        told = rows.withColumn("problem", F.lit(None).cast("string") if problem is None else problem)
        told = told.withColumn("kind", F.when(F.col("problem").isNull(), "accepted").otherwise("quarantine"))
        told.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={batch}")

    return write


def start_landing(stream: DataFrame, path: str, mode: str = "append", problem: Column | None = None) -> StreamingQuery:
    """STM-05: starts ``stream`` over what is there, into ``path``/table; its progress is in ``path``/progress, from which
    a later start goes on."""
    sink = stream.writeStream.foreachBatch(landing(f"{path}/table", problem)).outputMode(mode)
    return sink.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()


def landed(stream: DataFrame, path: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """The rows of ``stream`` that ``path`` holds, with ``kind`` and ``problem``: all of them; for ``complete`` those of
    the last batch; with ``keys`` the newest of each key."""
    spark, names = stream.sparkSession, stream.columns
    schema = T.StructType([*stream.schema.fields, T.StructField("problem", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("batch", T.LongType())])
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/table")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)  # a stream without a batch wrote none
    rows = spark.read.schema(schema).parquet(f"{path}/table")
    if mode == "complete":
        rows = rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi")
    if keys:
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in [*names, "problem", "kind"] if c not in keys]), "batch").alias("r")).select(*keys, "r.*")
    return rows.select(*names, "problem", "kind")


def run_once(stream: DataFrame, mode: str, keys: Sequence[str] = (), problem: Column | None = None) -> DataFrame:
    """Runs a stream over what is there, into a table in the folder that executors share, and returns its rows.

    The folder goes when the application ends.  ``problem`` and ``kind`` are among the columns if ``problem`` is given.
    """
    path = shared_folder(stream.sparkSession, "stream")
    start_landing(stream, path, mode, problem).awaitTermination()
    rows = landed(stream, path, mode, keys)
    return rows if problem is not None else rows.select(*stream.columns)


def upserted(changes: DataFrame) -> DataFrame:
    """STM-04: the newest version of each frame of ``changes(frame_id, version, kriya)``; late older versions change
    nothing.  State holds one version a frame."""

    def step(key, batches, state: GroupState):
        best = state.get if state.exists else None
        before = best
        for b in batches:
            for version, kriya in b[["version", "kriya"]].itertuples(index=False):
                if best is None or version > best[0]:
                    best = (int(version), kriya)
        if best is not None and best != before:
            state.update(best)
            yield pd.DataFrame({"frame_id": [key[0]], "version": [best[0]], "kriya": [best[1]]})

    schema = "frame_id string, version bigint, kriya string"
    return changes.groupBy("frame_id").applyInPandasWithState(step, schema, "version bigint, kriya string", "update", "NoTimeout")


def completed_documents(chunks: DataFrame) -> DataFrame:
    """STM-04: documents of ``chunks(doc_id, chunk, n_chunks)`` all of whose chunks have arrived, each reported once;
    a chunk that arrives twice counts once."""

    def step(key, batches, state: GroupState):
        seen, total, told = state.get if state.exists else ([], 0, False)
        seen = set(seen)
        for b in batches:
            seen.update(int(c) for c in b["chunk"])
            total = max(total, int(b["n_chunks"].max()))
        done = len(seen) >= total
        state.update((sorted(seen), total, told or done))
        if done and not told:
            yield pd.DataFrame({"doc_id": [key[0]], "n": [len(seen)]})

    return chunks.groupBy("doc_id").applyInPandasWithState(step, "doc_id bigint, n bigint", "seen array<bigint>, total bigint, told boolean", "update", "NoTimeout")


def stable_documents(chunks: DataFrame, quiet: str = "5 minutes", late: str = "0 seconds", tail: float = 0.1) -> DataFrame:
    """STM-06: documents of ``chunks(doc_id, chunk, n_chunks, at)`` that are complete and have been quiet.

    A document is complete when all its chunks but those of the last ``tail`` have arrived (numbered from 0; of several
    totals the last told counts, so chunk borders may still move).  It is reported once, when no chunk has come for
    ``quiet`` of event time, by a timer or by the chunk that ends the pause: ``doc_id, n_seen, n_chunks, last_at``.
    Rows later than ``late`` behind the newest are left out, and so are those with a null; after its report a document
    is not reported again.
    """
    pause = pd.Timedelta(quiet).value // 1000
    zoned = chunks.schema["at"].dataType != T.TimestampNTZType()

    def step(key, batches, state: GroupState):
        seen, total, last, told = state.get if state.exists else ([], 0, None, False)
        seen = set(seen)

        def report():
            done = last is not None and not told and all(c in seen for c in range(math.ceil(total * (1 - tail))))
            return pd.DataFrame({"doc_id": [key[0]], "n_seen": [len(seen)], "n_chunks": [total], "us": [last]}) if done else None

        if state.hasTimedOut:
            out = report()
            told = told or out is not None
            state.update((sorted(seen), total, last, told))
            if out is not None:
                yield out
            return
        rows = pd.concat(list(batches)).sort_values(["us", "chunk"])
        for chunk, n_chunks, now in rows[["chunk", "n_chunks", "us"]].itertuples(index=False):
            if last is not None and now >= last + pause and (out := report()) is not None:
                told = True
                yield out
            if told:
                break
            seen.add(int(chunk))
            if last is None or now >= last:
                total, last = int(n_chunks), int(now)
        state.update(([] if told else sorted(seen), total, last, told))
        if not told:
            state.setTimeoutTimestamp(max((last + pause) // 1000, state.getCurrentWatermarkMs() + 1))

    # a time without a zone is taken as it stands; micros keep the session's zone out of the state
    at = F.col("at") if zoned else F.expr("timestamp '1970-01-01 00:00:00Z' + (at - timestamp_ntz '1970-01-01 00:00:00')")
    back = F.timestamp_micros("us") if zoned else F.expr("timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(us / 1000000bd as decimal(18, 6)))")
    rows = chunks.select("doc_id", "chunk", "n_chunks", at.alias("at")).where("doc_id is not null and chunk is not null and n_chunks is not null and at is not null")
    found = rows.withColumn("us", F.unix_micros("at")).withWatermark("at", late).groupBy("doc_id").applyInPandasWithState(
        step, "doc_id bigint, n_seen bigint, n_chunks bigint, us bigint", "seen array<bigint>, total bigint, last bigint, told boolean", "append", "EventTimeTimeout"
    )
    return found.select("doc_id", "n_seen", "n_chunks", back.alias("last_at"))
