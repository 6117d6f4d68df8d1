"""Sentences as spans of the text they come from (STR-11, STR-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import align


def _near(chunk: Column, s: Column, share: float) -> Column:
    """``start, stop`` (from 0) of a stretch that chunk and sentence share and that is longer than ``share`` of the sentence.

    Such a stretch holds the sentence's middle.  The middle's first place is extended to both sides.
    """
    n = F.length(s)
    least = (F.floor(n * share) + 1).cast("int")
    edge, core = n - least, F.substring(s, n - least + 1, 2 * least - n)
    at = F.instr(chunk, core)
    left, right = F.substring(chunk, F.lit(1), at - 1), F.substring(chunk, at + F.length(core), edge)
    lengths = F.sequence(F.lit(0), edge)
    back = F.array_max(F.filter(lengths, lambda i: F.endswith(left, F.substring(s, edge - i + 1, i))))
    on = F.array_max(F.filter(lengths, lambda i: F.startswith(right, F.substring(s, least + 1, i))))
    shared = back + F.length(core) + on
    return F.when((at > 0) & (shared >= least), F.struct((at - 1 - back).alias("start"), (at - 1 - back + shared).alias("stop")))


def merged_chunks(chunks: DataFrame, share: float = 0.8) -> DataFrame:
    """STR-11: ``doc_id, start, stop, sentence`` of overlapping chunks ``doc_id, at, text, sentences``, each stretch once.

    A chunk starts at character ``at`` of its document (from 0).  A sentence stands at the chunk's offset plus its place in the
    chunk; its k-th mention in the chunk's list is the text's k-th.  A sentence that the chunk does not hold takes a
    stretch of more than ``share`` of it, else it is left out.  A span inside another span of the document goes (of
    equal ones the first chunk's stays), so what is cut at a chunk's end gives way to the whole sentence.  Null or
    empty sentences, null texts and null lists give nothing.
    """
    s = chunks.select("doc_id", "at", "text", "sentences", F.posexplode("sentences").alias("pos", "sentence")).where("sentence <> '' and text is not null")
    nth = F.size(F.filter(F.slice("sentences", 1, F.col("pos") + 1), lambda x: x == F.col("sentence")))
    s = s.withColumn("start", F.length(F.call_function("substring_index", F.col("text"), F.col("sentence"), nth)))
    exact = F.col("start") + F.length("sentence") <= F.length("text")
    here = F.struct("start", (F.col("start") + F.length("sentence")).alias("stop"))
    s = s.select("doc_id", "at", "sentence", F.when(exact, here).otherwise(_near(F.col("text"), F.col("sentence"), share)).alias("span")).where("span is not null")
    s = s.select("doc_id", "at", (F.col("at") + F.col("span.start")).cast("bigint").alias("start"), (F.col("at") + F.col("span.stop")).cast("bigint").alias("stop"), "sentence")
    w = Window.partitionBy("doc_id").orderBy("start", F.desc("stop"), "at", "sentence").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("before", F.max("stop").over(w)).where("before is null or stop > before").select("doc_id", "start", "stop", "sentence")


def covered(spans: DataFrame) -> DataFrame:
    """STR-15: ``doc_id, n_covered``: characters inside the union of ``spans(doc_id, start, stop)``."""
    w = Window.partitionBy("doc_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    gain = F.col("stop") - F.greatest("start", F.coalesce("before", "start"))
    return spans.withColumn("before", F.max("stop").over(w)).groupBy("doc_id").agg(F.sum(F.greatest(gain, F.lit(0))).cast("bigint").alias("n_covered"))


def alignment(docs: DataFrame, least: float = 0.95, most_off: int = 10) -> DataFrame:
    """STR-15: whether the ``sentences`` of ``docs(doc_id, text, sentences)`` account for the text.

    Each sentence takes its first place in the text (so repeated ones share one); without any, the window whose
    characters are most alike, if its score exceeds ``least``.  Returns ``doc_id, n_sentences, n_placed, n_covered,
    coverage, length_diff, aligned``; aligned: coverage over ``least`` and less than ``most_off`` characters
    between the lengths.  A null text or list counts as empty; an empty text has coverage 0.  ``doc_id`` must be unique.
    Each row is judged by itself; nothing is shuffled.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.filter(F.coalesce("sentences", F.array().cast("array<string>")), lambda x: x != "").alias("sentences"))
    size = F.aggregate("sentences", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    told = d.select("doc_id", F.length("text").cast("bigint").alias("n"), F.size("sentences").cast("bigint").alias("n_sentences"), size.alias("size"), align.cover("text", "sentences", F.lit(float(least))).alias("c"))
    told = told.select("doc_id", "n", "n_sentences", "size", "c.*")
    told = told.withColumn("coverage", F.when(F.col("n") > 0, F.col("n_covered") / F.col("n")).otherwise(F.lit(0.0))).withColumn("length_diff", F.abs(F.col("n") - F.col("size")))
    return told.select("doc_id", "n_sentences", "n_placed", "n_covered", "coverage", "length_diff", ((F.col("coverage") > least) & (F.col("length_diff") < most_off)).alias("aligned"))
