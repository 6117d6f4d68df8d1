"""A corpus pipeline of five stages over ``documents``.

Each stage takes all that its predecessor kept, as a Parquet table with the
columns of documents (the last stage returns its own).  ``run`` applies them in
order.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roleloom.llm.common import materialize, read_table, scratch
from roleloom.llm.jaccard import jaccard_components
from roleloom.llm.langid import UNKNOWN, predict, train
from roleloom.llm.mixing import sample_documents
from roleloom.llm.pieces import encode_documents
from roleloom.llm.substrings import without_repeats

#: Texts that cost more bits a byte than this under every language are not prose in any of them.
MOST_BITS = 6.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or that no learnt language explains; lang becomes the predicted language."""
    added = tuple(f"{'_' * max(map(len, docs.columns))}{x}" for x in ("pred", "score", "bits"))  # longer than any column's name
    pred, _, bits = added
    found = predict(docs, train(docs), added)
    known = found.where((F.col(pred) != UNKNOWN) & (F.col(bits) <= MOST_BITS))
    return known.withColumn("lang", F.col(pred)).select(*(f"`{c}`" for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (5-word shingles, Jaccard similarity 0.8) the smallest doc_id."""
    with scratch(spark):
        found = jaccard_components(docs, k=5, threshold=Fraction(4, 5))
        gone = materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone", outer=True)
    names = [f"`{c}`" for c in docs.columns]
    # repeated rows of one id are copies too: one of them stays
    once = docs.join(gone, "doc_id", "left_anti")
    again = once.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    several = once.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.join(again, "doc_id", "left_anti").select(*names).union(several.select(*names))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that also stand in a document with a smaller doc_id."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that tokens meet the target marginals of source, language and topic."""
    return sample_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, for training."""
    return encode_documents(docs, carry=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Language models, components and BPE are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
