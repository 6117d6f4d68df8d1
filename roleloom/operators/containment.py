"""Which texts contain which of many strings (STR-15, STR-20), by an inverted index of rare words.

Where a string stands in a text, its inner words (all but those that touch its
ends, which may be cut) are whole consecutive words of the text.  So each string
gets one key: the rarest of its inner runs of three words, or of its inner words
if there are fewer than three.  Texts whose keys hold it are candidates and are
verified.  Strings without an inner word have a word or run of white space that
must stand inside a token of the text; such tokens are found in the vocabulary,
by their groups of up to three characters.  All joins are on equal keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _words(t: Column) -> Column:
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def _runs(words: Column) -> Column:
    """Hashes of all runs of three words."""
    at = F.sequence(F.lit(0), F.size(words) - 3)
    runs = F.transform(at, lambda i: F.xxhash64(F.lit(3), F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, runs).otherwise(F.array().cast("array<bigint>"))


def _singles(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(F.lit(1), w))


def _any() -> Column:
    """The key of every text, for the empty string."""
    return F.array(F.xxhash64(F.lit(0)))


def _inner(needle: Column, words: Column) -> Column:
    first, last = F.rlike(needle, F.lit(r"^\S")).cast("int"), F.rlike(needle, F.lit(r"\S\z")).cast("int")
    return F.slice(words, first + 1, F.greatest(F.size(words) - first - last, F.lit(0)))


def _grams(token: Column, least: int, most: int) -> Column:
    """Groups of ``least`` to ``most`` neighbouring characters."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    of = lambda n: F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.array_join(F.slice(chars, i + 1, n), ""))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*map(of, range(least, most + 1))))


def _tokens(t: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(t, F.lit(r"(\s+|\S+)"), F.lit(1)))


def _by_inner_words(docs: DataFrame, long: DataFrame) -> DataFrame:
    """Candidates ``id, needle`` by each string's rarest key; a string with a key that no text has gets none."""
    wanted = long.select("needle", F.explode(F.when(F.col("needle") == "", _any()).when(F.size("inner") >= 3, _runs(F.col("inner"))).otherwise(_singles(F.col("inner")))).alias("key")).distinct()
    held = docs.select("id", _words(F.col("text")).alias("words")).select("id", F.explode(F.array_distinct(F.concat(_any(), _singles(F.col("words")), _runs(F.col("words"))))).alias("key"))
    held = held.join(wanted.select("key").distinct(), "key")
    count = held.groupBy("key").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    rarest = wanted.join(count, "key", "left").groupBy("needle").agg(F.min_by("key", F.struct(n, "key")).alias("key"), F.min(n).alias("n"))
    return held.join(rarest.where("n > 0"), "key").select("id", "needle")


def _by_vocabulary(docs: DataFrame, short: DataFrame) -> DataFrame:
    """Candidates ``id, needle`` for strings of one or two cut words or of white space only."""
    longest = lambda xs: F.array_max(F.transform(xs, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    part = F.coalesce(longest(_words(F.col("needle"))), F.col("needle"))
    parts = short.select("needle", part.alias("part"))
    size = F.least(F.length("part"), F.lit(3))
    sought = parts.select("needle", "part", F.explode(F.when(size == 3, _grams(F.col("part"), 3, 3)).otherwise(F.array("part"))).alias("gram"))
    held = docs.select("id", F.explode(_tokens(F.col("text"))).alias("token"))
    grams = held.select("token").distinct().select("token", F.explode(_grams(F.col("token"), 1, 3)).alias("gram")).join(sought.select("gram").distinct(), "gram")
    n = F.coalesce("n", F.lit(0))
    count = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = sought.join(count, "gram", "left").groupBy("needle", "part").agg(F.min_by("gram", F.struct(n, "gram")).alias("gram"))
    tokens = grams.join(rarest, "gram").where(F.contains("token", "part")).select("token", "needle")
    return held.join(tokens, "token").select("id", "needle")


def occurrences(docs: DataFrame, needles: DataFrame, doc_id: str = "doc_id", needle_id: str = "item_id", fold: bool = False) -> DataFrame:
    """``needle_id, doc_id, place``: every pair of a row of ``needles`` and a row of ``docs`` whose ``text`` contains the needle's.

    ``place`` counts characters from 1 and is the first place.  ``fold`` compares lower-cased.  A null text contains
    nothing and is found nowhere; the empty string stands at place 1 of every text that is not null.  Ids may be null
    or repeated: each row with an id is verified on its own.  Both tables may have further columns of any name.
    """
    say = (lambda c: F.lower(c)) if fold else (lambda c: c)
    d = docs.select(F.col(doc_id).alias("id"), say(F.col("text")).alias("text")).where("text is not null")
    n = needles.select(F.col(needle_id).alias("needle_id"), say(F.col("text")).alias("needle")).where("needle is not null")
    each = n.select("needle").distinct().select("needle", _inner(F.col("needle"), _words(F.col("needle"))).alias("inner"))
    inside = (F.size("inner") > 0) | (F.col("needle") == "")
    found = _by_inner_words(d, each.where(inside))
    short = each.where(~inside)
    if not short.isEmpty():
        found = found.union(_by_vocabulary(d, short))
    found = found.distinct().withColumnRenamed("id", "found_id")
    sure = found.join(d, F.col("id").eqNullSafe(F.col("found_id"))).where(F.contains("text", "needle"))
    placed = sure.select("needle", F.col("id").alias(doc_id), F.instr(F.col("text"), F.col("needle")).alias("place"))
    return placed.join(n, "needle").select(F.col("needle_id").alias(needle_id), doc_id, F.col("place").cast("bigint").alias("place"))
