"""Mixing sources to target weights by iterative proportional fitting.

Token weights are counted in cells (source, lang, topic) and raked in turn to
the three target marginals and to what each cell can give, until they settle;
documents are then sampled with the calibrated probability of their cell.
DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, release, renamed_back, scratch

#: Default targets: a marginal's share is its token share to this power, normed.
TEMPER = {"source": 0.7, "lang": 0.5, "topic": 1.0}
#: Expected share of the tokens that the sample keeps.
KEEP = 0.7
#: Raking ends when the marginals are off by no more than this share of all tokens, or STEP rounds better that by no more.
TOLERANCE, STEP = 0.002, 4
#: Up to so many cells are raked in one task, without shuffles.
ONE_TASK = 100_000
_DIMS = ("source", "lang", "topic")

Targets = Mapping[str, "Mapping[str, float] | DataFrame"]

#: Words that speak for a topic; the topic with most of them in a text wins, the first of equals; a text with none is prose.
TOPICS = {
    "legal": ("license", "licensed", "licence", "copyright", "rights", "reserved", "warranty", "terms", "permission"),
    "contact": ("@", "mail", "email", "phone", "tel", "call", "contact", "address"),
    "table": ("|", "total", "price", "qty", "id", "name", "date"),
    "code": ("{", "}", "def", "return", "function", "import", "class", "var", "password", "key", "token", "secret"),
}


def token_estimate(text: Column) -> Column:
    """Tokens of a text: its UTF-8 bytes by four, one at least; a null text has none."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4))).cast("bigint")


#: The characters other than A-Z whose lower case has a letter of a-z (Kelvin sign, dotted capital I); fixed values of Unicode.
LOWERED_TO_ASCII = ("\u212a", "\u0130")


def topic_of(text: Column) -> Column:
    """A coarse topic by the distinct TOPICS words in the text (A-Z lower-cased; the signs ``@ | { }`` are words wherever they stand).

    Never null, so that a join on it adds no filter that would work it out again.
    """
    text = F.coalesce(text, F.lit(""))
    special = F.contains(text, F.lit(LOWERED_TO_ASCII[0])) | F.contains(text, F.lit(LOWERED_TO_ASCII[1]))
    # lower() is the faster by far; it gives the same words but for texts with one of those characters
    plain = F.when(special, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))
    for sign in "@|{}":
        plain = F.replace(plain, F.lit(sign), F.lit(f" {sign} "))
    found = F.array_intersect(F.split(plain, r"[^a-z@|{}]+"), F.array(*(F.lit(w) for words in TOPICS.values() for w in words)))
    return F.coalesce(F.transform(F.array(found), _most)[0], F.lit("prose"))


def _most(found: Column) -> Column:
    scores = [F.struct(F.size(F.array_intersect(found, F.array(*map(F.lit, words)))).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(TOPICS.items())]
    best = F.greatest(*scores, F.struct(F.lit(0).alias("n"), F.lit(1).alias("i"), F.lit("prose").alias("name")))
    return best["name"]


def chance(doc_id: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on doc_id and seed alone; a null id counts as the word null."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def _filled(goals: DataFrame, total: float) -> DataFrame:
    """``goals(value, goal, most)`` scaled to the total, none above ``most``: what one cannot take goes to the others in proportion."""
    held = -1.0
    while True:
        # values that reach their most at this scale stay there; the others share the rest
        full = F.lit(False) if held < 0 else F.col("goal") * F.lit(held) >= F.col("most")
        got = goals.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("goal")))).first()
        scale = (total - (got[0] or 0.0)) / got[1] if got[1] else held
        if scale <= held:
            return goals.withColumn("goal", F.least(F.col("goal") * F.lit(max(held, 0.0)), F.col("most"))).drop("most")
        held = scale


def goals_of(cells: DataFrame, targets: Targets | None = None, temper: Mapping[str, float] | None = None, keep: float = KEEP) -> dict[str, DataFrame]:
    """For each dimension ``value, goal``: the tokens that its values are to have of all that there are.

    ``targets[d]``: shares by value, as a mapping or a table ``(value, share)``;
    values without one get none.  Dimensions without targets: token shares to
    the power ``temper[d]``.  A value's goal is never above what it can give,
    ``tokens / keep``; the rest goes to the others in proportion.
    """
    temper = {**TEMPER, **(temper or {})}
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    out = {}
    for d in _DIMS:
        m = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").cast("double").alias("t"))
        given = (targets or {}).get(d)
        if given is None:
            goal = F.when(F.col("t") > 0, F.pow("t", F.lit(float(temper[d])))).otherwise(F.lit(0.0))
        else:
            if not isinstance(given, DataFrame):
                given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], "value string, share double")
            m = m.join(given.select("value", "share"), "value", "left")
            goal = F.when(F.col("t") > 0, F.coalesce("share", F.lit(0.0))).otherwise(F.lit(0.0))
        goals = materialize(m.select("value", goal.alias("goal"), (F.col("t") / F.lit(keep)).alias("most")), f"goal-{d}")
        out[d] = materialize(_filled(goals, total), f"goal-{d}")
    return out


def rake(cells: DataFrame, goals: dict[str, DataFrame], keep: float = KEEP, tolerance: float = TOLERANCE) -> DataFrame:
    """``source, lang, topic, tokens, weight`` for each row of ``cells(source, lang, topic, tokens)``.

    Every round scales the weights to the three marginals in turn and cuts each
    to what its cell can give, ``tokens / keep``; the next round deals the cut
    mass to the others.  It ends when all marginals are met within the
    tolerance or, where no weights can meet them all, when they have settled.
    Cells are categories, not rows.  Up to ONE_TASK of them are raked in one
    task; more are summed by partial aggregation and joined with the sums of
    their values, one job a marginal, with the same weights but for rounding.
    """
    head = cells.agg(F.sum("tokens"), F.count("*")).first()
    total, alone = float(head[0] or 0), head[1] <= ONE_TASK
    fit = cells.select(*_DIMS, "tokens", F.col("tokens").cast("double").alias("weight"))
    for d in _DIMS:
        fit = fit.join(goals[d].select(F.col("value").alias(d), F.col("goal").alias(f"goal_{d}")), d)
    fit, before = materialize(fit, "fit"), None
    while total > 0:
        now = fit.coalesce(1) if alone else fit
        for _ in range(STEP):
            for d in _DIMS:
                if alone:
                    w = Window.partitionBy(d)
                    now = now.withColumns({"have": F.sum("weight").over(w), "n": F.count("*").over(w)})
                else:  # partial sums of every task, then a join: the cells of one value never meet in one task
                    now = now.join(now.groupBy(d).agg(F.sum("weight").alias("have"), F.count("*").alias("n")), d)
                now = now.withColumn(f"miss_{d}", F.abs(F.col("have") - F.col(f"goal_{d}")) / F.col("n"))
                now = now.withColumn("weight", F.when(F.col("have") > 0, F.col("weight") * F.col(f"goal_{d}") / F.col("have")).otherwise(F.lit(0.0))).drop("have", "n")
                if not alone:
                    now = materialize(now, "fit")  # both sides of the next join read it
            now = now.withColumn("weight", F.least("weight", F.col("tokens") / F.lit(keep)))
        fit = materialize(now, "fit")
        off = fit.agg(F.sum(F.col("miss_source") + F.col("miss_lang") + F.col("miss_topic"))).first()[0] / total
        if off <= tolerance or (before is not None and before - off <= tolerance):
            break
        before = off
    return fit.select(*_DIMS, "tokens", "weight")


def sampling_plan(docs: DataFrame, keep: float = KEEP, targets: Targets | None = None, temper: Mapping[str, float] | None = None, topic: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, rates)``: documents with tokens and topic; cells with weight and prob.  topic: a column of docs, else topic_of the text."""
    text = F.col("text").cast("string")
    rows = docs.select(
        *numbered(docs), F.col("doc_id").alias("_doc_id"), (F.coalesce(F.col(f"`{topic}`").cast("string"), F.lit("")) if topic else topic_of(text)).alias("_topic"),
        token_estimate(text).alias("_tokens"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"),
    )
    with scratch(docs.sparkSession):
        cells = rows.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("tokens"))
        cells = materialize(cells, "cells")
        fit = rake(cells, goals_of(cells, targets, temper, keep), keep)
        prob = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(keep) * F.col("weight") / F.col("tokens"))).otherwise(F.lit(0.0))
        rates = materialize(fit.select(*_DIMS, "weight", F.round(prob, 6).alias("prob")), "rates", outer=True)
    return rows, rates


def mix_sources(docs: DataFrame, keep: float = KEEP, targets: Targets | None = None, temper: Mapping[str, float] | None = None, topic: str | None = None) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, weight, prob, kept`` for every row of documents.

    See goals_of for targets and temper.  A null source, language or topic is a
    category of its own, named by an empty string; a null text has no tokens
    and is not kept.  kept compares prob with a number drawn from doc_id, so
    repeated rows and later runs agree.  ``weight``: the document's expected
    tokens in the sample.  An empty table gives no row.  Rates go to the
    documents by a join on the cell (broadcast only if Spark finds the table
    small).
    """
    rows, rates = sampling_plan(docs, keep, targets, temper, topic)
    rates = rates.select(*(F.col(d).alias(f"_{d}") for d in _DIMS), F.col("prob").alias("_p"))
    out = rows.select("_doc_id", "_source", "_lang", "_topic", "_tokens").join(rates, [f"_{d}" for d in _DIMS])
    return out.select(
        F.col("_doc_id").alias("doc_id"),
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("tokens"),
        F.round(F.col("_p") * F.col("_tokens"), 6).alias("weight"),
        F.col("_p").alias("prob"),
        (chance(F.col("_doc_id")) < F.col("_p")).alias("kept"),
    )


def mixing_report(docs: DataFrame, keep: float = KEEP, targets: Targets | None = None, temper: Mapping[str, float] | None = None, topic: str | None = None) -> DataFrame:
    """``dim, value, tokens, target, expected``: of each value its tokens, the share of the sample that it is to have and the share that the rates give it."""
    with scratch(docs.sparkSession):
        rows, rates = sampling_plan(docs, keep, targets, temper, topic)
        cells = rows.groupBy(*(F.col(f"_{d}").alias(d) for d in _DIMS)).agg(F.sum("_tokens").alias("tokens"))
        cells = materialize(cells.join(rates, list(_DIMS)), "cells")
        wanted = goals_of(cells, targets, temper, 1e-12)  # what is asked for, whether there is enough or not
        told = None
        for d in _DIMS:
            have = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("prob")).alias("w"))
            both = have.join(wanted[d], "value")
            sums = both.agg(F.sum("w").alias("sw"), F.sum("goal").alias("sg"))
            part = both.crossJoin(F.broadcast(sums)).select(F.lit(d).alias("dim"), "value", "tokens", F.try_divide("goal", "sg").alias("target"), F.try_divide("w", "sw").alias("expected"))  # one row
            told = part if told is None else told.union(part)
        out = materialize(told, "report", outer=True)
        release(rates)
        return out


def sample_documents(docs: DataFrame, keep: float = KEEP, targets: Targets | None = None, temper: Mapping[str, float] | None = None, topic: str | None = None) -> DataFrame:
    """The documents that mix_sources keeps, with the columns they came with."""
    rows, rates = sampling_plan(docs, keep, targets, temper, topic)
    rates = rates.select(*(F.col(d).alias(f"_{d}") for d in _DIMS), F.col("prob").alias("_p"))
    out = rows.join(rates, [f"_{d}" for d in _DIMS])
    return renamed_back(out.where(chance(F.col("_doc_id")) < F.col("_p")), docs)
