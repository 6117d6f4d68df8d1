"""Facts that meet: contradictions by five rules (PIP-20) and merged events by multiplicity (AGG-23)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules in order of precedence and the column that each compares; larger wins.
RULES = [("temporal_recency", "recency"), ("explicit_over_inferred", "explicit"), ("domain_authority", "authority"), ("specificity", "specificity")]
UNRESOLVED = "CONTRADICTION_UNRESOLVED"


def contradictions(facts: DataFrame, subject: Sequence[str], bucket: str = "30 DAYS") -> DataFrame:
    """PIP-20: ``winner, loser, rule, status``: the log of facts that another one of the same subject contradicts.

    ``facts(fact_id, <subject>, value, valid_from, valid_to, recency, explicit,
    authority, specificity)``.  A fact is laid into every bucket of time that its
    interval touches.  In each bucket the first fact by the rules, in order,
    stands; every fact with another value whose interval overlaps its is logged
    against it, with the rule that decided: the first in which they differ.  If
    none does, the rule is ``manual_review`` and the status unresolved (the
    smaller fact_id is then named first).  Losers are superseded, not deleted.

    One aggregate names the winners and is joined back: no fact meets all others
    of its subject.  Null values contradict nothing, nulls in a rule's column
    lose to others.
    """
    keys = list(subject)
    low, high = F.window("valid_from", bucket)["start"], F.window("valid_to", bucket)["start"]
    f = facts.where("value is not null and valid_from <= valid_to").withColumn("_low", low).withColumn("_high", high)
    f = f.withColumn("_bucket", F.explode(F.sequence("_low", "_high", F.expr(f"INTERVAL {bucket}"))))
    columns = [c for _, c in RULES]
    # nulls are the least in a maximum of structs; the smallest id stands first among equals
    stand = F.max(F.struct(*columns, (-F.col("fact_id")).alias("_minus"), F.struct("value", "valid_from", "valid_to").alias("_more"))).alias("w")
    told = f.join(f.groupBy(*keys, "_bucket").agg(stand), [*keys, "_bucket"])
    clash = told.where((F.col("value") != F.col("w._more.value")) & (F.col("valid_from") <= F.col("w._more.valid_to")) & (F.col("w._more.valid_from") <= F.col("valid_to")))
    rule = F.coalesce(*[F.when(~F.col(c).eqNullSafe(F.col(f"w.{c}")), F.lit(name)) for name, c in RULES], F.lit("manual_review"))
    status = F.when(F.col("rule") == "manual_review", UNRESOLVED).otherwise("resolved")
    return clash.select((-F.col("w._minus")).alias("winner"), F.col("fact_id").alias("loser"), rule.alias("rule")).distinct().withColumn("status", status)


def merged_events(events: DataFrame, participants: Sequence[str], kind: Column, gap: str = "1 DAY", source: str = "source") -> DataFrame:
    """AGG-23: ``<participants>, kind, event, n, first_at, last_at, sources`` of ``events(event_id, at, source, <participants>)``.

    ``kind`` is the multiplicity: ``singleton`` events of the same participants
    are one; ``bounded`` ones are one while no more than ``gap`` lies between
    neighbours; others are never merged.  ``event`` is the smallest event_id,
    ``sources`` the sorted distinct sources.  Events without a time are not
    merged unless they are singletons.
    """
    keys = list(participants)
    rows = events.select(*keys, "event_id", "at", F.col(source).alias("source"), kind.alias("kind"))
    once = rows.where("kind = 'singleton'").withColumn("run", F.lit(0).cast("bigint"))
    timed = (F.col("kind") == "bounded") & F.col("at").isNotNull()
    w = Window.partitionBy(*keys).orderBy("at", "event_id")
    cut = F.when(F.col("at") <= F.lag("at").over(w) + F.expr(f"INTERVAL {gap}"), 0).otherwise(1)
    some = rows.where(timed).withColumn("cut", cut).withColumn("run", F.sum("cut").over(w)).drop("cut")
    alone = rows.where(F.coalesce(F.col("kind") != "singleton", F.lit(True)) & ~F.coalesce(timed, F.lit(False))).withColumn("run", F.col("event_id").cast("bigint"))
    every = once.unionByName(some).unionByName(alone)
    return every.groupBy(*keys, "kind", "run").agg(
        F.min("event_id").alias("event"), F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.array_sort(F.collect_set("source")).alias("sources")
    ).drop("run")
