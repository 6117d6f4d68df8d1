"""Minimal correction: which identities to retract so that no false conclusion is derived (TOP-14)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import stored

#: Costs per conflict within this factor are dealt with together.
STEP = 1.1


def retraction_costs(uses: DataFrame, false: DataFrame) -> DataFrame:
    """``identity, cost``: one for the retraction and one for every conclusion that would fall with it and is not false.

    ``uses(conclusion, identity)``: the identities that a derivation rests on;
    ``false(conclusion)``: the conclusions known to be false.
    """
    good = uses.select("conclusion", "identity").distinct().join(false.select("conclusion"), "conclusion", "left_anti")
    collateral = good.groupBy("identity").agg(F.count("*").alias("n"))
    return uses.select("identity").distinct().join(collateral, "identity", "left").select("identity", (F.lit(1.0) + F.coalesce("n", F.lit(0))).alias("cost"))


def minimal_correction(conflicts: DataFrame, costs: DataFrame) -> DataFrame:
    """TOP-14: ``identity, cost, n_hit, round``: identities whose retraction breaks every derivation of ``conflicts(conflict, identity)``.

    A weighted hitting set by greedy choice, in parallel: each round weighs every
    identity (cost per conflict not yet hit, told in steps of STEP), each open
    conflict names its cheapest identity, and an identity that all its open
    conflicts name is taken.  Identities taken in one round share no conflict,
    so the outcome is that of one-by-one greedy choice, STEP apart: the cost is
    at most ``STEP * (1 + ln n)`` of the least one, n the most conflicts of an
    identity.  Ties are broken by a hash, so that chains of ties fall apart in
    logarithmically many rounds.  A conflict of null identities only cannot be
    hit and is not looked at; costs default to 1 and are taken as at least 1e-9.
    """
    pairs = conflicts.select("conflict", "identity").where("conflict is not null and identity is not null").distinct()
    # STEP is a fixed factor: the logarithm only sorts costs into levels
    weight = F.greatest(F.coalesce("cost", F.lit(1.0)), F.lit(1e-9))
    open_ = stored(pairs.join(costs.groupBy("identity").agg(F.min("cost").alias("cost")), "identity", "left").select("conflict", "identity", weight.alias("cost")))
    taken, number = None, 0
    while not open_.isEmpty():
        number += 1
        level = F.floor(F.log(F.col("cost") / F.col("n")) / F.lit(math.log(STEP)))
        weighed = open_.groupBy("identity").agg(F.count("*").alias("n"), F.first("cost").alias("cost")).select("identity", "n", F.struct(level.alias("level"), F.xxhash64("identity").alias("tie"), "identity").alias("rank"))
        weighed = stored(weighed)
        ranked = open_.join(weighed, "identity")
        named = ranked.groupBy("conflict").agg(F.min("rank").alias("best"))
        votes = named.groupBy(F.col("best.identity").alias("identity")).agg(F.count("*").alias("votes"))
        win = stored(weighed.join(votes, "identity").where("votes = n").select("identity", "n"))
        won = open_.join(win, "identity")
        new = won.groupBy("identity").agg(F.first("cost").alias("cost"), F.count("*").alias("n_hit")).withColumn("round", F.lit(number))
        taken = new if taken is None else taken.union(new)
        taken = stored(taken)
        open_ = stored(open_.join(won.select("conflict").distinct(), "conflict", "left_anti"))
    return taken if taken is not None else open_.select("identity", "cost", F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).alias("round"))
