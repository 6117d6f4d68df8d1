"""Atoms, retractable identities and derivations (PIP-15..19, AGG-26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import equivalence

ATOM = "id string, symbol string, arguments array<string>, confidence double, source string, active boolean"
#: symbol -> (kind, retractable)
KINDS = {"≡": ("IDENTITY", True), "derive": ("TRACE", True), "before": ("TEMPORAL", False), "RETRACT_IDENTITY": ("SYSTEM", False), "trace": ("AUDIT", False)}


def kind(symbol: Column) -> Column:
    """FLT-18: EVENT unless the registry knows better."""
    out = F.lit("EVENT")
    for s, (k, _) in KINDS.items():
        out = F.when(symbol == s, k).otherwise(out)
    return out


def accepts(min_confidence: float = 0.0, sources: list[str] | None = None, excluded: list[str] | None = None) -> Column:
    """FLT-15: the atoms that a context admits."""
    ok = F.col("active") & (F.col("confidence") >= min_confidence)
    if sources:
        ok = ok & F.col("source").isin(sources)
    return ok & ~F.col("id").isin(excluded) if excluded else ok


def active_atoms(atoms: DataFrame, context: Column | None = None) -> DataFrame:
    """FLT-16: admitted atoms; a derivation needs all identities among its arguments admitted."""
    ok = atoms.where(accepts() if context is None else context)
    named = atoms.where(kind(F.col("symbol")) == "IDENTITY").select(F.col("id").alias("arg"))
    good = ok.select(F.col("id").alias("arg"))
    bad = ok.where(kind(F.col("symbol")) == "TRACE").select("id", F.explode("arguments").alias("arg")).join(named, "arg", "left_semi").join(good, "arg", "left_anti")
    return ok.join(bad.select("id"), "id", "left_anti")


def identity_classes(atoms: DataFrame) -> DataFrame:
    """JN-16 over active identity atoms."""
    pairs = atoms.where(accepts() & (F.col("symbol") == "≡")).select(F.col("arguments")[0].alias("src"), F.col("arguments")[1].alias("dst"))
    return equivalence(pairs)


def invalidate_identity(atoms: DataFrame, identity: str) -> DataFrame:
    """PIP-17: the identity and the derivations that name it become inactive (one level); a retraction and a trace are added."""
    is_id = (F.col("id") == identity) & (kind(F.col("symbol")) == "IDENTITY")
    falls = (F.col("symbol") == "derive") & F.array_contains("arguments", identity)
    kept = atoms.withColumn("active", F.col("active") & ~is_id & ~falls)
    hit = atoms.where(is_id & F.col("active"))
    row = lambda name, symbol: hit.select(F.lit(name).alias("id"), F.lit(symbol).alias("symbol"), F.array(F.lit(identity)).alias("arguments"), F.lit(1.0).alias("confidence"), F.lit("system").alias("source"), F.lit(True).alias("active"))
    return kept.union(row(f"r{identity}", "RETRACT_IDENTITY")).union(row(f"t{identity}", "trace"))


def combined(frames: Column, identities: Column, rule: str = "product") -> Column:
    """AGG-26: confidence of a merge; product of all, min of all, or min of frames times min of identities."""
    least = lambda a: F.coalesce(F.array_min(a), F.lit(1.0))
    if rule == "min":
        return F.least(least(frames), least(identities))
    if rule == "min_min":
        return least(frames) * least(identities)
    return F.aggregate(F.concat(frames, identities), F.lit(1.0), lambda s, x: s * x)


#: status -> how it is shown: hidden ones need ``include_hidden``
VISIBILITY = {"active": "visible", "disputed": "warning", "retracted": "hidden", "superseded": "hidden"}


def visible(events: DataFrame, include_hidden: bool = False) -> DataFrame:
    """FLT-21: events with how they are shown; retracted and superseded ones only on request, nothing is deleted."""
    shown = F.lit("visible")
    for status, how in VISIBILITY.items():
        shown = F.when(F.col("status") == status, how).otherwise(shown)
    out = events.withColumn("shown", shown)
    return out if include_hidden else out.where("shown <> 'hidden'")


def preferred(events: DataFrame, keys: list[str], levels: list[str] | None = None) -> DataFrame:
    """FLT-22: rank of each event among those that answer the same: explicit ones first, inferred ones flagged.
    A missing level counts as explicit; ``levels`` keeps only these."""
    e = events.withColumn("level", F.coalesce("level", F.lit("explicit"))).withColumn("inferred", F.startswith("level", F.lit("inferred_")))
    e = e.where(F.col("level").isin(levels)) if levels else e
    order = F.when(F.col("level") == "explicit", 0).when(F.col("inferred"), 1).otherwise(2)
    return e.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "frame_id")))


def verify(conclusions: DataFrame, evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """PIP-16: whether a conclusion ``(conclusion, total)`` still follows from ``evidence(conclusion, id)``: all of it
    is among ``facts(id, amount)`` and the sum computed anew is the one stated."""
    found = evidence.join(facts, "id", "left").groupBy("conclusion").agg(F.count_if(F.col("amount").isNull()).alias("lost"), F.sum("amount").alias("again"))
    ok = (F.col("lost") == 0) & F.equal_null("again", "total")
    return conclusions.join(found, "conclusion", "left").select("conclusion", F.coalesce(ok, F.lit(False)).alias("valid"))


def trace_back(contradictions: DataFrame, glue: DataFrame, identities: DataFrame) -> DataFrame:
    """PIP-18: the identity to invalidate for each contradiction ``(left, right)``: the least sure one, first by id,
    that the traces ``glue(conclusion, identity)`` of both sides share; none if they share none."""
    a = contradictions.join(glue.select(F.col("conclusion").alias("left"), "identity"), "left")
    both = a.join(glue.select(F.col("conclusion").alias("right"), "identity"), ["right", "identity"])
    sure = both.join(identities.select(F.col("id").alias("identity"), "confidence"), "identity")
    return sure.groupBy("left", "right").agg(F.min_by("identity", F.struct("confidence", "identity")).alias("weakest"))


def correct(glue: DataFrame, identities: DataFrame, contradictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PIP-18: identities that stay, and the conclusions that fall with those that go (to be computed anew)."""
    gone = trace_back(contradictions, glue, identities).select(F.col("weakest").alias("identity")).distinct()
    fallen = glue.join(gone, "identity", "left_semi").select("conclusion").distinct()
    return identities.join(gone.withColumnRenamed("identity", "id"), "id", "left_anti"), fallen


#: primitive -> (store it acts on, whether the item is there afterwards); INFER and CORRECT are computed from state
PRIMITIVES = {"ASSERT": ("O", True), "OBSERVE": ("O", True), "RETRACT": ("O", False), "UNIFY": ("I", True), "SPLIT": ("I", False), "UPDATE": ("D", True)}


def replay(ops: DataFrame, force: bool = False) -> DataFrame:
    """PIP-19: state ``store, item`` after the operations ``ops(seq, op, item, replaces)``.

    The last operation on an item decides.  Observations are permanent: a RETRACT of one is ignored unless ``force``.
    UPDATE removes ``replaces`` and adds ``item``.
    """
    store, alive = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for name, (where, stays) in PRIMITIVES.items():
        store, alive = F.when(F.col("op") == name, where).otherwise(store), F.when(F.col("op") == name, stays).otherwise(alive)
    known = ops.where(F.col("op").isin(list(PRIMITIVES)))
    known = known if force else known.where("op <> 'RETRACT'")
    main = F.struct(store.alias("store"), F.col("item").alias("item"), alive.alias("alive"), F.lit(1).alias("part"))
    old = F.struct(F.lit("D").alias("store"), F.col("replaces").alias("item"), F.lit(False).alias("alive"), F.lit(0).alias("part"))
    both = F.when((F.col("op") == "UPDATE") & F.col("replaces").isNotNull(), F.array(old, main)).otherwise(F.array(main))
    flat = known.select("seq", F.inline(both))
    return flat.groupBy("store", "item").agg(F.max_by("alive", F.struct("seq", "part")).alias("alive")).where("alive").select("store", "item")


def views(base: DataFrame, ends: DataFrame) -> DataFrame:
    """PIP-23: ``key, valid_from, valid_to`` of a view over ``base(key, at)``: it holds until the first later event in
    ``ends(key, at)``, for ever if there is none."""
    stop = ends.select(F.col("key").alias("ended"), F.col("at").alias("stop"))
    joined = base.join(stop, (F.col("key") == F.col("ended")) & (F.col("stop") > F.col("at")), "left")
    return joined.groupBy("key", F.col("at").alias("valid_from")).agg(F.min("stop").alias("valid_to"))


def obstructions(one: DataFrame, two: DataFrame) -> DataFrame:
    """PIP-33: entities seen from both points of view whose classes ``(node, canonical)`` differ within the overlap;
    the two views have a common extension exactly if there are none.

    Two classes are equal if they share all their members, so three counts decide; no member list is built.
    """
    both = one.select("node", F.col("canonical").alias("a")).join(two.select("node", F.col("canonical").alias("b")), "node")
    shared = both.groupBy("a", "b").agg(F.count("*").alias("n_ab"))
    sizes = [both.groupBy(c).agg(F.count("*").alias(f"n_{c}")) for c in "ab"]
    counted = both.join(shared, ["a", "b"]).join(sizes[0], "a").join(sizes[1], "b")
    return counted.where("n_ab <> n_a or n_ab <> n_b").select("node", "a", "b")


def acquisitions(frames: DataFrame, process: str, source: Column, at: Column, module: str) -> DataFrame:
    """PIP-35: one provenance frame for each base frame."""
    return frames.select(F.concat(F.lit("acq:"), "frame_id").alias("acquisition_id"), "frame_id", F.lit(process).alias("process"), source.alias("source"), at.alias("at"), F.lit(module).alias("module"))


def interpretation(readings: DataFrame) -> DataFrame:
    """PIP-38: the reading that holds for each sentence ``(sentence_id, reading, specificity, confidence, fits)``:
    readings that fit their restrictions first, then the exception before the rule, then confidence.  ``figurative``
    is true if no literal reading fits."""
    w = Window.partitionBy("sentence_id").orderBy(F.desc("fits"), F.desc("specificity"), F.desc("confidence"), "reading")
    return readings.withColumn("place", F.row_number().over(w)).where("place = 1").select("sentence_id", "reading", (~F.col("fits")).alias("figurative"))
