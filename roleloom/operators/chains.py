"""Long paths in few rounds: chain contraction by pointer doubling, and what builds on it.

A node with one edge in and one edge out only hands on what reaches it.  Whole
chains of such nodes are found by doubling pointers (a chain of n nodes in
log2 n rounds) and become one edge that knows its number of steps.  Search,
ranks, bounds and strong components then work on the edges that are left, and
the chain's nodes get their values from its ends.  Rounds: the logarithm of the
longest chain plus the depth of what branches and meets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import stored


#: Layers of sources and sinks that are trimmed before chains are contracted again.
TRIMS = 6


@dataclass
class Contracted:
    """``core(src, dst, steps)``; ``members(node, head, tail, before, after)``: steps from the chain's head and to its tail;
    ``rings(node, least)``: cycles of which no node has another edge, and the least node of each."""

    core: DataFrame
    members: DataFrame
    rings: DataFrame
    rounds: int


def contract(edges: DataFrame, keep: DataFrame | None = None) -> Contracted:
    """Chains of ``edges(src, dst, steps)`` as single edges; nodes of ``keep(node)`` stay in the core.

    Of parallel edges ``edges`` must hold one.  A node on a self-loop stays.
    """
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.min("dst").alias("next"), F.min("steps").alias("step"))
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.min("src").alias("prev"))
    inner = outs.join(ins, "node").where("n_out = 1 and n_in = 1 and next <> node")
    if keep is not None:
        inner = inner.join(keep.select("node").distinct(), "node", "left_anti")
    inner = stored(inner.select("node", "prev", "next", "step"))
    names = inner.select(F.col("node").alias("next"), F.lit(True).alias("goes_on"))
    on = inner.join(names, "next", "left")
    cur = stored(
        on.select(
            "node", F.when(F.col("goes_on"), F.col("next")).otherwise(F.col("node")).alias("to"), F.when(F.col("goes_on"), F.col("step")).otherwise(F.lit(0)).alias("far"),
            F.when(F.col("goes_on"), F.least("node", "next")).otherwise(F.col("node")).alias("least"), F.col("goes_on").isNull().alias("done"),
        )
    )
    rounds, limit = 0, max(1, cur.count()).bit_length() + 1
    while rounds < limit and not cur.where("not done").isEmpty():
        at = cur.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("least").alias("least2"), F.col("done").alias("done2"))
        # the pointers of nodes that are not done are all different: no hot key
        moved = cur.where("not done").join(at, "to").select("node", F.col("to2").alias("to"), (F.col("far") + F.col("far2")).alias("far"), F.least("least", "least2").alias("least"), F.col("done2").alias("done"))
        cur, rounds = stored(cur.where("done").union(moved)), rounds + 1
    found = cur.where("done").join(inner, "node")
    firsts = found.join(inner.select(F.col("node").alias("prev"), F.lit(True).alias("inside")), "prev", "left").where("inside is null")
    first = firsts.select(F.col("to").alias("chain"), F.col("prev").alias("head"), F.col("far").alias("length"), F.col("node").alias("first"))
    enter = edges.select(F.col("src").alias("head"), F.col("dst").alias("first"), F.col("steps").alias("enter"))
    last = inner.select(F.col("node").alias("chain"), F.col("next").alias("tail"), F.col("step").alias("leave"))
    chains = stored(first.join(enter, ["head", "first"]).join(last, "chain").select("chain", "head", "tail", "enter", "length", "leave"))
    members = found.select("node", F.col("to").alias("chain"), "far").join(chains, "chain")
    members = members.select("node", "head", "tail", (F.col("enter") + F.col("length") - F.col("far")).alias("before"), (F.col("far") + F.col("leave")).alias("after"))
    gone = inner.select("node")
    plain = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst", "steps")
    core = plain.union(chains.select("head", "tail", F.col("enter") + F.col("length") + F.col("leave")))
    return Contracted(stored(core), stored(members), cur.where("not done").select("node", "least"), rounds)


def _simple(edges: DataFrame) -> DataFrame:
    return edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct().withColumn("steps", F.lit(1).cast("bigint"))


def distances(edges: DataFrame, start: DataFrame) -> DataFrame:
    """JN-18: ``node, steps`` of all nodes that ``start(node)`` reaches along ``edges(src, dst)``, by the fewest steps."""
    roots = stored(start.select("node").where("node is not null").distinct())
    c = contract(_simple(edges), keep=roots)
    cheapest = stored(c.core.groupBy("src", "dst").agg(F.min("steps").alias("w")))
    best = stored(roots.withColumn("steps", F.lit(0).cast("bigint")))
    front = best
    while True:
        new = front.join(cheapest, front.node == cheapest.src).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("steps") + F.col("w")).alias("steps"))
        front = stored(new.join(best.withColumnRenamed("steps", "old"), "node", "left").where("old is null or steps < old").select("node", "steps"))
        if front.isEmpty():
            break
        best = stored(best.union(front).groupBy("node").agg(F.min("steps").alias("steps")))
    inside = c.members.join(best.withColumnRenamed("node", "head"), "head").select("node", (F.col("steps") + F.col("before")).alias("steps"))
    return best.union(inside)


def longest_depth(edges: DataFrame) -> DataFrame:
    """WIN-08: ``node, psi``: the most steps on a path of ``edges(src, dst)`` that ends in the node; nodes of one cycle share theirs.

    Cycles are condensed first (steps within one do not count).
    """
    simple = stored(_simple(edges))
    nodes = stored(edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct())
    scc = strong_components(simple)
    if scc.isEmpty():
        dag, named = simple, nodes.select("node", F.col("node").alias("c"))
    else:
        named = stored(nodes.join(scc, "node", "left").select("node", F.coalesce("component", "node").alias("c")))
        of = lambda x: named.select(F.col("node").alias(x), F.col("c").alias(f"{x}_c"))
        dag = simple.join(of("src"), "src").join(of("dst"), "dst").where("src_c <> dst_c").select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst"), "steps").distinct()
    c = contract(dag)
    heavy = stored(c.core.groupBy("src", "dst").agg(F.max("steps").alias("w")))
    best = stored(named.select(F.col("c").alias("node")).distinct().join(c.members.select("node"), "node", "left_anti").withColumn("psi", F.lit(0).cast("bigint")))
    front = best
    while True:  # depths only grow, and end as there is no cycle
        new = front.join(heavy, front.node == heavy.src).groupBy(F.col("dst").alias("node")).agg(F.max(F.col("psi") + F.col("w")).alias("new"))
        front = stored(new.join(best, "node").where("new > psi").select("node", F.col("new").alias("psi")))
        if front.isEmpty():
            break
        best = stored(best.union(front).groupBy("node").agg(F.max("psi").alias("psi")))
    inside = c.members.join(best.withColumnRenamed("node", "head"), "head").select("node", (F.col("psi") + F.col("before")).alias("psi"))
    return best.union(inside).withColumnRenamed("node", "c").join(named, "c").select("node", "psi")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have edges in and out."""
    starts, ends = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
    return edges.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst", "steps")


def strong_components(edges: DataFrame) -> DataFrame:
    """PIP-21: ``node, component`` of the nodes that lie on a cycle of ``edges(src, dst)``; component: a node of it.

    Sources and sinks are trimmed and chains contracted as long as there are any.
    Of what is left, the least node that reaches a node colours it (labels jump
    to the labels' labels); a colour's nodes that reach its root are one
    component.  Nodes between cycles belong to none.  Self-loops are not cycles
    here (``causal_paradoxes`` tells them apart).
    """
    cur = stored(_simple(edges))
    before: list[DataFrame] = []  # members of the chains of each round
    found: list[DataFrame] = []
    while not cur.isEmpty():
        n = cur.count()
        c = contract(cur)
        before.append(c.members)
        found.append(c.rings.select("node", F.col("least").alias("component")))
        loops = c.core.where("src = dst").select(F.col("src").alias("node")).distinct()  # a chain from a node to itself
        rest = c.core.where("src <> dst").groupBy("src", "dst").agg(F.min("steps").alias("steps"))
        m = n
        for _ in range(TRIMS):  # some layers at once, before chains are looked for again
            rest, last = stored(_trimmed(rest)), m
            m = rest.count()
            if m in (0, last):
                break
        found.append(loops.select("node", F.col("node").alias("component")))  # goes if the node is found in a larger one
        if m < n:  # there may be more to trim and to contract
            cur = rest
            continue
        part = _coloured(rest)
        found.append(part)
        done = part.select("node")
        cur = stored(_trimmed(rest.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti")))
    if not found:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    total = found[0]
    for f in found[1:]:
        total = total.union(f)
    total = _merged(total)
    for members in reversed(before):  # a chain between two nodes of one component is part of it
        ends = lambda x: total.select(F.col("node").alias(x), F.col("component").alias(f"{x}_c"))  # noqa: B023, E731
        inside = members.join(ends("head"), "head").join(ends("tail"), "tail").where("head_c = tail_c").select("node", F.col("head_c").alias("component"))
        total = _merged(total.union(inside))
    return total


def _merged(found: DataFrame) -> DataFrame:
    """A node's component; one of several nodes goes before the node alone that was noted for a loop."""
    alone = F.col("node") == F.col("component")
    return stored(found.groupBy("node").agg(F.min(F.when(~alone, F.col("component"))).alias("other"), F.max(alone).alias("own")).select("node", F.coalesce("other", "node").alias("component")))


def _coloured(edges: DataFrame) -> DataFrame:
    """Strong components of more than one node that one round of colouring finds."""
    color = stored(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("c", F.col("node")))
    while True:
        into = edges.join(color.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("via"))
        new = color.join(into, "node", "left").select("node", F.least("c", "via").alias("new"), "c")
        jump = color.select(F.col("node").alias("new"), F.col("c").alias("up"))
        new = stored(new.join(jump, "new").select("node", F.least("new", "up").alias("new"), "c"))
        color = new.select("node", F.col("new").alias("c"))
        if new.where("new <> c").isEmpty():
            break
    of = lambda x: color.select(F.col("node").alias(x), F.col("c").alias(f"{x}_c"))
    same = stored(edges.join(of("src"), "src").join(of("dst"), "dst").where("src_c = dst_c").select("src", "dst", F.col("src_c").alias("c")))
    back = stored(color.where("node = c"))
    front = back
    while True:
        step = same.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "c").distinct()
        front = stored(step.join(back.select("node"), "node", "left_anti"))
        if front.isEmpty():
            break
        back = stored(back.union(front))
    several = back.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
    # of nodes with edges in there are components that no other reaches: those at least are found in every round
    return stored(back.join(several, "c", "left_semi").select("node", F.col("c").alias("component")))


def causal_paradoxes(edges: DataFrame) -> DataFrame:
    """PIP-21: ``src, dst, at, component, status`` of the edges ``(src, dst, at)`` that no acyclic graph could hold.

    SELF_CAUSATION: an edge from a node to itself (an extraction error).
    SUSPECT: the newest edge within each strong component (by ``at``, then src
    and dst); the others within it are CYCLE.  Parallel edges are told one by
    one, equal ones once; edges between components are fine.
    """
    rows = edges.select("src", "dst", "at").where("src is not null and dst is not null").distinct()
    scc = strong_components(rows)
    of = lambda x: scc.select(F.col("node").alias(x), F.col("component").alias(f"{x}_c"))
    inside = rows.where("src <> dst").join(of("src"), "src").join(of("dst"), "dst").where("src_c = dst_c").withColumn("component", F.col("src_c"))
    # components are named by their least node, and have one newest edge: an aggregate joined back, no window over a hot component
    least = scc.groupBy("component").agg(F.min("node").alias("name"))
    newest = inside.groupBy("component").agg(F.max(F.struct("at", "src", "dst")).alias("newest"))
    told = inside.join(newest, "component").join(least, "component")
    status = F.when(F.struct("at", "src", "dst") == F.col("newest"), "SUSPECT").otherwise("CYCLE")
    out = told.select("src", "dst", "at", F.col("name").alias("component"), status.alias("status"))
    loops = rows.where("src = dst").select("src", "dst", "at", F.col("src").alias("component"), F.lit("SELF_CAUSATION").alias("status"))
    return out.union(loops)


def confidence_closure(edges: DataFrame, max_hops: int = 3, least: float = 0.0) -> DataFrame:
    """JN-17: ``src, dst, conf``: the best product of confidences over paths of at most ``max_hops`` edges ``(src, dst, conf)``.

    A path that is no better than one found before (with no more edges) is
    dropped at once, as is one below ``least``; confidences lie in 0 to 1.
    """
    step = stored(edges.groupBy("src", "dst").agg(F.max("conf").alias("conf")).where(F.col("conf") >= least))
    best = front = step
    for _ in range(max_hops - 1):
        on = step.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("conf").alias("more"))
        new = front.withColumnRenamed("dst", "mid").join(on, "mid").where("src <> to").groupBy("src", F.col("to").alias("dst")).agg(F.max(F.col("conf") * F.col("more")).alias("conf"))
        better = new.where(F.col("conf") >= least).join(best.withColumnRenamed("conf", "old"), ["src", "dst"], "left").where("old is null or conf > old")
        front = stored(better.select("src", "dst", "conf"))
        if front.isEmpty():
            break
        best = stored(best.union(front).groupBy("src", "dst").agg(F.max("conf").alias("conf")))
    return best


def upper_bounds(before: DataFrame, times: DataFrame) -> DataFrame:
    """PIP-22: ``event, bound, is_derived``: known times, and for other events the least time known on any way ahead of ``before(e1, e2)``.

    A way ends at the first event whose time is known.
    """
    known = stored(times.select(F.col("event").alias("node"), F.col("at").alias("bound")))
    edges = before.select(F.col("e1").alias("src"), F.col("e2").alias("dst"))
    # nothing goes on behind a known event
    open_ = stored(_simple(edges).join(known.select(F.col("node").alias("src")), "src", "left_anti"))
    c = contract(open_, keep=known)
    core = stored(c.core.select("src", "dst").distinct())
    best = front = stored(known.where("bound is not null"))
    while True:
        new = core.join(front.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("bound").alias("bound"))
        front = stored(new.join(best.withColumnRenamed("bound", "old"), "node", "left").where("old is null or bound < old").select("node", "bound"))
        if front.isEmpty():
            break
        best = stored(best.union(front).groupBy("node").agg(F.min("bound").alias("bound")))
    inside = c.members.join(best.withColumnRenamed("node", "tail"), "tail").select("node", "bound")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(known.select("node")).distinct()
    sure = known.select("node", F.lit(True).alias("sure"))
    bounds = stored(best.union(inside))
    return nodes.join(bounds, "node", "left").join(sure, "node", "left").select(F.col("node").alias("event"), "bound", F.col("sure").isNull().alias("is_derived"))
