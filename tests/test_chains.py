"""Chains, cycles, closures and corrections against brute force."""

import itertools
import math
import random

from pyspark.sql import functions as F

from roleloom.operators import chains, correction


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def reach(edges):
    nodes = {x for e in edges for x in e}
    out = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for a, b in edges:
                if a == todo[-1] and b not in seen:
                    break
            else:
                todo.pop()
                continue
            seen.add(b)
            todo.append(b)
        out[n] = seen
    return out


def graphs(count, seed=0, acyclic=False):
    """Disjoint random graphs as one edge list: sparse and dense ones, with chains between and behind."""
    rng, out = random.Random(seed), []
    for g in range(count):
        n, base = rng.randrange(2, 9), 100 * g
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 2 * n))}
        if acyclic:
            edges = {(min(e), max(e)) for e in edges if e[0] != e[1]}
        more = n
        for a, b in list(edges):
            if rng.random() < 0.3:  # the edge becomes a chain
                steps = [a, *range(more, more + rng.randrange(1, 6)), b]
                more += len(steps) - 2
                edges.remove((a, b))
                edges |= set(itertools.pairwise(steps))
        out.append([(base + a, base + b) for a, b in edges])
    return out


def test_ten_thousand_nodes_in_a_chain(spark):
    n = 10_000
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert chains.contract(edges.withColumn("steps", F.lit(1).cast("bigint"))).rounds <= 15
    psi = chains.longest_depth(edges)
    assert psi.count() == n + 1 and psi.where("psi <> node").isEmpty()
    times = spark.sql("select * from values (10000L, 7), (50L, 3) t(event, at)")
    got = {r.event: (r.bound, r.is_derived) for r in chains.upper_bounds(edges.toDF("e1", "e2"), times).collect()}
    assert got[0] == (3, True) and got[50] == (3, False) and got[51] == (7, True) and got[9999] == (7, True)


def test_strong_components_and_paradoxes(spark):
    some = [*graphs(60), [(9000 + i, 9000 + (i + 1) % 70) for i in range(70)]]
    edges = [e for g in some for e in g]
    rows = [(a, b, (a * 7 + b * 13) % 5) for a, b in edges]
    rows += rows[:5] + [(None, 1, 1), (rows[0][0], rows[0][1], 9)]
    want = {}
    for g in some:
        r = reach(g)
        for x in r:
            peers = {y for y in r[x] if y in r and x in r[y]} if x in r[x] else set()
            if len(peers) > 1:
                want[x] = min(peers)
    scc = chains.strong_components(table(spark, rows, "src int, dst int, at int")).collect()
    assert len(scc) == len(want) == len({r.node for r in scc})
    name = {}
    for r in scc:
        name.setdefault(r.component, want[r.node])
        assert name[r.component] == want[r.node]
    got = chains.causal_paradoxes(table(spark, rows, "src int, dst int, at int")).collect()
    rows = {r for r in rows if None not in r}
    inside = [r for r in rows if r[0] != r[1] and r[0] in want and want.get(r[1]) == want[r[0]]]
    newest = {}
    for a, b, t in inside:
        newest[want[a]] = max(newest.get(want[a], (t, a, b)), (t, a, b))
    expect = [(a, b, t, want[a], "SUSPECT" if newest[want[a]] == (t, a, b) else "CYCLE") for a, b, t in inside]
    expect += [(a, b, t, a, "SELF_CAUSATION") for a, b, t in rows if a == b]
    assert sorted(tuple(r) for r in got) == sorted(expect)
    assert chains.strong_components(table(spark, [], "src int, dst int")).count() == 0


def test_distances_and_depths(spark):
    some = graphs(40, 1)
    edges = [e for g in some for e in g]
    start = [g[0][0] for g in some[:30]]
    want = dict.fromkeys(start, 0)
    front, h = set(start), 0
    while front:
        h += 1
        front = {b for a, b in edges if a in front} - set(want)
        want |= dict.fromkeys(front, h)
    got = chains.distances(table(spark, edges, "src int, dst int"), table(spark, [(x,) for x in start], "node int"))
    assert {r.node: r.steps for r in got.collect()} == want
    dag = [e for g in graphs(40, 2, True) for e in g]
    depth = dict.fromkeys({x for e in dag for x in e}, 0)
    for _ in range(60):
        for a, b in dag:
            depth[b] = max(depth[b], depth[a] + 1)
    assert {r.node: r.psi for r in chains.longest_depth(table(spark, dag, "src int, dst int")).collect()} == depth
    cyclic = table(spark, [(1, 2), (2, 3), (3, 2), (3, 4), (4, 5), (5, 5)], "src int, dst int")
    assert {r.node: r.psi for r in chains.longest_depth(cyclic).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}


def test_confidence_closure(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(12), rng.randrange(12)): round(rng.random(), 3) for _ in range(40)}
    for hops, least in ((1, 0.0), (4, 0.2)):
        best = {e: c for e, c in edges.items() if c >= least}
        paths = dict(best)
        for _ in range(hops - 1):
            new = {}
            for (a, b), c in paths.items():
                for (x, y), e in edges.items():
                    if b == x and a != y and c * e >= least:
                        new[a, y] = max(new.get((a, y), 0), c * e)
            paths = new
            for k, c in new.items():
                best[k] = max(best.get(k, 0), c)
        got = chains.confidence_closure(table(spark, [(a, b, c) for (a, b), c in edges.items()], "src int, dst int, conf double"), hops, least)
        got = {(r.src, r.dst): r.conf for r in got.collect()}
        assert got.keys() == best.keys() and all(math.isclose(got[k], best[k]) for k in got)


def test_minimal_correction(spark):
    rng = random.Random(5)
    families, costs = [], {}
    for g in range(60):
        names = [f"{g}-{i}" for i in range(rng.randrange(2, 8))]
        families.append([{x for x in rng.sample(names, rng.randrange(1, min(4, len(names)) + 1))} for _ in range(rng.randrange(1, 8))])
        costs |= {x: float(rng.randrange(1, 6)) for x in names}
    rows = [(f"{g}/{c}", x) for g, f in enumerate(families) for c, s in enumerate(f) for x in s]
    got = correction.minimal_correction(table(spark, rows + rows[:9] + [("none", None)], "conflict string, identity string"), table(spark, list(costs.items()), "identity string, cost double"))
    taken = {r.identity: (r.cost, r.n_hit) for r in got.collect()}
    for g, family in enumerate(families):
        mine = {x for x in taken if x.startswith(f"{g}-")}
        assert all(s & mine for s in family) and sum(taken[x][1] for x in mine) == len(family)
        names = set().union(*family)
        least = min(sum(costs[x] for x in c) for n in range(1, len(names) + 1) for c in itertools.combinations(names, n) if all(s & set(c) for s in family))
        most = max(sum(x in s for s in family) for x in names)
        assert sum(taken[x][0] for x in mine) <= correction.STEP * (1 + math.log(most)) * least + 1e-9
    assert correction.minimal_correction(table(spark, [], "conflict string, identity string"), table(spark, [], "identity string, cost double")).count() == 0
    uses = table(spark, [("bad", "i"), ("bad", "j"), ("good", "i"), ("fine", "i"), ("fine", "i")], "conclusion string, identity string")
    told = correction.retraction_costs(uses, table(spark, [("bad",)], "conclusion string")).collect()
    assert {r.identity: r.cost for r in told} == {"i": 3.0, "j": 1.0}
