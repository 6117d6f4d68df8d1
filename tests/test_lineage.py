"""Parents, versions, pairs that are read together: against brute force."""

import datetime as dt
import itertools
import math
import random
from collections import Counter

import pytest

from roleloom.operators import clusters, lineage
from roleloom.streaming import coaccess
from roleloom.streaming import frames as streams


def _climb(parents, node):
    """root, depth, state by walking up."""
    seen, at = {node}, node
    while (up := parents[at]) is not None and up in parents:
        if up in seen:
            return None, None, "CYCLE"
        seen.add(up)
        at = up
    depth = len(seen) - 1
    return at, depth, "CHILD" if depth else "ROOT" if parents[at] is None else "ORPHAN"


def test_ancestry_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, rng.randrange(140), max(0, i - 1), 7]), "x") for i in range(120)]
    rows += [(200, 200, "own"), (201, 200, None), (210, 211, None), (211, 212, None), (212, 210, None), (213, 212, None), (300, 999, None), (301, 300, None)]
    rows += [(None, 5, None), (5, 400, None), (5, 3, None), (301, 300, None)]  # no node; several parents; a repeated row
    parents = {}
    for node, parent, _ in rows:
        if node is not None:
            parents[node] = min((p for p in (parents.get(node), parent) if p is not None), default=None)
    links = spark.createDataFrame(rows, "node int, parent int, root string").repartition(3)
    got = {r.node: tuple(r)[1:] for r in lineage.ancestry(links).collect()}
    assert got == {n: (p, *_climb(parents, n)) for n, p in parents.items()}
    assert {got[n][3] for n in (200, 201, 210, 213)} == {"CYCLE"} and got[300][3] == "ORPHAN" and got[301][1:3] == (300, 1)
    v = {r.node: r for r in lineage.versions(links).collect()}
    refined = {p for p in parents.values() if p is not None}
    assert all(v[n].latest == (n not in refined) for n in parents) and v[301].version == 2 and v[210].version is None and len(v) == len(parents)
    sizes = Counter(_climb(parents, n)[0] for n in parents)
    assert {r.root: r.n_nodes for r in lineage.trace_sizes(links).collect()} == {k: n for k, n in sizes.items() if k is not None}
    assert lineage.ancestry(links.limit(0)).count() == 0


def test_long_chain_and_crowded_parent(spark, monkeypatch):
    chain = spark.range(10000).selectExpr("id node", "case when id > 0 then id - 1 end parent")
    crowd = spark.range(10000, 14000).selectExpr("id node", "9999l parent")
    rounds, inner = [], lineage._met
    monkeypatch.setattr(lineage, "_met", lambda *a: rounds.append(1) or inner(*a))
    got = lineage.ancestry(chain.union(crowd)).agg({"depth": "max", "root": "max", "node": "count"}).first()
    assert (got["max(depth)"], got["max(root)"], got["count(node)"]) == (10000, 0, 14000) and len(rounds) <= 16


def _reads(rng, n):
    return [(rng.choice([None, *range(40)]), rng.choice([None, *range(12)]), 1) for _ in range(n)]


def test_clusters_equal_brute_force(spark):
    rows = _reads(random.Random(4), 260) + [(q, f, 0) for q in range(60, 64) for f in (50, 51, 52)] + [(70, 60, 0), (71, 60, 0)]
    reads = {}
    for query, frame, _ in rows:
        if query is not None and frame is not None:
            reads.setdefault(query, set()).add(frame)
    support, both = Counter(f for s in reads.values() for f in s), Counter(p for s in reads.values() for p in itertools.combinations(sorted(s), 2))
    df = spark.createDataFrame(rows, "query int, frame int, n int").repartition(3)
    for least in (1, 4):
        pairs = {p: n for p, n in both.items() if n >= least}
        assert {(r.a, r.b): r.n for r in clusters.co_accesses(df, least).collect()} == pairs
        of = {f: f for p in pairs for f in p}
        for _ in of:
            for a, b in pairs:
                of[a] = of[b] = min(of[a], of[b])
        want = {}
        for c in set(of.values()):
            m = [f for f in of if of[f] == c]
            alike = sum(both[p] / (support[p[0]] + support[p[1]] - both[p]) for p in itertools.combinations(sorted(m), 2))
            want[c] = (len(m), round((len(m) + 2 * alike) / len(m) ** 2, 9))
        got = {r.cluster: r for r in clusters.clusters(df, least, 0.5).collect()}
        assert {c: r.n_frames for c, r in got.items()} == {c: n for c, (n, _) in want.items()}
        assert all(abs(got[c].coherence - x) < 1e-8 and got[c].kept == (got[c].coherence >= 0.5) for c, (_, x) in want.items())
        assert got[50].coherence == 1.0 and got[50].kept
    assert clusters.clusters(df.limit(0), 2, 0.5).count() == 0


def _faded(rows, half, least, evict, top):
    """What happens to each pair, by walking over its accesses in order of time."""
    out, by = [], {}
    for a, b, at in rows:
        if None not in (a, b, at):
            by.setdefault((a, b), []).append(at)
    for (a, b), times in by.items():
        weight, last, told = 0.0, None, False
        for t in [*sorted(times), None]:
            end = None if last is None else last + dt.timedelta(seconds=half.total_seconds() * math.log2(weight / evict))
            if end is not None and (end < top if t is None else t >= end):
                if told:
                    out.append((a, b, "EVICTED", end))
                weight, last, told = 0.0, None, False
            if t is None:
                break
            weight, last = weight * (0.5 ** ((t - last) / half) if last else 0) + 1, t
            if weight >= least and not told:
                told = True
                out.append((a, b, "CLUSTERED", t))
    return out


@pytest.mark.parametrize("files", [1, 4])
def test_fading_pairs_equal_brute_force(spark, tmp_path, files):
    rng, start = random.Random(files), dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(3), rng.choice(["x", "y", None]), start + dt.timedelta(hours=rng.randrange(2400))) for _ in range(160)]
    rows += [(9, "z", start + dt.timedelta(hours=h)) for h in (0, 0, 1, 1, 500, 501)] + [(None, "x", start), (1, "x", None)]
    rows.sort(key=lambda r: r[2] or start)
    step, schema = -(-len(rows) // files), "a int, b string, at timestamp"
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    half, store = dt.timedelta(hours=24), spark.conf.get(name := "spark.sql.streaming.stateStore.providerClass")
    for i in range(files):  # each start goes on from the state that the one before left
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(folder)
        coaccess.start_fading(coaccess.fading_pairs(src, "24 hours", 2.0, 0.5), path).awaitTermination()
    assert spark.conf.get(name) == store
    got = streams.landed(coaccess.fading_pairs(src, "24 hours", 2.0, 0.5), path).collect()
    want = _faded(rows, half, 2.0, 0.5, max(r[2] for r in rows if r[2]))
    near = lambda t: round(t.timestamp(), 2)
    assert sorted((r.a, r.b, r.what, near(r.at.replace(tzinfo=dt.UTC))) for r in got) == sorted((a, b, w, near(t.replace(tzinfo=dt.UTC))) for a, b, w, t in want)
    assert {"CLUSTERED", "EVICTED"} == {r.what for r in got}


def test_fading_pairs_reject_limits(spark):
    with pytest.raises(ValueError):
        coaccess.fading_pairs(spark.range(1), evict=1.5)
