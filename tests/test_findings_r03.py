"""Faults that a reviewer found in round 3."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from roleloom.functions import align, text
from roleloom.operators import clusters, entities, frames, graphwriter
from roleloom.plans import registry
from roleloom.streaming import coaccess
from roleloom.streaming import frames as streams

from .test_lineage import _faded


def _customers(spark, path, rows):
    spark.createDataFrame(rows, "c_custkey bigint, c_nationkey int, c_mktsegment string").repartition(3).write.parquet(f"{path}/customer.parquet")
    return str(path)


def test_identities_equal_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, rng.choice([None, 1, 2]), rng.choice([None, "a", "b"])) for k in rng.sample(range(-200, 400), 300)]
    rows += [*rows[:30], (None, 1, "a"), *((k, 1, "a") for k in (1000, 1040, 1041, 1080))]  # repeated rows count once
    want = sorted({(a, b) for a, m, x in rows for b, n, y in rows if None not in (a, b, m, x) and (m, x) == (n, y) and 1 <= b - a <= 40})
    got = registry._identities(spark, _customers(spark, tmp_path, rows))
    assert sorted(map(tuple, got.collect())) == want


def test_identities_meet_near_keys_only(spark, tmp_path):
    path = _customers(spark, tmp_path, [(k, 1, "a") for k in range(4000)])
    joins = [line for line in registry._identities(spark, path)._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins and all("stretch" in line for line in joins)  # rows of one nation and segment meet by a third key


def test_sentences_end_with_the_text(spark):
    told = ["one\n", "One. Two\r\n", "a!\nb\n\n", "x ", "no end", "end. "]
    got = spark.createDataFrame([(t,) for t in told], "t string").select("t", text.sentences(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == {"one\n": ["one\n"], "One. Two\r\n": ["One. ", "Two\r\n"], "a!\nb\n\n": ["a!\n", "b\n\n"], "x ": ["x "], "no end": ["no end"], "end. ": ["end. "]}


def test_streams_read_a_table_of_several_files(spark, tmp_path):
    rows = [(i, 0, "user", "") for i in range(20)] + [(50, 1, "tool", "x")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["stm05_quarantined"](spark, str(tmp_path))
    assert got.count() == 21 and got.where("problem = 'EMPTY'").count() == 20 and got.where("problem = 'UNKNOWN_ROLE'").count() == 1
    one = str(tmp_path / "one")
    spark.range(5).coalesce(1).write.parquet(one)
    (part,) = (tmp_path / "one").glob("*.parquet")
    part.rename(tmp_path / "flat.parquet")
    assert streams.run_once(streams.stream_table(spark, str(tmp_path), "flat"), "append").count() == 5


def test_pairs_that_are_all_there_fade_as_by_brute_force(spark):
    rng, start, half = random.Random(9), dt.datetime(2024, 1, 1), dt.timedelta(hours=24)
    rows = [(rng.randrange(4), rng.choice(["x", "y", None]), start + dt.timedelta(hours=rng.randrange(1200))) for _ in range(300)]
    rows += [(9, "z", start + dt.timedelta(hours=h)) for h in (0, 0, 1, 24, 500, 501)] + [(None, "x", start), (1, "x", None), (7, "x", start)]
    df = spark.createDataFrame(rows, "a int, b string, at timestamp").repartition(3)
    for least in (1.5, 2.0, 3.0):
        want = _faded(rows, half, least, 0.5, max(r[2] for r in rows if r[2]))
        got = coaccess.faded(df, "24 hours", least, 0.5).collect()
        near = lambda t: round(t.replace(tzinfo=dt.UTC).timestamp(), 2)
        assert sorted((r.a, r.b, r.what, near(r.at)) for r in got) == sorted((a, b, w, near(t)) for a, b, w, t in want)
    assert {"CLUSTERED", "EVICTED"} == {r.what for r in got} and coaccess.faded(df.limit(0)).count() == 0


def test_fading_pairs_of_a_table_start_no_stream(spark, tmp_path, monkeypatch):
    day = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(o, p, day) for o in (1, 2) for p in (1, 2, 3)], "l_orderkey bigint, l_suppkey bigint, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(coaccess, "start_fading", None)  # a call of Python for each pair took hours
    got = registry.QUERIES["agg21_fading_pairs"](spark, str(tmp_path)).collect()
    assert sorted((r.a, r.b, r.what, r.weight) for r in got) == [(a, b, "CLUSTERED", 2.0) for a, b in ((1, 2), (1, 3), (2, 3))]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_equals_brute_force_in_blocks(spark, monkeypatch, metric):
    for name, n in (("ROWS", 40), ("ASKED", 8), ("AT_ONCE", 3)):
        monkeypatch.setattr(frames, name, n, raising=False)
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-2, 3)) + 0.1 for _ in range(4)]) for i in range(200)]
    rows += [(300 + i, rows[i][1]) for i in range(60)] + [(400, [1.0, 2.0]), (402, [1.0, None, 2.0, 3.0]), (404, None), (406, [float("nan"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (410, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    asked = df.where("vec_id % 10 = 0")
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    d = text.squared_distance(F.col("embedding"), F.col("q")) if metric == "l2" else -text.cosine(F.col("embedding"), F.col("q"))
    by = defaultdict(list)
    for r in df.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", d.alias("d")).collect():
        by[r.query_id].append((r.d is not None, r.d is not None and math.isnan(r.d), r.d if r.d is not None and not math.isnan(r.d) else 0.0, r.vec_id))
    want = {(a, x[3], i + 1) for a, found in by.items() for i, x in enumerate(sorted(found)[:5])}
    result = frames.nearest(df, asked, 5, metric)
    assert set(map(tuple, result.collect())) == want
    assert "CoGroup" in result._jdf.queryExecution().executedPlan().toString()  # blocks, not a nested loop alone


def test_entities_by_components_in_blocks_and_with_copies(spark, monkeypatch):
    monkeypatch.setattr(entities, "BLOCK", 16, raising=False)
    rng = random.Random(2)
    vectors = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(60)]
    rows = [(i, f"n{i:03}", vectors[i % 60]) for i in range(240)]  # copies stand far apart
    of = list(range(240))
    cos = lambda v, w: sum(map(lambda x, y: x * y, v, w)) / math.sqrt(sum(x * x for x in v)) / math.sqrt(sum(x * x for x in w))
    linked = [(i, j) for i in range(240) for j in range(i) if cos(rows[i][2], rows[j][2]) >= 0.97]
    for _ in of:
        for i, j in linked:
            of[i] = of[j] = min(of[i], of[j])
    df = spark.createDataFrame(rows, "seq int, mention string, vector array<double>").repartition(3)
    asked = []
    inner = entities.equivalence
    monkeypatch.setattr(entities, "equivalence", lambda pairs: asked.append(pairs.count()) or inner(pairs))
    got = {r.mention: r.canonical for r in entities.resolve_by_components(df, 3, 0.97).collect()}
    assert got == {f"n{i:03}": f"n{of[i]:03}" for i in range(240)}
    assert asked[0] < len(linked) / 2  # links that hold classes together, not all pairs


def test_pairs_are_counted_in_more_parts_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(clusters, "PAIRS", 100, raising=False)
    rows = [(q, (q * 7 + i * 3) % 50) for q in range(120) for i in range(6)]
    found = clusters.co_accesses(spark.createDataFrame(rows, "query int, frame int"), 2)
    assert found.rdd.getNumPartitions() == 18  # 120 queries of 15 pairs
    reads = defaultdict(set)
    for q, f in rows:
        reads[q].add(f)
    both = defaultdict(int)
    for s in reads.values():
        for a in s:
            for b in s:
                both[a, b] += a < b
    assert {(r.a, r.b): r.n for r in found.collect()} == {p: n for p, n in both.items() if n >= 2}


def test_graph_records_go_in_more_parts_as_they_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graphwriter, "PART", 4000, raising=False)
    monkeypatch.setattr(graphwriter, "ROWS", 50, raising=False)
    rng = random.Random(8)
    rows = [(f"d{i % 180}", "d", i % 180, rng.choice(["go", "go", None]), {"karta": "Ram", "karma": f"x{i % 180 % 7}"}, [("he", None, "then")] if i % 3 else None) for i in range(200)]  # some frames twice
    f = spark.createDataFrame(rows, "frame_id string, doc_id string, line int, kriya string, roles map<string,string>, hints array<struct<pronoun:string,referent:string,context:string>>").repartition(3)
    want = set()
    for me, _, line, verb, roles, hints in rows:
        if verb is None:
            want.add(("quarantine", me, None, None, None, "NO_VERB"))
            continue
        x = f"go@{me}"
        want |= {("node", x, "Kriya", None, None, None), ("node", f"d_L{line}", "Document", None, None, None), ("edge", x, None, "CITED_IN", f"d_L{line}", None)}
        want |= {("node", v.lower(), "Entity", None, None, None) for v in roles.values()}
        want |= {("edge", x, None, "HAS_KARTĀ", "ram", None), ("edge", x, None, "HAS_KARMA", roles["karma"], None)}
        want |= {r for _ in hints or [] for r in (("node", "he", "Entity", None, None, None), ("hint", "he", None, None, None, "then"))}
    path, fields = f"{tmp_path}/graph", ["kind", "id", "type", "relation", "dst", "note"]
    out = graphwriter.graph_records(f)
    assert out.rdd.getNumPartitions() > 8  # the session has 4
    for batch in ("one", "two"):
        graphwriter.write_graph(f, path, batch)
    read = graphwriter.read_graph(spark, path)
    assert read.rdd.getNumPartitions() > 8
    for df in (out, read):
        got = [tuple(r) for r in df.select(*fields).collect()]
        assert set(got) == want and len(got) == len(want)
    by = defaultdict(list)
    for r in want:
        by[r[0], r[2], r[3]].append(r)
    told = {(r.kind, r.type, r.relation): (r.n, r.ids, r.dsts) for r in graphwriter.tally(read).collect()}
    assert told == {k: (len(v), len({r[1] for r in v}), len({r[4] for r in v} - {None})) for k, v in by.items()}
    assert graphwriter.tally(read.limit(0)).count() == 0


def test_alignment_reads_once_and_shuffles_nothing(spark, sf_dir):
    plan = registry.QUERIES["str15_alignment"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize("letters", ["ab", "abcdefgh .", "aé漢😀"])
def test_first_places_equal_brute_force(monkeypatch, letters):
    rng = random.Random(7)
    for least in (0, 5000):
        monkeypatch.setattr(align, "LONG", least)
        for n in (0, 1, 15, 16, 17, 400, 3000):
            t = "".join(rng.choice(letters) for _ in range(n))
            t += t[n // 3 : n // 2] + t[: n // 4]
            asked = [t[at : at + rng.choice([1, 3, 15, 16, 17, 40])] for at in (rng.randrange(len(t) + 1) for _ in range(60))] + [t, t + "z", "z" * 16, "z" * 20 + t]
            asked += [s[:-1] + "z" for s in asked[:20] if s]
            asked = [s for s in asked if s]
            assert align.first_places(t, asked) == [t.find(s) for s in asked]
