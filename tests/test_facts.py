"""The graph writer, contradictions and merged events."""

import datetime as dt

import pytest

from roleloom.operators import facts, graph, graphwriter
from roleloom.operators.facts import UNRESOLVED

FRAMES = "frame_id string, doc_id string, line int, kriya string, roles map<string,string>, hints array<struct<pronoun:string,referent:string,context:string>>"


def frames(spark, rows):
    return spark.createDataFrame(rows, FRAMES).repartition(3)


def test_graph_writer(spark, tmp_path):
    rows = [
        ("d_L0", "d", 0, "give", {"kartā": " Ram ", "object": "Book", "locus_space": "", "time": None}, [("He", "Ram", "line before"), (None, "x", None), ("It", None, None)]),
        ("d_L1", "d", 1, "take", {"Agent": "ram", "karma": "he"}, None),
        ("d_L2", "d", 2, None, {"karta": "nobody"}, None),
        ("d_L3", "d", 3, "EXTRACTION_FAILED", None, None),
        ("d_L4", "d", 4, "see", {"karta": "Eve", "mood": "sad", "locus_topic": "rain"}, None),
        ("d_L5", "d", 5, "rain", None, []),
    ]
    path = f"{tmp_path}/graph"
    graphwriter.write_graph(frames(spark, rows), path, "one")
    told = lambda: sorted(tuple(r) for r in graphwriter.read_graph(spark, path).select("kind", "id", "type", "relation", "dst", "note").na.fill("-").collect())
    first = told()
    graphwriter.write_graph(frames(spark, rows), path, "one")
    assert told() == first
    assert [r for r in first if r[0] == "quarantine"] == [("quarantine", "d_L2", "-", "-", "-", "NO_VERB"), ("quarantine", "d_L3", "-", "-", "-", "NO_VERB"), ("quarantine", "d_L4", "-", "-", "-", "UNKNOWN_ROLE:locus_topic,mood")]
    edges = {(r[1], r[3], r[4]) for r in first if r[0] == "edge"}
    assert edges == {
        ("give@d_L0", "HAS_KARTĀ", "ram"), ("give@d_L0", "HAS_KARMA", "book"), ("give@d_L0", "CITED_IN", "d_L0"), ("take@d_L1", "HAS_KARTĀ", "ram"), ("take@d_L1", "HAS_KARMA", "he"),
        ("take@d_L1", "CITED_IN", "d_L1"), ("rain@d_L5", "CITED_IN", "d_L5"),
    }
    assert {r[1] for r in first if r[2] == "Entity"} == {"ram", "book", "he", "it"}
    assert {r[1:] for r in first if r[0] == "hint"} == {("he", "-", "-", "Ram", "line before"), ("it", "-", "-", "-", "-")}
    # the lookups read what was written; a second batch adds to it, a batch written anew takes the old one's place
    links = graphwriter.graph_edges(spark, path)
    assert sorted(r.node for r in graph.neighbours(links, graph.F.lit("ram")).collect()) == ["give@d_L0", "take@d_L1"]
    graphwriter.write_graph(frames(spark, rows[:1]), path, "two")
    assert told() == first
    graphwriter.write_graph(frames(spark, rows[5:]), path, "one")
    assert {r[1] for r in told() if r[0] == "edge"} == {"give@d_L0", "rain@d_L5"} and not [r for r in told() if r[0] == "quarantine"]
    assert graphwriter.graph_records(frames(spark, [])).count() == 0


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def test_contradictions_by_five_rules(spark):
    def fact(i, who, value, a, b, *ranks):
        return (i, who, value, day(a), day(b), *ranks)

    rows = [
        fact(1, "recency", "x", 0, 5, 2, False, 0, 0), fact(2, "recency", "y", 3, 9, 1, True, 9, 9),
        fact(3, "explicit", "x", 0, 5, 1, True, 0, 0), fact(4, "explicit", "y", 0, 5, 1, False, 9, 9), fact(5, "explicit", "x", 0, 5, 1, False, 0, 0),
        fact(6, "authority", "x", 0, 5, 1, True, 1, 9), fact(7, "authority", "y", 0, 5, 1, True, 2, 0),
        fact(8, "specific", "x", 0, 5, 1, True, 1, None), fact(9, "specific", "y", 0, 5, 1, True, 1, 4),
        fact(10, "manual", "x", 0, 5, 1, True, 1, 4), fact(11, "manual", "y", 5, 6, 1, True, 1, 4), fact(12, "manual", None, 0, 9, 9, True, 9, 9),
        fact(13, "apart", "x", 0, 2, 1, True, 1, 4), fact(14, "apart", "y", 3, 6, 2, True, 1, 4),
        fact(15, "long", "x", 0, 400, 2, True, 1, 4), fact(16, "long", "y", 350, 360, 1, True, 1, 4),
        fact(17, None, "x", 0, 5, 2, True, 1, 4), fact(18, None, "y", 0, 5, 1, True, 1, 4), fact(19, "turned", "x", 9, 2, 1, True, 1, 1),
    ]
    schema = "fact_id int, who string, value string, valid_from timestamp, valid_to timestamp, recency int, explicit boolean, authority int, specificity int"
    got = sorted(tuple(r) for r in facts.contradictions(spark.createDataFrame(rows + rows[:3], schema).repartition(3), ["who"]).collect())
    assert got == [
        (1, 2, "temporal_recency", "resolved"), (3, 4, "explicit_over_inferred", "resolved"), (7, 6, "domain_authority", "resolved"), (9, 8, "specificity", "resolved"),
        (10, 11, "manual_review", UNRESOLVED), (15, 16, "temporal_recency", "resolved"),
    ]
    assert facts.contradictions(spark.createDataFrame([], schema), ["who"]).count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_merged_events(spark, shuffled):
    rows = [
        (1, "ram", "marry", day(0), "a"), (2, "ram", "marry", day(900), "b"), (3, "ram", "marry", None, "a"), (4, "sita", "marry", day(1), "a"),
        (5, "ram", "eat", day(0), "a"), (6, "ram", "eat", day(1), "b"), (7, "ram", "eat", day(2), "b"), (8, "ram", "eat", day(3, 1), "c"), (9, "ram", "eat", None, "c"),
        (10, "ram", "walk", day(0), "a"), (11, "ram", "walk", day(0), "a"), (12, "ram", "odd", day(0), "a"),
    ]
    df = spark.createDataFrame(rows[::-1] if shuffled else rows, "event_id int, who string, act string, at timestamp, source string").repartition(3)
    from pyspark.sql import functions as F

    kind = F.create_map(*[F.lit(x) for x in ("marry", "singleton", "eat", "bounded", "walk", "unbounded")])[F.col("act")]
    got = {r.event: (r.n, r.sources) for r in facts.merged_events(df, ["who", "act"], kind).collect()}
    assert got == {1: (3, ["a", "b"]), 4: (1, ["a"]), 5: (3, ["a", "b"]), 8: (1, ["c"]), 9: (1, ["c"]), 10: (1, ["a"]), 11: (1, ["a"]), 12: (1, ["a"])}
