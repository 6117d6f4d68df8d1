"""Text functions and operators of the event-frame engine on small fixtures."""

import pytest
from pyspark.sql import functions as F

from roleloom.functions import text
from roleloom.operators import belief, frames, graph, quality
from roleloom.plans import registry
from roleloom.sources import files, views


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize("t", ["Hello world. This is good. Goodbye.", "no end", "A!  B?\nC. ", "Dr. A ran.  B ate!  ", "a b. c"])
def test_split_is_lossless(spark, t):
    assert "".join(one(spark, t, text.sentences)) == t


def test_keys_strip_all_white_space(spark):
    assert one(spark, " \tRam \n", text.key) == "ram"


def test_abbreviations_do_not_end_sentences(spark):
    assert one(spark, "Dr. A ran. B ate.", lambda c: text.abbreviation_sentences(c, ["Dr.", "Mr."])) == ["Dr. A ran.", "B ate."]


def test_smart_split(spark):
    assert one(spark, "  ", text.smart_sentences) == [] and one(spark, "one", text.smart_sentences) == ["one"]


def test_statuses(spark):
    said = {"processing_completed": "completed", "queued": "processing", "upload_pending": "uploading", "Finished": "completed", "STOPPED": "failed", "processing upload": "processing", "complete": "unknown", "": "unknown", None: "unknown"}
    assert {x: one(spark, x, text.status) for x in said} == said


def test_questions(spark):
    assert one(spark, "Who funded the study?", text.asked_role) == "karta" and one(spark, "Where was it?", text.asked_role) == "locus_space"
    assert one(spark, "to whom was it given", text.asked_role) == "sampradana"
    assert one(spark, "Who ate the mango?", text.keywords) == ["mango?"]


def test_error_codes(spark):
    said = {"Timeout": "LLM_TIMEOUT", "error 429": "LLM_RATE_LIMIT", "limit of\ntokens": "LLM_TOKEN_LIMIT", "401": "LLM_AUTH_ERROR", "network down": "LLM_CONNECTION_ERROR", "cannot parse": "LLM_RESPONSE_PARSE_ERROR", "odd": "LLM_UNKNOWN_ERROR"}
    assert {x: one(spark, x, text.error_code) for x in said} == said


def test_fidelity_and_chunks(spark):
    df = spark.createDataFrame([("Ａ  b", "a b")], "a string, b string")
    assert df.select(text.fidelity("a", "b").alias("r")).first().r == 1.0
    t = "x" * 30 + "\n\n" + "y" * 30
    assert spark.createDataFrame([(t,)], "t string").select(text.safe_chunks(40)("t").alias("r")).first().r == ["x" * 30, "y" * 30]


def test_token_windows(spark):
    assert one(spark, "a b c d e", lambda c: text.windows_of(F.split(c, " "), 3, 1)) == [["a", "b", "c"], ["c", "d", "e"]]


def test_traversal_stops_one_hop_short(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b"), ("d", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    nodes = lambda h: {r.node for r in graph.traverse(edges, start, h).collect()}
    assert nodes(1) == {"a"} and nodes(2) == {"a", "b"} and nodes(4) == {"a", "b", "c", "d"}


def test_cycles_and_bounds(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "y")], "src string, dst string")
    assert {r.node for r in graph.cycle_nodes(edges).collect()} == {"b", "c"}
    before = spark.createDataFrame([("eat", "sleep"), ("cook", "eat")], "e1 string, e2 string")
    got = graph.upper_bounds(before, spark.createDataFrame([("sleep", 22)], "event string, at int")).collect()
    assert {(r.event, r.bound, r.is_derived) for r in got} == {("eat", 22, True), ("cook", 22, True), ("sleep", 22, False)}


def test_retraction(spark):
    rows = [("f1", "eat", ["ram_p5"], 0.95), ("f2", "king", ["ram_p50"], 0.9), ("id1", "≡", ["ram_p5", "ram_p50"], 0.75), ("d1", "derive", ["p", "f1", "f2", "id1"], 0.68)]
    atoms = spark.createDataFrame([(*r, "d", True) for r in rows], belief.ATOM)
    assert {r.node: r.canonical for r in belief.identity_classes(atoms).collect()} == {"ram_p5": "ram_p5", "ram_p50": "ram_p5"}
    after = belief.invalidate_identity(atoms, "id1")
    assert {r.id for r in belief.active_atoms(after).collect()} == {"f1", "f2", "rid1", "tid1"}
    conf = spark.range(1).select(*(belief.combined(F.array(F.lit(0.95), F.lit(0.9)), F.array(F.lit(0.75)), r).alias(r) for r in ("product", "min", "min_min"))).first()
    assert round(conf.min_min, 2) == 0.68 and conf.min == 0.75 and round(conf.product, 3) == 0.641


def test_roles_and_validators(spark):
    f = spark.createDataFrame([("F1", "eat", "Ram", "mango", "", None, None, None, None, None)], "frame_id string, kriya string, karta string, karma string, karana string, sampradana string, apadana string, locus_time string, locus_space string, locus_topic string")
    assert frames.shown_roles(f).first().roles == {"karta": "Ram", "karma": "mango"}
    assert frames.find_by_role(f, "AGENT", "ra").count() == 1 and frames.find_by_role(f, "other", "ra").count() == 0
    assert frames.find_by_entity(f, " RAM ").count() == 1 and frames.find_by_entity(f, "ra").count() == 0
    parts = spark.createDataFrame([("F1", "karta", "Ram"), ("F1", "karana", "fork")], "frame_id string, role string, filler string")
    bad = quality.ungrounded(parts, spark.createDataFrame([("F1", "Ram ate the mango.")], "frame_id string, sentence string")).collect()
    assert [r.filler for r in bad] == ["fork"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("old")
    (tmp_path / "a.md").write_text("One.\n\n  Two. \n")
    (tmp_path / "b.txt").write_text("x\r\ny")
    got = sorted((r.doc_id, r.line_number, r.text) for r in files.read_documents(spark, str(tmp_path)).collect())
    assert got == [("a", 1, "One."), ("a", 2, "Two."), ("b", 1, "x"), ("b", 2, "y")]
    (tmp_path / "f.json").write_text('[{"frame_id": "F0", "kriya": "eat", "karta": "Ram"}]')
    f = files.read_frames(spark, str(tmp_path / "f.json"))
    files.write_frames(f, str(tmp_path / "out"))
    assert files.read_frames(spark, str(tmp_path / "out")).first().karta == "Ram"
    assert files.report(spark.createDataFrame([("a|b", "c\nd")], "x string, y string")).first().line == "| a\\|b | c d |"
    j = spark.createDataFrame([('{"S": "x"}',), ('{"N": "5"}',)], "j string").select(files.unwrap_typed_json(F.col("j")).alias("v"))
    assert [r.v for r in j.collect()] == ["x", "5"]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_run(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_oracles_cover_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(registry.QUERIES) - set(registry.ORACLES) <= {"pip03_extracted_frames", "stm01_sentence_stream", "top14_minimal_correction", "pip07_document_graph"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_cycles_of_all_edges(spark, sf_dir, tmp_path):
    rows = [(1, 1, 1), (2, 2, 0), (3, 3, 3), (4, 41, 4)]  # 1 -> 2 -> 1 in orders that are no multiples of 50
    spark.createDataFrame(rows, "l_orderkey bigint, l_suppkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(r.node for r in registry.QUERIES["pip21_cycles"](spark, str(tmp_path)).collect()) == [1, 2]
    links = views.adjacent(views.event_frames(spark, sf_dir)).select("src", "dst").collect()
    assert sorted(r.node for r in registry.QUERIES["val12_causal_paradox"](spark, sf_dir).collect()) == sorted({x for r in links for x in r})


def test_cycles_behind_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(205)] + [(1000, 1001), (1001, 1000)], "src bigint, dst bigint").coalesce(1)
    assert {r.node for r in graph.cycle_nodes(edges).collect()} == {1000, 1001}


def test_provenance_of_a_long_chain(spark):
    derives = spark.createDataFrame([(i, i + 1) for i in range(25)] + [(25, 20)], "conclusion bigint, evidence bigint").coalesce(1)
    start = spark.createDataFrame([(0,)], "node bigint")
    assert sorted(map(tuple, graph.provenance(derives, start).collect())) == [(i, i) for i in range(26)]
    assert graph.provenance(derives, start, 3).count() == 4
