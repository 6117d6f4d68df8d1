"""Reply parsing, alignment, extraction, entity resolution, beliefs and streams on small fixtures."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from roleloom.functions import align, responses, text
from roleloom.operators import belief, entities, extract, frames, oplog, postpass, quality
from roleloom.plans import engine
from roleloom.sources import files
from roleloom.streaming import frames as streams


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("raw", "want"),
    [('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}), ('see [x]: {"a": 1} done', {"a": 1}), ("[1, 2]", [1, 2]), ("none", None), ("", None), (None, None), ("{broken", None)],
)
def test_lenient_json(spark, raw, want):
    got = one(spark, raw, lambda c: F.to_json(responses.lenient_json(c)))
    assert (None if got is None else json.loads(got)) == want


def test_first_and_answer_json(spark):
    assert one(spark, 'x {"a": {"b": 1}} y', responses.first_json) == '{"a": {"b": 1}}'
    assert one(spark, "x [1, [2]] y", responses.first_json) == "[1, [2]]" and one(spark, "plain", responses.first_json) == "plain"
    assert json.loads(one(spark, "plain {", lambda c: F.to_json(responses.answer_json(c)))) == {"answer": "plain {"}


def test_shapes(spark):
    size = lambda raw: one(spark, raw, lambda c: F.size(responses.extractions(F.try_parse_json(c))))
    assert size('[{"verb": "a"}, {"verb": "b"}]') == 2 and size('{"verb": "a"}') == 1 and size('{"extractions": [{"verb": "a"}]}') == 1
    assert size("[]") in (None, -1) and size('{"x": 1}') in (None, -1) and size('{"verb": "a", "karakas": {"agent": ["x"]}}') in (None, -1)


def _plain_window(t, pattern):
    best = (0.0, -1, -1)
    for size in range(max(1, len(pattern) - 10), len(pattern) + 11):
        for i in range(len(t) - size + 1):
            a, b = set(t[i : i + size]), set(pattern)
            if a and len(a & b) / len(a | b) > best[0]:
                best = (len(a & b) / len(a | b), i, i + size)
    return best


def test_best_window_equals_brute_force():
    rnd = random.Random(5)
    for _ in range(150):
        t, p = ("".join(rnd.choice("abcdef ") for _ in range(rnd.randrange(n))) for n in (60, 20))
        assert align.best_window(t, p) == _plain_window(t, p)
    assert align.best_window("", "") == (0.0, -1, -1)


def test_align():
    t = "Ram ate the mango.  Sita went home."
    got = align.aligned(t, ["Ram ate the mango.", "Sita went home."])
    assert [" ".join(g.split()) for g in got] == ["Ram ate the mango.", "Sita went home."]
    assert align.aligned(t, ["Something else entirely."]) is None and align.aligned(t, []) is None
    assert all(difflib.SequenceMatcher(None, a, " ".join(b.split())).ratio() >= 0.85 for a, b in zip(["Ram ate a mango.", "Sita went home."], align.aligned(t, ["Ram ate a mango.", "Sita went home."]), strict=True))


def test_pandas_columns(spark):
    df = spark.createDataFrame([("A b. C d.", ["A b.", "C d."]), (None, None)], "t string, p array<string>")
    r = df.select(align.align("t", "p").alias("a"), align.best_substring("t", F.lit("C d.")).alias("w")).collect()
    assert len(r[0].a) == 2 and r[0].w.score > 0.9 and r[1].a is None and r[1].w.start == -1


def test_word_boundary(spark):
    at = lambda t, n: one(spark, t, lambda c: align.word_boundary(c, F.lit(n)))
    assert at("hello world", 8) == 6 and at("hello", 3) == 3 and at("ab cd", 5) == 5


def test_rules():
    get = lambda s: json.loads(extract.by_rule(s))
    assert get("Ram gave the book to Sita in Ayodhya.") == {"kriya": "gave", "karta": "Ram", "karma": "the book", "sampradana": "Sita", "locus_space": "Ayodhya"}
    assert get("The city was founded by Ram in 1200.") == {"kriya": "founded", "karma": "The city", "karta": "Ram", "locus_time": "1200"}
    assert "karta" not in get("The mango was created there.")


def test_extraction_keeps_failures(spark):
    rows = [(1, 0, "Ram ate the mango."), (1, 1, "Nothing here"), (1, 2, " "), (1, 3, None)]
    got = {r.line: r for r in extract.extract_frames(spark.createDataFrame(rows, "doc_id long, line int, sentence string"), retries=1).collect()}
    assert set(got) == {0, 1} and got[0].karta == "Ram" and got[0].attempts == 1
    assert got[1].kriya == extract.FAILED and got[1].status == "failed" and got[1].attempts == 2 and "no verb" in got[1].error


def test_split_by_retries_and_keeps_the_rest():
    t = "Ram ate the mango. Sita went home then. The end of it all."
    calls = []

    def bad_then_good(x, feedback):
        calls.append(feedback)
        return ["nonsense that is not there"] if feedback is None else text_parts(x)

    assert len(extract.split_by(bad_then_good, t)) == 3 and calls[1] is not None
    assert extract.split_by(lambda x, f: ["nope nope nope"], t) == [t]


def text_parts(t):
    return [p.strip() + "." for p in t.split(".") if p.strip()]


def test_greedy_and_component_resolution(spark):
    rows = [(0, 1, "Ram", [1.0, 0.0]), (0, 2, "ram", [1.0, 0.0]), (0, 3, "Lord Ram", [0.99, 0.05]), (0, 4, "Sita", [0.0, 1.0]), (0, 5, None, [1.0, 1.0]), (0, 6, "Odd", None), (0, 7, "Zero", [0.0, 0.0])]
    m = spark.createDataFrame(rows, "scope int, seq int, mention string, vector array<double>")
    want = {"Ram": "Ram", "ram": "Ram", "Lord Ram": "Ram", "Sita": "Sita", "Odd": "Odd", "Zero": "Zero"}
    assert {r.mention: r.canonical for r in entities.resolve_in_order(m).collect() if r.mention} == want
    assert {r.mention: r.canonical for r in entities.resolve_by_components(m.drop("scope"), 2).collect()} == want


def test_post_passes(spark):
    rows = [("d", 1, "f1", "Ram", "Ram ate."), ("d", 2, "f2", "He", "Therefore he slept."), ("d", 3, "f3", "king of Ayodhya", "It rained because of it."), ("d", 9, "f4", "she", "x")]
    t = spark.createDataFrame(rows, "doc_id string, line int, frame_id string, entity string, sentence string")
    assert [(r.src, r.dst, r.confidence) for r in postpass.coreferences(t).collect()] == [("He", "Ram", "high")]
    assert [(r.src, r.dst) for r in postpass.metaphors(t).collect()] == [("king of Ayodhya", "Ram")]
    assert {(r.src, r.dst) for r in postpass.causal_links(t).collect()} == {("f1", "f2"), ("f3", "f2")}


def test_beliefs(spark):
    ops = spark.createDataFrame([(1, "ASSERT", "a", None), (2, "RETRACT", "a", None), (3, "UNIFY", "i", None), (4, "SPLIT", "i", None), (5, "UPDATE", "d2", "d1"), (0, "UPDATE", "d1", None), (6, "ODD", "z", None)], "seq int, op string, item string, replaces string")
    got = lambda **k: {(r.store, r.item) for r in belief.replay(ops, **k).collect()}
    assert got() == {("O", "a"), ("D", "d2")} and got(force=True) == {("D", "d2")}
    glue = spark.createDataFrame([("x", "i1"), ("x", "i2"), ("y", "i1"), ("y", "i2"), ("z", "i2")], "conclusion string, identity string")
    ids = spark.createDataFrame([("i1", 0.9), ("i2", 0.5)], "id string, confidence double")
    kept, fallen = belief.correct(glue, ids, spark.createDataFrame([("x", "y")], "left string, right string"))
    assert [r.id for r in kept.collect()] == ["i1"] and {r.conclusion for r in fallen.collect()} == {"x", "y", "z"}
    one_pov = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (5, 5)], "node int, canonical int")
    two_pov = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 3)], "node int, canonical int")
    assert {r.node for r in belief.obstructions(one_pov, two_pov).collect()} == {1, 2}


def test_missing_and_incompatible(spark):
    parts = spark.createDataFrame([("e", "eat", "karta", "stone")], "frame_id string, kriya string, role string, filler_key string")
    wanted = spark.createDataFrame([("eat", "karta", ["animate"])], "kriya string, role string, wants array<string>")
    none = spark.createDataFrame([], "filler_key string, has array<string>")
    assert quality.incompatible(parts, wanted, none).first().lacks == ["animate"]


def test_uploads(spark):
    h = "a" * 64
    new = spark.createDataFrame([(1, h), (2, h), (3, "bad"), (4, None), (5, "b" * 64)], "upload_id int, hash string")
    got = {r.upload_id: r.outcome for r in oplog.uploads(new, spark.createDataFrame([("b" * 64,)], "hash string")).collect()}
    assert got == {1: "UPLOAD_PENDING", 2: "REUSED", 3: "INVALID_HASH", 4: "INVALID_HASH", 5: "REUSED"}


def test_text_tags(spark):
    assert one(spark, "blue-eyed man", text.compound).kind == "possessive" and one(spark, "Ram", text.compound).kind is None
    assert one(spark, "It rained, not because of wind", text.polarity) == "cause" and one(spark, "Ram didn't eat", text.polarity) == "event"
    assert one(spark, "  Who led it?? ", text.question_key) == "who led it"


def test_sources(spark, tmp_path):
    assert one(spark, "aéb", lambda c: files.byte_range(c, F.lit(0), F.lit(2))) == "a" and one(spark, "aéb", lambda c: files.byte_range(c, F.lit(1), F.lit(4))) == "éb"
    (tmp_path / "p.yaml").write_text("# x\na: |\n  Hello\n  there\nb: LOAD_FROM_PROMPTS_JSON\nc: 'short'\n")
    assert files.read_prompts(str(tmp_path / "p.yaml")) == {"a": "Hello\nthere", "c": "short"}


def test_engine(spark):
    docs = spark.createDataFrame([("a", 1, "queued"), ("b", None, "failed"), ("c", 3, "completed")], "doc_id string, created_at int, status string")
    e = engine.Engine(docs, docs, docs)
    assert [r.doc_id for r in e.docs().collect()] == ["c", "a", "b"] and e.status("a").first().status == "processing"
    first = e.cached(docs.where("created_at > 0"))
    assert e.cached(docs.where("created_at > 0")) is first
    e.forget()


def test_completed_documents(spark, tmp_path):
    schema = "doc_id long, chunk int, n_chunks int"
    for i, rows in enumerate([[(1, 0, 2), (2, 0, 1)], [(1, 0, 2)], [(1, 1, 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.run_once(streams.completed_documents(stream), "update").collect()
    assert sorted((r.doc_id, r.n) for r in got) == [(1, 2), (2, 1)]


def test_store_and_answers(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "frame_id string, v int"), spark.createDataFrame([("b", 3), ("c", 4)], "frame_id string, v int")
    assert sorted((r.frame_id, r.v) for r in frames.upserted(old, new).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    assert frames.cleared(old).count() == 0
    asked = spark.createDataFrame([(1, None), (2, None), (3, "bad")], "question_id int, problem string")
    got = frames.answer_rows(asked, spark.createDataFrame([(1,), (1,)], "question_id int")).collect()
    assert {(r.question_id, r.status, r.n) for r in got} == {(1, "GROUNDED", 2), (2, "NO_MATCH", 0), (3, "ERROR", 0)}
