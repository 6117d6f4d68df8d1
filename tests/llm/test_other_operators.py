"""Vectors, URLs, mixing, chat and the pipeline against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roleloom.llm import mixing, urlfilter
from roleloom.llm.chat import DEFAULT, Template, Turn, conversation_digests, format_conversations, read_back
from roleloom.llm.common import connected_components
from roleloom.llm.embeddings import embedding_links
from roleloom.llm.mixing import goals_of, mix_sources, mixing_report, rake, sample_documents, topic_of


def brute_links(rows, t=0.98):
    top = {i: i for i, _, _ in rows}
    n = dict.fromkeys(top, 0)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    good = [(i, np.array(v, float), label) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    for a in range(len(good)):
        for b in range(a):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= t:
                n[i] += 1
                n[j] += 1
                x_, y_ = sorted((find(i), find(j)))
                top[y_] = x_
    return {i: (n[i], find(i)) for i in top}


def clusters(seed=3, n=400, dim=16):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((20, dim))
    rows = []
    for i in range(n):
        c = int(rng.integers(0, 20)) if rng.random() < 0.6 else 0
        noise = [0.0, 0.02, 0.05, 0.3][int(rng.integers(0, 4))]
        rows.append((i, [float(x) for x in np.float32(centers[c] + noise * rng.standard_normal(dim))], int(rng.integers(0, 2))))
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, rows[0][1], None), (n + 4, [1.0, 2.0], 1), (n + 5, [None] + [1.0] * (dim - 1), 0), (n + 6, [], 0)]
    return rows


def test_embedding_links(spark):
    rows = clusters()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    for leaf in (400, 40):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_links(df, leaf=leaf).collect()}
        want = brute_links(rows)
        assert set(got) == set(want)
        found, real = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
        assert 0.99 * real <= found <= real
        assert all(got[i][0] <= want[i][0] and got[i][2] == (got[i][1] == i) for i in got)
    assert embedding_links(df.limit(0)).count() == 0
    again = df.union(df).union(spark.createDataFrame([(None, [1.0, 0.0], 1)], "vec_id bigint, embedding array<float>, label int"))
    assert embedding_links(again).count() == len(rows) + 1


def test_embedding_blocks(spark, monkeypatch):
    from roleloom.llm import embeddings

    monkeypatch.setattr(embeddings, "BLOCK", 32)
    rows = clusters(8, 300)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(df).collect()} == brute_links(rows)


def test_embedding_recall(spark):
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in data.collect()]
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([p for _, _, p in rows])
    near = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    want = {r[0]: int(n) for r, n in zip(rows, near.sum(1))}
    got = {r.vec_id: r.n_links for r in embedding_links(data).collect()}
    assert sum(got.values()) >= 0.99 * sum(want.values()) and all(got[i] <= want[i] for i in want)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {n: find(n) for n in top}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


PAGES = [
    (1, "https://www.Shop.example.COM/en/1?x=1#a", ""),
    (2, "https://a.example.com/en/77/b", ""),
    (3, "http://b.example.net/de", '<link href="http://b.example.net/de/1" rel="canonical">'),
    (4, "http://c.example.net/fr/1", '<link rel=canonical href="http://z.example.net/de/5">'),
    (5, "http://d.example.net/fr/2", '<meta http-equiv="refresh" content="0; url=http://c.example.net/fr/1">'),
    (6, "http://d.example.net/fr/3", '<link rel=canonical href="http://e.example.net/de/8/x">'),
    (7, "http://d.example.net/fr/4", '<link rel=canonical href="http://d.example.net/fr/3">'),
    (8, "http://d.example.net/fr/4", None),
    (9, None, "<link>"),
    (10, "no scheme/de/", ""),
    (11, "http://notexample.org/es/x", ""),
    (12, "http://com/en/", ""),
    (13, "http://xcom/en/", ""),
    (14, "http://q.example.net/fr/9?utm_source=f", ""),
    (15, "", ""),
    (16, "http://r.example.com/fr/1", '<link rel="canonical" href="/en/1">'),
    (17, "http://r.example.com/fr/x/2", '<p><LINK href=../../en/./2 rel=CANONICAL><link rel=canonical href="/fr/other">'),
    (18, "http://r.example.com/fr/3", "<meta content=' 3 ; URL=\"//s.example.org/es/1\"' http-equiv='Refresh'>"),
    (19, "http://r.example.com/fr/4", '<link rel="alternate" href="/en/4"><a rel="canonical" href="/en/4"><link data-rel="canonical" href="/en/4">'),
    (20, "http://r.example.com/fr/5", '<base href="/en/deep/"><link rel="x canonical" href=" t?a=1&amp;b=&quot;2 ">'),
    (21, "http://r.example.com/fr/6", '<link rel=canonical href="#top"><link rel=canonical href="mailto:a@b"><link rel=canonical href=""><link rel=canonical>'),
    (22, "http://r.example.com", '<link rel=canonical href="en&#47;9">'),
    (23, "http://r.example.com/fr/7?q=1", '<link rel=canonical href="?q=2">'),
    (24, "http://r.example.com/fr/7?q=2", '<link rel=canonical href="http://R.example.com/en/8#x">'),
    (25, "http://r.example.com/fr/8", '<link rel=canonical href="HTTP://w.example.com/en/8">'),
    (26, "no-scheme", '<link rel=canonical href="/en/1">'),
    (None, "http://r.example.com/fr/8", '<link rel=canonical href="http://w.example.com/en/75">'),
]


def test_urls(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in urlfilter.judge_urls(df).collect()}
    assert len(got) == len(PAGES)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.shop.example.com", "/en/1", "com/en/", "block")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/7", "allow")
    assert got[3].rule is None and got[3].verdict == "block"  # /de is /de/1's alias
    assert got[4].verdict == got[5].verdict == "block" and got[4].alias_of == got[5].alias_of
    assert got[6].verdict == got[7].verdict == got[8].verdict == "allow"
    assert [got[i].host for i in (9, 10, 15)] == [""] * 3 and all(got[i].verdict == "allow" and got[i].rule is None for i in (9, 10, 15))
    assert got[11].rule == "org/es/" and got[12].rule == "com/en/" and got[13].rule is None
    assert all(got[i].rule is None and got[i].verdict == "block" for i in (16, 17, 18, 20, 22, 23, 24))
    assert all(got[i].verdict == "allow" and got[i].alias_of is None for i in (19, 21, 26))
    assert got[25].verdict == got[None].verdict == "allow" and got[25].alias_of  # an explicitly allowed alias goes before a blocked one
    assert got[20].alias_of == 'r.example.com/en/deep/t?a=1&b="2'
    more = spark.createDataFrame([("http://q.example.net/fr/9?utm_source=f", "http://q.example.net/de/1")], "url string, target string")
    assert {r.page_id: r.verdict for r in urlfilter.judge_urls(df, redirects=more).collect()}[14] == "block"
    # spellings of an address are aliases only on request
    spelled = spark.createDataFrame([(1, "http://q.example.net/de/1/"), (2, "http://m.q.example.net/de/1.html"), (3, "http://www.x.example.net/de"), (4, "http://x.example.net/de/")], "page_id bigint, url string").withColumn("html", F.lit(""))
    assert {r.page_id: r.verdict for r in urlfilter.judge_urls(spelled).collect()}[3] == "allow"
    assert {r.page_id: r.verdict for r in urlfilter.judge_urls(spelled, spellings=True).collect()}[3] == "block"
    assert urlfilter.judge_urls(df.limit(0)).count() == 0
    clash = df.withColumns({c: F.lit("x") for c in ("host", "rule", "key", "src", "alias_of", "target")})
    assert sorted(urlfilter.judge_urls(clash).collect(), key=str) == sorted(got.values(), key=str)


def test_urls_against_the_sql(spark):
    import duckdb

    from roleloom.llm.queries import ORACLES

    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    con = duckdb.connect()
    con.register("pages", df.toArrow())
    want = con.sql(f"select page_id, host, path, rule, verdict, alias_of from ({ORACLES['op3_urls']})").fetchall()
    assert sorted(map(tuple, urlfilter.judge_urls(df).collect()), key=str) == sorted(want, key=str)


def test_declared_targets():
    page = """<!-- <link rel=canonical href=/no> --><script>'<link rel=canonical href=/no>'</script><base href="/a/"><base href="/b/">
      <link title="x > y" rel='CANONICAL nofollow' HREF='c?d=1&amp;e=2'><link rel=canonical href=../f rel=alternate><link title=it's rel=canonical href=/g>
      <meta http-equiv=refresh content="5"><meta http-equiv=Refresh content="0;URL='h'"><link rel=canonical href="http://[bad/"><link rel=canonical href="tel:1">"""
    assert urlfilter.targets_of("http://x.y/z/q", page) == ["http://x.y/a/c?d=1&e=2", "http://x.y/f", "http://x.y/g", "http://x.y/a/h"]


CELLS = "source string, lang string, topic string, tokens bigint"


def test_raking_meets_marginals(spark):
    rng = random.Random(2)
    cells = [(s, g, t, rng.randint(300, 500)) for s in "abc" for g in "xy" for t in "pqr"]
    df = spark.createDataFrame(cells, CELLS)
    total = sum(c[3] for c in cells)
    targets = {"lang": {"x": 3.0, "y": 2.0}, "topic": spark.createDataFrame([("p", 0.4), ("q", 0.3), ("r", 0.3), ("none", 9.0)], "value string, share double")}
    out = rake(df, goals_of(df, targets, {"source": 0.7}, 0.5), 0.5, 1e-9).collect()
    have = [{}, {}, {}]
    for r in out:
        assert 0 <= r.weight <= r.tokens / 0.5
        for k in range(3):
            have[k][r[k]] = have[k].get(r[k], 0) + r.weight
    base = {s: sum(c[3] for c in cells if c[0] == s) ** 0.7 for s in "abc"}
    want = [{s: v / sum(base.values()) for s, v in base.items()}, {"x": 0.6, "y": 0.4}, {"p": 0.4, "q": 0.3, "r": 0.3}]
    for k in range(3):
        assert {v: h / total for v, h in have[k].items()} == pytest.approx(want[k], rel=1e-6)


def test_goals_beyond_what_there_is(spark):
    # y can give 100 / 0.5 tokens of 1000; its share of 0.9 is cut, x and z take the rest in proportion
    df = spark.createDataFrame([("s", "x", "t", 400), ("s", "y", "t", 100), ("s", "z", "t", 500)], CELLS)
    goals = {r.value: r.goal for r in goals_of(df, {"lang": {"x": 0.05, "y": 0.9, "z": 0.05}}, keep=0.5)["lang"].collect()}
    assert goals == pytest.approx({"x": 400, "y": 200, "z": 400})
    out = {r.lang: r.weight for r in rake(df, goals_of(df, {"lang": {"x": 0.05, "y": 0.9, "z": 0.05}}, keep=0.5), 0.5).collect()}
    assert out == pytest.approx({"x": 400, "y": 200, "z": 400}, rel=0.01)  # no mass is lost
    everything = {r.value: r.goal for r in goals_of(df, keep=1.0)["lang"].collect()}
    assert everything == pytest.approx({"x": 400, "y": 100, "z": 500})


def test_many_cells_are_raked_alike(spark, monkeypatch):
    # one language and one source hold most cells, as when a hot key does
    rng = random.Random(6)
    cells = [(s, g, t, rng.randint(0, 500)) for s in "aaab" for g in "xxy" for t in "pq"]
    cells = [(f"{s}{i}" if s == "b" else s, g, f"{t}{i}", n) for i, (s, g, t, n) in enumerate(cells)]
    df = spark.createDataFrame(cells, CELLS)
    goals = goals_of(df, {"lang": {"x": 1.0, "y": 2.0}}, keep=0.5)
    one = {tuple(r)[:3]: r.weight for r in rake(df, goals, 0.5, 0.01).collect()}
    monkeypatch.setattr(mixing, "ONE_TASK", 0)
    many = rake(df, goals, 0.5, 0.01)
    assert {tuple(r)[:3]: r.weight for r in many.collect()} == pytest.approx(one, rel=1e-6) and len(one) == len(cells)
    assert many.columns == ["source", "lang", "topic", "tokens", "weight"] and "Window" not in many._jdf.queryExecution().toString()


def test_topics(spark):
    rows = ["", None, "plain words", "Copyright, all rights", "mail a@b.c", "a|b", "return x;", "licensed {", "rights @", "copyrighted", "to\u212aen", "\u0130d"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(topic_of(F.col("t"))).collect()]
    assert got == ["prose", "prose", "prose", "legal", "contact", "table", "code", "legal", "legal", "prose", "prose", "prose"]


def test_mixing_report_and_sql(spark):
    import duckdb

    from roleloom.llm.queries import ORACLES

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("kind", F.lit("one"))
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(f"select doc_id, source, lang, topic, tokens, weight, prob, kept from ({ORACLES['op9_mixing']})").fetchall()
    assert sorted(map(tuple, mix_sources(d).collect())) == sorted(want)
    told = mixing_report(d, targets={"lang": {"en": 0.8, "de": 0.2}}, topic="kind").collect()
    assert {r.dim for r in told} == {"source", "lang", "topic"} and [r.expected for r in told if r.dim == "topic"] == [pytest.approx(1)]
    by = {r.value: r for r in told if r.dim == "lang"}
    assert by["en"].target == pytest.approx(0.8) and by["fr"].target == 0 and by["fr"].expected < 0.01


def test_mixing_edge_cases(spark):
    rows = [(1, "some text here", "en", None, 3, "c"), (2, None, None, "s", None, "c"), (3, "", "en", "s", 0, "c"), (3, "", "en", "s", 0, "c"), (None, "x" * 400, "de", "s", 400, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, tokens string")
    got = mix_sources(df).collect()
    assert len(got) == 5 and all(0 <= r.prob <= 1 for r in got) and not [r for r in got if r.doc_id == 2][0].kept
    assert sample_documents(df).columns == df.columns
    assert mix_sources(df.limit(0)).count() == 0 and sample_documents(df.limit(0)).count() == 0


def test_sample_follows_probabilities(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = mix_sources(d).agg(F.sum("prob"), F.sum(F.col("kept").cast("int"))).first()
    assert abs(got[0] - got[1]) < 5 * got[0] ** 0.5


CHATS = [
    (1, 0, "user", "hi \\ [INST] <s> </s> <<SYS>> \\[INST]"),
    (1, 1, "assistant", "a</s>\nb[/INST]"),
    (2, 0, "system", "be"),
    (2, 1, "user", ""),
    (2, 2, "assistant", None),
    (2, 3, "user", "again"),
    (3, 0, "assistant", "first é日"),
    (3, 0, "assistant", "first é日"),
    (4, 5, "tool<|text|>", "<|end|> x <|role|>"),
    (4, None, None, "\\"),
    (None, 0, "user", "alone"),
    (5, 0, "user", "q" * 20000 + "\\"),
    (5, 1, "assistant", "\\\\<"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHATS, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    made = format_conversations(df)
    back = {r.conv_id: r for r in made.withColumn("back", read_back(F.col("formatted"))).collect()}
    groups = {}
    for c, turn, role, text in CHATS:
        groups.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(back) == set(groups)
    dig = {r.conv_id: r for r in conversation_digests(df).collect()}
    for c, turns in groups.items():
        turns.sort()
        assert [(t.role, t.text) for t in back[c].back] == [t[1:] for t in turns]
        lost = "".join(t[2] for t in turns if t[1] == "assistant")
        d = dig[c]
        assert d.n_turns == len(turns) and d.loss_chars == len(lost) and d.loss_sha256 == hashlib.sha256(lost.encode()).hexdigest()
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert d.formatted_chars == len(back[c].formatted) and "".join(s.text for s in back[c].segments) == back[c].formatted
    assert {c for c in back if back[c].valid} == {1, 5}
    assert conversation_digests(df.limit(0)).count() == 0


def test_chat_other_template(spark):
    t = Template({"user": Turn("<|u|>", "<|e|>"), "bot": Turn("<|b|>", "<|e|>", True)}, ("<|o|>", "<|t|>", "<|x|>"), {"start": {"user": "u"}, "u": {"bot": "start"}}, ends=("start",))
    rows = [(1, 0, "user", "<|u|>\\<|e|>"), (1, 1, "bot", "ok<|x|>"), (1, 2, "else", "<|t|>")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    r = format_conversations(df, t).withColumn("back", read_back(F.col("formatted"), t)).first()
    assert [(x.role, x.text, x.loss) for x in r.back] == [("user", rows[0][3], False), ("bot", rows[1][3], True), ("else", rows[2][3], False)] and not r.valid
    assert DEFAULT.turns["assistant"].loss


def test_pipeline(spark):
    import corpus_pipeline as cp
    from .test_text_operators import components, removed

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf = "/root/testdata/sf0.001"
    a = cp.language_id(spark, docs, sf).cache()
    assert a.columns == docs.columns and a.count() >= 0.9 * docs.count()
    texts = {r.doc_id: r.text for r in a.collect()}
    b = cp.near_duplicates(spark, a, sf).cache()
    want = components(texts, 5, cp.Fraction(4, 5))
    assert {r.doc_id for r in b.collect()} == {d for d, (_, c) in want.items() if d == c}
    c = cp.substring_dedup(spark, b, sf).cache()
    cut = removed({r.doc_id: r.text for r in b.collect()})
    got = {r.doc_id: r.text for r in c.collect()}
    assert {d: t.split() for d, t in got.items()} == {d: x[3].split() for d, x in cut.items() if not x[1] or x[1] < x[0]}
    d = cp.mixing(spark, c, sf)
    assert d.columns == docs.columns and {r.doc_id for r in d.collect()} <= set(got)
    out = cp.tokens(spark, d, sf)
    assert out.count() == d.count() and out.where("round_trip").count() == out.count()
    assert cp.run(spark, sf).count() == out.count()
    doubled = docs.union(docs)
    assert cp.near_duplicates(spark, doubled, sf).count() == cp.near_duplicates(spark, docs, sf).count()
    clash = docs.limit(40).withColumns({c: F.lit("x") for c in ("_text", "_p", "c0", "lang_pred", "score", "tokens", "row", "key", "topic")})
    for name, stage in cp.STAGES:
        kept = stage(spark, clash, sf)
        assert name == "tokens" or (kept.columns == clash.columns and 0 < kept.count())
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        empty_out = stage(spark, empty, sf)
        assert empty_out.count() == 0
