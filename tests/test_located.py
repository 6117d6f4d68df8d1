"""Occurrences, merged chunks, coverage and path divergence against brute force."""

import random

from roleloom.operators import containment, divergence, graph, spans


def _text(rng, words):
    glue = [" ", "  ", "\n", ". ", " \t"]
    return "".join(rng.choice(["", " "]) if rng.random() < 0.1 else rng.choice(words) + rng.choice(glue) for _ in range(rng.randrange(12)))


def test_occurrences_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "ab", "abc", "Über", "x", "baba", "Land", "aabb", "é"]
    docs = [(rng.choice([None, *range(40)]), None if rng.random() < 0.05 else _text(rng, words), "extra") for _ in range(120)] + [(7, "ab" * 5000, "long")]
    needles = []
    for j in range(150):
        t = rng.choice(docs)[1] or ""
        at = rng.randrange(len(t) + 1)
        needles.append((rng.choice([None, j, j, j, 3]), rng.choice([t[at : at + rng.randrange(25)], _text(rng, words)[:9], None, "", " "]) if rng.random() < 0.9 else t))
    d = spark.createDataFrame(docs, "doc_id int, text string, needle string").repartition(3)
    n = spark.createDataFrame(needles, "item_id int, text string")
    for fold in (False, True):
        say = str.lower if fold else str
        want = [(i, k, say(t).index(say(x)) + 1) for i, x in needles for k, t, _ in docs if x is not None and t is not None and say(x) in say(t)]
        got = [tuple(r) for r in containment.occurrences(d, n, fold=fold).collect()]
        key = lambda r: tuple((v is None, v or 0) for v in r)
        # a candidate is verified with every row of its id, and a repeated text of strings is placed for each of its ids
        assert sorted(got, key=key) == sorted(want, key=key)
    assert containment.occurrences(d.limit(0), n).count() == 0 and containment.occurrences(d, n.limit(0)).count() == 0


def test_occurrences_have_no_nested_loop(spark, sf_dir):
    d, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = containment.occurrences(d, b)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_chunks_merge(spark):
    t = "Thank you. Go on. Thank you. The end came late."
    rows = [
        (1, 0, t[:25], ["Thank you. ", "Go on. ", "Thank y"]),  # the last one is cut at the chunk's end
        (1, 11, t[11:], ["Go on. ", "Thank you. ", "The end came late."]),
        (2, 5, "abcdefghijk", ["abcdefghiX", "no such words", "", None]),
        (3, 0, "The cat sat down here.", ["The cat sat dawn here."]),
        (4, 0, None, ["x"]), (5, 0, "x", None),
    ]
    c = spark.createDataFrame(rows, "doc_id int, at int, text string, sentences array<string>")
    got = sorted((r.doc_id, r.start, r.stop, r.sentence) for r in spans.merged_chunks(c).collect())
    assert got == [(1, 0, 11, "Thank you. "), (1, 11, 18, "Go on. "), (1, 18, 29, "Thank you. "), (1, 29, 47, "The end came late."), (2, 5, 14, "abcdefghiX")]


def test_near_places_equal_brute_force(spark):
    rng, rows = random.Random(5), []
    for i in range(200):
        chunk = "".join(rng.choice("abcdefghij") for _ in range(30))
        at, n = rng.randrange(20), rng.randrange(1, 11)
        s = list(chunk[at : at + n])
        s[rng.choice([0, -1, rng.randrange(n)])] = "X"
        rows.append((i, 0, chunk, ["".join(s)]))
    got = {r.doc_id: (r.start, r.stop) for r in spans.merged_chunks(spark.createDataFrame(rows, "doc_id int, at int, text string, sentences array<string>")).collect()}
    for i, _, chunk, (s,) in rows:
        n = len(s)
        blocks = [(b - a, a) for a in range(n) for b in range(a + 1, n + 1) if b - a > 0.8 * n and s[a:b] in chunk]
        assert (i in got) == bool(blocks)
        if blocks:
            assert got[i][1] - got[i][0] > 0.8 * n and chunk[slice(*got[i])] in s


def test_alignment(spark):
    rows = [
        (1, "One two. Three.", ["One two. ", "Three."]), (2, "Go. Go. ", ["Go. ", "Go. "]), (3, "Some words here.", ["Some wrods here."]),
        (4, "abc", None), (5, None, ["x"]), (6, "", []), (7, "abcd efgh", ["abcd", "bcd efgh", ""]), (8, "Nothing alike", ["zzz"]),
    ]
    got = {r.doc_id: r for r in spans.alignment(spark.createDataFrame(rows, "doc_id int, text string, sentences array<string>")).collect()}
    assert [got[i].aligned for i in range(1, 9)] == [True, False, True, False, False, False, True, False]
    assert got[2].coverage == 0.5 and got[2].n_placed == 2 and got[3].n_placed == 1 and got[7].n_covered == 9 and got[8].n_placed == 0 and len(got) == 8


def test_path_divergence_equals_brute_force(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(14), rng.randrange(14), rng.random() < 0.6, rng.random() < 0.8, rng.random() < 0.8) for _ in range(26)]
    edges += [(20 + i, 21 + i, i == 30, True, i != 30) for i in range(60)]  # a chain with one identity inside
    pairs = [(i, rng.randrange(14), rng.randrange(14)) for i in range(30)] + [(90, 20, 80), (91, 20, 45), (92, 80, 20), (93, None, 3)]

    def reach(x, step):
        seen, todo = {x}, [x]
        while todo:
            todo += new if (new := set(step(todo.pop())) - seen) else []
            seen |= new
        return seen

    want = {}
    for p, a, b in pairs:
        on = reach(a, lambda v: [e[1] for e in edges if e[0] == v]) & reach(b, lambda v: [e[0] for e in edges if e[1] == v])
        ids = [e for e in edges if e[2] and e[0] in on and e[1] in on and e[0] != e[1]] if a is not None else []
        loops = [e for e in edges if e[2] and e[0] == e[1] and e[0] in on] if a is not None else []
        found = ids + loops
        want[p] = (len(found), sum(e[3] != e[4] for e in found))
    e = spark.createDataFrame(edges, "src int, dst int, identity boolean, one boolean, two boolean").repartition(2)
    got = divergence.divergences(e, spark.createDataFrame(pairs, "pair int, src int, dst int")).collect()
    assert {r.pair: (r.n_identities, r.n_differing) for r in got} == want
    assert all((r.verdict == "DIVERGENCE") == (r.n_differing > 0) for r in got) and want[90] == (1, 1) and want[91] == (0, 0)


def test_expanded(spark):
    e = spark.createDataFrame([(1, 2, "CAUSES"), (1, 2, "CAUSES"), (2, 3, "CAUSES"), (3, 3, "CAUSES"), (4, 1, "HAS"), (5, 1, "CAUSES"), (None, 1, "CAUSES")], "src int, dst int, relation string")
    start = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 9), ("d", None)], "question string, node int")
    got = {(r.question, r.node) for r in graph.expanded(e.where("src is not null"), start, "CAUSES").collect()}
    assert got == {("a", 1), ("a", 2), ("a", 3), ("a", 5), ("b", 3), ("b", 2), ("c", 9), ("d", None)}
    assert ("a", 4) in {(r.question, r.node) for r in graph.expanded(e, start).collect()} and graph.expanded(e.limit(0), start).count() == 5
