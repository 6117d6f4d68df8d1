"""Hard negatives, decontamination and token alignment against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roleloom.llm import negatives
from roleloom.llm.negatives import mine_negatives


def brute_negatives(rows, every=100, k=5):
    good = [(i, label, [math.floor(256 * x) for x in v], n) for n, (i, v, label) in enumerate(rows) if i is not None and label is not None and v is not None and None not in v and all(map(math.isfinite, v))]
    out = []
    for i, label, x, n in good:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y, strict=True)), j, other, m) for j, other, y, m in good if len(y) == len(x)]
        positives = sorted(s[:2] for s in scored if s[2] == label and s[3] != n)[:k]
        others = sorted(s[:2] for s in scored if s[2] != label)
        for p, pid in positives:
            fit = [(s, j) for s, j in others if 80 * -p <= 100 * -s <= 100 * -p][:k]
            out += [(i, pid, r + 1, j, -p, -s) for r, (s, j) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n=500, dim=12, scale=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((8, dim))
    rows = []
    for i in range(n):
        v = centers[int(rng.integers(0, 8))] + 0.3 * rng.standard_normal(dim)
        rows.append((i, [float(x) for x in np.float32(scale * v)], int(rng.integers(0, 3))))
    rows += [(n + i, rows[7][1], i % 3) for i in range(40)]  # ties
    rows += [rows[100], rows[100], rows[3], (rows[5][0], rows[6][1], 1)]  # repeated rows, an id with two vectors
    rows += [(1000, None, 1), (1100, [float("nan")] * dim, 1), (1200, [None] + [1.0] * (dim - 1), 1), (1300, rows[1][1], None), (None, rows[1][1], 1), (1400, [1.0, -2.0], 1), (1401, [0.5, 2.0], 1), (1402, [1.0, -1.9], 2), (1500, [], 0), (1501, [], 0), (1502, [], 1), (1600, [float("inf")] * dim, 0), (1700, [0.0] * dim, 1)]
    return rows


def mined(df, **how):
    return sorted(tuple(r) for r in mine_negatives(df, **how).collect())


@pytest.mark.parametrize("seed, scale", [(1, 1.0), (2, 1e6)])
def test_negatives_against_brute_force(spark, monkeypatch, seed, scale):
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    rows = vectors(seed, scale=scale)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("key", F.lit("x")).repartition(3)
    want = brute_negatives(rows, every=20)
    assert len(want) > 300 and mined(df, every=20) == want
    assert mine_negatives(df.limit(0)).count() == 0
    assert mine_negatives(df.where("vec_id = 1300")).count() == 0


def test_negatives_of_one_common_vector(spark):
    rows = [(i, [0.25, -0.5, 0.125], i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert mined(df) == brute_negatives(rows)


def test_brackets_hold_and_prune(spark):
    rng = np.random.default_rng(5)
    vecs = np.floor(256 * np.concatenate([rng.standard_normal((50, 3)) * 0.1 + c for c in ([4, 0, 0], [0, 4, 0], [0, 0, 4])])).astype(np.int32)
    norms = (vecs.astype(float) ** 2).sum(1)
    m2, pivots = norms.max(), vecs[[0, 60, 120]].astype(float)
    lift = lambda v: np.sqrt(m2 - (v.astype(float) ** 2).sum(1))
    make = lambda extra: negatives._Block({"many": len(vecs), "vecs": vecs.tobytes(), "far": negatives._distances(vecs, extra, pivots, lift(pivots)).tobytes(), **{c: np.arange(len(vecs)).tobytes() for c in ("ids", "labels", "keys")}}, "", 3)
    a, r, every = make(np.zeros(len(vecs))), make(lift(vecs)), np.arange(len(vecs))
    low, high = negatives.bracket(a, every, r, every, m2)
    scores = negatives.exact(a, every, r, every)
    assert (low <= scores).all() and (scores <= high).all()
    best = np.sort(scores, 1)[:, -6]
    assert (high >= best[:, None]).mean() < 0.5


def item_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(docs, items):
    windows = {}
    for item_id, text in items:
        w = item_words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + min(10, len(w))]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, found = item_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leaked(seed=0, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "A", "über", "naïve", "x1", "Zoë", "42", "ñu", "ok", "l'art"]) if rng.random() < 0.7 else f"w{rng.randrange(60)}"
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 9, 10, 11, 25]) if i % 5 == 0 else 20)) for i in range(30)]
    items += [(3, items[8][1]), (None, items[9][1]), (40, None), (41, ""), (42, "..!"), (12, items[12][1]), (43, items[10][1]), (44, "the the the the the the the the the the the the")]
    docs = []
    for i in range(n):
        t = text(rng.randrange(0, 60))
        if rng.random() < 0.5:
            w = item_words(rng.choice(items)[1])
            a = rng.randrange(0, len(w) + 1)
            t += " -- ".join(["", *(x.upper() if rng.random() < 0.2 else x for x in w[a:])]) + " " + text(5)
        docs.append((i, t))
    docs += [(7, docs[5][1]), docs[9], docs[9], (None, docs[8][1]), (900, None), (901, ""), (902, "the " * 5000), (903, " ".join(t for _, t in items if t) * 3)]
    return docs, items


@pytest.mark.parametrize("blocks", [1 << 21, 60])
def test_contamination_against_brute_force(spark, monkeypatch, blocks):
    from roleloom.llm import decontaminate as d

    monkeypatch.setattr(d, "BLOCK_WORDS", blocks)
    docs, items = leaked()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("_items", F.lit(1)).withColumn("c0", F.lit("x")).repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_hits(docs, items)
    assert sum(x[5] for x in want) > 40
    got = sorted((tuple(r)[:6] for r in d.contamination_digests(df, bench).collect()), key=str)
    assert got == want
    left = d.without_contaminated(df, bench)
    assert left.columns == df.columns and sorted((r.doc_id for r in left.collect()), key=str) == sorted((x[0] for x in want if not x[5]), key=str)
    assert d.contamination_digests(df.limit(0), bench).count() == 0
    none = d.contamination_digests(df, bench.limit(0))
    assert none.count() == len(docs) and none.where("contaminated or n_words is null").count() == 0


def test_verbatim_matches(spark):
    from roleloom.llm.decontaminate import verbatim_matches

    body = [f"t{i}" for i in range(30)]
    docs = [(1, " ".join(["a", *body[3:25], "b", *body[:9]])), (2, " ".join([*body, *body]))]
    got = sorted(tuple(r) for r in verbatim_matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(9, " ".join(body))], "item_id bigint, text string")).collect())
    assert got == [(1, "9", 1, 3, 22), (2, "9", 0, 0, 30), (2, "9", 30, 0, 30)]


def brute_alignment(rows):
    """Links by byte ranges, with the libraries that the vocabularies are made for."""
    import sentencepiece
    from tokenizers import Tokenizer

    from roleloom.llm.alignment import BYTE_BPE, PIECES, byte_letters

    ta = Tokenizer.from_file(BYTE_BPE)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = byte_letters()
    bytes_a = lambda i: bytes(letters[c] for c in ta.id_to_token(i))
    bytes_b = lambda i: bytes([int(tb.id_to_piece(i)[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", tb.id_to_piece(i)) else tb.id_to_piece(i).replace("▁", " ").encode()
    told, total = [], Counter()
    for doc_id, text in rows:
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        ra, rb = list(map(bytes_a, a)), list(map(bytes_b, b))
        if not text or b"".join(ra) != (" " + text).encode() or b"".join(rb) != (" " + text).encode():
            told.append((doc_id, 0, 0, [], ""))
            continue
        ea, eb = np.cumsum([len(x) for x in ra]), np.cumsum([len(x) for x in rb])
        links = [(x, y) for x, e, n in zip(a, ea, ra, strict=True) for y, f, m in zip(b, eb, rb, strict=True) if max(e - len(n), f - len(m)) < min(e, f)]
        total.update(links)
        cuts, i, j, groups = sorted(set(ea.tolist()) & set(eb.tolist())), 0, 0, []
        for c in cuts:
            p, q = int((ea <= c).sum()), int((eb <= c).sum())
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        told.append((doc_id, len(a), len(b), links, ";".join(groups)))
    most = Counter()
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, n_a, n_b, links, groups in told:
        counts = [total[x] for x in links]
        n_best = sum(total[x, y] == most[y] for x, y in links)
        out.append((doc_id, n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), n_best, sum(counts), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("pairs, remember", [(1 << 21, 1 << 21), (40, 50)])
def test_alignment_against_brute_force(spark, sf_dir, monkeypatch, pairs, remember):
    from roleloom.llm import alignment

    monkeypatch.setattr(alignment, "PAIRS", pairs)
    rng = random.Random(4)
    parts = ["naïve", "  ", "\n\n", "<|endoftext|>", "</s>", "日本語", "🙂🙃", "don't", "12345", "é", "​", "a" * 40, "\t", "x_y", "ﬁ", " ", "▁", "<0x41>", "Ünïcödé"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", "."]) for _ in range(rng.randrange(1, 30)))) for i in range(60 if pairs > 99 else 12)]
    rows += [(100, None), (101, ""), (102, " "), (103, " lead"), (104, "\x00"), (105, "The quick brown fox. " * 30), rows[1], rows[1], (1, "other"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("pairs", F.lit(1)).repartition(3)
    want = brute_alignment(rows)
    assert sum(x[4] for x in want) > 500
    assert sorted((tuple(r) for r in alignment.alignment_digests(df).collect()), key=str) == want
    assert alignment.alignment_digests(df.limit(0)).count() == 0
    lists = {r.doc_id: r for r in alignment.align_tokens(df.where("doc_id in (100, 105)")).collect()}
    assert lists[100].a_ids == [] and lists[105].groups[-1] == (len(lists[105].a_ids), len(lists[105].b_ids))


def test_ranks_equal_the_tokenizers_library(sf_dir):
    from tokenizers import Tokenizer

    from roleloom.llm.alignment import BYTE_BPE, ByteBpe

    t = Tokenizer.from_file(BYTE_BPE)
    t.encode_special_tokens = True
    points = [c for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f" a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2 !{chr(c)}?  {chr(c)}\n{chr(c)} " for c in points]
    assert ByteBpe(BYTE_BPE).encode(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_transducer_rejects_other_bytes():
    from roleloom.llm.alignment import Transducer

    t = Transducer([b"ab", b"c"], [b"a", b"bc", b"b"])
    assert t.align([0, 1], [0, 1]) == ([2], [2], [0, 2, 3])
    assert t.align([0, 1], [0, 2]) is None and t.align([0], [1]) is None and t.align([0, 1], [0]) is None
