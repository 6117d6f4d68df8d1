"""Operators on texts against brute force: fingerprints, pieces, languages, shards, substrings, Jaccard."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from roleloom.llm import fingerprints as fp
from roleloom.llm.jaccard import Bands, jaccard_components, max_difference, parity_bitmap
from roleloom.llm.langid import Model, identify_languages, kept_contexts
from roleloom.llm.pieces import MODEL, decode_documents, encode_documents
from roleloom.llm.sharding import assign_shards, jump_hash
from roleloom.llm.substrings import WINDOW, removed_repeats, without_repeats

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, bucket string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgé日") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passage = [rng.choice(vocab) for _ in range(70)]
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.25 and texts:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 5, 40, 60, 150, 400]))]
        if kind > 0.7:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        if kind > 0.93:
            words[:0] = ["ha"] * 120
        text = rng.choice([" ", "\n", "  \t"]).join(words)
        texts.append(text)
        rows.append(text)
    rows += [None, "", " \n ", rows[5], "A" * 5000, "word " * 3000, "▁x", "x\x00y"]
    return [(i * 7 % 1009, t, "en", "s", len(t or ""), "clash", "b") for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_fingerprints(docs, empty):
    texts = texts_of(docs)
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fp.edited_fingerprints(docs, 6).collect()}
    assert sorted(got) == sorted(texts)
    for a, b in zip(order, order[1:] + order[:1]):
        t, nxt = texts[a] or "", texts[b] or ""
        cut = len(t) - len(t) // 3
        edited = t[:cut] + nxt[: len(t) // 3]
        r = got[a]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == str(fp.fingerprint(fp.Prefixes(fp._points(t))))
        assert r.edited_fingerprint == str(fp.fingerprint(fp.Prefixes(fp._points(edited))))
        assert r.near_edited == fp.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == fp.likeness(r.fingerprint, got[b].fingerprint)
        assert (r.near_next == 1.0) == (t == nxt)
        common = next((i for i, (x, y) in enumerate(zip(t, edited)) if x != y), min(len(t), len(edited)))
        assert r.common_prefix == common
        if len(t) > 100:
            assert r.near_edited > 0.4
    assert fp.edited_fingerprints(empty, 3).count() == 0


def test_fingerprints_of_null_ids_and_ties(spark):
    rows = [(None, "nul"), (3, "b"), (3, "a"), (3, "a"), (9, "zz")]
    got = fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"), 3).collect()
    assert len(got) == 5 and {r.doc_id for r in got} == {None, 3, 9}
    # order: 9, 3 b, 3 a, 3 a, null; the null's next is 9
    assert [r.near_next for r in got if r.doc_id is None] == [0.0]


def test_span_hashes():
    rng = np.random.default_rng(0)
    a = fp.Prefixes(rng.integers(0, 2, 300).astype(np.uint32))
    for _ in range(200):
        i, j = rng.integers(0, 300, 2)
        n = int(rng.integers(0, 300 - max(i, j) + 1))
        assert fp.spans_equal(a, i, a, j, n) == (a.points[i : i + n] == a.points[j : j + n]).all()
        k = fp.longest_common_extension(a, i, a, j)
        assert (a.points[i : i + k] == a.points[j : j + k]).all()
        assert i + k == 300 or j + k == 300 or a.points[i + k] != a.points[j + k]


def test_pieces(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = encode_documents(docs)
    texts = texts_of(docs)
    got = out.collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id] or ""
        assert list(r.token_ids) == sp.encode(t) and r.n_tokens == len(r.token_ids)
        assert r.round_trip == ("▁" not in t)
        if r.round_trip:
            assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = {r.doc_id: r.text for r in decode_documents(out).collect()}
    assert all(back[d] == (t or "").replace("▁", " ") for d, t in texts.items())
    assert encode_documents(empty).count() == 0


def test_pieces_on_documents(spark, sf_dir):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in encode_documents(d, carry=("doc_id", "text")).collect():
        assert list(r.token_ids) == sp.encode(r.text) and r.round_trip


def test_languages_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify_languages(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_edge_cases(spark, docs, empty):
    assert identify_languages(empty).count() == 0
    rows = [(i, "abc abd " * 5, "xx") for i in range(20)] + [(50, None, "xx"), (51, "123 456", "xx"), (None, "abc", None), (52, "ABC", None)]
    got = {r.doc_id: r for r in identify_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got[50].lang_pred == got[51].lang_pred == "und" and got[None].lang_pred == "xx" and not got[None].held_out
    none = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert identify_languages(none).first().lang_pred == "und"


def code_length(text: bytes, trees: dict, order: int) -> float:
    """PPM, method C, byte by byte."""
    bits = 0.0
    for i, b in enumerate(text):
        ctx = text[max(0, i - order) : i]
        while ctx not in trees:
            ctx = ctx[1:]
        while True:
            nxt = trees.get(ctx, {})
            total, kinds = sum(nxt.values()), len(nxt)
            if b in nxt:
                bits -= np.log2(nxt[b] / (total + kinds))
                break
            if kinds:
                bits -= np.log2(kinds / (total + kinds))
            if not ctx:
                bits += 8
                break
            ctx = ctx[1:]
    return bits


def test_languages_against_brute_force(spark):
    rng = random.Random(4)
    letters = {"aa": "abcde é", "bb": "bcdef ß", "cc": "abxyz 日"}
    rows = [(i, "".join(rng.choice(letters[g]) for _ in range(rng.randint(1, 60))), g) for i, g in enumerate(rng.choices(list(letters), k=240))]
    rows += [(900 + i, "".join(rng.choice("abcdefxyzq é") for _ in range(20)), None) for i in range(30)] + [rows[3], (None, rows[5][1], "aa"), (950, rows[5][1], rows[5][2])]
    trees = {g: {b"": {}} for g in letters}
    for text, lang in {(t, g) for i, t, g in rows if g and (i is None or zlib.crc32(str(i).encode()) % 3 != 1)}:
        raw = text.encode()
        for i, b in enumerate(raw):
            for k in range(min(3, i) + 1):
                nxt = trees[lang].setdefault(raw[i - k : i], {})
                nxt[b] = nxt.get(b, 0) + 1
    known = set().union(*(t.keys() for t in trees.values()))
    got = identify_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        raw = texts[r.doc_id].encode()
        cost = {g: code_length(raw, {c: t.get(c, {}) for c in known}, 3) for g, t in trees.items()}
        least = min(cost.values())
        if r.lang_pred == "und":
            assert not re.search(r"[^\W\d_]", texts[r.doc_id])
            continue
        assert cost[r.lang_pred] == pytest.approx(least, abs=1e-2) and r.bits_per_byte * len(raw) == pytest.approx(least, abs=1e-2)


def test_languages_of_null_and_repeated_ids(spark):
    words = {"en": "the of and to in is that", "de": "der die und das nicht ist ein", "fr": "le la les et des est une"}
    rng = random.Random(9)
    some = lambda g: " ".join(rng.choice(words[g].split()) for _ in range(12))
    for ids in (lambda i: None, lambda i: 7):  # 7 is not held out, 6 is
        rows = [(ids(i), some(g), g) for i in range(3000) for g in words] + [(7, "of the of the", "en")] * 3000
        got = identify_languages(spark.createDataFrame([*rows, (77, "und das ist nicht die", None)], "doc_id bigint, text string, lang string"), 200)
        assert got.where("lang_pred = 'und'").count() == 0 and got.where("doc_id = 77").first().lang_pred == "de"


def test_many_languages(spark):
    rows = [(3 * i + k, f"{chr(0x4E00 + i) * 6} {chr(0x4E00 + i) * k}", f"l{i:03}") for i in range(90) for k in range(3)] + [(9999, chr(0x4E00 + 88) * 4, None)]
    got = identify_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    learnt = {g for i, _, g in rows if g and zlib.crc32(str(i).encode()) % 3 != 1}  # of some all rows are held out
    assert [r.lang_pred for r in got if r.doc_id == 9999] == ["l088"] and {r.lang_pred for r in got} == learnt and len(learnt) > 64
    assert kept_contexts(4) == 8192 and kept_contexts(10_000) * 256 * 4 * 10_000 <= 256 << 20


def test_code_lengths_by_hand():
    counts = {"a": {b"": {1: 3, 2: 1}, b"\x01": {1: 2}, b"\x02": {2: 1}}}
    m = Model(["a"], counts, 1)
    bits = m.bits(np.array([1, 1, 2, 9], np.uint8), np.array([0, 4]))[0, 0]
    log = np.log2
    first = -log(3 / 6)  # root: 4 bytes of 2 kinds
    second = -log(2 / 3)
    third = -log(1 / 3) - log(1 / 6)  # escape from \x01, then root
    fourth = -log(1 / 2) - log(2 / 6) + 8  # escape from \x02 and from the root
    assert abs(bits - (first + second + third + fourth)) < 1e-4


def test_shards(docs, empty):
    keys = np.arange(20000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, 12):
        a, b = jump_hash(keys, n), jump_hash(keys, n + 1)
        assert ((a == b) | (b == n)).all() and abs((a != b).mean() - 1 / (n + 1)) < 0.02

    def one(key, n):  # the published loop
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    assert [one(int(k), 7) for k in keys[:500]] == jump_hash(keys[:500], 7).tolist()
    twice = docs.union(docs)
    got = assign_shards(twice, 8).collect()
    texts = texts_of(docs)
    assert len(got) == 2 * len(texts)
    by = {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "key"
        assert r.grown_shard in (r.shard, 8)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert assign_shards(empty, 8).count() == 0


def removed(texts: dict) -> dict:
    """Brute force of substring dedup."""
    words = {d: WORD.findall(t or "") for d, t in texts.items()}
    first, out = {}, {}
    for d in sorted(words):
        w, gone = words[d], [False] * len(words[d])
        seen = []
        for i in range(len(w) - WINDOW + 1):
            key = tuple(w[i : i + WINDOW])
            if first.get(key, d) < d:
                gone[i : i + WINDOW] = [True] * WINDOW
            seen.append(key)
        for key in seen:
            first.setdefault(key, d)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def test_substrings(spark, docs, empty):
    for data in (docs, spark.createDataFrame(make(5, 150), SCHEMA).repartition(3), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        want = removed(texts_of(data))
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in removed_repeats(data).collect()}
        assert got == {d: x[:3] for d, x in want.items()}
        assert sum(x[1] for x in got.values()) > 0
    assert removed_repeats(empty).count() == 0


def test_substrings_around_the_shared_words(spark):
    # a shared passage between other words of the same least document, in one row and in several
    rng = random.Random(21)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for case in range(8):
        w, z, y, v, q = some(60), some(80), some(40), some(40), some(30)
        rows = {3: y + w + v, 5: z + w + z + q + z + w + z}
        texts = {d: " ".join(x) for d, x in rows.items()}
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in removed_repeats(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
        assert got == {d: x[:3] for d, x in removed(texts).items()} and got[5][1] == 120, case


def test_substrings_of_doubled_blocks(spark):
    # the second copy of L P R, in the same text or in another row of its id, holds P as well as the first
    rng = random.Random(11)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(0, 200, 10):
        p = some(rng.randint(50, 80))
        block = some(30) + p + some(30)
        rows += [(i + 3, some(40) + p + some(40)), (i + 5, block + some(20) + block), (i + 7, some(5) + block), (i + 7, block + some(5))]
    data = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id bigint, text string").repartition(3)
    windows = lambda w: [tuple(w[j : j + WINDOW]) for j in range(len(w) - WINDOW + 1)]
    first = {}
    for d, w in sorted(rows):
        for x in windows(w):
            first.setdefault(x, d)
    want = []
    for d, w in rows:
        gone = {j + k for j, x in enumerate(windows(w)) if first[x] < d for k in range(WINDOW)}
        want.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    assert sorted(map(tuple, removed_repeats(data).collect())) == sorted(want)


def test_texts_without_repeats(docs):
    want = removed(texts_of(docs))
    out = without_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    for d, t in texts_of(docs).items():
        n, gone, _, kept = want[d]
        if gone and gone == n:
            assert d not in got
        elif gone:
            assert got[d].text.split() == kept.split() and got[d].n_chars == len(got[d].text)
        else:
            assert got[d].text == t


def components(texts: dict, k: int, t: Fraction) -> dict:
    """Brute force of the Jaccard join."""
    sets = {}
    for d, x in texts.items():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * t.denominator >= t.numerator * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("k,t", [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(1, 2))])
def test_jaccard(spark, docs, empty, k, t):
    for data in (docs, spark.createDataFrame(make(9, 120), SCHEMA).repartition(3)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(data, k, t).collect()}
        assert got == components(texts_of(data), k, t)
    if k == 3:
        assert jaccard_components(empty, k, t).count() == 0


def test_bitmaps_fold_to_half_the_size():
    rng = np.random.default_rng(3)
    for n in (65, 129, 257, 513):
        u = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        long = parity_bitmap(u)
        want = np.zeros(len(long) * 32, int)  # parities of half as many classes
        np.add.at(want, (u % np.uint64(len(want))).astype(int), 1)
        half = long[: len(long) // 2] ^ long[len(long) // 2 :]
        assert [int(x >> np.uint64(j)) & 1 for x in half for j in range(64)] == list(want % 2)


@pytest.mark.parametrize("t", [Fraction(9, 10), Fraction(1, 3)])
def test_jaccard_around_powers_of_two(spark, t):
    rng = random.Random(7)
    rows = []
    for low, high in ((60, 70), (120, 135), (250, 262)):
        for n in range(low, high):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n + 2)]
            rows += [words, words + [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 4))]]
            if t < Fraction(1, 2):
                rows.append(words[: n // 2])
    texts = {i: " ".join(w) for i, w in enumerate(rows)}
    data = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(data, 3, t).collect()}
    assert got == components(texts, 3, t)


def test_jaccard_on_documents(spark):
    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(data, 3, Fraction(9, 10)).collect()}
    assert got == components(texts_of(data), 3, Fraction(9, 10))


def test_jaccard_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "a b c d"), (4, "q r")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, Fraction(9, 10)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (1, 1), (1, 1), (2, 1), (4, 4)]


def test_pigeonhole_bound():
    for t in (Fraction(9, 10), Fraction(4, 5)):
        b = Bands(t)
        for a in range(1, 120):
            for c in range(a, 130):
                if Fraction(a, c) >= t:
                    assert set(b.of(a)) & set(b.of(c))
                    band = max(set(b.of(a)) & set(b.of(c)))
                    m, d = b.plans[band]
                    both = -(-t.numerator * (a + c) // (t.numerator + t.denominator))  # least intersection
                    assert m + d > a + c - 2 * both
                    assert a + c - 2 * both <= max_difference(c, t)


def components_of_rows(rows, k, t):
    """Components by brute force where ids may repeat: rows of one id are one node."""
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if rows[a][0] == rows[b][0] or (u and i * t.denominator >= u * t.numerator):
                top[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[find(x)] = min(i, least.get(find(x), i))
    return sorted({(rows[x][0], least[find(x)]) for x in range(len(rows))})


def test_jaccard_ids_with_several_texts(spark):
    a, b = "a b c d e", "q r s t u v"
    cases = [[(3, a), (5, a), (5, b), (4, b)]]
    for seed in (1, 2):
        rng = random.Random(seed)
        texts = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(30)) for _ in range(25)]
        texts += [t + " zz" for t in texts[:10]]
        cases.append([(rng.randrange(40), rng.choice(texts)) for _ in range(70)])
    for rows in cases:
        data = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        got = sorted({(r.doc_id, r.component_id) for r in jaccard_components(data, 3, Fraction(9, 10)).collect()})
        assert got == components_of_rows(rows, 3, Fraction(9, 10))


def test_languages_of_few_texts_in_many_rows(spark):
    """Six languages of 8000 rows without ids, one or two texts each: all are learnt."""
    letters = ["abcde", "fghij", "klmno", "pqrst", "uvwxy", "éèêôû"]
    texts = {}
    for i, alphabet in enumerate(letters):
        rng = random.Random(i)
        texts[f"l{i}"] = [" ".join("".join(rng.choice(alphabet) for _ in range(4)) for _ in range(30)) for _ in range(1 if i == 2 else 2)]
    rows = [(None, t, lang) for lang, some in texts.items() for t in some]
    data = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4000)))).drop("n")
    found = {r.lang_pred: r["count"] for r in identify_languages(data).groupBy("lang_pred").count().collect()}
    assert found == {lang: 4000 * len(some) for lang, some in texts.items()}
