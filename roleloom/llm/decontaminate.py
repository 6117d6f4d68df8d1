"""Benchmark decontamination by suffix arrays of the training text.

The documents are the training side.  A task indexes them shard by shard (about
SHARD bytes of text, or one longer document): the suffixes of all its words in
lexicographic order, sorted to a depth of at least WINDOW words by prefix
doubling.  Every test suffix is binary-searched in every shard, word by word:
its range of training suffixes narrows until no suffix is left or the window is
matched; the range then holds the window's locations.  Windows that follow each
other in both texts join to the longest verbatim matches.

The test side is cut into blocks of bounded size, which are broadcast one after
the other.  Words are compared by 63 bits of a hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_at, map_arrow, materialize, numbered, release, renamed_back, scratch
from .textscan import BASE, BASE_INV, mix, powers, text_views, words

WINDOW = 10
#: Bytes of training text indexed together.
SHARD = 4 << 20
#: Test words expected in a block (one item more at most).
BLOCK_WORDS = 1 << 21

#: Bytes outside of words: those below 0x80 but for digits and letters.
OUTSIDE = np.ones(256, bool)
OUTSIDE[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    OUTSIDE[_a:_b] = False


def _hashes(data: np.ndarray, offs: np.ndarray):
    """Hashes (never 0) of the words in lower case and the index of each text's first word."""
    _, _, h, first = words(data, offs, True, OUTSIDE)
    return h | np.uint64(1), first


def suffix_array(h: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``h`` in the order of the next ``depth`` or more values (past the end: lowest)."""
    order = np.argsort(h)
    rank = _ranks(h[order], order)
    k = 1
    while k < depth and rank.max(initial=0) < len(h) - 1:
        key = rank * (len(h) + 1)
        key[: len(h) - k] += rank[k:] + 1
        order = np.argsort(key)
        rank = _ranks(key[order], order)
        k *= 2
    return order


def _ranks(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    step = np.ones(len(order), np.int64)
    step[:1] = 0
    step[1:] = ordered[1:] != ordered[:-1]
    out[order] = np.cumsum(step)
    return out


class Tests:
    """A block of test items: words, and their distinct windows with the items and places that hold them."""

    def __init__(self, item_ids: list[str | None], texts: list[np.ndarray], window: int = WINDOW):
        sizes = np.array([len(t) for t in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ids = item_ids
        self.h = np.concatenate([*texts, np.empty(0, np.uint64)]).astype(np.uint64)
        counts = np.where(sizes > 0, np.maximum(sizes - window + 1, 1), 0)
        item = np.repeat(np.arange(len(texts)), counts)
        at = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
        start, length = first[item] + at, np.minimum(sizes[item], window)
        run = np.zeros(len(self.h) + 1, np.uint64)
        np.cumsum(self.h * powers(BASE, len(self.h)), out=run[1:])
        whole = mix((run[start + length] - run[start]) * powers(BASE_INV, len(self.h) + 1)[start] + length.astype(np.uint64))
        order = np.lexsort((at, item, whole))
        new = np.ones(len(order), bool)
        new[1:] = whole[order][1:] != whole[order][:-1]
        edge = np.flatnonzero(new)
        self.start, self.length = start[order][edge], length[order][edge]
        #: of needle i: item[place[i]:place[i + 1]] and the word where it starts there
        self.place, self.item, self.at = np.append(edge, len(order)), item[order], at[order]

    def find(self, h: np.ndarray, order: np.ndarray):
        """Needle and position of every occurrence in ``h``, whose suffix array is ``order``; and each needle's matched length."""
        first = h[order]
        w = self.h[self.start] if len(self.start) else np.empty(0, np.uint64)
        low, high = np.searchsorted(first, w, "left"), np.searchsorted(first, w, "right")
        matched = (high > low).astype(np.int64)
        live = np.flatnonzero((high > low) & (self.length > 1))
        d = 1
        while len(live):
            w = self.h[self.start[live] + d]
            a, b = _narrow(h, order, d, low[live], high[live], w)
            low[live], high[live] = a, b
            matched[live[b > a]] = d + 1
            d += 1
            live = live[(b > a) & (self.length[live] > d)]
        n = np.where(matched == self.length, high - low, 0)
        needle = np.repeat(np.arange(len(n)), n)
        return needle, order[np.repeat(low, n) + np.arange(len(needle)) - np.repeat(np.cumsum(n) - n, n)], matched


def _narrow(h, order, d, low, high, w):
    """The part of the ranges [low, high) of suffixes whose word ``d`` is ``w``."""
    out = []
    for right in (False, True):
        a, b = low.copy(), high.copy()
        while True:
            live = np.flatnonzero(a < b)
            if not len(live):
                break
            mid = (a[live] + b[live]) >> 1
            v = h[order[mid] + d]
            up = (v <= w[live]) if right else (v < w[live])
            a[live[up]] = mid[up] + 1
            b[live[~up]] = mid[~up]
        out.append(a)
    return out


class _Shard:
    """Words of a run of texts with an empty value behind each text, and their suffix array."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        h, first = _hashes(data, offs)
        self.sizes = np.diff(first)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.first = first[:-1] + np.arange(len(self.sizes))  # of each text, in the padded sequence
        self.h = np.zeros(len(h) + len(self.sizes) + 2 * WINDOW, np.uint64)
        place = np.arange(len(h)) + self.doc
        self.h[place] = h
        self.order = suffix_array(self.h, WINDOW)
        self.order = self.order[self.h[self.order] > 0]

    def owner(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1


def _marked(shard: _Shard, starts: np.ndarray, lengths: np.ndarray):
    """The spans that cover: text, first word, words."""
    mark = np.zeros(len(shard.h) + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + lengths, -1)
    inside = np.cumsum(mark) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    doc = shard.owner(a)
    return doc, a - shard.first[doc], b - a


def _scan(tests, text: str, names: list[str]):
    """Adds word count, hit spans (first word << 32 | words) and items, joined with those of earlier blocks."""

    def run(batches):
        t: Tests = tests.value
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n = batch.num_rows
            n_words, spans, items = np.zeros(n, np.int64), [[]] * n, [[]] * n
            for f, count, data, offs in text_views(column[text], SHARD):
                shard = _Shard(data, offs)
                n_words[f : f + count] = shard.sizes
                needle, at, _ = t.find(shard.h, shard.order)
                starts, lengths = [at], [t.length[needle]]
                for i in range(count):
                    old = column["_spans"][f + i].as_py() if "_spans" in column else None
                    if old:
                        starts.append(shard.first[i] + np.array([x >> 32 for x in old]))
                        lengths.append(np.array([x & 0xFFFFFFFF for x in old]))
                    if "_items" in column:
                        items[f + i] = column["_items"][f + i].as_py() or []
                doc, a, size = _marked(shard, np.concatenate(starts), np.concatenate(lengths))
                for i, x, y in zip(doc.tolist(), a.tolist(), size.tolist(), strict=True):
                    spans[f + i] = [*spans[f + i], (x << 32) | y]
                pair = np.unique(shard.owner(at) * len(t.start) + needle) if len(at) else at
                doc, needle = pair // max(1, len(t.start)), pair % max(1, len(t.start))
                many = t.place[needle + 1] - t.place[needle] if len(pair) else pair
                which = t.item[np.repeat(t.place[needle], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)] if len(pair) else pair
                both = np.unique(np.repeat(doc, many) * len(t.ids) + which) if len(pair) else pair
                for i, x in zip((both // max(1, len(t.ids))).tolist(), (both % max(1, len(t.ids))).tolist(), strict=True):
                    if t.ids[x] is not None:
                        items[f + i] = [*items[f + i], t.ids[x]]
            kept = {c: column[c] for c in names}
            yield pa.RecordBatch.from_pydict(kept | {"_n_words": pa.array(n_words), "_spans": pa.array(spans, pa.list_(pa.int64())), "_items": pa.array(items, pa.list_(pa.string()))})

    return run


def _test_rows(batches):
    for batch in batches:
        for f, count, data, offs in text_views(batch.column(1)):
            h, first = _hashes(data, offs)
            lists = [h[a:b].view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"item_id": batch.column(0).slice(f, count), "h": pa.array(lists, pa.list_(pa.int64()))})


def test_blocks(benchmark: DataFrame):
    """The test items in blocks of about BLOCK_WORDS words, one after the other, each with whether it is the last; equal rows once."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    found = materialize(map_arrow(rows, _test_rows, "item_id string, h array<bigint>").where(F.size("h") > 0), "tests")
    total = found.agg(F.sum(F.size("h"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    for b in range(blocks):
        part = found.where(F.pmod(F.xxhash64("item_id", "h"), F.lit(blocks)) == b).toArrow()
        yield Tests(part["item_id"].to_pylist(), [np.array(x, np.int64).view(np.uint64) for x in part["h"].to_pylist()]), b + 1 == blocks
    release(found)


test_blocks.__test__ = False  # not a test of pytest

_FOUND = "_n_words bigint, _spans array<bigint>, _items array<string>"


def _with_hits(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` under the names of ``numbered`` and ``_n_words, _spans, _items``."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    text, every = column_at(docs, "text"), [f"c{i}" for i in range(len(docs.columns))]
    kept = [c for c, name in zip(every, docs.columns, strict=True) if name in keep]
    fields = {c: f"{c} {f.dataType.simpleString()}" for c, f in zip(every, docs.schema.fields, strict=True)}
    state = docs.select(*numbered(docs))
    for tests, last in test_blocks(benchmark):
        names = kept if last else every
        held = docs.sparkSession.sparkContext.broadcast(tests)
        state = map_arrow(state, _scan(held, text, names), ", ".join([*(fields[c] for c in names), _FOUND]))
        if not last:  # a further block of tests: the text once more, with what was found so far
            state = materialize(state, "hits")
    return state


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, spans, items`` of every document.

    Words are maximal runs of letters, digits and anything beyond ASCII, A-Z
    lower-cased.  A test item's windows are its runs of WINDOW words, or all its
    words if it has fewer; an item without words has none.  ``spans(first,
    words)``: the words of the document within any occurrence of a window;
    ``items``: the distinct ids, as strings in order, of the items with windows
    that occur.  A null text has no words.  An item without id hits, but is not
    listed; repeated items and ids count once.  Documents are judged row by row,
    so their ids may be null or repeated.  Without items nothing is hit; an
    empty table gives no row.
    """
    out = _with_hits(docs.select("doc_id", "text"), benchmark, ["doc_id"])
    spans = F.transform("_spans", lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("first"), x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("words")))
    return out.select(F.col("c0").alias("doc_id"), F.col("_n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct("_items")).alias("items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, of which no word is in a test window."""
    return renamed_back(_with_hits(docs, benchmark, docs.columns).where(F.size("_spans") == 0), docs)


def _matches(tests):
    """Longest verbatim matches of a partition's documents: occurrences on one diagonal joined."""

    def run(batches):
        t: Tests = tests.value
        for batch in batches:
            for f, count, data, offs in text_views(batch.column(1), SHARD):
                shard = _Shard(data, offs)
                needle, at, _ = t.find(shard.h, shard.order)
                many = t.place[needle + 1] - t.place[needle] if len(needle) else needle
                row = np.repeat(np.arange(len(needle)), many)
                spot = np.repeat(t.place[needle], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) if len(needle) else needle
                item, there, here = t.item[spot], t.at[spot], at[row]
                size = t.length[needle[row]]
                order = np.lexsort((here, here - there, item))
                item, there, here, size = item[order], there[order], here[order], size[order]
                new = np.ones(len(order), bool)
                new[1:] = (item[1:] != item[:-1]) | (here[1:] - there[1:] != here[:-1] - there[:-1]) | (here[1:] != here[:-1] + 1)
                a = np.flatnonzero(new)
                b = np.append(a[1:], len(order)) - 1 if len(a) else a
                doc = shard.owner(here[a])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).take(pa.array(f + doc)), "item_id": pa.array([t.ids[x] for x in item[a]], pa.string()), "doc_word": pa.array(here[a] - shard.first[doc]),
                        "item_word": pa.array(there[a]), "n_words": pa.array(here[b] + size[b] - here[a]),
                    }
                )

    return run


def verbatim_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, doc_word, item_word, n_words``: every longest run of words that a document and an item share.

    Of WINDOW words or more (or a whole shorter item), with its place in both
    texts, counted in words from 0.  One row for each document, item and place.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sc, out = docs.sparkSession.sparkContext, None
    with scratch(docs.sparkSession):
        for tests, _ in test_blocks(benchmark):
            part = map_arrow(base, _matches(sc.broadcast(tests)), "doc_id bigint, item_id string, doc_word bigint, item_word bigint, n_words bigint")
            out = part if out is None else out.union(part)
        return materialize(out, "matches", outer=True)


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` (see the contract of op12), and ``longest``, the words of the longest hit span."""
    found = contamination(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["words"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), F.coalesce(F.array_max("spans.words"), F.lit(0)).cast("bigint").alias("longest"),
    )
