"""Substring dedup by recompression.

The word sequence of every document is compressed in rounds.  A round names
runs of equal symbols and then pairs: a symbol is left or right by a bit of its
name, and a left symbol followed by a right one becomes a new symbol.  Names
are hashes of what they replace, so they are the same in all documents, and a
symbol's fate depends on its neighbours only: equal substrings get equal
symbols but for a few at their ends.  For every symbol the extent of words that
it depends on is kept; a symbol whose extent lies in a window is a symbol of
that window wherever the window occurs.

Each window of WINDOW words is represented by the least-named of its symbols;
consecutive windows with the same symbol form a segment.  Spark groups the
segments by symbol: symbols that occur in one document only are done; segments
equal throughout are settled at once; where segments differ, their windows are
compared one by one, for each content all segments of its least document.

Naming needs no dictionary and so no round of its own in Spark: a name is a
hash of what it stands for, the same everywhere.  A false match of names only
costs a comparison.  What decides are hashes of 64-bit word hashes, no word is
compared again: contents agree in a symbol's hash and one of their own, windows
in two hashes of their own (128 bits each; a false match is not expected in
10**15 windows).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_at, ddl, map_arrow, materialize, numbered, renamed_back, scratch
from .textscan import BASE, BASE_INV, mix, powers, text_views, words

WINDOW = 50
#: Rounds of recompression.
ROUNDS = 3


def recompress(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS):
    """Symbols of word hashes ``h``: names, and the extents ``[low, high)`` of words they depend on.

    ``first``: the index of each document's first word and the end.  Symbols
    never cross documents; one that depends on a document's end has an extent
    beyond it.
    """
    n = len(h)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    name, low, high = h.copy(), np.arange(n), np.arange(1, n + 1)
    for level in range(rounds):
        # runs
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(name)))
        last = start + length - 1
        name_r, doc_r = name[start], doc[start]
        many = length > 1
        if many.any():
            name_r = name_r.copy()
            name_r[many] = mix(name_r[many] * np.uint64(BASE) + length[many].astype(np.uint64) + np.uint64(0x1234567 + level))
        low_r, high_r = low[start] - 1, high[last] + 1
        inner = doc_r[1:] == doc_r[:-1]
        low_r[1:][inner] = np.minimum(low_r[1:][inner] + 1, low[last[:-1]][inner])
        high_r[:-1][inner] = np.maximum(high_r[:-1][inner] - 1, high[start[1:]][inner])
        # pairs
        right = (mix(name_r + np.uint64(level * 2 + 1)) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(name_r), bool)
        pair[:-1] = ~right[:-1] & right[1:] & inner
        second = np.zeros(len(name_r), bool)
        second[1:] = pair[:-1]
        lo, hi = low_r.copy(), high_r.copy()
        # a left symbol looks at the next one, a right symbol at the one before
        nxt, prv = ~right, right
        hi[:-1] = np.where(nxt[:-1] & inner, np.maximum(high_r[:-1], high_r[1:]), high_r[:-1])
        lo[1:] = np.where(prv[1:] & inner, np.minimum(low_r[1:], low_r[:-1]), low_r[1:])
        both = np.flatnonzero(pair)
        out = name_r.copy()
        out[both] = mix(name_r[both] * np.uint64(BASE) + name_r[both + 1] + np.uint64(0x7654321 + level))
        hi[both] = np.maximum(hi[both], hi[both + 1])
        keep = ~second
        name, low, high, doc = out[keep], lo[keep], hi[keep], doc_r[keep]
        # extents grow with the position
        low, high = np.maximum.accumulate(low), np.minimum.accumulate(high[::-1])[::-1]
    return name, low, high


def _spans(h: np.ndarray, again: int = 0):
    """A function from arrays (start, end) to hashes of the words between; with ``again`` other ones."""
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum((mix(h + np.uint64(again)) if again else h) * powers(BASE, len(h)), out=run[1:])
    inverse = powers(BASE_INV, len(h) + 1)
    return lambda a, b: mix((run[b] - run[a]) * inverse[a] + (b - a).astype(np.uint64))


#: Makes the second hash of a word from the first.
_AGAIN = 0x3C79AC492BA7B653


def segments(h: np.ndarray, first: np.ndarray, window: int = WINDOW):
    """Segments of all windows: symbol key, content key, first window, number of windows (word indexes)."""
    name, low, high = recompress(h, first)
    span = _spans(h)
    counts = np.maximum(np.diff(first) - window + 1, 0)
    total = int(counts.sum())
    if not total:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), np.empty(0, np.uint64), e, e
    at = np.arange(total) + np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)  # window starts
    a, b = np.searchsorted(low, at), np.searchsorted(high, at + window, side="right")
    size = np.maximum(b - a, 0)
    best = np.full(total, -1)
    best[size == 1] = a[size == 1]
    table, step = np.arange(len(name)), 1
    while step < size.max(initial=0):
        nxt = table[: len(table) - step] if len(table) > step else table[:0]
        other = table[step:]
        table = np.where(name[other] < name[nxt], other, nxt)  # least name in 2 * step symbols, the first of equals
        sel = np.flatnonzero((size >= 2 * step) & (size < 4 * step))
        if len(sel):
            x, y = table[a[sel]], table[b[sel] - 2 * step]
            best[sel] = np.where(name[y] < name[x], y, x)
        step *= 2
    sel = np.flatnonzero((size >= 2) & (size < 4) & (best < 0))
    if len(sel):  # pragma: no cover - sizes 2 and 3 are settled by the first step
        raise AssertionError("unsettled windows")
    cut = np.ones(total, bool)
    cut[1:] = (best[1:] != best[:-1]) | (best[1:] < 0) | (at[1:] != at[:-1] + 1)
    s = np.flatnonzero(cut)
    n = np.diff(np.append(s, total))
    p, x = at[s], best[s]
    end = p + n - 1 + window
    whole = span(p, end)
    key = np.where(x >= 0, span(np.maximum(low[x], 0), np.minimum(high[x], len(h))), whole)
    inner = np.where(x >= 0, np.maximum(low[x], 0) - p, -1)
    return key, mix(whole + inner.astype(np.uint64) * np.uint64(BASE_INV)), p, n


def _segment_rows(batches):
    for batch in batches:
        ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for f, count, data, offs in text_views(batch.column(2)):
            _, _, h, first = words(data, offs)
            x, k, p, n = segments(h, first)
            doc = np.searchsorted(first, p, side="right") - 1
            yield pa.RecordBatch.from_pydict(
                {
                    "x": pa.array(x.view(np.int64)), "k": pa.array(k.view(np.int64)), "doc_id": pa.array(ids[f + doc]), "row": pa.array(keys[f + doc]),
                    "p": pa.array((p - first[doc]).astype(np.int32)), "n": pa.array(n.astype(np.int32)),
                }
            )


def _window_rows(batches):
    """Hashes of the windows of the ranges (p, n) of each row."""
    for batch in batches:
        ids, keys, ranges = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        for f, count, data, offs in text_views(batch.column(2)):
            _, _, h, first = words(data, offs)
            span, span_too = _spans(h), _spans(h, _AGAIN)
            docs, starts = [], []
            for i in range(count):
                for p, n in _unpacked(ranges[f + i].as_py()):
                    starts.append(np.arange(p, p + n))
                    docs.append(np.full(n, i))
            if not docs:
                continue
            d, p = np.concatenate(docs), np.concatenate(starts)
            a = first[d] + p
            w, w_too = (f(a, a + WINDOW).view(np.int64) for f in (span, span_too))
            yield pa.RecordBatch.from_pydict(
                {"w": pa.array(w), "w_too": pa.array(w_too), "doc_id": pa.array(ids[f + d]), "row": pa.array(keys[f + d]), "p": pa.array(p.astype(np.int32))}
            )


def _packed():
    """A range (p, n) as one number; lists of numbers are a quarter of lists of structs."""
    return F.shiftleft(F.col("p").cast("bigint"), 32) + F.col("n")


def _unpacked(ranges: list[int] | None):
    return [(r >> 32, r & 0xFFFFFFFF) for r in ranges or ()]


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``doc_id, row, ranges``: for each text with repeats the windows that start in a smaller doc_id, as packed ``(first word, count)``.

    ``row`` is a hash of doc_id and text and tells rows of one id apart.
    """
    base = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    segs = materialize(map_arrow(base, _segment_rows, "x bigint, k bigint, doc_id bigint, row bigint, p int, n int"), "segments")
    by_symbol = segs.groupBy("x").agg(F.min("doc_id").alias("x0"), F.max("doc_id").alias("x1")).where("x0 < x1")
    # the joined tables are written first: a join of stored tables can be split at a hot key
    live = materialize(segs.join(materialize(by_symbol.select("x"), "symbols"), "x"), "live")
    contents = materialize(live.groupBy("x", "k").agg(F.min("doc_id").alias("least")), "contents")
    judged = materialize(live.join(contents, ["x", "k"]).select("x", "doc_id", "row", "p", "n", "least"), "judged")
    whole = judged.where("doc_id > least").select("doc_id", "row", "p", "n")
    # symbols with several contents: all segments of each content's least document are compared window by window
    several = contents.groupBy("x").agg(F.count("*").alias("c")).where("c > 1").select("x")
    firsts = judged.where("doc_id = least").join(materialize(several, "several"), "x")
    asked = materialize(firsts.groupBy("doc_id", "row").agg(F.collect_set(_packed()).alias("ranges")), "asked")
    texts = base.join(asked, ["doc_id", "row"]).select("doc_id", "row", "text", "ranges")
    windows = materialize(map_arrow(texts, _window_rows, "w bigint, w_too bigint, doc_id bigint, row bigint, p int"), "windows")
    least = windows.groupBy("w", "w_too").agg(F.min("doc_id").alias("w0"), F.max("doc_id").alias("w1")).where("w0 < w1").select("w", "w_too", "w0")
    single = windows.join(materialize(least, "least"), ["w", "w_too"]).where("doc_id > w0").select("doc_id", "row", "p", F.lit(1).alias("n"))
    return whole.union(single).groupBy("doc_id", "row").agg(F.collect_set(_packed()).alias("ranges"))


def _covered(n_words: int, ranges) -> np.ndarray:
    mark = np.zeros(n_words + 1, np.int64)
    for p, n in _unpacked(ranges):
        mark[p] += 1
        mark[min(n_words, p + n - 1 + WINDOW)] -= 1
    return np.cumsum(mark[:-1]) > 0


def _finish(names: list[str], texts: str = ""):
    """texts: the column that gets the remaining text of each row; without, the digest columns are made."""

    def run(batches):
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            bodies, ranges = column["_text"], column["_ranges"]
            kept, n_words, n_removed = [], [], []
            for body, ran in zip(bodies, ranges, strict=True):
                text, ran = body.as_py(), ran.as_py()
                raw = (text or "").encode()
                if texts and not ran:
                    kept.append(text)
                    n_words.append(0)
                    n_removed.append(0)
                    continue
                parts = raw.split()
                n_words.append(len(parts))
                if ran:
                    gone = _covered(len(parts), ran)
                    n_removed.append(int(gone.sum()))
                    if texts:
                        data = np.frombuffer(raw, np.uint8)
                        start, end, _, _ = words(data, np.array([0, len(raw)]))
                        # from the first removed word to the next kept one
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                        pieces, at = [], 0
                        for a, b in zip(edge[::2], edge[1::2], strict=True):
                            pieces.append(raw[at : start[a]])
                            at = int(start[b]) if b < len(start) else len(raw)
                        kept.append(b"".join([*pieces, raw[at:]]).decode())
                        continue
                    parts = [w for w, g in zip(parts, gone, strict=True) if not g]
                else:
                    n_removed.append(0)
                kept.append(hashlib.sha256(b" ".join(parts)).hexdigest())
            if texts:
                new = {c: column[c] for c in names} | {texts: pa.array(kept, pa.string()), "_removed": pa.array(n_removed, pa.int64())}
                yield pa.RecordBatch.from_pydict(new)
            else:
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": column["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(kept, pa.string())}
                )

    return run


def _with_ranges(docs: DataFrame, columns: list) -> DataFrame:
    """``columns`` of every row, its text and the ranges of its repeated windows (null: none)."""
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    base = docs.select(*columns, text.alias("_text"), doc_id.alias("_id"), F.xxhash64(doc_id, text).alias("_row"))
    with scratch(docs.sparkSession):
        found = repeated_ranges(docs.select(doc_id.alias("doc_id"), text.alias("text")))
        found = materialize(found.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("ranges").alias("_ranges")), "ranges", outer=True)
    return base.join(found, ["_id", "_row"], "left").drop("_id", "_row")


def removed_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row (see the contract of op8).

    Words are maximal runs of bytes other than space and 0x09-0x0D.  A word is
    removed if a window of WINDOW words covers it whose sequence also starts in
    a document with a smaller doc_id, all judged on the input.  A null text has
    no words; texts of fewer words than a window are kept; a row with a null
    doc_id neither removes nor loses words; rows with equal ids do not affect
    each other.  An empty table gives no row.
    """
    data = _with_ranges(docs, [F.col("doc_id").cast("bigint").alias("doc_id")])
    return map_arrow(data, _finish(["doc_id"]), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out of text (n_chars follows, if there is such a column).

    White space between kept words stays; documents without repeats stay as they
    are; a document of which no word is left goes.
    """
    data = _with_ranges(docs, numbered(docs))
    text = column_at(docs, "text")
    fields = ddl(docs.withColumn("text", F.col("text").cast("string")))
    out = map_arrow(data, _finish([f"c{i}" for i in range(len(docs.columns))], text), f"{fields}, _removed bigint")
    out = out.where((F.col("_removed") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        n = column_at(docs, "n_chars")
        out = out.withColumn(n, F.when(F.col("_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return renamed_back(out, docs)
