"""SentencePiece BPE encoding and decoding by suffix-array matching.

The distinct chunks of a batch (a run of spaces with the word after it; no
piece spans more) are concatenated and indexed by a suffix array.  Every piece
is binary-searched for its range of occurrences; the occurrences are edges
(start, piece), sorted by their end and relaxed position by position.

The relaxation is exact for BPE: of the edges that end at a position, the last
token of the BPE encoding of that prefix is the one whose piece may follow the
last token at the edge's start.  Two pieces may follow each other if merging
their concatenation gives them back, which is read off the merges that made
them (see ``Vocabulary.may_follow``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

from .textscan import BASE, BASE_INV, BYTE, mix, powers, text_views

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of new chunks matched at once, and chunks remembered by a Python worker.
BLOCK, REMEMBER = 150_000, 300_000
SPACE = "▁"
WIDEST = 16


class Vocabulary:
    """Pieces by rank: single characters first, then merges in the order in which BPE applies them."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: list[int]):
        skip = set(byte_ids) | set(special)
        plain = [i for i in range(len(pieces)) if i not in skip and pieces[i] and len(pieces[i]) <= WIDEST]
        plain.sort(key=lambda i: (len(pieces[i]) > 1, -scores[i] if len(pieces[i]) > 1 else 0.0, i))
        number = {pieces[i]: r for r, i in enumerate(plain)}
        parts: dict[int, tuple[int, int]] = {}
        pairs: dict[tuple[int, int], int] = {}
        kept = []
        for r, i in enumerate(plain):
            p = pieces[i]
            for cut in range(1, len(p)):
                left, right = number.get(p[:cut]), number.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = r
        for r, i in enumerate(plain):
            p = pieces[i]
            if len(p) == 1:
                parts[r] = (r, r)
                kept.append(r)
                continue
            symbols = [number.get(c, -1) for c in p]
            while len(symbols) > 1:
                found = [(pairs.get((a, b), 1 << 30), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
                best, at = min(found)
                if best == 1 << 30:
                    break
                last = (symbols[at], symbols[at + 1])
                symbols[at : at + 2] = [best]
            if symbols == [r]:  # others cannot come out of BPE
                parts[r] = last
                kept.append(r)
        n = self.size = len(plain)
        self.ids = np.array(plain, np.int32)
        self.left = np.array([parts.get(r, (r, r))[0] for r in range(n)], np.int64)
        self.right = np.array([parts.get(r, (r, r))[1] for r in range(n)], np.int64)
        self.length = np.array([len(pieces[i]) for i in plain], np.int64)
        keys = sorted((a * n + b, r) for (a, b), r in pairs.items())
        self.pair_keys = np.array([k for k, _ in keys], np.int64)
        self.pair_to = np.array([r for _, r in keys], np.int64)
        letters = sorted({c for i in plain for c in pieces[i]})
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        kind = {c: k + 1 for k, c in enumerate(letters)}
        self.bits = max(1, len(letters).bit_length())
        if self.bits > 15:
            raise ValueError("too many letters")
        self.rows = np.array(kept, np.int64)
        self.spelled = np.zeros((len(kept), WIDEST), np.int64)
        for row, r in enumerate(kept):
            self.spelled[row, : self.length[r]] = [kind[c] for c in pieces[plain[r]]]
        self.byte_ids = np.array(byte_ids, np.int32)
        self.whole = any(SPACE in p.lstrip(SPACE) for p in number)
        # decoding: the bytes of every id
        raw = [b"" if i in special else pieces[i].replace(SPACE, " ").encode() for i in range(len(pieces))]
        for b, i in enumerate(byte_ids):
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE of two pieces' concatenation is these two; both are taken apart by their last merges until they meet no merge or an earlier one."""
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 40, np.int64)
        while len(live):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_to[at] < limit)
            out[live[bad]] = False
            go = ~bad
            a, b, live = a[go], b[go], live[go]
            ra, lb = self.right[a], self.left[b]
            first = a > b
            # take apart the one that was merged later; if it is a character, the other; if both are, done
            use_a = (first & (ra != a)) | (~first & (lb == b) & (ra != a))
            use_b = ~use_a & (lb != b)
            limit = np.where(use_a, a, b + 1)
            done = ~use_a & ~use_b
            a, b = np.where(use_a, ra, a), np.where(use_b, lb, b)
            if done.any():
                a, b, live, limit = a[~done], b[~done], live[~done], limit[~done]
        return out


def load_vocabulary(model_file: str = MODEL) -> Vocabulary:
    """Reads a BPE model on the driver; executors get it by broadcast."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    special = [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)]
    v = Vocabulary([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], byte_ids, special)
    if v.whole:
        raise ValueError("pieces with inner spaces are not supported")
    return v


def match_pieces(v: Vocabulary, kinds: np.ndarray):
    """Edges ``(start, rank)`` of all occurrences of all pieces in a sequence of letter kinds."""
    n = len(kinds)
    pad = np.concatenate([kinds, np.zeros(WIDEST + 4, np.int64)])
    four = np.zeros(n + WIDEST, np.int64)
    for j in range(4):
        four = (four << v.bits) | pad[j : j + n + WIDEST]
    uniq, rank = np.unique(four, return_inverse=True)
    head = (rank[:n] << 32) | rank[4 : n + 4]
    tail = (rank[8 : n + 8] << 32) | rank[12 : n + 12]
    suffixes = np.lexsort((tail, head))
    head, tail = head[suffixes], tail[suffixes]

    def quarter(rows, q):
        """Lower and upper rank of the q-th four letters of the pieces; shorter ends match any letters."""
        w = v.spelled[rows, 4 * q : 4 * q + 4]
        low = np.zeros(len(rows), np.int64)
        high = low.copy()
        for j in range(4):
            low = (low << v.bits) | w[:, j]
            high = (high << v.bits) | np.where(w[:, j] > 0, w[:, j], (1 << v.bits) - 1)
        return np.searchsorted(uniq, low), np.searchsorted(uniq, high, side="right")

    rows = np.arange(len(v.rows))
    size = v.length[v.rows]
    lo, hi = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    a, b = quarter(rows, 0)
    short = size <= 4
    lo[short] = np.searchsorted(head, a[short] << 32)
    hi[short] = np.searchsorted(head, b[short] << 32)
    more = np.flatnonzero(~short & (b > a))
    c, d = quarter(more, 1)
    lo[more] = np.searchsorted(head, (a[more] << 32) | c)
    hi[more] = np.searchsorted(head, (a[more] << 32) | d)
    long = more[(size[more] > 8) & (hi[more] > lo[more])]
    if len(long):
        e, f = quarter(long, 2)
        g, h = quarter(long, 3)
        twelve = size[long] <= 12
        low_key = np.where(twelve, e << 32, (e << 32) | g)
        high_key = np.where(twelve, f << 32, (e << 32) | h)
        high_key[~twelve & (f <= e)] = low_key[~twelve & (f <= e)]

        def bisect(key):
            x, y = lo[long].copy(), hi[long].copy()
            while (x < y).any():
                m = (x + y) // 2
                less = (x < y) & (tail[np.minimum(m, n - 1)] < key)
                x, y = np.where(less, m + 1, x), np.where(less | (x >= y), y, m)
            return x

        x, y = bisect(low_key), bisect(high_key)
        lo[long], hi[long] = x, np.maximum(x, y)
    count = np.maximum(hi - lo, 0)
    at = np.arange(int(count.sum())) + np.repeat(lo - (np.cumsum(count) - count), count)
    return suffixes[at], np.repeat(v.rows, count)


def encode_chunks(v: Vocabulary, points: np.ndarray, offs: np.ndarray):
    """Token ids of chunks (code points, spaces written as SPACE); ids and their offsets."""
    n, chunks = len(points), len(offs) - 1
    at = np.minimum(np.searchsorted(v.letters, points), len(v.letters) - 1)
    kinds = np.where(v.letters[at] == points, at + 1, 0).astype(np.int64)
    start, rank = match_pieces(v, kinds)
    chunk_of = np.repeat(np.arange(chunks), np.diff(offs))
    ok = start + v.length[rank] <= offs[chunk_of[start] + 1]
    start, rank = start[ok], rank[ok]
    # a character without a piece of its own is written in bytes: an edge that nothing merges with
    unknown = np.ones(n, bool)
    unknown[start[v.length[rank] == 1]] = False
    alone = np.flatnonzero(unknown)
    start, rank = np.concatenate([start, alone]), np.concatenate([rank, np.full(len(alone), v.size)])
    length = np.append(v.length, 1)
    end = start + length[rank]
    chunk = chunk_of[start]
    depth = end - offs[chunk]
    order = np.argsort(depth.astype(np.int32), kind="stable")
    start, rank, chunk, depth = start[order], rank[order], chunk[order], depth[order]
    # slot of the position before code point i of chunk c: i + c
    last = np.full(n + chunks, -1, np.int64)
    slot, goal = start + chunk, start + length[rank] + chunk
    is_first = start == offs[chunk]
    cuts = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2 if len(depth) else 1))
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        before, t = last[slot[x:y]], rank[x:y]
        good = is_first[x:y] | (before >= 0)
        test = np.flatnonzero(good & ~is_first[x:y] & (before < v.size) & (t < v.size))
        good[test] = v.may_follow(before[test], t[test])
        last[goal[x:y][good]] = t[good]
    # walk back
    ends = offs[1:] + np.arange(chunks)
    floor = offs[:-1] + np.arange(chunks)
    live = np.flatnonzero(ends > floor)
    cur = ends.copy()
    who, token, place = [], [], []
    while len(live):
        t = last[cur[live]]
        if (t < 0).any():
            raise AssertionError("a prefix has no encoding")
        cur[live] -= length[t]
        who.append(live)
        token.append(t)
        place.append(cur[live] - live)
        live = live[cur[live] > floor[live]]
    if not who:
        return np.empty(0, np.int32), np.zeros(chunks + 1, np.int64)
    who, token, place = (np.concatenate(x) for x in (who, token, place))
    order = np.lexsort((place, who))
    who, token, place = who[order], token[order], place[order]
    ids = np.append(v.ids, 0)[token]
    odd = np.flatnonzero(token == v.size)
    cp = points[place[odd]]
    ids[odd] = v.byte_ids[np.minimum(cp, 127)]
    wide = odd[cp > 127]
    if len(wide):
        raw = [chr(points[place[k]]).encode() for k in wide]
        times = np.ones(len(ids), np.int64)
        times[wide] = [len(r) for r in raw]
        first = np.cumsum(times) - times
        ids, who = np.repeat(ids, times), np.repeat(who, times)
        for k, r in zip(wide, raw, strict=True):
            ids[first[k] : first[k] + len(r)] = v.byte_ids[np.frombuffer(r, np.uint8)]
    return ids.astype(np.int32), np.searchsorted(who, np.arange(chunks + 1))


class Encoder:
    """Encodes batches of UTF-8 texts; remembers chunks between batches."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._forget()

    def _forget(self):
        self.slot: dict[int, int] = {}
        self.ids = [np.empty(0, np.int32)]
        self.total = 0
        self.at: list[np.ndarray] = []
        self.len: list[np.ndarray] = []

    def __call__(self, data: np.ndarray, offs: np.ndarray):
        """Ids of the texts and their offsets."""
        data, offs = self._spaced(data, offs)
        n = len(data)
        if not n:
            return np.empty(0, np.int32), np.zeros(len(offs), np.int64)
        space = data == 32
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[offs[:-1][offs[:-1] < n]] |= True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * powers(BASE, n), out=run[1:])
        h = mix((run[ends] - run[starts]) * powers(BASE_INV, n)[starts] + (ends - starts).astype(np.uint64))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.slot) + len(u) > REMEMBER:
            self._forget()
        get = self.slot.get
        slots = np.array([get(x, -1) for x in u.tolist()], np.int64)
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            slots[fresh] = np.arange(len(self.slot), len(self.slot) + len(fresh))
            self._learn(data, starts[first[fresh]], ends[first[fresh]])
            self.slot.update(zip(u[fresh].tolist(), slots[fresh].tolist(), strict=True))
        self.at, self.len, self.ids = ([np.concatenate(x)] if len(x) > 1 else x for x in (self.at, self.len, self.ids))
        s = slots[back]
        count = self.len[0][s]
        stop = np.cumsum(count)
        where = np.arange(int(stop[-1])) + np.repeat(self.at[0][s] - (stop - count), count)
        text_at = np.searchsorted(starts, offs)
        return self.ids[0][where], np.concatenate([[0], stop])[text_at]

    @staticmethod
    def _spaced(data: np.ndarray, offs: np.ndarray):
        """Puts a space before every text that is not empty and turns the space symbol into a space."""
        raw = data.tobytes()
        if SPACE.encode() in raw:
            parts = [raw[a:b].replace(SPACE.encode(), b" ") for a, b in zip(offs[:-1], offs[1:], strict=True)]
            raw = b"".join(parts)
            offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            data = np.frombuffer(raw, np.uint8)
        some = np.diff(offs) > 0
        before = np.concatenate([[0], np.cumsum(some)])
        out = np.full(len(data) + int(before[-1]), 32, np.uint8)
        out[np.arange(len(data)) + np.repeat(before[1:], np.diff(offs))] = data
        return out, offs + before

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts
        block = np.cumsum(size) // BLOCK
        for k in np.unique(block):
            sel = block == k
            a, m = starts[sel], size[sel]
            where = np.arange(int(m.sum())) + np.repeat(a - (np.cumsum(m) - m), m)
            raw = data[where]
            points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
            points[points == 32] = ord(SPACE)
            lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            offs = lead[np.concatenate([[0], np.cumsum(m)])]
            ids, at = encode_chunks(self.v, points, offs)
            self.at.append(at[:-1] + self.total)
            self.len.append(np.diff(at))
            self.ids.append(ids)
            self.total += len(ids)


def decode_ids(v: Vocabulary, ids: np.ndarray, offs: np.ndarray):
    """UTF-8 bytes of the texts of these ids, and their offsets; the space put before a text is dropped."""
    size = v.raw_at[ids + 1] - v.raw_at[ids]
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    where = np.arange(total) + np.repeat(v.raw_at[ids] - (stop - size), size)
    out = v.raw[where]
    at = np.concatenate([[0], stop])[offs]
    some = (np.diff(at) > 0) & (out[np.minimum(at[:-1], max(0, total - 1))] == 32 if total else False)
    keep = np.ones(total, bool)
    keep[at[:-1][some]] = False
    return out[keep], at - np.concatenate([[0], np.cumsum(some)])


_ENCODERS: dict[int, Encoder] = {}


def _encode(held):
    def run(batches):
        enc = _ENCODERS.get(held.id if hasattr(held, "id") else id(held))
        if enc is None:
            _ENCODERS.clear()
            enc = _ENCODERS[getattr(held, "id", id(held))] = Encoder(held.value)
        for batch in batches:
            names = batch.schema.names[:-1]
            for first, count, data, offs in text_views(batch.column(len(names)), 1 << 20):
                ids, at = enc(data, offs)
                back, back_at = decode_ids(enc.v, ids, at)
                raw, now = back.tobytes(), data.tobytes()
                digests, same = [], []
                for a, b, c, d in zip(back_at[:-1], back_at[1:], offs[:-1], offs[1:], strict=True):
                    digests.append(hashlib.sha256(raw[a:b]).hexdigest())
                    same.append(raw[a:b] == now[c:d])
                cols = {c: batch.column(i).slice(first, count) for i, c in enumerate(names)}
                yield pa.RecordBatch.from_pydict(
                    cols
                    | {
                        "n_tokens": pa.array(np.diff(at)),
                        "token_ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
                        "decoded_sha256": pa.array(digests),
                        "round_trip": pa.array(same, pa.bool_()),
                    }
                )

    return run


def encode_documents(docs: DataFrame, model_file: str = MODEL, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``doc_id, n_tokens, token_ids, decoded_sha256, round_trip`` for every row.

    token_ids are those of the SentencePiece BPE model (a space is put before
    the text; characters without a piece become bytes).  decoded_sha256 is the
    digest of the decoded text, round_trip whether that is the text itself:
    always, unless it holds U+2581, which SentencePiece reads as a space.  A
    null or empty text has no tokens.  ``carry``: columns to keep.
    """
    held = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    rows = docs.select(*carry, F.col("text").cast("string").alias("_text"))
    fields = ", ".join(f"`{c}` {kind[c]}" for c in carry)
    return map_arrow(rows, _encode(held), f"{fields}, n_tokens bigint, token_ids array<int>, decoded_sha256 string, round_trip boolean")


def _decode(held):
    def run(batches):
        v = held.value
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            raw, at = decode_ids(v, flat, np.concatenate([[0], np.cumsum(sizes)]))
            raw = raw.tobytes()
            texts = [raw[a:b].decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({batch.schema.names[0]: batch.column(0), "text": pa.array(texts, pa.string())})

    return run


def decode_documents(rows: DataFrame, model_file: str = MODEL, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, text`` of ``rows(doc_id, token_ids)``."""
    held = rows.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return map_arrow(rows.select(id_col, F.col("token_ids").cast("array<int>")), _decode(held), f"`{id_col}` {kind[id_col]}, text string")
