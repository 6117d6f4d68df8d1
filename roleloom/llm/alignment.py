"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes, A and B.  The transducer reads a token of the
side that lags; its state is the side that leads and the bytes of its last token
that the other side has not matched yet (its dangling suffix; empty: both end
here, and A is read next).  A transition depends on the state and the token
only, so transitions are memoised.  A group of tokens closes whenever the
suffix is empty.  Every token read into a non-empty suffix overlaps the leader's
last token: that is a link, and those are all pairs of tokens that share bytes.

How often a pair of ids is linked in the corpus is summed up in Spark.  The
counts are then looked up in blocks of bounded size, one broadcast after the
other, each over the stored links of the documents.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, release, scratch

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Transitions remembered by a Python worker; beyond, it starts over.
REMEMBER = 1 << 21
#: Characters encoded together.
TOGETHER = 1 << 19
#: Pairs of ids whose counts are expected in a broadcast (24 bytes each).
PAIRS = 1 << 21


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others counted up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Fixed value: the pattern of words of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Ids and token bytes of a byte-level BPE vocabulary file; special tokens' strings are plain text.

    A file of the plain form (words by PATTERN, no normalizer, ids in the order
    of the merges) is read as ranks, which the tiktoken library applies several
    times faster with the same ids; others are left to the tokenizers library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        table = dict(told["model"]["vocab"]) | {t["content"]: t["id"] for t in told.get("added_tokens") or ()}
        self.raw: list[bytes] = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            self.raw[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        ranks = _ranks(told, letters)
        if ranks is None:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import tiktoken

            encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [encoding.encode_ordinary(t) for t in texts]


def _ranks(told: dict, letters: dict[str, int]) -> dict[bytes, int] | None:
    """The ranks of a vocabulary file of the plain form, else None."""
    model, words = told["model"], told.get("pre_tokenizer") or {}
    odd = told.get("normalizer") or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if odd or model.get("type", "BPE") != "BPE" or words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex", True):
        return None
    merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
    vocab = model["vocab"]
    if any(vocab.get("".join(m)) != 256 + k for k, m in enumerate(merges)) or any(vocab.get(c, 256) > 255 for c in letters) or len(vocab) != 256 + len(merges):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocab.items()}


class PieceBpe:
    """Ids and token bytes of a piece model; it puts a space in front of the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = m = SentencePieceProcessor(model_file=path)
        self.raw = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class Transducer:
    """Aligns token sequences of equal bytes.

    States are numbered: 0 is the empty suffix, others (side, suffix).  The two
    sides' ids share one number space for the memo: B's come after A's.
    """

    def __init__(self, raw_a: list[bytes], raw_b: list[bytes]):
        self.raw = (*raw_a, *raw_b)
        self.shift, self.width = len(raw_a), len(raw_a) + len(raw_b)
        self._forget()

    def _forget(self) -> None:
        self.names: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.memo: dict[int, int] = {}
        self.both: dict[int, int] = {}

    def _step(self, state: int, token: int) -> int:
        """The state after ``token`` (of the side that lags) is read in ``state``: twice its number, plus 1 if A leads in it; -1 if bytes differ or it has none."""
        side, suffix = self.states[state]
        raw = self.raw[token]
        if not raw:
            return -1
        if not suffix:
            new = (0, raw)
        elif len(raw) <= len(suffix):
            if not suffix.startswith(raw):
                return -1
            new = (side, suffix[len(raw) :])
        else:
            if not raw.startswith(suffix):
                return -1
            new = (1 - side, raw[len(suffix) :])
        if not new[1]:
            new = (0, b"")
        number = self.names.get(new)
        if number is None:
            number = self.names[new] = len(self.states)
            self.states.append(new)
        out = self.memo[state * self.width + token] = 2 * number + (new[0] == 0 and number > 0)
        return out

    def align(self, a: list[int], b: list[int]):
        """Ends of the groups in ``a`` and in ``b``, and the links as numbers ``b id * A's size + a id``; None if the bytes differ."""
        if len(self.memo) + len(self.both) > REMEMBER:
            self._forget()
        memo, both, width, shift, step = self.memo, self.both, self.width, self.shift, self._step
        ends_a, ends_b, links = [], [], []
        i = j = state = 0
        na, nb = len(a), len(b)
        a_leads = True
        while True:
            if not state:  # the next token of A and then that of B: two transitions, remembered as one
                if i == na or j == nb:
                    return (ends_a, ends_b, links) if i == na and j == nb else None
                lead = b[j] * shift + a[i]
                links.append(lead)
                new = both.get(lead)
                if new is None:
                    new = both[lead] = self._two(a[i], b[j])
                    if new < 0:
                        return None
                a_leads = new & 1
                lead = a[i] if a_leads else b[j]
                i += 1
                j += 1
            elif a_leads:
                if j == nb:
                    return None
                token = b[j]
                j += 1
                links.append(token * shift + lead)
                key = state * width + shift + token
                new = memo.get(key)
                if new is None:
                    new = step(state, shift + token)
                if not new & 1:  # the token that was read sticks out and leads now
                    lead = token
                    a_leads = 0
            else:
                if i == na:
                    return None
                token = a[i]
                i += 1
                links.append(lead * shift + token)
                key = state * width + token
                new = memo.get(key)
                if new is None:
                    new = step(state, token)
                if new & 1:
                    lead = token
                    a_leads = 1
            if new < 2:
                if new < 0:
                    return None
                ends_a.append(i)
                ends_b.append(j)
                state = 0
            else:
                state = new >> 1

    def _two(self, a: int, b: int) -> int:
        first = self._step(0, a)
        return self._step(first >> 1, self.shift + b) if first > 1 else -1


_HELD: dict[tuple[str, str], tuple] = {}


def _tools(path_a: str, path_b: str):
    """Both vocabularies and the transducer, once a worker."""
    if (path_a, path_b) not in _HELD:
        a, b = ByteBpe(path_a), PieceBpe(path_b)
        _HELD[path_a, path_b] = a, b, Transducer(a.raw, b.raw)
    return _HELD[path_a, path_b]


def _runs(texts: list, limit: int):
    """Texts in runs of about ``limit`` characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _aligned(texts: list, path_a: str, path_b: str):
    """For each text (a ids, b ids, group ends in a, in b, links), or None: null, empty, or not cut whole by both."""
    a, b, transducer = _tools(path_a, path_b)
    for start, end in _runs(texts, TOGETHER):
        some = [t for t in texts[start:end] if t]
        found = iter(zip(some, a.encode([" " + t for t in some]), b.encode(some), strict=True))
        for t in texts[start:end]:
            if not t:
                yield None
                continue
            t, ids_a, ids_b = next(found)
            same = b"".join(map(a.raw.__getitem__, ids_a)) == (" " + t).encode()
            got = transducer.align(ids_a, ids_b) if same else None  # B's bytes are A's, or there is no alignment
            yield None if got is None else (ids_a, ids_b, *got)


def align_tokens(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECES) -> DataFrame:
    """``doc_id, a_ids, b_ids, groups``: both token sequences of each text (with a space in front) and their groups.

    ``groups(a_end, b_end)``: where the groups end in the two sequences.  Null
    and empty texts, and those that a tokenizer does not give back byte by byte,
    have empty lists.  Rows are judged one by one; an empty table gives no row.
    """

    def run(batches):
        for batch in batches:
            rows = [x or ((),) * 5 for x in _aligned(batch.column(1).to_pylist(), path_a, path_b)]
            groups = [[{"a_end": x, "b_end": y} for x, y in zip(r[2], r[3], strict=True)] for r in rows]
            kind, ids = pa.list_(pa.struct([("a_end", pa.int32()), ("b_end", pa.int32())])), pa.list_(pa.int32())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "a_ids": pa.array([list(r[0]) for r in rows], ids), "b_ids": pa.array([list(r[1]) for r in rows], ids), "groups": pa.array(groups, kind)})

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(base, run, "doc_id bigint, a_ids array<int>, b_ids array<int>, groups array<struct<a_end: int, b_end: int>>")


class _Spelled:
    """Text of groups: every id with each of the three signs that can follow it."""

    def __init__(self, size: int):
        self.size = size
        self.table = np.array([f"{i}{sign}" for sign in ",|;" for i in range(size)], object)

    def __call__(self, a, b, ends_a, ends_b) -> bytes:
        ea, eb = np.array(ends_a), np.array(ends_b)
        na, nb = np.diff(ea, prepend=0), np.diff(eb, prepend=0)
        flat = np.empty(len(a) + len(b), np.int64)
        flat[np.arange(len(a)) + np.repeat(eb - nb, na)] = a
        flat[np.arange(len(b)) + np.repeat(ea, nb)] = b
        flat[ea + eb - nb - 1] += self.size
        flat[ea + eb - 1] += 2 * self.size
        return "".join(self.table[flat].tolist())[:-1].encode()


_LINKS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


def document_links(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECES) -> DataFrame:
    """For each document its counts of tokens, groups and links, the groups' digest, and its distinct linked pairs with their numbers of links.

    A pair is ``b id * size of A's vocabulary + a id``.
    """

    def run(batches):
        spelled = None
        for batch in batches:
            numbers, digests, pairs, times = np.zeros((4, batch.num_rows), np.int64), [], [], []
            for i, got in enumerate(_aligned(batch.column(1).to_pylist(), path_a, path_b)):
                if got is None:
                    digests.append("")
                    pairs.append(np.empty(0, np.int64))
                    times.append(np.empty(0, np.int32))
                    continue
                a, b, ends_a, ends_b, links = got
                if spelled is None:
                    tools = _tools(path_a, path_b)
                    spelled = _Spelled(max(len(tools[0].raw), len(tools[1].raw)))
                numbers[:, i] = len(a), len(b), len(ends_a), len(links)
                digests.append(hashlib.sha256(spelled(a, b, ends_a, ends_b)).hexdigest())
                u, n = np.unique(np.array(links, np.int64), return_counts=True)
                pairs.append(u)
                times.append(n.astype(np.int32))
            offs = np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(x))) for x in (pairs, times)] if pairs else [pa.array([], pa.list_(k)) for k in (pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in numbers), pa.array(digests, pa.string()), *lists], [f.split()[0] for f in _LINKS.split(", ")])

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(base, run, _LINKS)


def pair_counts(links: DataFrame, size_a: int) -> DataFrame:
    """``pair, n, best`` of ``links(pairs, times)``: how many links hold a pair, and whether no other pair of its B id has more."""
    single = links.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").cast("bigint").alias("times"))
    counts = materialize(single.groupBy("pair").agg(F.sum("times").alias("n")), "counts").withColumn("b_id", F.expr(f"pair div {size_a}"))
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    return counts.join(most, "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(held, carry: list[str]):
    """Adds what a block of counts holds of each document's links."""

    def run(batches):
        pair, n, best = held.value
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            lists, times = column["pairs"], column["times"].flatten().to_numpy()
            flat = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(pair, flat), max(0, len(pair) - 1))
            ok = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
            total, top = column["count_sum"].to_numpy().copy(), column["n_best"].to_numpy().copy()
            np.add.at(total, row[ok], times[ok] * n[at[ok]])
            np.add.at(top, row[ok], times[ok] * best[at[ok]])
            yield pa.RecordBatch.from_arrays([*(column[c] for c in carry), pa.array(top), pa.array(total)], [*carry, "n_best", "count_sum"])

    return run


def _count_blocks(counts: DataFrame):
    """The counts in blocks of about PAIRS pairs, each with whether it is the last."""
    blocks = max(1, -(-counts.count() // PAIRS))
    for b in range(blocks):
        part = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == b).toArrow()
        pair, n, best = (part[c].to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        yield (pair[order], n[order], best[order].astype(np.int64)), b + 1 == blocks


def alignment_digests(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document (see the contract of op13).

    Null and empty texts, and texts whose bytes a tokenizer does not give back,
    have zeros and an empty digest.  Null or repeated ids do not matter: rows are
    judged one by one, and each counts in the corpus.  An empty table gives no row.
    """
    spark = docs.sparkSession
    told = [f for f in _LINKS.split(", ") if f.split()[0] not in ("pairs", "times")]
    with scratch(spark):
        links = materialize(document_links(docs, path_a, path_b), "links")
        counts = materialize(pair_counts(links, len(ByteBpe(path_a).raw)), "pair-counts")
        zero = F.lit(0).cast("bigint")
        state, before = links.withColumn("n_best", zero).withColumn("count_sum", zero), None
        for block, last in _count_blocks(counts):
            carry = told if last else _LINKS.split(", ")
            held = spark.sparkContext.broadcast(block)
            state = map_arrow(state, _looked_up(held, [f.split()[0] for f in carry]), ", ".join([*carry, "n_best bigint", "count_sum bigint"]))
            if not last:
                state = materialize(state, "looked-up")
                release(before)
                before = state
        return materialize(state.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "alignment", outer=True)
