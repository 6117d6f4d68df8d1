"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts up to ORDER bytes is counted on
labelled text.  With frozen counts the code length of a byte after its longest
known context is exact: -log2 of its probability there, or the escape's cost
plus the code length in the context one byte shorter (method C: a context with
n bytes of d kinds escapes with d / (n + d)); after the empty context a byte
costs 8 bits.  A text's language is the one under which its bytes cost least.

All trees are folded into one automaton: a state for each context known to any
language, and for each state, byte and language the code length.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ddl, map_arrow, materialize, numbered, renamed_back, scratch
from .textscan import text_views

#: Longest context, in bytes.
ORDER = 3
#: Labelled texts expected in the training sample of each language (all, if there are fewer).
SAMPLE = 1500
#: Contexts kept: those with the largest share of their language's bytes, in whichever language that is.
CONTEXTS = 8192
#: Bytes of the model's table (contexts x bytes x languages x 4): with very many languages fewer contexts are kept.
TABLE_BYTES = 256 << 20
UNKNOWN = "und"


class Model:
    """States, classes of bytes and code lengths; ``cost[state, byte class, language]`` in bits."""

    def __init__(self, langs: list[str], counts: dict[str, dict[bytes, dict[int, int]]], order: int = ORDER):
        """counts: of each language, for each context the number of times each byte follows."""
        self.langs, self.order = langs, order
        keep, used = {b""}, set()
        for trees in counts.values():
            for ctx, nxt in trees.items():
                keep.update(ctx[k:] for k in range(len(ctx) + 1))
                used.update(nxt)
        # bytes seen in training get classes 1.., others share class 0
        self.byte_class = np.zeros(256, np.int64)
        for i, b in enumerate(sorted(used)):
            self.byte_class[b] = i + 1
        k = self.classes = len(used) + 1
        states = sorted(keep, key=lambda c: (len(c), c))
        number = {c: i for i, c in enumerate(states)}
        cost = np.zeros((len(states), k, len(langs)), np.float32)
        for j, lang in enumerate(langs):
            trees = counts[lang]
            for i, ctx in enumerate(states):
                base = np.full(k, 8.0) if not ctx else cost[number[ctx[1:]], :, j].astype(float)
                nxt = trees.get(ctx)
                if nxt:
                    n, d = sum(nxt.values()), len(nxt)
                    base = base - np.log2(d / (n + d))
                    for b, c in nxt.items():
                        base[self.byte_class[b]] = -np.log2(c / (n + d))
                cost[i, :, j] = base
        self.cost = np.ascontiguousarray(cost.reshape(len(states) * k, len(langs)).T)
        # for each length the state of the context of these classes; 0: unknown
        self.maps = []
        for length in range(1, order + 1):
            m = np.zeros(k**length, np.int32)
            for ctx in states:
                if len(ctx) == length:
                    at = 0
                    for b in ctx:
                        at = at * k + int(self.byte_class[b])
                    m[at] = number[ctx]
            self.maps.append(m)

    def bits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code lengths in bits, text by language, of the texts in one buffer; contexts do not cross texts."""
        c = self.byte_class[data]
        n = len(c)
        room = np.minimum(np.arange(n) - np.repeat(offs[:-1], np.diff(offs)), self.order)  # bytes before, in the text
        state = np.zeros(n, np.int64)
        key = np.zeros(n, np.int64)
        scale = 1
        for length, m in enumerate(self.maps, 1):
            if n <= length:
                break
            key[length:] += c[:-length] * scale
            scale *= self.classes
            s = m[key[length:]]
            ok = (s > 0) & (room[length:] >= length)
            state[length:][ok] = s[ok]
        at = state * self.classes + c
        out = np.empty((len(offs) - 1, len(self.langs)))
        for j in range(len(self.langs)):
            run = np.concatenate([[0.0], np.cumsum(self.cost[j][at], dtype=np.float64)])
            out[:, j] = run[offs[1:]] - run[offs[:-1]]
        return out


def _count(batches):
    """Partial counts of (lang, context, byte) of a partition."""
    have: dict[str, list] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, count, data, offs in text_views(batch.column(1), 1 << 20):
            for lang in set(langs[first : first + count]):
                rows = [i for i in range(count) if langs[first + i] == lang]
                for order in range(ORDER + 1):
                    keys = []
                    for i in rows:
                        d = data[offs[i] : offs[i + 1]].astype(np.uint32)
                        if len(d) > order:
                            key = d[order:].copy()
                            for back in range(1, order + 1):
                                key |= d[order - back : len(d) - back] << np.uint32(8 * back)
                            keys.append(key)
                    if keys:
                        u, n = np.unique(np.concatenate(keys), return_counts=True)
                        have.setdefault(f"{order}{lang}", []).append((u, n))
    for name, parts in have.items():
        u, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(inv, np.concatenate([p[1] for p in parts]).astype(float)).astype(np.int64)
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array([name[1:]] * len(u)), "ord": pa.array(np.full(len(u), int(name[0]), np.int32)), "gram": pa.array(u.astype(np.int64)), "n": pa.array(n)}
        )


def kept_contexts(languages: int, contexts: int = CONTEXTS) -> int:
    """How many contexts may be kept so that the table stays within TABLE_BYTES."""
    return max(1, min(contexts, TABLE_BYTES // (256 * 4 * max(1, languages))))


def train(rows: DataFrame, sample: int = SAMPLE, contexts: int = CONTEXTS) -> Model:
    """A model of ``rows(doc_id, text, lang)``; rows without text or lang are not used.

    A bounded sample is learnt from: of each language the rows whose hash of id
    and text lies below ``sample / different pairs of id and text`` (told to
    2 %), and those of the least hash (whole texts, equal ones once).  So
    repeated rows do not thin the sample out, and every value of lang that has a
    text is learnt.  Counts are summed and contexts
    chosen in Spark; what reaches the driver is bounded by the contexts kept.
    """
    rows = rows.where("text is not null and lang is not null").select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit("train")), F.lit(1_000_003))
    mark = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(mark, 0.02).alias("many"), F.min(drawn).alias("least")).collect()
    if not sizes:
        return Model([], {})
    spark = rows.sparkSession
    share = spark.createDataFrame([(r[0], max(float(r[2] + 1), 1_000_003.0 * sample / max(1, r[1]))) for r in sizes], "lang string, share double")
    picked = rows.join(F.broadcast(share), "lang").where(drawn < F.col("share")).select("lang", "text").distinct()  # one row for each lang
    grams = map_arrow(picked, _count, "lang string, ord int, gram bigint, n bigint").groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n"))
    with scratch(spark):
        grams = materialize(grams.withColumn("ctx", F.expr("gram >> 8")), "grams")
        # a context's share is no larger than that of its end: what is kept holds the ends of all
        whole = grams.where("ord = 0").groupBy("lang").agg(F.sum("n").alias("bytes"))
        part = grams.groupBy("lang", "ord", "ctx").agg(F.sum("n").alias("n")).join(F.broadcast(whole), "lang")
        best = part.groupBy("ord", "ctx").agg(F.max(F.col("n") / F.col("bytes")).alias("share"))
        keep = best.where("ord > 0").orderBy(F.desc("share"), "ord", "ctx").limit(kept_contexts(len(sizes), contexts)).select("ord", "ctx")
        root = spark.createDataFrame([(0, 0)], "ord int, ctx bigint")
        got = grams.join(materialize(keep.union(root), "contexts"), ["ord", "ctx"]).select("lang", "ord", "gram", "n").toArrow()
    counts: dict[str, dict[bytes, dict[int, int]]] = {r[0]: defaultdict(dict) for r in sizes}
    for batch in got.to_batches():
        for lang, order, gram, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = gram.to_bytes(4, "big")[3 - order :]
            counts[lang][raw[:-1]][raw[-1]] = n
    return Model(sorted(lang for lang in counts if counts[lang]), counts)


def _letters(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.match_substring_regex(pc.fill_null(texts, ""), r"\pL").to_numpy(zero_copy_only=False)


def _predictor(model: Broadcast, names: list[str]):
    def run(batches):
        m: Model = model.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text"))
            n = len(texts)
            pred, score, rate = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
            ok = _letters(texts)
            if m.langs:
                for first, count, data, offs in text_views(texts, 1 << 19):
                    bits = m.bits(data, offs)
                    size = np.diff(offs)
                    best = bits.argmin(1)
                    least = bits.min(1)
                    post = 1.0 / np.exp2(-np.clip(bits - least[:, None], 0, 1000)).sum(1)
                    for i in np.flatnonzero(ok[first : first + count]):
                        pred[first + i] = m.langs[best[i]]
                        score[first + i] = post[i]
                        rate[first + i] = least[i] / max(1, size[i])
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            yield pa.RecordBatch.from_pydict(cols | {"_pred": pa.array(pred), "_score": pa.array(score), "_bits": pa.array(rate)})

    return run


def predict(docs: DataFrame, model: Model, added: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """Adds language, score and bits per byte under the names ``added``: whole texts, no shuffle.

    score is the posterior of the predicted language (equal priors);
    ``und`` with score 0 for a null text, one without a letter, or a model
    without languages.  Ties go to the first language by name.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    data = docs.select(*numbered(docs), F.col("text").cast("string").alias("_text"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    out = map_arrow(data, _predictor(held, names), f"{ddl(docs)}, _pred string, _score double, _bits double")
    return renamed_back(out, docs, *(F.col(c).alias(n) for c, n in zip(("_pred", "_score", "_bits"), added, strict=True)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits_per_byte``; learns from the rows that are not held out.

    A null doc_id is not held out.  Texts are judged by their bytes only.  Null
    or repeated ids do not matter to the training sample, which is drawn by id
    and text; a text that many rows share is learnt from once a language.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))), sample)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(rows, model).drop("text")
