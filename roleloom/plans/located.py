"""Queries on places of sentences in texts, on paths between nodes and on streams into tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import containment, divergence, graph, spans
from ..sources import views
from ..sources.views import table
from ..streaming import frames as streams
from .registry import _ID, CA, _identities, q

#: Characters of a chunk, and how far the next one starts behind it.
SIZE, STEP = 400, 300


@q(
    "str11_merged_chunks",
    f"""with c as (select doc_id, unnest(range(0, length(text), {STEP})) "at", text from documents where length(text) > 0),
 k as (select doc_id, "at", substring(text, "at" + 1, {SIZE}) text from c),
 p as (select *, list_filter(string_split(regexp_replace(text, '([.!?]\\s+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') s from k),
 u as (select doc_id, "at", text, s, unnest(s) sentence, unnest(range(1, len(s) + 1)) pos from p),
 n as (select *, len(list_filter(s[1:pos], lambda x: x = sentence)) nth from u),
 w as (select doc_id, "at", "at" + list_sum(list_transform(string_split(text, sentence)[1:nth], lambda x: length(x))) + (nth - 1) * length(sentence) start, length(sentence) n, sentence from n),
 m as (select doc_id, start, start + n stop, sentence, max(start + n) over (partition by doc_id order by start, n desc, "at" rows between unbounded preceding and 1 preceding) before from w)
select doc_id, start::bigint as start, stop::bigint stop, sentence from m where before is null or stop > before""",
)
def _(s, d):
    docs = table(s, d, "documents").where("length(text) > 0")
    c = docs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.length("text") - 1, F.lit(STEP)), lambda at: F.struct(at.alias("at"), F.substring(F.col("text"), at + 1, F.lit(SIZE)).alias("text")))).alias("c")).select("doc_id", "c.*")
    return spans.merged_chunks(c.withColumn("sentences", text.sentences(F.col("text"))))


@q(
    "str15_alignment",
    """with sp as (select doc_id, coalesce(text, '') text, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?]\\s+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') s from documents),
 u as (select doc_id, text, unnest(s) x from sp), h as (select doc_id, position(x in text) - 1 a, position(x in text) - 1 + length(x) b from u),
 g as (select doc_id, a, b, max(b) over (partition by doc_id order by a, b rows between unbounded preceding and 1 preceding) before from h),
 c as (select doc_id, count(*) n_placed, sum(greatest(b - greatest(a, coalesce(before, a)), 0))::bigint n_covered from g group by 1),
 t as (select doc_id, len(s)::bigint n_sentences, coalesce(n_placed, 0) n_placed, coalesce(n_covered, 0) n_covered, case when text = '' then 0 else coalesce(n_covered, 0)::double / length(text) end coverage, abs(length(text) - coalesce(list_sum(list_transform(s, lambda x: length(x))), 0))::bigint length_diff from sp left join c using (doc_id))
select *, coverage > 0.95 and length_diff < 10 aligned from t""",
)
def _(s, d):
    return spans.alignment(table(s, d, "documents").withColumn("sentences", text.sentences(F.col("text"))))


@q(
    "str15_benchmark_cover",
    """with h as (select doc_id, position(b.text in d.text) - 1 x, position(b.text in d.text) - 1 + length(b.text) y from benchmark b join documents d on contains(d.text, b.text) where length(b.text) > 0),
 g as (select *, max(y) over (partition by doc_id order by x, y rows between unbounded preceding and 1 preceding) before from h)
select doc_id, sum(greatest(y - greatest(x, coalesce(before, x)), 0))::bigint n_covered from g group by 1""",
)
def _(s, d):
    b = table(s, d, "benchmark").where("length(text) > 0")
    found = containment.occurrences(table(s, d, "documents"), b).join(b.select("item_id", F.length("text").alias("n")), "item_id")
    return spans.covered(found.select("doc_id", (F.col("place") - 1).alias("start"), (F.col("place") - 1 + F.col("n")).alias("stop")))


@q("jn13_causal_neighbours", f"with {CA}, s as (select kriya question, frame_id node from e where value > 20) select * from s union select question, dst from s join ca on node = src union select question, src from s join ca on node = dst")
def _(s, d):
    e = views.event_frames(s, d)
    return graph.expanded(views.adjacent(e), e.where("value > 20").select(F.col("kriya").alias("question"), F.col("frame_id").alias("node")))


@q(
    "pip32_path_divergence",
    f"""with recursive {_ID}, pr as (select src pair, src, max(dst) dst from i group by src), f as (select pair, src node from pr union select f.pair, i.dst from f join i on f.node = i.src),
 b as (select pair, dst node from pr union select b.pair, i.src from b join i on b.node = i.dst),
 e as (select pair, i.* from i join f on f.node = i.src join b using (pair) where b.node = i.dst),
 c as (select pair, count(*) n_identities, count(*) filter ((dst - src <= 10) <> (dst - src <= 20)) n_differing from e group by 1)
select pair, coalesce(n_identities, 0) n_identities, coalesce(n_differing, 0) n_differing, case when n_differing > 0 then 'DIVERGENCE' else 'CONVERGENCE' end verdict from pr left join c using (pair)""",
)
def _(s, d):
    i = _identities(s, d).distinct()
    gap = F.col("dst") - F.col("src")
    edges = i.select("src", "dst", F.lit(True).alias("identity"), (gap <= 10).alias("one"), (gap <= 20).alias("two"))
    return divergence.divergences(edges, i.groupBy(F.col("src").alias("pair")).agg(F.max("dst").alias("dst")).withColumn("src", F.col("pair")))


@q(
    "stm05_quarantined",
    "select conv_id, turn, problem, case when problem is null then 'accepted' else 'quarantine' end kind from (select *, case when trim(coalesce(text, '')) = '' then 'EMPTY' when role is null or role not in ('user', 'assistant') then 'UNKNOWN_ROLE' end problem from conversations)",
)
def _(s, d):
    problem = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "EMPTY").when(F.col("role").isNull() | ~F.col("role").isin("user", "assistant"), "UNKNOWN_ROLE")
    return streams.run_once(streams.stream_table(s, d, "conversations"), "append", problem=problem).select("conv_id", "turn", "problem", "kind")


@q(
    "stm06_stable_documents",
    """with x as (select user_id doc_id, event_id % 10 chunk, ts "at" from events), f as (select doc_id, chunk, min("at") f from x where chunk < 9 group by all),
 r as (select doc_id, max(f) ready from f group by 1 having count(*) = 9), g as (select doc_id, "at", lead("at") over (partition by doc_id order by "at") nxt from x),
 l as (select doc_id, min("at") last_at from g join r using (doc_id) where "at" >= ready and case when nxt is null then (select max("at") from x) > "at" + interval 12 hour else nxt >= "at" + interval 12 hour end group by 1)
select doc_id, count(distinct chunk) n_seen, 10::bigint n_chunks, last_at from l join x using (doc_id) where "at" <= last_at group by doc_id, last_at""",
)
def _(s, d):
    e = streams.stream_table(s, d, "events")
    chunks = e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 10).alias("chunk"), F.lit(10).alias("n_chunks"), F.col("ts").alias("at"))
    return streams.run_once(streams.stable_documents(chunks, quiet="12 hours"), "append")
