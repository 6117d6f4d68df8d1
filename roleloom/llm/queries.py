"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .alignment import alignment_digests
from .chat import conversation_digests
from .common import read_table
from .decontaminate import contamination_digests
from .embeddings import embedding_links
from .fingerprints import edited_fingerprints
from .jaccard import jaccard_components
from .langid import identify_languages
from .mixing import mix_sources, mixing_report
from .negatives import mine_negatives
from .pieces import encode_documents
from .sharding import assign_shards
from .substrings import removed_repeats
from .urlfilter import CONTRACT_RULES, judge_urls


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), CONTRACT_RULES)


def op4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(read_table(spark, sf_dir, "embeddings"), 0.98)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_table(spark, sf_dir, "documents"), 8)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), k=3, threshold=Fraction(90, 100))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_repeats(read_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


def mixing_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sample of op9_mixing is from its targets."""
    told = mixing_report(read_table(spark, sf_dir, "documents"))
    return told.select("dim", "value", "tokens", *(F.round(c, 4).alias(c) for c in ("target", "expected")))


def conversations_with_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold control strings."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    probe = spark.sql(
        f"select cast(conv_id as bigint) conv_id, cast(turn as bigint) turn, role, text from values (-7, 0, 'user', '{text}'), (-7, 1, 'assistant', '{text}') as t(conv_id, turn, role, text)"
    )
    return rows.union(probe)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_digests(conversations_with_probe(spark, sf_dir))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.expr("case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end")
    return mine_negatives(read_table(spark, sf_dir, "embeddings"), label=moved)


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digests(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digests(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_fingerprints, op2_pieces, op3_urls, op4_languages, op5_embeddings, op6_shards, op7_jaccard, op8_substrings, op9_mixing, op10_chat, op11_negatives, op12_decontaminate, op13_alignment, mixing_residuals)
}


def _urls_sql() -> str:
    """Rules and character references are written out here, apart from the operator's."""
    host = lambda u: f"translate(regexp_extract({u}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = lambda u: f"regexp_extract({u}, '://[^/?#]*([^?#]*)', 1)"
    at = lambda h: f"('.' || {h})"  # noqa: E731  a host and its subdomains end with .host

    def rules(h: str, p: str, value: str) -> str:
        fits = [("example.com", "/en/7", "allow"), ("example.net", "/de/8", "allow"), ("com", "/en/", "block"), ("net", "/de/", "block"), ("org", "/es/", "block")]
        return "case " + " ".join(f"when {at(h)} like '%.{x}' and {p} like '{y}%' then '{v if value == 'verdict' else x + y}'" for x, y, v in fits) + " end"

    def attribute(tag: str, name: str) -> str:
        pattern = f"(?is)[\\s\"''/]{name}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))"
        out = " || ".join(f"regexp_extract({tag}, '{pattern}', {i})" for i in (1, 2, 3))
        for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0*47;|&#x0*2f;|&sol;", "/"), ("&#0*58;|&#x0*3a;|&colon;", ":"), ("&#0*38;|&#x0*26;|&amp;", "&")):
            out = f"regexp_replace({out}, '{code}', '{char}', 'gi')"
        return f"trim({out}, E' \\t\\n\\f\\r')"

    def full(base: str, t: str) -> str:
        origin, p = f"regexp_extract({base}, '(?s)^(.*?://[^/?#]*)', 1)", path(base)
        return (
            f"case when regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*://') then {t} when regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') or {t} = '' or {t}[1] = '#' or position('://' in {base}) = 0 then null "
            f"when {t}[1:2] = '//' then regexp_extract({base}, '(?s)^(.*?:)//', 1) || {t} when {t}[1] = '/' then {origin} || {t} when {t}[1] = '?' then {origin} || {p} || {t} "
            f"else {origin} || case when {p} = '' then '/' else regexp_extract({p}, '(?s)^(.*/)', 1) end || {t} end"
        )

    def walked(u: str) -> str:
        steps = f"string_split({path(u)}[2:], '/')"
        kept = f"array_to_string(list_reduce({steps}, lambda a, x: case when x = '..' then a[:-2] when x = '.' then a else list_append(a, x) end, []::varchar[]), '/')"
        clean = f"'/' || {kept} || case when {kept} <> '' and {steps}[-1] in ('.', '..') then '/' else '' end"
        return (
            f"case when list_has_any({steps}, ['.', '..']) then regexp_extract({u}, '(?s)^(.*?://[^/?#]*)', 1) || {clean} || regexp_extract({u}, '(?s)://[^/?#]*[^?#]*(.*)$', 1) else {u} end"
        )

    key = lambda u: f"case when position('://' in {u}) > 0 then {host(u)} || case when {path(u)} = '' then '/' else '' end || regexp_extract({u}, '(?s)://[^/?#]*([^#]*)', 1) end"
    return rf"""
with recursive tags as (
  select url, {attribute("regexp_extract(html, '(?is)<base\\b[^>]*>')", "href")} b, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) tag
  from pages where regexp_matches(html, '(?i)canonical|http-equiv') and position('://' in url) > 0
), told as (
  select url, coalesce({full("url", "b")}, url) base0, tag,
    case when tag ilike '<link%' and list_contains(string_split_regex(lower({attribute("tag", "rel")}), '\s+'), 'canonical') then {attribute("tag", "href")}
      when tag ilike '<meta%' and lower({attribute("tag", "http-equiv")}) = 'refresh' then trim(regexp_extract({attribute("tag", "content")}, '(?is)^[0-9.]*\s*[;,]?\s*url\s*=\s*["'']?([^"'']*)', 1)) end target0
  from tags
), based as (select url, {walked("base0")} base, target0 from told where target0 is not null
), aimed as (select url, {full("base", "target0")} target from based
), links as (select {key("url")} src, {key(walked("target"))} dst from aimed where target is not null
), sym as (
  select src a, dst b from links where src <> dst union select dst, src from links where src <> dst
), reach as (
  select a node, a other from sym union select r.node, s.b from reach r join sym s on r.other = s.a
), comps as (
  select node, min(other) component from reach group by node
), judged as (
  select *, {rules(host("('x://' || node)"), path("('x://' || node)"), "verdict")} v from comps
), classes as (
  select component, coalesce(bool_or(v = 'allow'), false) a, coalesce(bool_or(v = 'block'), false) b from judged group by component
), base as (
  select page_id, coalesce({host("url")}, '') host, coalesce({path("url")}, '') path, {key("url")} k from pages
)
select page_id, host, path, {rules("host", "path", "name")} as rule,
  coalesce({rules("host", "path", "verdict")}, case when a then 'allow' when b then 'block' else 'allow' end) verdict, component alias_of
from base left join comps on k = node left join classes using (component)
"""


def _mixing_sql() -> str:
    """Targets are filled up in closed form; of _SQL_STEPS times 4 rounds the first after which raking may end counts."""
    words = {
        "legal": "license licensed licence copyright rights reserved warranty terms permission", "contact": "@ mail email phone tel call contact address",
        "table": "| total price qty id name date", "code": "{ } def return function import class var password key token secret",
    }
    lists = {name: "[" + ", ".join(f"'{w}'" for w in told.split()) + "]" for name, told in words.items()}
    n = {name: f"len(list_intersect(found, {told}))" for name, told in lists.items()}
    most = f"greatest({', '.join(n.values())})"
    topic = f"case when {most} = 0 then 'prose' " + " ".join(f"when {x} = {most} then '{name}'" for name, x in n.items()) + " end"
    steps = []
    for d, power in (("source", 0.7), ("lang", 0.5), ("topic", 1.0)):
        steps.append(
            f"""g_{d} as (
  select *, (select sum(tokens) from cells)::double total from (select {d} v, sum(tokens)::double t, case when sum(tokens) > 0 then pow(sum(tokens)::double, {power}) else 0.0 end g, sum(tokens) / 0.7 most from cells group by {d})
), s_{d} as (
  select *, (total - coalesce(sum(most) over (order by most / g, v rows between unbounded preceding and 1 preceding), 0)) / sum(g) over (order by most / g, v rows between current row and unbounded following) scale from g_{d} where g > 0
), t_{d} as (
  select v, least(g * coalesce((select min_by(scale, (most / g, v)) from s_{d} where scale <= most / g), 1e300), most) goal from g_{d}
)"""
        )
    have = lambda d: f"sum(w) over (partition by {d})"
    miss = lambda d: f"abs({have(d)} - (select goal from t_{d} where v = {d})) / count(*) over (partition by {d})"
    scaled = lambda d: f"case when {have(d)} > 0 then w * (select goal from t_{d} where v = {d}) / {have(d)} else 0.0 end"
    steps.append("w0 as (select source, lang, topic, tokens, tokens::double w, 0.0::double m from cells)")
    for i in range(4 * _SQL_STEPS):
        steps.append(f"a{i} as materialized (select * replace ({scaled('source')} as w, {miss('source')} as m) from w{i})")
        steps.append(f"b{i} as materialized (select * replace ({scaled('lang')} as w, m + {miss('lang')} as m) from a{i})")
        steps.append(f"c{i} as materialized (select * replace ({scaled('topic')} as w, m + {miss('topic')} as m) from b{i})")
        steps.append(f"w{i + 1} as materialized (select * replace (least(w, tokens / 0.7) as w) from c{i})")
    ends = " union all ".join(f"select {i} step, sum(m) / (select sum(tokens) from cells) off from w{4 * i}" for i in range(1, _SQL_STEPS + 1))
    steps.append(f"ends as materialized ({ends})")
    steps.append("final as (select min(step) step from (select *, lag(off) over (order by step) before from ends) where off <= 0.002 or before - off <= 0.002)")
    steps.append("w as (" + " union all ".join(f"select source, lang, topic, tokens, w from w{4 * i} where (select step from final) = {i}" for i in range(1, _SQL_STEPS + 1)) + ")")
    return f"""
with rows_ as (
  select doc_id, coalesce(source, '') source, coalesce(lang, '') lang, {topic} topic, tok tokens
  from (select *, string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([@|{{}}])', ' \\1 ', 'g'), '[^a-z@|{{}}]+') found,
    case when text is null then 0 else greatest(1, strlen(text) // 4) end::bigint tok from documents)
), cells as (select source, lang, topic, sum(tokens)::bigint tokens from rows_ group by all),
{", ".join(steps)},
rates as (select source, lang, topic, round(case when tokens > 0 then least(1.0, 0.7 * w / tokens) else 0.0 end, 6) p from w)
select r.doc_id, source, lang, topic, r.tokens, round(p * r.tokens, 6) weight, p prob,
  ('0x' || substr(md5('mix:' || coalesce(r.doc_id::varchar, 'null')), 1, 8))::bigint / 4294967296.0::double < p kept
from rows_ r join rates c using (source, lang, topic)
"""


_SQL_STEPS = 10


def _chat_sql() -> str:
    t = chat.DEFAULT
    groups = len({m[0] for m in t.marks})
    to = "".join(f"\\{2 * i + 1}" for i in range(groups)) + "\\\\" + "".join(f"\\{2 * i + 2}" for i in range(groups))
    esc = lambda x: f"regexp_replace(replace({x}, '\\', '\\\\'), '{chat.mark_pattern(t)}', '{to}', 'g')"
    marks = "case role " + " ".join(f"when '{r}' then {len(x.before) + len(x.after)}" for r, x in t.turns.items()) + f" else {sum(map(len, t.other))} + length({esc('role')}) end"
    probe = "</s>[INST] ok [/INST]"
    loss = "role in (" + ", ".join(f"'{r}'" for r, x in t.turns.items() if x.loss) + ")"
    return f"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{probe}' union all select -7, 1, 'assistant', '{probe}'
), o as (
  select conv_id, count(*) n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) told,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where {loss}), '') lost, string_agg(left(role, 1), '' order by turn, role, text) roles,
    bool_and(role in ('system', 'user', 'assistant')) known, sum(length({esc('text')}) + {marks})::bigint formatted_chars
  from r group by conv_id
)
select conv_id, n_turns, sha256(told) turns_sha256, length(lost) loss_chars, sha256(lost) loss_sha256, formatted_chars,
  known and regexp_matches(roles, '^s?(ua)+$') as valid
from o
"""


def _negatives_sql() -> str:
    return """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)) v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id anchor_id, a.label anchor_label, b.vec_id, b.label, list_inner_product(a.v, b.v)::bigint score
  from r a join r b on len(a.v) = len(b.v) where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), p as (
  select anchor_id, vec_id positive_id, score positive_score from s where label = anchor_label
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int rank, vec_id negative_id, positive_score, score negative_score
from p join s on s.anchor_id = p.anchor_id and label <> anchor_label and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
"""


def _decontaminate_sql() -> str:
    found = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with d as (select row_number() over () r, doc_id, {found} w from documents),
i as (select item_id, {found} w from benchmark),
win as (select distinct item_id, least(len(w), 10) l, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') s from (select *, unnest(range(1, greatest(1, len(w) - 9) + 1)) k from i where len(w) > 0)),
runs as (select r, k, l, array_to_string(w[k : k + l - 1], ' ') s from (select r, w, l, unnest(range(1, len(w) - l + 2)) k from d, (select distinct l from win))),
hit as (select r, k, l, s from runs where s in (select s from win where win.l = runs.l)),
covered as (select r, list_sort(list(distinct q)) q from (select r, unnest(range(k, k + l)) q from hit) group by r),
island as (select r, max(n) longest, sum(n)::bigint n_hit from (select r, count(*) n from (select r, q - row_number() over (partition by r order by q) g from (select r, unnest(q) q from covered)) group by r, g) group by r),
listed as (select r, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct r, item_id::varchar item from hit join win using (l, s) where item_id is not null) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256, n_hit is not null contaminated, coalesce(longest, 0)::bigint longest
from d left join island using (r) left join listed using (r)
"""


ORACLES: dict[str, str] = {"op11_negatives": _negatives_sql(), "op12_decontaminate": _decontaminate_sql(), "op3_urls": _urls_sql(), "op9_mixing": _mixing_sql(), "op10_chat": _chat_sql()}
