"""Queries over reply parsing, operation tables, beliefs, post-passes and validators, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import align, responses, text
from ..operators import belief, entities, extract, graph, oplog, postpass, quality
from ..sources import files, views
from ..sources.views import table
from ..streaming import frames as streams
from . import engine
from .registry import _PRON, CA, EF, LOG, ME, OF, PT, SE, _re2, q

# --- filters


@q("flt07_to_dict", f"with {OF} select frame_id, json_object('frame_id', frame_id, 'kriya', kriya, 'karta', karta)::varchar j from o")
def _(s, d):
    return views.order_frames(s, d).select("frame_id", F.to_json(F.struct("frame_id", "kriya", "karta")).alias("j"))


@q("flt14_citation", f"with {SE} select l.doc_id, se.line, se.sentence from labels l join se on se.doc_id = l.doc_id and se.line = l.quality")
def _(s, d):
    ids = table(s, d, "labels").select(F.concat("doc_id", F.lit("_L"), "quality").alias("kriya_id"))
    parts = ids.select(F.regexp_extract("kriya_id", r"^(.*)_L(\d+)$", 1).cast("bigint").alias("doc_id"), F.regexp_extract("kriya_id", r"^(.*)_L(\d+)$", 2).cast("int").alias("line"))
    return views.document_sentences(s, d).join(parts, ["doc_id", "line"]).select("doc_id", "line", "sentence")


@q("flt17_argument_kinds", f"with {EF}, a as (select frame_id src, unnest([karta, 'E' || (event_id * 2)]) arg from e) select src, arg, case when arg in (select frame_id from e) then 'frame' else 'entity' end kind from a")
def _(s, d):
    e = views.event_frames(s, d)
    args = e.select(F.col("frame_id").alias("src"), F.explode(F.array("karta", F.concat(F.lit("E"), F.col("event_id") * 2))).alias("arg"))
    known = e.select(F.col("frame_id").alias("arg"), F.lit(True).alias("known"))
    return args.join(known, "arg", "left").select("src", "arg", F.when(F.col("known"), "frame").otherwise("entity").alias("kind"))


_STATUS = "case event_id % 4 when 0 then 'active' when 1 then 'retracted' when 2 then 'disputed' else 'superseded' end"


@q("flt21_visible_events", f"select event_id, case when {_STATUS} = 'disputed' then 'warning' else 'visible' end shown from events where {_STATUS} in ('active', 'disputed')")
def _(s, d):
    return belief.visible(table(s, d, "events").withColumn("status", F.expr(_STATUS))).select("event_id", "shown")


_LEVEL = "case event_id % 4 when 0 then 'asserted' when 1 then 'explicit' when 2 then 'inferred_causal' end"


@q("flt22_preferred_events", f"with {EF} select frame_id, level like 'inferred%' inferred, row_number() over (partition by karta, kriya order by case when level = 'explicit' then 0 when level like 'inferred%' then 1 else 2 end, frame_id)::int place from (select *, coalesce({_LEVEL}, 'explicit') as level from e)")
def _(s, d):
    e = views.event_frames(s, d).withColumn("level", F.expr(_LEVEL))
    return belief.preferred(e, ["karta", "kriya"]).select("frame_id", "inferred", "place")


# --- joins


@q("jn01_current_request", "select l_orderkey chunk_id, l_suppkey request_id, s_name from orders join lineitem on l_orderkey = o_orderkey and l_suppkey = o_custkey % 10 + 1 join supplier on s_suppkey = l_suppkey")
def _(s, d):
    chunks = table(s, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_custkey") % 10 + 1).alias("current"))
    tries = table(s, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("request_id"))
    return oplog.current_requests(chunks, tries, table(s, d, "supplier").select(F.col("s_suppkey").alias("request_id"), "s_name")).select("chunk_id", "request_id", "s_name")


@q("jn02_ordered_candidates", f"with {SE} select doc_id, row_number() over (partition by doc_id order by line)::int place, sentence from se join documents using (doc_id) where length(sentence) > 40 and lang = 'en'")
def _(s, d):
    ready = table(s, d, "documents").where("lang = 'en'").select("doc_id")
    passed = views.document_sentences(s, d).where("length(sentence) > 40").join(ready, "doc_id", "left_semi")
    return passed.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line")).alias("place"), "sentence")


@q("jn05_failed_extractions", "select a.event_id, a.event_type operation, b.value from events a join events b on a.event_id = b.event_id where a.event_type like '%_ur%' and b.value < 20")
def _(s, d):
    e = table(s, d, "events")
    return e.where(F.col("event_type").like("%_ur%")).select("event_id", F.col("event_type").alias("operation")).join(e.where("value < 20").select("event_id", "value"), "event_id")


_ITEMS = "i as (select distinct l_orderkey src, l_partkey dst from lineitem)"


def _items(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


@q("jn10_either_endpoint", f"with {_ITEMS} select o_orderkey node, other from orders join (select src a, dst other from i union all select dst, src from i where src <> dst) on o_orderkey = a")
def _(s, d):
    # a match on either end is a union of two equi-joins; a loop matches once
    i = _items(s, d)
    sym = i.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(i.where("src <> dst").select("dst", "src"))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("node")).join(sym, "node")


@q("jn22_version_chain", "select conv_id, turn, lag(turn) over (partition by conv_id order by turn) parent, row_number() over (partition by conv_id order by turn)::int depth from conversations")
def _(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(s, d, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("parent"), F.row_number().over(w).alias("depth"))


# --- aggregations, windows, rankings, sets


@q("agg09_scorer_average", "select l_orderkey, l_linenumber, (l_quantity + l_tax * 100) / 2 average, (l_quantity + l_tax * 100) / 2 < 20 regenerate from lineitem")
def _(s, d):
    v = oplog.scorer_verdict(F.col("l_quantity"), F.col("l_tax") * 100, 20).alias("v")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", v).select("l_orderkey", "l_linenumber", "v.average", "v.regenerate")


@q("agg24_metrics", f"with {OF}, {EF} select 'agentless' metric, (select count(*) from o where karta is null)::double as value union all select 'errors', (select count(*) filter (where kriya = 'error') / count(*) from e) union all select 'topics', (select count(distinct locus_topic) from o)")
def _(s, d):
    o, e = views.order_frames(s, d), views.event_frames(s, d)
    return quality.metrics({"agentless": o.agg(F.count_if(F.col("karta").isNull())), "errors": e.agg(F.count_if(F.col("kriya") == "error") / F.count("*")), "topics": o.agg(F.countDistinct("locus_topic"))})


@q("win04_attempts", f"with {LOG} select event_id, row_number() over (partition by user_id, operation order by ts, event_id)::int attempt from lg")
def _(s, d):
    return oplog.attempt_numbers(oplog.op_log(table(s, d, "events")), ["user_id", "operation"], ["ts", "event_id"]).select("event_id", "attempt")


@q("win06_first_three", f"with {ME} select src, dst from (select *, row_number() over (partition by src order by relation, dst) r from m) where r <= 3")
def _(s, d):
    w = Window.partitionBy("src").orderBy("relation", "dst")
    return views.item_edges(s, d).withColumn("r", F.row_number().over(w)).where("r <= 3").select("src", "dst")


@q("top09_best_of_phase", "select l_returnflag, l_linestatus, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_returnflag, l_linestatus order by l_extendedprice desc, l_orderkey, l_linenumber) r from lineitem) where r = 1")
def _(s, d):
    best = F.max_by(F.struct("l_orderkey", "l_linenumber"), F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("b")
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(best).select("l_returnflag", "l_linestatus", "b.*")


@q("top12_newest_documents", "select doc_id, created_at from (select event_id doc_id, case when event_type <> 'error' then ts end created_at from events)")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("doc_id"), F.when(F.col("event_type") != "error", F.col("ts")).alias("created_at"))
    return engine.Engine(e, e, e).docs()


@q("set02_bag_then_set", f"with {CA} select distinct src node from (select src from ca union all select dst from ca union all select src from ca)")
def _(s, d):
    ca = views.adjacent(views.event_frames(s, d))
    steps = ca.select("src").unionAll(ca.select("dst")).unionAll(ca.select("src"))
    return steps.distinct().withColumnRenamed("src", "node")


@q("set03_fixpoint", f"with recursive {_ITEMS}, r as (select dst reached from i where src <= 5 union select i.dst from r join i on r.reached = i.src) select reached from r")
def _(s, d):
    i = _items(s, d)
    start = i.where("src <= 5").select(F.col("dst").alias("node"))
    return graph.traverse(i, start, None).select(F.col("node").alias("reached")).distinct()


# --- text and scalar functions


@q("str17_word_boundary", r"select doc_id, case when 80 >= length(text) or back = 0 then 80 else back end stop from (select doc_id, text, length(regexp_extract(left(text, 80), '(?s)^.*\s', 0)) back from documents)")
def _(s, d):
    return table(s, d, "documents").select("doc_id", align.word_boundary(F.col("text"), F.lit(80)).cast("bigint").alias("stop"))


@q("str29_locus", f"with {PT} select frame_id, filler, case when role in ('locus_time', 'locus_space') then role else 'locus_topic' end kind from pt where role like 'locus%'")
def _(s, d):
    p = views.participations(views.order_frames(s, d)).where("role like 'locus%'")
    places = table(s, d, "nation").select(F.col("n_name").alias("filler"), F.lit(True).alias("known")).distinct()
    return p.join(places, "filler", "left").select("frame_id", "filler", text.locus(F.col("filler"), F.col("known")).alias("kind"))


@q("str31_demo_answers", "select c_custkey, c_mktsegment answer from customer where c_custkey % 2 = 0")
def _(s, d):
    c = table(s, d, "customer")
    asked = c.select("c_custkey", text.question_key(F.concat(F.lit(" "), F.upper("c_name"), F.lit("?? "))).alias("k"))
    return asked.join(c.where("c_custkey % 2 = 0").select(F.lower("c_name").alias("k"), F.col("c_mktsegment").alias("answer")), "k").select("c_custkey", "answer")


@q("str32_verb_roots", f"with {EF} select frame_id, case when kriya = 'click' then 'press' else kriya end root, kriya <> 'click' normalisation_failed from e")
def _(s, d):
    lexicon = s.createDataFrame([("press", True)], "proposed string, known boolean")
    e = views.event_frames(s, d).withColumn("proposed", F.when(F.col("kriya") == "click", "press").otherwise("unknown"))
    v = text.normalised_verb(F.col("kriya"), F.col("proposed"), F.col("known")).alias("v")
    return e.join(F.broadcast(lexicon), "proposed", "left").select("frame_id", v).select("frame_id", "v.root", "v.normalisation_failed")  # one row


@q("fn01_duration", "select event_id, (epoch(date_trunc('second', nx)) - epoch(date_trunc('second', ts)))::bigint * 1000 ms from (select event_id, ts, lead(ts) over (partition by user_id order by ts, event_id) nx from events)")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").select("event_id", oplog.duration_ms(F.col("ts"), F.lead("ts").over(w)).alias("ms"))


@q("fn08_stable_ids", "select doc_id, sha256(doc_id || chr(31) || lang) id from documents where lang is not null")
def _(s, d):
    return table(s, d, "documents").where("lang is not null").select("doc_id", oplog.stable_id(F.col("doc_id").cast("string"), F.col("lang")).alias("id"))


@q("fn10_cache_confidence", "select event_id, round(value / 100 + case when event_type = 'click' then 0.1 else -0.2 end - 0.01 * (event_id % 7), 6) c from events where value / 100 + case when event_type = 'click' then 0.1 else -0.2 end - 0.01 * (event_id % 7) >= 0.05")
def _(s, d):
    c = oplog.cache_confidence(F.col("value") / 100, F.col("event_type") == "click", F.col("event_id") % 7)
    return table(s, d, "events").select("event_id", c.alias("c")).where("c >= 0.05").withColumn("c", F.round("c", 6))


@q("fn11_usage_weights", "select event_type, user_id, round(count(*) * 0.1, 6) weight, round(count(*) / sum(count(*)) over (partition by event_type), 6) share from events group by 1, 2")
def _(s, d):
    u = oplog.usage_weights(table(s, d, "events"), "event_type", "user_id")
    return u.select("event_type", "user_id", F.round("weight", 6).alias("weight"), F.round("share", 6).alias("share"))


@q("fn12_lenient_json", "select event_id, json_extract_string(props, '$.k') k, 1 n from events")
def _(s, d):
    raw = F.concat(F.lit("Sure [see below]:\n```json\n{\"items\": ["), "props", F.lit(",], }\n```"))
    v = responses.lenient_json(raw)
    return table(s, d, "events").select("event_id", F.try_variant_get(v, "$.items[0].k", "string").alias("k"), F.size(F.try_variant_get(v, "$.items", "array<variant>")).alias("n"))


@q("fn13_first_json", "select event_id, '{\"a\": ' || props || '}' j from events")
def _(s, d):
    return table(s, d, "events").select("event_id", responses.first_json(F.concat(F.lit("so [1] {\"a\": "), "props", F.lit("} then {}"))).alias("j"))


@q("fn14_answer_json", "select event_id, case when event_id % 2 = 0 then json_extract_string(props, '$.k') end k, case when event_id % 2 = 1 then 'no {json' end answer from events")
def _(s, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("reply "), "props", F.lit(" end"))).otherwise("no {json")
    v = responses.answer_json(raw)
    return table(s, d, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), F.try_variant_get(v, "$.answer", "string").alias("answer"))


@q("fn16_extraction_shapes", "select event_id, case event_id % 4 when 0 then 2 when 1 then 1 when 2 then 1 end n, 'Candidate_' || chr((65 + event_id % 4)::int) candidate from events")
def _(s, d):
    one = '{"verb": "eat", "karakas": {"agent": "Ram"}}'
    shapes = [f"[{one}, {one}]", one, f'{{"extractions": [{one}]}}', '[{"verb": "eat", "karakas": {"agent": ["Ram", "Sita"]}}]']
    raw = F.element_at(F.array(*map(F.lit, shapes)), (F.col("event_id") % 4 + 1).cast("int"))
    found = responses.extractions(responses.lenient_json(raw))
    return table(s, d, "events").select("event_id", F.when(found.isNotNull(), F.size(found)).alias("n"), responses.candidate_id(F.col("event_id") % 4).alias("candidate"))


@q("fn17_role_rows", f"with {EF} select frame_id, 'agent' as role, karta filler from e union all select frame_id, 'object', karma from e where karma <> ''")
def _(s, d):
    e = views.event_frames(s, d)
    roles = F.create_map(F.lit("agent"), F.col("karta"), F.lit("object"), F.col("karma"), F.lit("source"), F.lit(""))
    return e.select("frame_id", responses.role_rows(roles))


@q("fn18_token_usage", "select event_id, case event_id % 3 when 0 then user_id when 1 then user_id else 2 end prompt_tokens, case event_id % 3 when 0 then event_id when 1 then event_id else 1 end completion_tokens, case event_id % 3 when 0 then 7 when 1 then user_id + event_id else 4 end total_tokens from events")
def _(s, d):
    openai = F.format_string('{"usage": {"prompt_tokens": %d, "completion_tokens": %d, "total_tokens": 7}}', "user_id", "event_id")
    anthropic = F.format_string('{"usage": {"input_tokens": %d, "output_tokens": %d}}', "user_id", "event_id")
    k = F.col("event_id") % 3
    raw = F.when(k == 0, openai).when(k == 1, anthropic).otherwise('{"prompt": "tell me now", "completion": "yes sir"}')
    provider = F.element_at(F.array(F.lit("openai"), F.lit("anthropic"), F.lit("local")), (k + 1).cast("int"))
    u = responses.token_usage(F.try_parse_json(raw), provider).alias("u")
    return table(s, d, "events").select("event_id", u).select("event_id", "u.*")


@q("fn20_reasoning_mode", "select event_id, case when event_id % 2 = 0 and user_id % 2 = 0 and (event_id % 3 = 0 or (event_id % 3 = 1 and value < 10)) then 'on' else 'off' end as mode from events")
def _(s, d):
    asked = F.element_at(F.array(F.lit("on"), F.lit("auto"), F.lit("off")), (F.col("event_id") % 3 + 1).cast("int"))
    default = F.when(F.col("value") < 10, "on").otherwise("off")
    return table(s, d, "events").select("event_id", responses.reasoning_mode(asked, F.col("event_id") % 2 == 0, F.col("user_id") % 2 == 0, default).alias("mode"))


@q("src09_byte_range", "select doc_id, left(text, list_max(list_filter(range(41), lambda n: strlen(left(text, n)) <= 40))) part from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", files.byte_range(F.col("text"), F.lit(0), F.lit(40)).alias("part"))


# --- pipeline operators


def _turns(s, d):
    c = table(s, d, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line"), F.concat("conv_id", F.lit("_L"), "turn").alias("frame_id"), F.get(F.split("text", " "), F.pmod(F.col("conv_id"), F.lit(7)).cast("int")).alias("entity"), F.col("text").alias("sentence"))


@q("pip03_extracted_frames")
def _(s, d):
    return extract.extract_frames(views.document_sentences(s, d)).select("frame_id", "kriya", "karta", "karma", "status", "attempts")


_TURNS = rf"""t as (select conv_id doc_id, turn line, conv_id || '_L' || turn frame_id, string_split(text, ' ')[conv_id % 7 + 1] entity, text sentence from conversations),
 p as (select *, coalesce(lower(trim(entity, E' \n\t\r')) in ({_PRON}, 'la', 'die', 'el'), false) doubtful from t),
 v as (select *, last_value(case when not doubtful and lower(trim(entity, E' \n\t\r')) <> '' then row(line, entity) end ignore nulls) over (partition by doc_id order by line, frame_id, entity rows between unbounded preceding and 1 preceding) s from p)"""


@q("pip08_coreferences", f"with {_TURNS} select frame_id, entity src, s[2] dst, case when line - s[1] <= 1 then 'high' else 'medium' end confidence from v where doubtful and line - s[1] <= 5 and lower(trim(entity, E' \\n\\t\\r')) <> lower(trim(s[2], E' \\n\\t\\r'))")
def _(s, d):
    doubtful = F.coalesce(text.key(F.col("entity")).isin([*text.PRONOUNS, "la", "die", "el"]), F.lit(False))
    return postpass.coreferences(_turns(s, d), doubtful=doubtful).select("frame_id", "src", "dst", "confidence")


@q("pip09_metaphors", "select user_id doc_id, 'E' || event_id frame_id, name src, s[2] dst from (select *, last_value(case when event_type <> 'view' then row(event_id, name) end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) s from (select *, case when event_type = 'view' then 'king of ' || event_type else 'N' || event_id end name from events)) where event_type = 'view' and event_id - s[1] <= 30")
def _(s, d):
    e = table(s, d, "events")
    name = F.when(F.col("event_type") == "view", F.concat(F.lit("king of "), "event_type")).otherwise(F.concat(F.lit("N"), "event_id"))
    t = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line"), F.concat(F.lit("E"), "event_id").alias("frame_id"), name.alias("entity"))
    return postpass.metaphors(t, 30).select("doc_id", "frame_id", "src", "dst")


@q("pip10_entity_types", f"with {PT}, c as (select lower(trim(filler)) entity, role, count(*) n from pt group by all), r as (select *, row_number() over (partition by entity order by n desc, role) k from c) select entity, case role when 'karta' then 'Agent' when 'sampradana' then 'Agent' when 'locus_time' then 'Time' when 'locus_space' then 'Place' when 'locus_topic' then 'Concept' else 'Thing' end as type, n from r where k = 1")
def _(s, d):
    return postpass.entity_types(views.participations(views.order_frames(s, d)))


_EFFECT, _CAUSE = _re2(r"\b(so|donc|also)\b"), _re2(r"\b(que|weil)\b")


@q("pip11_causal_links", f"with t as (select *, conv_id || '_L' || turn f, lead(turn) over w nt, lead(conv_id || '_L' || turn) over w nf, lead(lower(text)) over w said from conversations window w as (partition by conv_id order by turn)) select case when regexp_matches(said, '{_EFFECT}') then f else nf end src, case when regexp_matches(said, '{_EFFECT}') then nf else f end dst from t where nt - turn <= 3 and (regexp_matches(said, '{_EFFECT}') or regexp_matches(said, '{_CAUSE}'))")
def _(s, d):
    return postpass.causal_links(_turns(s, d), effect=r"\b(so|donc|also)\b", cause=r"\b(que|weil)\b")


_PAID = "f as (select l_orderkey id, sum(l_quantity) amount from lineitem group by 1)"


@q("pip16_verified", f"with {_PAID} select o_custkey conclusion, count(*) = count(f.id) valid from orders left join f on f.id = o_orderkey and f.id % 9 <> 0 group by 1")
def _(s, d):
    facts = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("amount")).where("id % 9 <> 0")
    evidence = table(s, d, "orders").select(F.col("o_custkey").alias("conclusion"), F.col("o_orderkey").alias("id"))
    stated = evidence.join(facts, "id", "left").groupBy("conclusion").agg(F.sum("amount").alias("total"))
    return belief.verify(stated, evidence, facts)


_GLUE = "g as (select distinct l_orderkey c, l_suppkey i from lineitem), x as (select o_orderkey a, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) b from orders)"


@q("pip18_weakest_shared", f"with {_GLUE} select a as \"left\", b as \"right\", i weakest from (select x.a, x.b, g1.i, row_number() over (partition by x.a, x.b order by s_acctbal, g1.i) r from x join g g1 on g1.c = x.a join g g2 on g2.c = x.b and g1.i = g2.i join supplier on s_suppkey = g1.i) where r = 1")
def _(s, d):
    glue = table(s, d, "lineitem").select(F.col("l_orderkey").alias("conclusion"), F.col("l_suppkey").alias("identity")).distinct()
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    clash = table(s, d, "orders").select(F.col("o_orderkey").alias("left"), F.lead("o_orderkey").over(w).alias("right")).where("right is not null")
    return belief.trace_back(clash, glue, table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("confidence")))


_OPS = "case event_type when 'click' then 'ASSERT' when 'error' then 'RETRACT' when 'purchase' then 'UNIFY' else 'SPLIT' end"


@q("pip19_replayed", f"with l as (select user_id item, event_id, {_OPS} op from events) select case when op in ('ASSERT', 'RETRACT') then 'O' else 'I' end store, 'x' || item item from (select *, row_number() over (partition by item, op in ('ASSERT', 'RETRACT') order by event_id desc) r from l) where r = 1 and op in ('ASSERT', 'UNIFY')")
def _(s, d):
    ops = table(s, d, "events").select(F.col("event_id").alias("seq"), F.expr(_OPS).alias("op"), F.concat(F.lit("x"), "user_id").alias("item"), F.lit(None).cast("string").alias("replaces"))
    return belief.replay(ops, force=True)


@q("pip23_view_validity", "select a.user_id as key, a.ts valid_from, min(b.ts) valid_to from events a left join events b on a.user_id = b.user_id and b.event_type = 'error' and b.ts > a.ts where a.event_type = 'purchase' group by all")
def _(s, d):
    e = table(s, d, "events")
    return belief.views(e.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("ts").alias("at")), e.where("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("ts").alias("at")))


@q("pip26_assignment", "select event_id, (event_id % 4)::int worker, row_number() over (partition by event_id % 4 order by user_id % 5, ts, event_id)::int place from events where value < 10")
def _(s, d):
    queue = table(s, d, "events").select("event_id", "ts", (F.col("user_id") % 5).alias("priority"), F.when(F.col("value") < 10, "pending").otherwise("done").alias("status"))
    return oplog.assignment(queue, 4, F.col("event_id")).select("event_id", "worker", "place")


_HASHED = "n as (select doc_id, case when doc_id % 10 = 0 then 'bad' else sha256(text) end h from documents where text is not null), k as (select sha256(text) h from benchmark)"


@q("pip27_uploads", f"with {_HASHED} select doc_id upload_id, case when h = 'bad' then 'INVALID_HASH' when h in (select h from k) or doc_id > min(doc_id) over (partition by h) then 'REUSED' else 'UPLOAD_PENDING' end outcome from n")
def _(s, d):
    h = F.sha2(F.encode("text", "UTF-8"), 256)
    new = table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("upload_id"), F.when(F.col("doc_id") % 10 == 0, "bad").otherwise(h).alias("hash"))
    return oplog.uploads(new, table(s, d, "benchmark").select(h.alias("hash")))


@q("pip29_quantities", "select p_partkey, case p_size % 4 when 0 then p_size::varchar when 1 then '3' when 2 then 'ALL' else 'ZERO' end quantity, case p_size % 4 when 0 then 'exact' when 1 then 'exact' when 2 then 'universal' else 'negative' end quantity_type, case when p_size % 4 = 3 then 'negative' else 'positive' end polarity from part")
def _(s, d):
    first = F.element_at(F.array(F.col("p_size").cast("string"), F.lit("three"), F.lit("all"), F.lit("no")), F.col("p_size") % 4 + 1)
    x = text.quantity(F.concat(first, F.lit(" parts"))).alias("x")
    return table(s, d, "part").select("p_partkey", x).select("p_partkey", "x.*")


@q("pip33_obstructions", "select s_suppkey node, s_nationkey a, s_nationkey % 5 b from (select *, count(*) over (partition by s_nationkey) na, count(*) over (partition by s_nationkey % 5) nb from supplier) where na <> nb")
def _(s, d):
    x = table(s, d, "supplier")
    return belief.obstructions(x.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("canonical")), x.select(F.col("s_suppkey").alias("node"), (F.col("s_nationkey") % 5).alias("canonical"))).select("node", "a", "b")


@q("pip35_acquisitions", f"with {EF} select 'acq:' || frame_id acquisition_id, frame_id, karta source, ts as at from e")
def _(s, d):
    return belief.acquisitions(views.event_frames(s, d), "ingest", F.col("karta"), F.col("ts"), "events").select("acquisition_id", "frame_id", "source", "at")


@q("pip36_causation", f"with {CA} select src frame_id, dst answer from ca")
def _(s, d):
    e = views.event_frames(s, d)
    return engine.ask(engine.QueryOp.CAUSATION, e, views.adjacent(e).withColumn("relation", F.lit("caused_by")))


@q("pip37_tense", "select p_partkey, ['lṛṅ', 'liṅ', 'lṛṭ', 'liṭ', 'luṅ', 'laṭ', 'loṭ'][p_size % 7 + 1] tag from part")
def _(s, d):
    said = ["Ram would have read", "Ram should read", "Ram will read", "Ram has walked", "Ram walked", "Ram reads", "Read!"]
    return table(s, d, "part").select("p_partkey", text.lakara(F.element_at(F.array(*map(F.lit, said)), F.col("p_size") % 7 + 1)).alias("tag"))


@q("pip38_interpretations", "select l_orderkey sentence_id, l_linenumber reading, l_returnflag <> 'N' figurative from (select *, row_number() over (partition by l_orderkey order by l_returnflag = 'N' desc, l_tax desc, l_discount desc, l_linenumber, l_suppkey) r from lineitem) where r = 1")
def _(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("sentence_id"), F.col("l_linenumber").alias("reading"), F.col("l_tax").alias("specificity"), F.col("l_discount").alias("confidence"), (F.col("l_returnflag") == "N").alias("fits"))
    return belief.interpretation(li)


@q("pip40_relation_classes", "select event_id, case event_id % 3 when 0 then 'causal' when 1 then 'temporal' end class from events")
def _(s, d):
    relation = F.element_at(F.array(F.lit("ENABLED_BY"), F.lit("overlaps"), F.lit("odd")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(s, d, "events").select("event_id", engine.relation_class(relation).alias("class"))


_NEAR = "p as (select a.vec_id a, b.vec_id b from embeddings a join embeddings b on a.vec_id <> b.vec_id and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.95)"


@q("pip06_resolved_by_components", f"with recursive {_NEAR}, r as (select a node, b other from p union select r.node, p.b from r join p on r.other = p.a), c as (select node, least(node, min(other)) k from r group by node) select 'V' || vec_id mention, 'V' || coalesce(k, vec_id) canonical from embeddings left join c on node = vec_id")
def _(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("seq"), F.concat(F.lit("V"), "vec_id").alias("mention"), F.col("embedding").cast("array<double>").alias("vector"))
    return entities.resolve_by_components(e, 64, 0.95)


# --- validators and streams


@q("val01_entity_links", "select l_orderkey src, l_partkey dst from lineitem where l_orderkey % 2 = 1 and l_partkey % 2 = 1")
def _(s, d):
    edges = table(s, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).select("node", F.when(F.col("node") % 2 == 1, "entity").otherwise("event").alias("kind"))
    return quality.entity_links(edges, nodes).select("src", "dst")


@q("val03_stray_causes", f"with {CA} select src, dst from ca where substr(src, 2)::bigint % 10 = 0 or substr(dst, 2)::bigint % 10 = 0")
def _(s, d):
    e = views.event_frames(s, d)
    nodes = e.select(F.col("frame_id").alias("node"), F.when(F.col("event_id") % 10 != 0, "event").otherwise("entity").alias("kind"))
    return quality.stray_causes(views.adjacent(e), nodes).select("src", "dst")


@q("val04_unmarked_views", "select event_id from events where event_id % 3 <> 0")
def _(s, d):
    e = table(s, d, "events").withColumn("is_derived", F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False))
    return quality.unmarked_views(e).select("event_id")


@q("val06_missing_roles", f"with {OF} select frame_id, 'karma' as role from o where kriya = 'fulfil'")
def _(s, d):
    o = views.order_frames(s, d)
    needed = s.createDataFrame([("fulfil", "karma"), ("open", "karta")], "kriya string, role string")
    return quality.missing_roles(o, needed, views.participations(o))


@q("val07_incompatible", f"with {EF} select frame_id, lower(karta) filler_key from e where kriya = 'purchase' and substr(karta, 2)::bigint % 2 = 1")
def _(s, d):
    e = views.event_frames(s, d)
    parts = e.select("frame_id", "kriya", F.lit("karta").alias("role"), text.key(F.col("karta")).alias("filler_key"))
    wanted = s.sql("select 'purchase' kriya, 'karta' as role, array('animate') wants")
    features = parts.select("filler_key").distinct().where("cast(substr(filler_key, 2) as bigint) % 2 = 0").withColumn("has", F.array(F.lit("animate"), F.lit("human")))
    return quality.incompatible(parts, wanted, features).select("frame_id", "filler_key")


@q("val12_causal_paradox", f"with {CA} select src node from ca union select dst from ca")
def _(s, d):
    links = views.adjacent(views.event_frames(s, d))  # each cause doubles as its own effect
    return graph.cycle_nodes(links.union(links.select("dst", "src")))


@q("val14_illegal_retractions", "select event_id id, case when event_id % 3 = 1 then 'EVENT' else 'TEMPORAL' end kind from events where event_type = 'error' and event_id % 3 <> 0")
def _(s, d):
    e = table(s, d, "events")
    kind = F.element_at(F.array(F.lit("IDENTITY"), F.lit("EVENT"), F.lit("TEMPORAL")), (F.col("event_id") % 3 + 1).cast("int"))
    return quality.illegal_retractions(e.where("event_type = 'error'").select(F.col("event_id").alias("id")), e.select(F.col("event_id").alias("id"), kind.alias("kind")), ["IDENTITY", "TRACE"])


@q("val15_without_origin", "select c_custkey state_id from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def _(s, d):
    states = table(s, d, "customer").select(F.col("c_custkey").alias("state_id"), F.col("c_mktsegment").alias("category"))
    return quality.without_origin(states, table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("state_id")), ["BUILDING", "MACHINERY"]).select("state_id")


@q("stm04_upserted_frames", "select 'U' || user_id frame_id, max(event_id) version, max_by(event_type, event_id) kriya from events group by 1")
def _(s, d):
    changes = streams.stream_table(s, d, "events").select(F.concat(F.lit("U"), "user_id").alias("frame_id"), F.col("event_id").alias("version"), F.col("event_type").alias("kriya"))
    return streams.run_once(streams.upserted(changes), "update", keys=["frame_id"])
