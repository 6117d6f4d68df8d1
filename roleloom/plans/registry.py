"""All queries over the driver's tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import belief, clusters, containment, frames, graph, oplog, quality
from ..sources import views
from ..sources.views import table
from ..streaming import frames as streams
from . import query as plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

OF = """o as (select 'O' || o_orderkey frame_id, o_orderkey, case o_orderstatus when 'F' then 'fulfil' when 'O' then 'open' else 'process' end kriya,
 c_name karta, c_mktsegment sampradana, strftime(o_orderdate, '%Y-%m-%d') locus_time, n_name locus_space, o_orderpriority locus_topic, n_regionkey, o_totalprice price
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""
PT = OF + """, pt as (select * from (
 select frame_id, 'karta' as role, karta filler from o union all select frame_id, 'sampradana', sampradana from o union all select frame_id, 'locus_time', locus_time from o
 union all select frame_id, 'locus_space', locus_space from o union all select frame_id, 'locus_topic', locus_topic from o) where filler <> '')"""
ME = """m as (select 'O' || l_orderkey src, p_name dst, 'HAS_KARMA' relation from lineitem join part on l_partkey = p_partkey
 union all select 'O' || l_orderkey, s_name, 'FROM_APĀDĀNA' from lineitem join supplier on l_suppkey = s_suppkey)"""
EF = "e as (select 'E' || event_id frame_id, event_id, event_type kriya, 'U' || user_id karta, ts, json_extract_string(props, '$.k') karma, value from events)"
CA = EF + """, ca as (select frame_id src, dst from (select frame_id, ts, lead(frame_id) over w dst, lead(ts) over w t2 from e
 window w as (partition by karta order by ts, event_id)) where dst is not null and t2 <= ts + interval 3 hour)"""
SE = r"""sp as (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?]\s+)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') s from documents),
 se as (select doc_id, unnest(range(len(s)))::int line, unnest(s) sentence from sp)"""
LOG = """lg as (select event_id, user_id, ts, event_type operation, case when event_type = 'error' then 'failed' when value < 5 then 'pending' else 'completed' end status,
 value duration_ms, 'p' || (user_id % 3) provider, user_id % 2 = 0 reasoning, json_extract_string(props, '$.k')::int tokens from events)"""


def _re2(pattern: str) -> str:
    """Word boundaries spelled out: RE2 knows ASCII ones only, Spark's know all letters."""
    first = pattern.replace("\\b", r"(?:^|[^\pL\pN_])", 1) if pattern.startswith("\\b") else pattern
    return first.replace("\\b", r"(?:[^\pL\pN_]|$)")


def q(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# --- lookups and filters


@q("flt01_get_frame", f"with {OF} select frame_id, kriya, karta from o where frame_id = 'O7'")
def _(s, d):
    return views.order_frames(s, d).where(F.col("frame_id") == "O7").select("frame_id", "kriya", "karta")


@q("flt02_all_frames", f"with {OF} select frame_id, kriya, karta, sampradana, locus_time, locus_space, locus_topic from o")
def _(s, d):
    return views.order_frames(s, d).select("frame_id", "kriya", "karta", "sampradana", "locus_time", "locus_space", "locus_topic")


@q("flt03_find_by_entity", f"with {PT} select distinct frame_id from pt where lower(trim(filler)) = 'building'")
def _(s, d):
    return frames.find_by_entity(views.order_frames(s, d), " Building ").select("frame_id")


@q("flt04_find_by_kriya", f"with {EF} select frame_id, karta from e where lower(trim(kriya)) = 'click'")
def _(s, d):
    return frames.find_by_kriya(views.event_frames(s, d), "CLICK ").select("frame_id", "karta")


@q("flt05_find_by_role", f"with {OF} select frame_id, karta, locus_space from o where contains(lower(locus_space), '_1')")
def _(s, d):
    return frames.find_by_role(views.order_frames(s, d), "place", "_1").select("frame_id", "karta", "locus_space")


@q("role_lookup_who", f"with {OF} select frame_id, karta answer from o where kriya = 'fulfil' and contains(lower(sampradana), 'build')")
def _(s, d):
    return plans.Template("fulfil", {"recipient": "build"}, "agent").run(views.order_frames(s, d))


@q("flt06_shown_roles", f"with {PT} select frame_id, string_agg(role || '=' || filler, ';' order by role) roles from pt group by frame_id")
def _(s, d):
    shown = frames.shown_roles(views.order_frames(s, d))
    return shown.select("frame_id", F.array_join(F.array_sort(F.transform(F.map_entries("roles"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("roles"))


# written out here, so that the SQL does not depend on the lists it checks
_STATIVE = r"(?:^|[^\pL\pN_])(?:is\s+a|are\s+the|was\s+a|were\s+the|is\s+an|has\s+been)(?:[^\pL\pN_]|$)"
_ACTS = "'ate', 'ran', 'went', 'said', 'made', 'gave', 'took', 'came', 'saw', 'got', 'put', 'found', 'told', 'asked', 'used', 'tried', 'left', 'called'"


@q(
    "flt08_eventive_check",
    f"with {SE} select doc_id, line, case when regexp_matches(lower(sentence), '{_STATIVE}') and not list_has_any(string_split_regex(lower(sentence), '\\s+'), [{_ACTS}]) then false end eventive from se",
)
def _(s, d):
    return views.document_sentences(s, d).select("doc_id", "line", text.eventive(F.col("sentence")).alias("eventive"))


@q("flt09_filter_eventive", f"with {SE} select doc_id, line, trim(sentence, E' \\n\\t\\r') sentence from se where trim(sentence, E' \\n\\t\\r') <> '' and not (regexp_matches(lower(sentence), '{_STATIVE}') and not list_has_any(string_split_regex(lower(sentence), '\\s+'), [{_ACTS}]))")
def _(s, d):
    x = views.document_sentences(s, d)
    return x.where((text.strip(F.col("sentence")) != "") & F.coalesce(text.eventive(F.col("sentence")), F.lit(True))).select("doc_id", "line", text.strip(F.col("sentence")).alias("sentence"))


@q("flt10_cited_documents", f"with {CA} select c.src frame_id, b.karta cited from ca c join e b on c.dst = b.frame_id where b.kriya = 'purchase'")
def _(s, d):
    e = views.event_frames(s, d)
    hit = e.where("kriya = 'purchase'").select(F.col("frame_id").alias("dst"), F.col("karta").alias("cited"))
    return views.adjacent(e).join(hit, "dst").select(F.col("src").alias("frame_id"), "cited")


@q("flt11_neighbours", f"with {CA} select dst node, 'out' way from ca where src = (select min(src) from ca) union all select src, 'in' from ca where dst = (select min(src) from ca)")
def _(s, d):
    links = views.adjacent(views.event_frames(s, d)).withColumn("relation", F.lit("CAUSES"))
    start = links.agg(F.min("src")).first()[0]
    return graph.neighbours(links, F.lit(start)).select("node", "way")


@q("flt12_match_all", f"with {ME} select distinct a.src from m a join m b on a.src = b.src where a.relation = 'HAS_KARMA' and a.dst = (select min(p_name) from part) and b.relation = 'FROM_APĀDĀNA' and b.dst like 'Supplier%1'")
def _(s, d):
    m = views.item_edges(s, d)
    least = table(s, d, "part").agg(F.min("p_name").alias("dst"))
    a = m.where("relation = 'HAS_KARMA'").join(F.broadcast(least), "dst", "left_semi").select("src").distinct()  # one row
    return a.join(m.where((F.col("relation") == "FROM_APĀDĀNA") & F.col("dst").like("Supplier%1")), "src", "left_semi")


@q("flt13_entity_first", f"with {PT} select frame_id from pt where role = 'karta' and filler like '%7' intersect select frame_id from pt where role = 'sampradana' and filler = 'MACHINERY'")
def _(s, d):
    p = views.participations(views.order_frames(s, d))
    a = p.where("role = 'karta' and filler like '%7'").select("frame_id")
    return a.intersect(p.where("role = 'sampradana' and filler = 'MACHINERY'").select("frame_id"))


@q("flt15_context_accepts", f"with {LOG} select event_id from lg where status <> 'failed' and duration_ms >= 10 and provider in ('p0', 'p1') and event_id not in (3, 4)")
def _(s, d):
    log = oplog.op_log(table(s, d, "events"))
    atoms = log.select(F.col("event_id").alias("id"), (F.col("status") != "failed").alias("active"), F.col("duration_ms").alias("confidence"), F.col("provider").alias("source"))
    return atoms.where(belief.accepts(10, ["p0", "p1"], [3, 4])).select(F.col("id").alias("event_id"))


@q("flt19_pov_restricted", f"with {OF} select frame_id, kriya from o where n_regionkey = 1 and locus_time >= '1995-01-01' and price > 1000")
def _(s, d):
    where = plans.PointOfView((F.col("n_regionkey") == 1,)) & plans.PointOfView((F.col("locus_time") >= "1995-01-01", F.col("price") > 1000))
    return where.apply(views.order_frames(s, d)).select("frame_id", "kriya")


@q("flt23_capable_provider", "select s_suppkey, s_acctbal from supplier where s_acctbal > 0 order by s_acctbal desc, s_suppkey limit 1")
def _(s, d):
    return table(s, d, "supplier").where("s_acctbal > 0").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(1).select("s_suppkey", "s_acctbal")


@q("flt24_workers", "select s_suppkey from supplier where s_suppkey % 3 = 0 and list_contains([s_nationkey, s_nationkey + 1], 5)")
def _(s, d):
    return table(s, d, "supplier").where("s_suppkey % 3 = 0").where(F.array_contains(F.array("s_nationkey", F.col("s_nationkey") + 1), 5)).select("s_suppkey")


@q("flt25_open_states", f"with {EF} select karta, frame_id from (select *, lead(ts) over (partition by karta order by ts, event_id) n from e) where n is null")
def _(s, d):
    w = Window.partitionBy("karta").orderBy("ts", "event_id")
    return views.event_frames(s, d).withColumn("n", F.lead("ts").over(w)).where("n is null").select("karta", "frame_id")


# --- joins and navigation


@q("jn03_sentences_of_documents", f"with {SE} select d.doc_id, d.lang, count(*) n from documents d join se using (doc_id) group by all")
def _(s, d):
    return table(s, d, "documents").select("doc_id", "lang").join(views.document_sentences(s, d), "doc_id").groupBy("doc_id", "lang").agg(F.count("*").alias("n"))


@q("jn04_traces_with_errors", "select a.event_id, b.event_id error_id from events a left join events b on a.user_id = b.user_id and b.event_type = 'error' and b.ts = a.ts")
def _(s, d):
    e = table(s, d, "events")
    err = e.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"))
    return e.join(err, ["user_id", "ts"], "left").select("event_id", "error_id")


@q("jn06_pattern_join", "select c_mktsegment, count(*) n from orders join customer on o_custkey = c_custkey where c_name like '%_1%' group by 1")
def _(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer").where(F.col("c_name").like("%_1%"))
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@q("jn07_without_participants", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def _(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders").where("o_orderstatus = 'P'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@q("jn08_exists_in_arguments", "select frame_id from (select 'O' || l_orderkey frame_id, list(l_partkey) a from lineitem group by 1) where list_contains(a, 5)")
def _(s, d):
    atoms = table(s, d, "lineitem").groupBy(F.concat(F.lit("O"), "l_orderkey").alias("frame_id")).agg(F.collect_set("l_partkey").alias("arguments"))
    return atoms.where(F.array_contains("arguments", 5)).select("frame_id")


@q("jn09_missing_roles", f"with {EF}, r as (select * from (values ('purchase', 'karma'), ('click', 'karma'), ('error', 'karana')) t(kriya, role)) select frame_id, role from e join r using (kriya) where not (role = 'karma' and karma is not null)")
def _(s, d):
    need = s.sql("select * from values ('purchase', 'karma'), ('click', 'karma'), ('error', 'karana') as t(kriya, role)")
    e = views.event_frames(s, d)
    have = e.where("karma is not null").select("frame_id", F.lit("karma").alias("role"))
    return e.join(F.broadcast(need), "kriya").select("frame_id", "role").join(have, ["frame_id", "role"], "left_anti")  # three rows


@q("jn11_bfs_bounded", f"with recursive {CA}, b as (select 'E0' node, 0 hops union select dst, hops + 1 from b join ca on src = node where hops < 3) select node, min(hops)::int hops from b group by 1")
def _(s, d):
    start = s.sql("select 'E0' as node")
    return graph.traverse(views.adjacent(views.event_frames(s, d)), start, 4)


@q("jn12_one_hop_causal", f"with {CA}, h as (select frame_id from e where kriya = 'purchase' and value > 150) select frame_id, 0 hop from h union all select distinct n, 1 from (select dst n from ca join h on src = frame_id union all select src from ca join h on dst = frame_id) where n not in (from h)")
def _(s, d):
    e = views.event_frames(s, d)
    links = views.adjacent(e)
    h = e.where("kriya = 'purchase' and value > 150").select("frame_id")
    near = links.join(h, links.src == h.frame_id).select(F.col("dst").alias("n")).union(links.join(h, links.dst == h.frame_id).select("src")).distinct()
    return h.select("frame_id", F.lit(0).alias("hop")).union(near.join(h, near.n == h.frame_id, "left_anti").select("n", F.lit(1)))


@q("jn13_causal_chain", f"with {CA} select a.src, c.dst from ca a join ca c on a.dst = c.src")
def _(s, d):
    c = views.adjacent(views.event_frames(s, d))
    return c.alias("a").join(c.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")


@q("jn14_evidence_walk", f"with {PT} select entity, frame_id from (select filler entity, frame_id, row_number() over (partition by filler order by frame_id) r from pt where role = 'locus_space') where r <= 3")
def _(s, d):
    p = views.participations(views.order_frames(s, d)).where("role = 'locus_space'").select(F.col("filler").alias("entity"), "frame_id")
    return frames.top_per(p, ["entity"], [F.col("frame_id")], 3).drop("rank")


_ID = "i as (select distinct a.c_custkey src, b.c_custkey dst from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_mktsegment = b.c_mktsegment and b.c_custkey between a.c_custkey + 1 and a.c_custkey + 40)"


def _identities(s, d):
    """Pairs whose keys are at most 40 apart lie in the same stretch of 40 keys or in the next one: rows meet in those
    two only, so the join grows with the table and not with the square of a nation's segment."""
    c = table(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.expr("c_custkey div 40").alias("stretch"))
    a, b = c.withColumn("stretch", F.explode(F.array("stretch", F.col("stretch") + 1))).alias("a"), c.alias("b")
    on = (F.col("a.c_nationkey") == F.col("b.c_nationkey")) & (F.col("a.c_mktsegment") == F.col("b.c_mktsegment")) & (F.col("a.stretch") == F.col("b.stretch"))
    near = a.join(b, on & F.col("b.c_custkey").between(F.col("a.c_custkey") + 1, F.col("a.c_custkey") + 40))
    return near.select(F.col("a.c_custkey").alias("src"), F.col("b.c_custkey").alias("dst")).distinct()


@q("jn16_equivalence_classes", f"with recursive {_ID}, y as (select src, dst from i union select dst, src from i), r as (select src node, dst other from y union select r.node, y.dst from r join y on r.other = y.src) select node, least(node, min(other)) canonical from r group by node")
def _(s, d):
    return graph.equivalence(_identities(s, d))


@q("jn15_connected_pairs", f"with recursive {_ID}, y as (select src, dst from i union select dst, src from i), r as (select src node, dst other from y union select r.node, y.dst from r join y on r.other = y.src), k as (select node, least(node, min(other)) canonical from r group by node) select node, canonical, count(*) over (partition by canonical) - 1 connected from k")
def _(s, d):
    # two nodes are connected if they share a class: membership says it of all pairs without listing them
    k = graph.equivalence(_identities(s, d))
    return k.join(k.groupBy("canonical").agg((F.count("*") - 1).alias("connected")), "canonical").select("node", "canonical", "connected")


@q("jn19_before_event", f"with {EF} select frame_id, before from (select frame_id, kriya, lag(kriya) over (partition by karta order by ts, event_id) before from e) where kriya = 'purchase' and before is not null")
def _(s, d):
    w = Window.partitionBy("karta").orderBy("ts", "event_id")
    e = views.event_frames(s, d).select("frame_id", "kriya", F.lag("kriya").over(w).alias("before"))
    return e.where("kriya = 'purchase' and before is not null").select("frame_id", "before")


@q("jn20_same_event", f"with {EF} select a.frame_id a, b.frame_id b from e a join e b on a.karta = b.karta and a.kriya = b.kriya and a.event_id < b.event_id and b.ts <= a.ts + interval 1 hour and b.ts >= a.ts - interval 1 hour")
def _(s, d):
    a, b = views.event_frames(s, d).alias("a"), views.event_frames(s, d).alias("b")
    hour = F.expr("INTERVAL 1 HOUR")
    on = (F.col("a.karta") == F.col("b.karta")) & (F.col("a.kriya") == F.col("b.kriya")) & (F.col("a.event_id") < F.col("b.event_id"))
    return a.join(b, on & (F.col("b.ts") <= F.col("a.ts") + hour) & (F.col("b.ts") >= F.col("a.ts") - hour)).select(F.col("a.frame_id").alias("a"), F.col("b.frame_id").alias("b"))


@q("jn21_turn_tree", "with recursive t as (select conv_id, turn, 0 depth from conversations where turn = 0 union all select c.conv_id, c.turn, depth + 1 from t join conversations c on c.conv_id = t.conv_id and c.turn = t.turn + 1) select conv_id, max(depth)::int depth from t group by 1")
def _(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn")
    w = Window.partitionBy("conv_id").orderBy("turn")
    whole = c.distinct().withColumn("r", F.row_number().over(w) - 1).where("r = turn")  # the unbroken chain from turn 0
    return whole.groupBy("conv_id").agg(F.max("r").cast("int").alias("depth"))


@q("jn23_frame_view", f"with {ME} select src frame_id, count(distinct dst) filter (where relation = 'HAS_KARMA') n_karma, min(dst) filter (where relation = 'FROM_APĀDĀNA') apadana from m group by 1")
def _(s, d):
    m = views.item_edges(s, d)
    return m.groupBy(F.col("src").alias("frame_id")).agg(
        F.count_distinct(F.when(F.col("relation") == "HAS_KARMA", F.col("dst"))).alias("n_karma"), F.min(F.when(F.col("relation") == "FROM_APĀDĀNA", F.col("dst"))).alias("apadana")
    )


# --- aggregations


@q("agg01_store_stats", f"with {PT} select (select count(*) from o) n_frames, count(distinct lower(trim(filler))) n_entities, (select count(distinct kriya) from o) n_kriyas from pt")
def _(s, d):
    f = views.order_frames(s, d)
    a = f.agg(F.count("*").alias("n_frames"), F.count_distinct("kriya").alias("n_kriyas"))
    return a.crossJoin(views.participations(f).agg(F.count_distinct("filler_key").alias("n_entities")))  # one row each


@q("agg02_inverted_index", f"with {ME} select lower(trim(dst)) filler_key, count(distinct src) n, min(src) first, max(src) last from m where relation = 'HAS_KARMA' group by 1")
def _(s, d):
    m = views.item_edges(s, d).where("relation = 'HAS_KARMA'")
    return m.groupBy(text.key(F.col("dst")).alias("filler_key")).agg(F.count_distinct("src").alias("n"), F.min("src").alias("first"), F.max("src").alias("last"))


@q("agg03_edge_distribution", f"with {ME} select relation, count(*) n from m group by 1")
def _(s, d):
    return views.item_edges(s, d).groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation")


@q("agg04_ingestion_stats", f"with {LOG} select count(*) total, count_if(status = 'completed') ok, round(count_if(status = 'completed') / count(*), 9) rate from lg")
def _(s, d):
    ok = F.count_if(F.col("status") == "completed")
    return oplog.op_log(table(s, d, "events")).agg(F.count("*").alias("total"), ok.alias("ok"), F.round(F.try_divide(ok, F.count("*")), 9).alias("rate"))


@q("agg05_failure_reasons", f"with {LOG} select status, count(*) n from lg where status <> 'completed' group by 1")
def _(s, d):
    return oplog.op_log(table(s, d, "events")).where("status <> 'completed'").groupBy("status").agg(F.count("*").alias("n"))


@q("agg06_optimisation_stats", f"with {LOG} select operation, round(avg(duration_ms), 6) avg_all, round(avg(duration_ms) filter (where status = 'completed'), 6) avg_ok, count_if(reasoning) n_reasoning from lg group by 1")
def _(s, d):
    ok = F.when(F.col("status") == "completed", F.col("duration_ms"))
    return oplog.op_log(table(s, d, "events")).groupBy("operation").agg(F.round(F.avg("duration_ms"), 6).alias("avg_all"), F.round(F.avg(ok), 6).alias("avg_ok"), F.count_if("reasoning").alias("n_reasoning"))


@q("agg07_lines_with_kriya", "select o_custkey, count(distinct o_orderdate) n from orders where o_orderstatus = 'F' group by 1")
def _(s, d):
    return table(s, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count_distinct("o_orderdate").alias("n"))


@q("agg08_ensemble_score", "select user_id, coalesce(round(avg(case when floor(value) between 1 and 100 then floor(value) end), 9), 1.0) score from events group by 1")
def _(s, d):
    score = F.avg(text.valid_score(F.col("value").cast("string")))
    return table(s, d, "events").groupBy("user_id").agg(F.coalesce(F.round(score, 9), F.lit(1.0)).alias("score"))


@q("agg10_status_counts", f"with {LOG} select user_id, count(*) n, count_if(status = 'completed') done, count_if(status = 'failed') failed, count_if(status = 'pending') pending from lg group by 1")
def _(s, d):
    c = lambda x: F.count_if(F.col("status") == x)
    return oplog.op_log(table(s, d, "events")).groupBy("user_id").agg(F.count("*").alias("n"), c("completed").alias("done"), c("failed").alias("failed"), c("pending").alias("pending"))


@q("agg11_max_offset", "select coalesce(max(n_chars), 0) top from documents where source = 'none'")
def _(s, d):
    return table(s, d, "documents").where("source = 'none'").agg(F.coalesce(F.max("n_chars"), F.lit(0)).alias("top"))


@q("agg12_pending_gate", f"with {LOG} select user_id, count_if(status not in ('completed', 'failed')) open from lg group by 1")
def _(s, d):
    return oplog.op_log(table(s, d, "events")).groupBy("user_id").agg(F.count_if(~F.col("status").isin("completed", "failed")).alias("open"))


@q("agg13_operation_performance", f"with {LOG} select operation, round(avg(duration_ms), 6) avg_ms, count(*) n, count_if(status = 'failed') n_failed from lg group by 1")
def _(s, d):
    return oplog.performance(oplog.op_log(table(s, d, "events")))


@q("agg14_reasoning_usage", f"with {LOG} select operation, reasoning, count(*) n, round(avg(tokens), 6) avg_tokens from lg group by all")
def _(s, d):
    return oplog.op_log(table(s, d, "events")).groupBy("operation", "reasoning").agg(F.count("*").alias("n"), F.round(F.avg("tokens"), 6).alias("avg_tokens"))


@q("agg15_success_by_provider", f"with {LOG} select provider, count(*) n, count_if(status = 'completed') n_ok, round(100.0::double * count_if(status = 'completed') / count(*), 2) success_rate from lg group by 1")
def _(s, d):
    return oplog.success_by_provider(oplog.op_log(table(s, d, "events")))


@q("agg16_token_impact", f"with {LOG} select provider, reasoning, round(avg(tokens), 6) avg_tokens, max(tokens) top from lg group by all")
def _(s, d):
    return oplog.op_log(table(s, d, "events")).groupBy("provider", "reasoning").agg(F.round(F.avg("tokens"), 6).alias("avg_tokens"), F.max("tokens").alias("top"))


@q("agg17_regenerations", "select sha256(text) h, count(*) n from documents group by text having count(*) > 1")
def _(s, d):
    return table(s, d, "documents").groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("h")).agg(F.count("*").alias("n")).where("n > 1")


@q("agg18_worker_counters", f"with {LOG} select provider, sum(case status when 'pending' then 1 when 'failed' then -1 else 0 end)::bigint load from lg group by 1")
def _(s, d):
    delta = F.when(F.col("status") == "pending", 1).when(F.col("status") == "failed", -1).otherwise(0)
    return oplog.op_log(table(s, d, "events")).groupBy("provider").agg(F.sum(delta).alias("load"))


@q("agg19_composite_frames", f"with {EF} select karta, kriya, min(ts) begin, max(ts) finish, count(*) n, count(distinct karma) n_karma from e group by all")
def _(s, d):
    return views.event_frames(s, d).groupBy("karta", "kriya").agg(F.min("ts").alias("begin"), F.max("ts").alias("finish"), F.count("*").alias("n"), F.count_distinct("karma").alias("n_karma"))


@q("agg20_coherence", "select label, round(sum(list_inner_product(s, s)) / max(n * n), 6) coherence from (select label, list(x order by p) s, max(n) n from (select label, p, sum(x) x, count(*) n from (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) p from embeddings) group by label, p) group by label) group by label")
def _(s, d):
    # unit vectors: the sum of all pairwise cosines is the squared norm of the sum
    e = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    sums = e.groupBy("label", "p").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return sums.groupBy("label").agg(F.round(F.sum(F.col("x") * F.col("x")) / F.max(F.col("n") * F.col("n")), 6).alias("coherence"))


@q("agg21_co_access", "with u as (select distinct l_orderkey k, l_suppkey s from lineitem) select a.s a, b.s b, count(*) n from u a join u b on a.k = b.k and a.s < b.s group by all having count(*) >= 3")
def _(s, d):
    return clusters.co_accesses(table(s, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("frame")), 3)


@q("agg22_how_many", f"with {EF} select count(distinct karta) n from e where kriya = 'purchase'")
def _(s, d):
    return views.event_frames(s, d).where("kriya = 'purchase'").agg(F.count_distinct("karta").alias("n"))


@q("agg23_event_merge", f"with {EF} select karta, kriya, date_trunc('day', ts) as day, count(*) n from e group by all")
def _(s, d):
    return views.event_frames(s, d).groupBy("karta", "kriya", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))


@q("agg25_progress", "select doc_id, round(least(n_chars, 1000) * 100.0::double / n_chars, 2) pct from documents where n_chars > 0")
def _(s, d):
    return table(s, d, "documents").where("n_chars > 0").select("doc_id", F.round(F.least("n_chars", F.lit(1000)) * F.lit(100.0) / F.col("n_chars"), 2).alias("pct"))


@q("agg26_confidence_rules", f"with {_ID}, g as (select src, list(1.0::double / (1 + dst - src)) c from i group by 1) select src, round(list_product(c), 12) p, round(list_min(c), 9) lo from g")
def _(s, d):
    g = _identities(s, d).groupBy("src").agg(F.collect_list(F.lit(1.0) / (1 + F.col("dst") - F.col("src"))).alias("c"))
    none = F.array().cast("array<double>")
    return g.select("src", F.round(belief.combined(F.array_sort("c"), none), 12).alias("p"), F.round(belief.combined(F.col("c"), none, "min"), 9).alias("lo"))


# --- windows, ranking, sets


@q("win01_adjacent_pairs", f"with {CA} select src, dst from ca")
def _(s, d):
    return views.adjacent(views.event_frames(s, d))


@q("win02_sequence_numbers", f"with {EF} select frame_id, row_number() over (partition by karta order by ts, event_id)::int - 1 seq from e")
def _(s, d):
    return views.event_frames(s, d).select("frame_id", (F.row_number().over(Window.partitionBy("karta").orderBy("ts", "event_id")) - 1).alias("seq"))


@q("win03_document_sequence", f"with {SE} select doc_id, line, sum(length(sentence)) over (partition by doc_id order by line)::bigint - length(sentence) start from se")
def _(s, d):
    w = Window.partitionBy("doc_id").orderBy("line")
    return views.document_sentences(s, d).select("doc_id", "line", (F.sum(F.length("sentence")).over(w) - F.length("sentence")).alias("start"))


@q("win05_next_pending", f"with {LOG} select user_id, min_by(event_id, (ts, event_id)) nxt from lg where status = 'pending' group by 1")
def _(s, d):
    return oplog.op_log(table(s, d, "events")).where("status = 'pending'").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("nxt"))


@q("win07_state_supersession", f"with {EF} select frame_id, lead(ts) over w valid_to, lead(frame_id) over w closed_by from e window w as (partition by karta, kriya order by ts, event_id)")
def _(s, d):
    w = Window.partitionBy("karta", "kriya").orderBy("ts", "event_id")
    return views.event_frames(s, d).select("frame_id", F.lead("ts").over(w).alias("valid_to"), F.lead("frame_id").over(w).alias("closed_by"))


@q("win09_first_per_key", "select text_hash, doc_id from (select sha256(text) text_hash, doc_id, row_number() over (partition by text order by doc_id) r from documents where text <> '') where r = 1")
def _(s, d):
    x = table(s, d, "documents").where("text <> ''").groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("text_hash"))
    return x.agg(F.min("doc_id").alias("doc_id"))


@q("win10_latest_version", "select user_id, max_by(event_id, (ts, event_id)) latest from events group by 1")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


_SCORE = "case when contains(kriya, 'ful') then 3 else 0 end + case when contains(x, 'building') then 2 else 0 end + case when contains(x, 'nation_1') then 2 else 0 end"
_KW = f"k as (select *, {_SCORE} score from (select *, lower(concat_ws(' ', karta, kriya, 'about', locus_topic)) || '|' || lower(concat_ws(' ', karta, sampradana, locus_time, locus_space)) x from o))"


@q("top01_keyword_rank", f"with {OF}, {_KW} select frame_id, score from k where score > 0")
def _(s, d):
    return frames.keyword_rank(views.order_frames(s, d), ["ful"], ["building", "nation_1"]).select("frame_id", "score")


@q("top02_keyword_fallback", f"with {OF} select frame_id, 0 score from o")
def _(s, d):
    return frames.keyword_rank(views.order_frames(s, d), ["zzz"], ["qqq"], fallback=True).select("frame_id", "score")


@q("top03_knn_l2", "select query_id, vec_id, r::int rank from (select q.vec_id query_id, e.vec_id, row_number() over (partition by q.vec_id order by list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::double - e.embedding[i]::double) * (q.embedding[i]::double - e.embedding[i]::double))), e.vec_id) r from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 100 = 0) where r <= 5")
def _(s, d):
    e = table(s, d, "embeddings")
    return frames.nearest(e, e.where("vec_id % 100 = 0"), 5)


@q("top04_cosine", "select query_id, vec_id, r::int rank from (select q.vec_id query_id, e.vec_id, row_number() over (partition by q.vec_id order by list_cosine_similarity(q.embedding::double[], e.embedding::double[]) desc, e.vec_id) r from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 100 = 0) where r <= 5")
def _(s, d):
    e = table(s, d, "embeddings")
    return frames.nearest(e, e.where("vec_id % 100 = 0"), 5, "cosine")


@q("top05_queue_head", "select o_custkey, min_by(o_orderkey, (o_orderpriority, o_orderdate, o_orderkey)) head from orders where o_orderstatus = 'O' group by 1")
def _(s, d):
    return table(s, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderpriority", "o_orderdate", "o_orderkey")).alias("head"))


@q("top06_best_worker", "select s_nationkey, s_suppkey from (select *, row_number() over (partition by s_nationkey order by s_suppkey % 3, s_acctbal desc, s_suppkey) r from supplier) where r = 1")
def _(s, d):
    return frames.top_per(table(s, d, "supplier"), ["s_nationkey"], [F.col("s_suppkey") % 3, F.desc("s_acctbal"), F.col("s_suppkey")]).select("s_nationkey", "s_suppkey")


@q("top07_provider_pick", "select p_brand, max_by(p_partkey, (p_retailprice, -p_partkey)) best from part group by 1")
def _(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("best"))


@q("top08_select_candidate", "with c as (select user_id, event_id pos, coalesce(list_avg(list_filter([floor(value)::int, (event_id % 130)::int], lambda x: x between 1 and 100)), 1.0) score from events) select user_id, pos, round(score, 9) score from (select *, row_number() over (partition by user_id order by score desc, pos) r from c) where r = 1")
def _(s, d):
    c = table(s, d, "events").select("user_id", F.col("event_id").alias("pos"), F.array(F.floor("value").cast("int"), (F.col("event_id") % 130).cast("int")).alias("scores"))
    return frames.select_candidate(c, ["user_id"]).select("user_id", "pos", F.round("score", 9).alias("score"))


@q("top10_context", f"with {SE} select doc_id, string_agg('[' || doc_id || ', Line ' || line || ']: ' || trim(sentence, E' \\n\\t\\r'), chr(10) order by line) context from se group by 1")
def _(s, d):
    x = views.document_sentences(s, d)
    said = F.concat(F.lit("["), "doc_id", F.lit(", Line "), "line", F.lit("]: "), text.strip(F.col("sentence")))
    rows = x.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", said.alias("t")))).alias("a"))
    return rows.select("doc_id", F.array_join(F.transform("a", lambda e: e["t"]), "\n").alias("context"))


@q("top11_citation_limit", "select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderkey) filter (where r <= 3) shown, greatest(count(*) - 3, 0) more from (select *, row_number() over (partition by o_custkey order by o_orderkey) r from orders) group by 1")
def _(s, d):
    # only three rows a customer are gathered
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(s, d, "orders").select("o_custkey", "o_orderkey")
    first = o.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"))
    more = o.groupBy("o_custkey").agg(F.greatest(F.count("*") - 3, F.lit(0)).alias("more"))
    return first.join(more, "o_custkey").select("o_custkey", F.array_join(F.col("a").cast("array<string>"), ",").alias("shown"), "more")


@q("top13_weakest_identity", f"with {_ID} select src, min_by(dst, (1.0 / (1 + dst - src), dst)) weakest from i group by 1")
def _(s, d):
    return _identities(s, d).groupBy("src").agg(F.min_by("dst", F.struct(F.lit(1.0) / (1 + F.col("dst") - F.col("src")), "dst")).alias("weakest"))


@q("set01_neighbour_union", f"with {CA} select src frame_id, dst node from ca union select dst, src from ca")
def _(s, d):
    c = views.adjacent(views.event_frames(s, d))
    return c.select(F.col("src").alias("frame_id"), F.col("dst").alias("node")).union(c.select("dst", "src")).distinct()


@q("set04_intersection", f"with {OF} select karta from o where kriya = 'open' intersect select karta from o where kriya = 'fulfil'")
def _(s, d):
    o = views.order_frames(s, d)
    return o.where("kriya = 'open'").select("karta").intersect(o.where("kriya = 'fulfil'").select("karta"))


@q("set05_difference", f"with {OF} select karta from o where kriya = 'open' except select karta from o where kriya = 'fulfil'")
def _(s, d):
    o = views.order_frames(s, d)
    return o.where("kriya = 'open'").select("karta").subtract(o.where("kriya = 'fulfil'").select("karta"))


@q("set06_content_hash_dedup", f"with {SE} select h, min(doc_id) first_doc, count(*) n from (select doc_id, sha256(trim(regexp_replace(translate(sentence, '“”‘’', '\"\"'''''), '\\s+', ' ', 'g'))) h from se) group by 1")
def _(s, d):
    x = views.document_sentences(s, d).select("doc_id", text.sentence_hash(F.encode("sentence", "UTF-8").cast("string")).alias("h"))
    return x.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@q("set07_keep_first_pool", f"with {CA} select node, min(o) src_order from (select src node, 0 o from ca union all select dst, 1 from ca) group by 1")
def _(s, d):
    c = views.adjacent(views.event_frames(s, d))
    return c.select(F.col("src").alias("node"), F.lit(0).alias("o")).union(c.select("dst", F.lit(1))).groupBy("node").agg(F.min("o").alias("src_order"))


# --- texts and functions


@q("str01_keys", "select c_custkey, lower(trim(c_name)) k from customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", text.key(F.concat(F.lit(" \t"), "c_name", F.lit(" \n"))).alias("k"))


@q("str02_canonical_text", f"with {OF} select frame_id, karta || ' ' || kriya || ' about ' || locus_topic t from o")
def _(s, d):
    return views.order_frames(s, d).select("frame_id", text.canonical_text({c: F.col(c) for c in ("karta", "kriya", "karma", "karana", "locus_topic")}).alias("t"))


@q("str03_sentence_split", f"with {SE} select doc_id, line, sentence from se")
def _(s, d):
    return views.document_sentences(s, d).select("doc_id", F.col("line"), "sentence")


@q("str04_split_fidelity", "select doc_id, true lossless from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text.lossless(text.sentences(F.col("text")), F.col("text")).alias("lossless"))


@q("str08_paragraphs", "select doc_id, len(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p, E' \\n\\t\\r')), lambda p: p <> '')) n from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.size(text.paragraphs(F.col("text"))).cast("bigint").alias("n"))


@q("str10_token_windows", "select doc_id, len(list_filter(range(0, greatest(n - 1, 0) + 1, 80), lambda i: i = 0 or i + 20 < n)) windows from (select doc_id, len(string_split(text, ' ')) n from documents)")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.size(text.windows_of(F.split("text", " "), 100, 20)).cast("bigint").alias("windows"))


@q("str14_normalised", "select doc_id, sha256(trim(regexp_replace(translate(text, '“”‘’', '\"\"'''''), '\\s+', ' ', 'g'))) h from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(F.encode(text.normalised_sentence(F.col("text")), "UTF-8"), 256).alias("h"))


@q("str15_coverage", "select item_id, doc_id, position(b.text in d.text) place from benchmark b join documents d on contains(d.text, b.text) where length(b.text) > 0")
def _(s, d):
    return containment.occurrences(table(s, d, "documents"), table(s, d, "benchmark").where("length(text) > 0")).select("item_id", "doc_id", "place")


@q("str18_token_estimate", "select doc_id, case when coalesce(text, '') = '' then 0 else greatest(1, length(text) // 4) end tokens from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@q("str19_template", f"with {OF} select frame_id, 'Did ' || karta || ' ' || kriya || ' {{X}}?' t from o")
def _(s, d):
    m = F.create_map(F.lit("WHO"), F.col("karta"), F.lit("ACT"), F.col("kriya"))
    return views.order_frames(s, d).select("frame_id", text.fill_template(F.lit("Did {WHO} {ACT} {X}?"), m).alias("t"))


@q("str20_grounding", "select item_id, count(d.doc_id) n from benchmark b left join documents d on contains(lower(d.text), lower(b.text)) group by 1")
def _(s, d):
    b = table(s, d, "benchmark")
    n = containment.occurrences(table(s, d, "documents"), b, fold=True).groupBy("item_id").agg(F.count("doc_id").alias("n"))
    return b.select("item_id").distinct().join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))


_PRON = "'he', 'she', 'it', 'they', 'him', 'her', 'his', 'hers', 'its', 'their', 'theirs', 'which', 'that', 'who', 'whom', 'this', 'these', 'those'"


@q("str21_pronoun_scan", f"select conv_id, turn, len(list_filter(string_split(text, ' '), lambda w: lower(trim(w, E' \\n\\t\\r')) in ({_PRON}))) n from conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.size(F.filter(F.split("text", " "), text.is_pronoun)).cast("bigint").alias("n"))


_META = r"(?:king|lord|master|father|mother|son|daughter) of [\pL\pM\pN_]|[\pL\pM\pN_] the [\pL\pM\pN_]"


@q("str22_metaphor_scan", f"with {SE} select doc_id, line from se where regexp_matches(lower(sentence), '{_META}')")
def _(s, d):
    return views.document_sentences(s, d).where(text.is_metaphor(F.col("sentence"))).select("doc_id", "line")


@q("str23_reasoning", "select conv_id, turn, trim(regexp_extract('<think>' || text || '</think> x', '(?s)<think>(.*?)</think>', 1), E' \\n\\t\\r') r from conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", text.reasoning(F.concat(F.lit("<think>"), "text", F.lit("</think> x"))).alias("r"))


_RAW = ["Processing_FAILED", "queued", "upload_pending", "pending", "RUNNING", "in_progress", "processing_completed", "Succeeded", "done", "finished late", "stopped", "processing upload", "new", "completing"]


@q("str24_status", f"select event_id, case when regexp_matches(s, 'completed|succeeded|done|finished') then 'completed' when regexp_matches(s, 'failed|error|stopped') then 'failed' when regexp_matches(s, 'processing|running|in_progress|queued') then 'processing' when contains(s, 'upload') then 'uploading' when contains(s, 'pending') then 'pending' else 'unknown' end st from (select event_id, lower({_RAW}[event_id % 14 + 1] || ' ' || event_type) s from events)")
def _(s, d):
    raw = F.concat(F.element_at(F.array(*map(F.lit, _RAW)), (F.col("event_id") % 14 + 1).cast("int")), F.lit(" "), "event_type")
    return table(s, d, "events").select("event_id", text.status(raw).alias("st"))


@q("str25_question_kind", "select conv_id, turn, case when contains(t, 'who') or contains(t, 'agent') then 'agent' when contains(t, 'what') and (contains(t, 'happen') or contains(t, 'did')) then 'event' when contains(t, 'where') then 'location' when contains(t, 'when') then 'time' when contains(t, 'how') then 'method' else 'general' end kind from (select *, lower(text) t from conversations)")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", text.question_kind(F.col("text")).alias("kind"))


_ASK = " ".join(
    f"when regexp_matches(t, '(?:^|[^\\pL\\pN_])(?:{words})(?:[^\\pL\\pN_]|$)') then '{role}'"
    for words, role in [
        ("from where|from whom", "apadana"), ("to whom|for whom", "sampradana"), ("with what", "karana"), ("by whom", "karta"), ("about what", "locus_topic"),
        ("who", "karta"), ("whom|what", "karma"), ("how", "karana"), ("when", "locus_time"), ("where", "locus_space"),
    ]
)


@q("str26_asked_role", f"select conv_id, turn, case {_ASK} end as role from (select *, lower(text) t from conversations)")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", text.asked_role(F.col("text")).alias("role"))


@q("str27_keywords", "select conv_id, turn, len(list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 3)) n from conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.size(text.keywords(F.col("text"))).cast("bigint").alias("n"))


_SAID = ["Request TIMEOUT", "HTTP 429", "limit of tokens reached", "Authentication missing", "Network down", "cannot parse", "odd", "Rate Limit", "status 401", "connection lost", "bad JSON"]


@q("str28_error_codes", f"select frame_id, case when contains(m, 'timeout') then 'LLM_TIMEOUT' when contains(m, 'rate limit') or contains(m, '429') then 'LLM_RATE_LIMIT' when contains(m, 'token') and contains(m, 'limit') then 'LLM_TOKEN_LIMIT' when contains(m, 'authentication') or contains(m, '401') then 'LLM_AUTH_ERROR' when contains(m, 'connection') or contains(m, 'network') then 'LLM_CONNECTION_ERROR' when contains(m, 'json') or contains(m, 'parse') then 'LLM_RESPONSE_PARSE_ERROR' else 'LLM_UNKNOWN_ERROR' end code from (select 'E' || event_id frame_id, lower({_SAID}[event_id % 11 + 1] || ' ' || event_id) m from events)")
def _(s, d):
    m = F.concat(F.element_at(F.array(*map(F.lit, _SAID)), (F.col("event_id") % 11 + 1).cast("int")), F.lit(" "), "event_id")
    return table(s, d, "events").select(F.concat(F.lit("E"), "event_id").alias("frame_id"), text.error_code(m).alias("code"))


@q("fn02_expiry", "select event_id, case when ts > timestamp '2024-01-15' then ts + interval 15 minute else ts end expires from events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.when(F.col("ts") > F.lit("2024-01-15").cast("timestamp"), F.col("ts") + F.expr("INTERVAL 15 MINUTES")).otherwise(F.col("ts")).alias("expires"))


@q("fn03_cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def _(s, d):
    e = table(s, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("b")), 6).alias("c"))


@q("fn04_mean_pool", "select label, p::int p, round(x, 6) x from (select label, p, avg(x) x from (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 p from embeddings) group by all)")
def _(s, d):
    return table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x")).groupBy("label", "p").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


@q("fn07_cache_keys", "select doc_id, md5(lang || ':' || text) k from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(F.encode(F.concat("lang", F.lit(":"), "text"), "UTF-8")).alias("k"))


@q("fn15_json_fields", "select event_id, json_extract_string(props, '$.k') k from events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k"))


@q("fn19_token_limits", "select doc_id, case when n_chars // 4 > 2000 then 'too long' when n_chars // 4 > 1000 then 'near limit' else 'ok' end verdict from documents")
def _(s, d):
    n = F.floor(F.col("n_chars") / 4)
    return table(s, d, "documents").select("doc_id", F.when(n > 2000, "too long").when(n > 1000, "near limit").otherwise("ok").alias("verdict"))


@q("fn21_retry_transition", f"with {LOG} select event_id, event_id % 6 retry_count, case when event_id % 6 <= 3 then 'pending' else 'failed' end new_status, case when event_id % 6 <= 3 then greatest(1, user_id % 5) else user_id % 5 + 1 end priority, case when event_id % 6 > 3 then 'MAX_RETRIES_EXCEEDED' end error_code from lg where status = 'failed'")
def _(s, d):
    return oplog.retried(oplog.op_log(table(s, d, "events")))


@q("fn22_context_clamp", "select doc_id, greatest(0, doc_id % 700 - 300) low, least(n_chars, doc_id % 700 + 300) high from documents")
def _(s, d):
    at = F.col("doc_id") % 700
    return table(s, d, "documents").select("doc_id", F.greatest(F.lit(0), at - 300).alias("low"), F.least("n_chars", at + 300).alias("high"))


@q("fn23_chunk_boundaries", "select doc_id, b * 600 as start, least((b + 1) * 600, n) stop from (select doc_id, strlen(text) n, unnest(range(0, (strlen(text) + 599) // 600)) b from documents where text <> '')")
def _(s, d):
    x = table(s, d, "documents").where("text <> ''").select("doc_id", F.octet_length("text").cast("bigint").alias("n"))
    y = x.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / 600))).alias("b"))
    return y.select("doc_id", (F.col("b") * 600).alias("start"), F.least((F.col("b") + 1) * 600, "n").alias("stop"))


# --- graph export, pipeline operators, validators


@q("src07_graph_edges", f"with {PT} select frame_id, role, lower(trim(filler)) filler_key from pt")
def _(s, d):
    return frames.graph_edges(views.order_frames(s, d)).select("frame_id", "role", "filler_key")


@q("pip05_best_variation", "select l_orderkey, l_partkey, consensus from (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_partkey, l_suppkey) r, min(l_returnflag) over (partition by l_orderkey) = max(l_returnflag) over (partition by l_orderkey) consensus from lineitem) where r = 1")
def _(s, d):
    li = table(s, d, "lineitem")
    g = li.groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_quantity", -F.col("l_partkey"), -F.col("l_suppkey"))).alias("l_partkey"), F.min("l_returnflag").alias("a"), F.max("l_returnflag").alias("b"))
    return g.select("l_orderkey", "l_partkey", (F.col("a") == F.col("b")).alias("consensus"))


@q("pip12_multi_step", f"with {ME} select 1 step, src frame_id from m where relation = 'FROM_APĀDĀNA' and dst = 'Supplier#000000001' group by src union all select 2, src from m where relation = 'FROM_APĀDĀNA' and dst = 'Supplier#000000002' group by src")
def _(s, d):
    return plans.run_steps(views.item_edges(s, d), [plans.Step({"apadana": "Supplier#000000001"}), plans.Step({"apadana": "Supplier#000000002"})])


_ASKED = f"with {CA}, {OF}, {_KW}, ln as (select 'O' || o_orderkey src, 'O' || nx dst from (select o_orderkey, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) nx from orders) where nx is not null), h as (select frame_id, score from k where score > 0), g as (select frame_id, score, 0 hop from h union all select distinct n, 0, 1 from (select dst n from ln join h on src = frame_id union all select src from ln join h on dst = frame_id) where n not in (select frame_id from h))"


@q("ask_ranked_with_citations", _ASKED + " select frame_id, score, hop, '[' || frame_id || '] ' || karta || ' ' || kriya || ' in ' || locus_space || ' on ' || locus_time citation from g join o using (frame_id)")
def _(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    nxt = table(s, d, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("src"), F.concat(F.lit("O"), F.lead("o_orderkey").over(w)).alias("dst")).where("dst is not null")
    return plans.ask(views.order_frames(s, d), nxt, ["ful"], ["building", "nation_1"])


@q("pip15_projection", f"with recursive {_ID}, y as (select src, dst from i union select dst, src from i), r as (select src node, dst other from y union select r.node, y.dst from r join y on r.other = y.src), k as (select node, least(node, min(other)) c from r group by node) select coalesce(c, o_custkey) canonical, count(*) n, min(o_orderkey) first, round(sum(o_totalprice), 2) total from orders left join k on o_custkey = node group by 1")
def _(s, d):
    k = graph.equivalence(_identities(s, d)).select(F.col("node").alias("o_custkey"), "canonical")
    j = table(s, d, "orders").join(k, "o_custkey", "left").withColumn("canonical", F.coalesce("canonical", "o_custkey"))
    return j.groupBy("canonical").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.round(F.sum("o_totalprice"), 2).alias("total"))


GOLDEN = "('f1', 'eat', array('ram_p5'), 0.95, 'd', true), ('f2', 'king', array('ram_p50'), 0.90, 'd', true), ('id1', '≡', array('ram_p5', 'ram_p50'), 0.75, 'd', true), ('d1', 'derive', array('proj_king_eats', 'f1', 'f2', 'id1'), 0.68, 'd', true)"


@q("pip17_invalidate_cascade", "select unnest(['f1', 'f2', 'rid1', 'tid1']) id")
def _(s, d):
    atoms = s.sql(f"select id, symbol, arguments, cast(confidence as double) confidence, source, active from values {GOLDEN} as t(id, symbol, arguments, confidence, source, active)")
    return belief.active_atoms(belief.invalidate_identity(atoms, "id1")).select("id")


@q("pip20_contradictions", f"with {EF} select a.frame_id winner, b.frame_id loser from e a join e b on a.karta = b.karta and a.kriya = b.kriya and a.karma = b.karma and (a.ts, a.event_id) > (b.ts, b.event_id) and a.value <> b.value")
def _(s, d):
    a, b = views.event_frames(s, d).alias("a"), views.event_frames(s, d).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("karta", "kriya", "karma")]
    later = F.struct("a.ts", "a.event_id") > F.struct("b.ts", "b.event_id")
    return a.join(b, same[0] & same[1] & same[2] & later & (F.col("a.value") != F.col("b.value"))).select(F.col("a.frame_id").alias("winner"), F.col("b.frame_id").alias("loser"))


@q("pip31_hypotheses", f"with {EF} select karta, frame_id, rank() over (partition by karta, kriya order by value desc)::int place from e where value > 20")
def _(s, d):
    w = Window.partitionBy("karta", "kriya").orderBy(F.desc("value"))
    return views.event_frames(s, d).where("value > 20").select("karta", "frame_id", F.rank().over(w).alias("place"))


@q("pip32_pov_divergence", f"with {_ID} select src, dst from i where (dst - src <= 10) <> (dst - src <= 20)")
def _(s, d):
    i = _identities(s, d)
    gap = F.col("dst") - F.col("src")
    return i.where((gap <= 10) != (gap <= 20))


@q("pip34_ellipsis", f"with {EF} select frame_id, last_value(nullif(kriya, 'view') ignore nulls) over (partition by karta order by ts, event_id rows unbounded preceding) kriya from e")
def _(s, d):
    w = Window.partitionBy("karta").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return views.event_frames(s, d).select("frame_id", F.last(F.nullif(F.col("kriya"), F.lit("view")), ignorenulls=True).over(w).alias("kriya"))


@q("val02_actions_without_roles", f"with {EF} select frame_id from e where length(karma) < 2")
def _(s, d):
    e = views.event_frames(s, d)
    return quality.without_participants(e, e.where("length(karma) > 1").select("frame_id")).select("frame_id")


@q("val08_bad_types", f"with {ME} select src, dst from m where relation <> 'HAS_KARMA'")
def _(s, d):
    return quality.bad_types(views.item_edges(s, d), "relation", ["HAS_KARMA"]).select("src", "dst")


@q("val09_duplicate_keys", "select l_orderkey, l_linenumber, count(*) n from lineitem group by all having count(*) > 1")
def _(s, d):
    return quality.duplicates(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@q("val10_orphans", "select l.doc_id from labels l where l.doc_id not in (select doc_id from documents where lang = 'en')")
def _(s, d):
    return quality.orphans(table(s, d, "labels"), "doc_id", table(s, d, "documents").where("lang = 'en'"), "doc_id").select("doc_id")


@q("val11_several_roles", f"with {ME} select src frame_id, dst filler_key, count(*) n from m group by all having count(*) > 1")
def _(s, d):
    return quality.several_roles(views.item_edges(s, d).select(F.col("src").alias("frame_id"), F.col("dst").alias("filler_key")))


@q("val13_illegal_moves", f"with {LOG} select id, before, after from (select user_id id, lag(status) over (partition by user_id order by ts, event_id) before, status after from lg) where before <> after and (before, after) not in (('pending', 'completed'), ('pending', 'failed'))")
def _(s, d):
    h = oplog.op_log(table(s, d, "events")).select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("seq"), "status")
    return quality.illegal_moves(h, [("pending", "completed"), ("pending", "failed")])


@q("stm01_sentence_stream")
def _(s, d):
    return streams.run_once(streams.sentence_stream(streams.stream_table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), "text")), "append")


@q("stm03_frame_counts", "select event_type kriya, count(*) n from events group by 1")
def _(s, d):
    return streams.run_once(streams.frame_counts(streams.stream_table(s, d, "events").select(F.col("event_type").alias("kriya"))), "complete")


from . import deep, extended, lineal, located  # noqa: E402,F401  register the rest with q
