"""Queries over long paths, cycles, corrections, the graph writer and merged facts, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chains, correction, extract, facts, graphwriter
from ..operators.graph import shared_folder
from ..sources import views
from .registry import _ID, CA, EF, OF, _identities, q


@q("jn17_identity_confidence", f"with recursive {_ID}, ic as (select src, dst, 1.0::double / (1 + dst - src) c from i), p as (select src, dst, c conf, 1 h from ic union all select p.src, ic.dst, p.conf * ic.c, h + 1 from p join ic on p.dst = ic.src where h < 3) select src, dst, round(max(conf), 9) conf from p group by all")
def _(s, d):
    i = _identities(s, d).withColumn("conf", F.lit(1.0) / (1 + F.col("dst") - F.col("src")))
    return chains.confidence_closure(i, max_hops=3).select("src", "dst", F.round("conf", 9).alias("conf"))


@q("jn18_provenance", f"with recursive {CA}, t as (select 'E9' node, 0 depth union select dst, depth + 1 from t join ca on src = node) select node, min(depth)::int depth from t group by 1")
def _(s, d):
    return chains.distances(views.adjacent(views.event_frames(s, d)), s.sql("select 'E9' as node")).select("node", F.col("steps").cast("int").alias("depth"))


@q("win08_multi_index_ranks", f"with {EF}, g as (select *, case when ts <= lag(ts) over w + interval 3 hour then 0 else 1 end cut from e window w as (partition by karta order by ts, event_id)), h as (select *, sum(cut) over (partition by karta order by ts, event_id rows unbounded preceding) run from g) select frame_id, rank() over (partition by karta order by event_id)::int alpha, (row_number() over (partition by karta, run order by ts, event_id) - 1)::bigint psi, rank() over (partition by karta order by ts)::int tau, dense_rank() over (partition by karta order by value desc)::int omega from h")
def _(s, d):
    e = views.event_frames(s, d)
    psi = chains.longest_depth(views.adjacent(e)).withColumnRenamed("node", "frame_id")
    w = Window.partitionBy("karta")
    ranks = e.select("frame_id", F.rank().over(w.orderBy("event_id")).alias("alpha"), F.rank().over(w.orderBy("ts")).alias("tau"), F.dense_rank().over(w.orderBy(F.desc("value"))).alias("omega"))
    return ranks.join(psi, "frame_id", "left").select("frame_id", "alpha", F.coalesce("psi", F.lit(0)).alias("psi"), "tau", "omega")


_STATES = f"""{EF}, n as (select karta || ':' || kriya src, lead(karta || ':' || kriya) over w dst, lead(ts) over w "at", karta from e window w as (partition by karta order by ts, event_id)), ev as (select distinct src, dst, "at" from n where dst is not null)"""


@q(
    "pip21_causal_paradoxes",
    f"""with recursive {_STATES}, g as (select distinct src a, dst b from ev where src <> dst), r as (select a, b from g union select r.a, g.b from r join g on r.b = g.a),
 k as (select x.a node, min(x.b) component from r x join r y on x.a = y.b and x.b = y.a group by 1),
 o as (select ev.*, component, row_number() over (partition by component order by "at" desc, src desc, dst desc) z from ev join k on src = k.node where src <> dst and dst in (select node from k k2 where k2.component = k.component))
select src, dst, "at", component, case z when 1 then 'SUSPECT' else 'CYCLE' end status from o union all select src, dst, "at", src, 'SELF_CAUSATION' from ev where src = dst""",
)
def _(s, d):
    state = F.concat("karta", F.lit(":"), "kriya")
    w = Window.partitionBy("karta").orderBy("ts", "event_id")
    edges = views.event_frames(s, d).select(state.alias("src"), F.lead(state).over(w).alias("dst"), F.lead("ts").over(w).alias("at"))
    return chains.causal_paradoxes(edges)


@q("pip21_cycles", "with recursive g as (select distinct l_suppkey a, l_partkey + 1 b from lineitem where l_suppkey <> l_partkey + 1 and l_partkey + 1 in (select l_suppkey from lineitem)), r as (select a, b from g union select r.a, g.b from r join g on r.b = g.a) select distinct a node from r where a = b")
def _(s, d):
    return chains.strong_components(views.table(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1).alias("dst"))).select("node")


@q("pip22_upper_bounds", f"with recursive {CA}, kn as (select frame_id ev, ts from e where kriya = 'purchase'), nd as (select src ev from ca union select dst from ca union select ev from kn), w as (select ev, ev o from nd union select w.ev, ca.dst from w join ca on w.o = ca.src where w.o not in (select ev from kn)) select nd.ev as event, case when nd.ev in (select ev from kn) then (select ts from kn where kn.ev = nd.ev) else (select min(ts) from w join kn on w.o = kn.ev where w.ev = nd.ev) end bound from nd")
def _(s, d):
    e = views.event_frames(s, d)
    before = views.adjacent(e).select(F.col("src").alias("e1"), F.col("dst").alias("e2"))
    return chains.upper_bounds(before, e.where("kriya = 'purchase'").select(F.col("frame_id").alias("event"), F.col("ts").alias("at"))).select("event", "bound")


def _conflicts(s, d):
    """Chains of two identities; one whose ends' balances differ by more than 8000 is a conflict, the others are conclusions to keep."""
    i = _identities(s, d)
    a, b = i.alias("a"), i.alias("b")
    balance = views.table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    name = lambda x: F.concat(f"{x}.src", F.lit("="), f"{x}.dst")
    both = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("k1"), F.col("b.dst").alias("k2"), name("a").alias("x"), name("b").alias("y"))
    told = both.join(balance.toDF("k1", "b1"), "k1").join(balance.toDF("k2", "b2"), "k2")
    told = told.withColumn("conclusion", F.concat("x", F.lit("&"), "y")).withColumn("wrong", F.abs(F.col("b1") - F.col("b2")) > 8000)
    return told.select("conclusion", "wrong", F.explode(F.array("x", "y")).alias("identity"))


@q("top14_minimal_correction")
def _(s, d):
    uses = _conflicts(s, d)
    false = uses.where("wrong").select("conclusion").distinct()
    costs = correction.retraction_costs(uses, false)
    return correction.minimal_correction(uses.where("wrong").select(F.col("conclusion").alias("conflict"), "identity"), costs)


def _order_roles(s, d):
    """Order frames with their filled roles; only urgent ones carry the topic, for which the graph has no relation."""
    f = views.order_frames(s, d).withColumn("locus_topic", F.when(F.col("locus_topic").startswith("1"), F.col("locus_topic")))
    return f.select("frame_id", F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("line"), "kriya", graphwriter.role_map(f).alias("roles"), F.lit(None).cast("array<struct<pronoun:string,referent:string,context:string>>").alias("hints"))


@q(
    "pip07_graph_records",
    f"""with {OF}, g as (select *, kriya || '@' || frame_id me, o_orderkey || '_L0' place from o where locus_topic not like '1%'),
 r as (select * from (select me, 'HAS_KARTĀ' relation, karta x from g union all select me, 'TARGETS_SAMPRADĀNA', sampradana from g union all select me, 'OCCURS_AT', locus_time from g union all select me, 'LOCATED_IN', locus_space from g) where trim(x) <> '')
select kind, id, type, relation, dst, note from (
 select 'node' kind, me id, 'Kriya' as type, null relation, null dst, null note from g union select 'node', place, 'Document', null, null, null from g union select 'node', lower(trim(x)), 'Entity', null, null, null from r
 union all select 'edge', me, null, 'CITED_IN', place, null from g union all select 'edge', me, null, relation, lower(trim(x)), null from r
 union all select 'quarantine', frame_id, null, null, null, 'UNKNOWN_ROLE:locus_topic' from o where locus_topic like '1%')""",
)
def _(s, d):
    path = shared_folder(s, "graph")
    for _ in range(2):  # a second run of the batch changes nothing
        graphwriter.write_graph(_order_roles(s, d), path, "orders")
    return graphwriter.read_graph(s, path).select("kind", "id", "type", "relation", "dst", "note")


@q("pip07_document_graph")
def _(s, d):
    f = extract.extract_frames(views.document_sentences(s, d))
    f = f.select("frame_id", "doc_id", "line", "kriya", graphwriter.role_map(f).alias("roles"), F.lit(None).cast("array<struct<pronoun:string,referent:string,context:string>>").alias("hints"))
    path = shared_folder(s, "graph")
    graphwriter.write_graph(f, path, "documents")
    return graphwriter.tally(graphwriter.read_graph(s, path))


@q(
    "pip20_contradiction_log",
    f"""with {EF}, f as (select event_id fact_id, karta, kriya, karma, value, ts valid_from, ts + interval 2 day valid_to, date_trunc('month', ts) recency, floor(value)::bigint % 2 = 0 explicit, floor(value * 10)::bigint % 3 authority, floor(value * 100)::bigint % 4 specificity from e where value is not null),
 b as (select *, unnest(range(epoch_ms(valid_from) // 2592000000, epoch_ms(valid_to) // 2592000000 + 1)) bucket from f),
 w as (select *, first_value(fact_id) over z w_id, first_value(value) over z w_value, first_value(valid_from) over z w_from, first_value(valid_to) over z w_to, first_value(recency) over z w1, first_value(explicit) over z w2, first_value(authority) over z w3, first_value(specificity) over z w4
  from b window z as (partition by karta, kriya, karma, bucket order by recency desc, explicit desc, authority desc, specificity desc, fact_id)),
 l as (select distinct w_id winner, fact_id loser, case when recency <> w1 then 'temporal_recency' when explicit <> w2 then 'explicit_over_inferred' when authority <> w3 then 'domain_authority' when specificity <> w4 then 'specificity' else 'manual_review' end rule
  from w where karma is not null and value <> w_value and valid_from <= w_to and w_from <= valid_to)
select *, case rule when 'manual_review' then 'CONTRADICTION_UNRESOLVED' else 'resolved' end status from l""",
)
def _(s, d):
    e = views.event_frames(s, d).where("karma is not null")
    part = lambda scale, n: F.floor(F.col("value") * scale) % n
    f = e.select(
        F.col("event_id").alias("fact_id"), "karta", "kriya", "karma", "value", F.col("ts").alias("valid_from"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("valid_to"), F.date_trunc("month", "ts").alias("recency"),
        (part(1, 2) == 0).alias("explicit"), part(10, 3).alias("authority"), part(100, 4).alias("specificity"),
    )
    return facts.contradictions(f, ["karta", "kriya", "karma"])


@q(
    "agg23_merged_events",
    f"""with {EF}, m as (select *, case kriya when 'purchase' then 'singleton' when 'view' then 'unbounded' else 'bounded' end kind from e),
 c as (select *, case when ts <= lag(ts) over w + interval 1 day then 0 else 1 end cut from m window w as (partition by karta, kriya, karma order by ts, event_id)),
 r as (select *, case kind when 'singleton' then 0 when 'unbounded' then event_id else sum(cut) over (partition by karta, kriya, karma order by ts, event_id rows unbounded preceding) end run from c)
select karta, kriya, karma, kind, min(event_id) as event, count(*) n, min(ts) first_at, max(ts) last_at, array_to_string(list_sort(list(distinct strftime(ts, '%Y-%m'))), ',') sources from r group by karta, kriya, karma, kind, run""",
)
def _(s, d):
    e = views.event_frames(s, d).withColumn("at", F.col("ts")).withColumn("source", F.date_format("ts", "yyyy-MM"))
    kind = F.when(F.col("kriya") == "purchase", "singleton").when(F.col("kriya") == "view", "unbounded").otherwise("bounded")
    return facts.merged_events(e, ["karta", "kriya", "karma"], kind).withColumn("sources", F.array_join("sources", ","))
