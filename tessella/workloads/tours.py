"""Evidence under budgets, and reading paths."""

from pyspark.sql import functions as F

from tessella.functions.text import is_test_path
from tessella.operators import code, evidence as E, mixed, retrieval, serving as S, tours as T
from tessella.plans.catalog import query, table
from tessella.workloads import hybrid as H, more
from tessella.workloads.code import _SYM, _TEST, _TEXTS
from tessella.workloads.serving import _CHECKS, checks, spans

_NUM = "array_to_string(list_transform({t}, lambda x, i: ({n} + i - 1)::varchar || ' | ' || x), chr(10))".format
_NUMBERED = f"nu as (select vt.repo_id, vt.symbol_id, {_NUM(t='string_split(body, chr(10))', n='coalesce(s.line_start, 1)')} as text from vt join {_SYM} s on s.repo_id = vt.repo_id and s.symbol_id = vt.symbol_id where body is not null and s.kind in ('function', 'method'))"


def _numbered(spark, d):
    s = table(spark, d, "symbols").distinct()
    texts = code.verified_texts(s, table(spark, d, "snapshots"))
    rows = s.filter("kind IN ('function', 'method')").select("repo_id", "symbol_id", "line_start").join(texts, ["repo_id", "symbol_id"])
    return rows.select("repo_id", "symbol_id", E.numbered(F.col("body").cast("string"), F.coalesce("line_start", F.lit(1))).alias("text"))


@query(f"with {_TEXTS}, {_NUMBERED} select repo_id, symbol_id, md5(text) as text from nu")
def v2_numbered_source(spark, d):
    return _numbered(spark, d).withColumn("text", F.md5("text"))


@query(f"""with recursive {_TEXTS}, {_NUMBERED}, o as (select tour_id as grp, symbol_id as id, min(stop_order) as rank from stops group by all), it as (select grp, id, rank, max(text) as text from o left join nu on nu.symbol_id = o.id group by all),
 r as (select *, strlen(text) as size, row_number() over (partition by grp order by rank, id) as i from it where text is not null),
 f(grp, i, room) as (select grp, 0::bigint, 3000::bigint from (select distinct grp from r) union all select f.grp, r.i, case when r.size <= f.room then f.room - r.size else f.room end from f join r on r.grp = f.grp and r.i = f.i + 1)
 select it.grp as "group", it.id, coalesce(r.size <= f.room, false) as taken, case when it.text is null then 'missing' when r.size > f.room then 'budget' end as reason from it left join r on r.grp = it.grp and r.id = it.id left join f on f.grp = r.grp and f.i = r.i - 1""")
def v1_source_sections(spark, d):
    stops = table(spark, d, "stops").groupBy(F.col("tour_id").alias("group"), F.col("symbol_id").alias("id")).agg(F.min("stop_order").alias("rank"))
    return E.sections(stops.join(_numbered(spark, d).select(F.col("symbol_id").alias("id"), "text"), "id", "left"), 3000)


_CITE = f"""{_CHECKS}, gd as (select * from ck where assertion_id not in (select assertion_id from ff)),
 uc as (select * from (select *, coalesce(max(line_end) over (partition by assertion_id, repo_id, path order by line_start, line_end desc, span_id rows between unbounded preceding and 1 preceding) >= line_end, false) as held from gd) where not held),
 rc as (select assertion_id, string_agg(path || ':' || line_start || '-' || line_end, ', ' order by path, line_start, line_end, span_id) as citations, sum(byte_end - byte_start)::bigint as size from uc group by all)"""


@query(f"with {_CITE} select * from rc")
def v3_citations(spark, d):
    return E.rendered_citations(checks(spark, d))


@query(f"""with {_CITE}, sb as (select * from (select qualname as subject, path, line_start, line_end, (byte_end - byte_start)::bigint as ssize, row_number() over (partition by qualname order by symbol_id) as n_ from {_SYM}) where n_ = 1),
 b as (select a.assertion_id, a.subject, case when n.assertion_id is null then 'no_citations' when ff.reason is not null then 'citation_' || ff.reason when rc.size > 2000 then 'budget' end as reason, rc.size from (select distinct assertion_id, subject_qualname as subject from assertions) a
  left join (select distinct assertion_id from ck) n using (assertion_id) left join ff using (assertion_id) left join rc using (assertion_id)),
 ov as (select distinct b.assertion_id from b join sb using (subject) join ck on ck.assertion_id = b.assertion_id and ck.path = sb.path where ck.line_start <= sb.line_start and ck.line_end >= sb.line_end)
 select b.assertion_id, b.reason is null as included, b.reason, case when b.reason is null then case when sb.subject is null then 'subject_not_indexed' when ov.assertion_id is not null then 'covered_by_citation' when b.size + sb.ssize > 2000 then 'budget' end end as subject_reason
 from b left join sb using (subject) left join ov using (assertion_id)""")
def v4_claim_evidence(spark, d):
    s = table(spark, d, "symbols").distinct()
    least = F.min(F.struct("symbol_id", "path", "line_start", "line_end", (F.col("byte_end") - F.col("byte_start")).cast("long").alias("size")))
    subjects = s.groupBy(F.col("qualname").alias("subject")).agg(least.alias("s")).select("subject", "s.path", "s.line_start", "s.line_end", "s.size")
    claims = table(spark, d, "assertions").select("assertion_id", F.col("subject_qualname").alias("subject"))
    return E.claim_evidence(claims, checks(spark, d), subjects, 2000)


_SIZES = f"(select 'source' as candidate_type, doc_id as id, strlen(text) as size from documents where text is not null union all select 'assertion', doc_id, max(strlen(text)) from {more._CLAIM_DOCS} group by all)"
_F14 = next(sql for name, sql in __import__("tessella.plans.catalog", fromlist=["ORACLES"]).ORACLES.items() if name == "f14_mixed_fusion")


@query(f"""with recursive m as ({_F14}), r as (select m.query_id, m.candidate_type, m.id, m.rank, s.size, row_number() over (partition by m.query_id order by m.rank) as i from m join {_SIZES} s using (candidate_type, id)),
 f(query_id, i, room) as (select query_id, 0::bigint, 1500::bigint from (select distinct query_id from r) union all select f.query_id, r.i, case when r.size <= f.room then f.room - r.size else f.room end from f join r on r.query_id = f.query_id and r.i = f.i + 1)
 select m.query_id, m.candidate_type, m.id, m.rank, coalesce(r.size <= f.room, false) as taken from m left join r on r.query_id = m.query_id and r.rank = m.rank left join f on f.query_id = r.query_id and f.i = r.i - 1""")
def v5_mixed_bundle(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select(F.lit("source").alias("candidate_type"), F.col("doc_id").alias("id"), F.octet_length("text").alias("size"))
    a = table(spark, d, "assertions").filter("status = 'active'")
    text = F.concat(F.lit("kind: "), F.col("kind"), F.lit("\nsubject: "), F.col("subject_qualname"), F.lit("\nclaim: "), F.col("claim"))
    claims = a.groupBy(F.lit("assertion").alias("candidate_type"), F.col("assertion_id").alias("id")).agg(F.max(F.octet_length(text)).alias("size"))
    return E.bundle(more.f14_mixed_fusion(spark, d), docs.unionByName(claims), 1500)


# nodes of the graph without tests; centrality here is the number of callers
_NODES = f"""{H._CE}, cen as (select dst as id, count(*)::double as c from ce group by all), nd as (select symbol_id as id, qualname, path as module, coalesce(c, 0) as centrality from sy left join cen on cen.id = symbol_id
 where symbol_id in (select src from ce union select dst from ce) and kind in ('function', 'method', 'class') and not {_TEST})"""


def nodes(spark, d):
    e = H.edges_by_id(spark, d)
    ends = e.select(F.col("src").alias("symbol_id")).union(e.select("dst")).distinct()
    callers = e.groupBy(F.col("dst").alias("symbol_id")).agg(F.count("*").cast("double").alias("c"))
    s = H.first_symbols(spark, d).filter(F.col("kind").isin("function", "method", "class") & ~is_test_path(F.col("path"))).join(ends, "symbol_id", "left_semi").join(callers, "symbol_id", "left")
    return s.select(F.col("symbol_id").alias("id"), "qualname", F.col("path").alias("module"), F.coalesce("c", F.lit(0.0)).alias("centrality"), "repo_id")


@query(f"with {_NODES} select nd.id, repo_id, row_number() over (partition by repo_id order by centrality desc, nd.qualname, nd.id) as centrality_rank from nd join sy on sy.symbol_id = nd.id")
def r5_centrality_rank(spark, d):
    return T.centrality_ranks(nodes(spark, d), ["repo_id"]).select("id", "repo_id", "centrality_rank")


_SEED = f"""{_NODES}, {more._bm25_sql('x', H._DOCS, 12)}, s1 as (select query_id, doc_id as id, row_number() over (partition by query_id order by rank, doc_id) as place from xlex where doc_id in (select id from nd)),
 s2 as (select query_id, id, place from (select distinct query_id from {more._TOPICS}) q cross join (select id, row_number() over (order by centrality desc, id) as place from nd order by centrality desc, id limit 4) where query_id not in (select query_id from s1)),
 seeds as (select * from s1 union all select * from s2)"""


def _hits(spark, d):
    return retrieval.bm25(H.symbol_docs(spark, d), more._topics(spark, d), 12).withColumnRenamed("doc_id", "id")


@query(f"with {_SEED} select * from seeds")
def t5_tour_seeds(spark, d):
    return T.seeds(_hits(spark, d), more._topics(spark, d), nodes(spark, d))


_SELECT = f"""{_SEED}, en as (select src, dst, edge_id from ce where src in (select id from nd) and dst in (select id from nd)),
 nb as (select * from (select *, row_number() over (partition by node, weight order by edge_id) as n from (select src as node, dst as other, edge_id, 1.0::double as weight from en union all select dst, src, edge_id, 0.35 from en)) where n <= 24),
 g1 as (select s.query_id, nb.other as id, (1.0::double / s.place) * weight * 0.45 as a from seeds s join nb on nb.node = s.id),
 f1 as (select query_id, id, max(a) as a from g1 where (query_id, id) not in (select (query_id, id) from seeds) group by all),
 g2 as (select f1.query_id, nb.other as id, f1.a * weight * 0.45 * 0.45 as a from f1 join nb on nb.node = f1.id),
 gs as (select query_id, id, round(sum(a), 6) as score from (select * from g1 union all select * from g2) where (query_id, id) not in (select (query_id, id) from seeds) group by all),
 ga as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from gs) where rank <= 48),
 sl as (select query_id, id, n as place from (select *, row_number() over (partition by query_id order by late, place, score desc, centrality desc, qualname, id) as n from
  (select query_id, id, 0 as late, place, 0.0::double as score, 0.0::double as centrality, '' as qualname from seeds union all select query_id, ga.id, 1, 0, score, centrality, qualname from ga join nd on nd.id = ga.id)) where n <= 12)"""


def _node_edges(spark, d):
    keep = nodes(spark, d).select("id")
    e = H.edges_by_id(spark, d)
    return e.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")


@query(f"with {_SELECT} select * from sl")
def t6_tour_selection(spark, d):
    return T.selection(t5_tour_seeds(spark, d), _node_edges(spark, d), nodes(spark, d))


_ORDER = f"""{_SELECT}, ie as (select a.query_id, en.src, en.dst from sl a join en on en.src = a.id join sl b on b.query_id = a.query_id and b.id = en.dst),
 reach(query_id, a, b) as (select query_id, src, dst from ie union select reach.query_id, reach.a, ie.dst from reach join ie on ie.query_id = reach.query_id and ie.src = reach.b),
 scc as (select sl.query_id, sl.id, least(sl.query_id || ':' || sl.id, min(x.query_id || ':' || x.b)) as component from sl left join (select r.query_id, r.a, r.b from reach r join reach q on q.query_id = r.query_id and q.a = r.b and q.b = r.a) x on x.query_id = sl.query_id and x.a = sl.id group by sl.query_id, sl.id),
 cl as (select distinct x.query_id, x.component as a, y.component as b from ie join scc x on x.query_id = ie.query_id and x.id = ie.src join scc y on y.query_id = ie.query_id and y.id = ie.dst where x.component <> y.component),
 pth(a, depth) as (select distinct component, 0 from scc union select cl.a, pth.depth + 1 from pth join cl on cl.b = pth.a), dp as (select a as component, max(depth) as tier from pth group by all),
 rw as (select s.query_id, s.id, s.component, tier, qualname, module, centrality from scc s join dp using (component) join nd on nd.id = s.id),
 ld as (select *, max(top) over (partition by query_id, tier, home) as module_top from (select query_id, component, tier, max(centrality) as top, arg_min(module, (-centrality, qualname)) as home, arg_min(qualname, (-centrality, qualname)) as lead from rw group by all)),
 st as (select r.query_id, r.id, r.component, r.tier, row_number() over (partition by r.query_id order by r.tier, module_top desc, home, top desc, lead, centrality desc, qualname, r.id) as stop from rw r join ld l using (query_id, component))"""


@query(f"with recursive {_ORDER} select query_id, id, stop, tier from st")
def t7_tour_ordering(spark, d):
    return T.ordered(t6_tour_selection(spark, d), _node_edges(spark, d), nodes(spark, d)).drop("component")


@query(f"""with recursive {_ORDER}, li as (select ie.query_id, ie.src, ie.dst from ie join st a on a.query_id = ie.query_id and a.id = ie.src join st b on b.query_id = ie.query_id and b.id = ie.dst where a.component <> b.component),
 dn1 as (select query_id, src as id, count(*) as calls from li group by all), up1 as (select query_id, dst as id, count(*) as called from li group by all), sz as (select query_id, component, count(*) as members from st group by all),
 cr as (select query_id, st.id, row_number() over (partition by query_id order by centrality desc, qualname, st.id) as cr, count(*) over (partition by query_id) as total from st join nd on nd.id = st.id)
 select query_id, id, stop, tier, case when members > 1 then 'In a cycle of ' || members || ' symbols, read as one' when tier = 0 and coalesce(called, 0) > 0 then 'Leaf with ' || called || ' caller(s) here' when tier = 0 then 'Leaf that stands alone here'
  else 'Depth ' || tier || ' on ' || coalesce(calls, 0) || ' callee(s), with ' || coalesce(called, 0) || ' caller(s) here' end || '; centrality ' || cr || ' of ' || total || '.' as reason
 from st join sz using (query_id, component) left join dn1 using (query_id, id) left join up1 using (query_id, id) join cr using (query_id, id)""")
def t10_reading_path(spark, d):
    """Stops, order and reasons (T9) of every topic's path."""
    return T.reading_paths(more._topics(spark, d), _hits(spark, d), _node_edges(spark, d), nodes(spark, d))


@query("select distinct repo_id, qualname from stops where list_contains(calls_here, qualname)")
def t8_self_calls(spark, d):
    return table(spark, d, "stops").filter(F.array_contains("calls_here", F.col("qualname"))).select("repo_id", "qualname").distinct()
