"""Hybrid and mixed search over symbols, hydration, related symbols, and the code graph's joins."""

from pyspark.sql import Window as W, functions as F

from tessella.functions.text import is_test_path
from tessella.operators import claims as C, code, mining, mixed, retrieval
from tessella.plans.catalog import query, table
from tessella.workloads import more
from tessella.workloads.code import _HEADER, _TEST

_S = "sy as (select * from (select *, row_number() over (partition by repo_id, qualname order by path, line_start asc nulls last, symbol_id) n_ from (select distinct * from symbols)) where n_ = 1)"
_CE = f"""{_S}, ce as (select src, dst, row_number() over (order by src, dst) as edge_id from (select distinct a.symbol_id as src, b.symbol_id as dst from (select distinct repo_id, qualname, unnest(calls_here) as callee from stops) t
 join sy a on a.repo_id = t.repo_id and a.qualname = t.qualname join sy b on b.repo_id = t.repo_id and b.qualname = t.callee where a.symbol_id <> b.symbol_id))"""
_DOCS = f"(select symbol_id as doc_id, {_HEADER} as text from sy)"
_DENSE = """dn as (select *, row_number() over (partition by query_id order by score desc, id) as rank from (select q.vec_id as query_id, v.vec_id as id, round(list_sum(list_transform(list_zip(q.e, v.e), lambda x: x[1] * x[2])), 6) as score
 from (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where vec_id in (select query_id from {t})) q, (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where vec_id in (select symbol_id from sy)) v))""".format(t=more._TOPICS)
_NB = "nb as (select * from (select *, row_number() over (partition by node, weight order by edge_id) as n from (select src as node, dst as other, edge_id, 1.0::double as weight from ce union all select dst, src, edge_id, 0.35 from ce)) where n <= 24)"
_POOL = f"""{_CE}, {more._bm25_sql('x', _DOCS, 160)}, {_DENSE}, {_NB},
 ld as (select query_id, 'lexical' as modality, rank, doc_id as id from xlex where rank <= {{d}} union all select query_id, 'dense', rank, id from dn where rank <= {{d}}),
 sd as (select query_id, id, place from (select query_id, id, row_number() over (partition by query_id order by pos, id) as place from (select query_id, id, min(rank * 10 + case modality when 'lexical' then 0 else 1 end) as pos from ld group by all)) where place <= {{k}}),
 g1 as (select s.query_id, nb.other as id, (1.0::double / s.place) * weight * 0.45 as a from sd s join nb on nb.node = s.id),
 f1 as (select query_id, id, max(a) as a from g1 where (query_id, id) not in (select (query_id, id) from sd) group by all),
 g2 as (select f1.query_id, nb.other as id, f1.a * weight * 0.45 * 0.45 as a from f1 join nb on nb.node = f1.id),
 gs as (select query_id, id, round(sum(a), 6) as score from (select * from g1 union all select * from g2) where (query_id, id) not in (select (query_id, id) from sd) group by all),
 gr as (select * from (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from gs) where rank <= {{d}}),
 vt as (select * from ld union all select query_id, 'graph', rank, id from gr),
 su as (select query_id, id, sum(case modality when 'graph' then 0.3 else 1.0 end / (60 + rank)) as s, array_to_string(list_sort(list_distinct(list(modality))), '+') as modality from vt group by all),
 ma as (select su.query_id, id, modality, {_TEST} as t, round(s * case when {_TEST} then 0.5 else 1.0 end, 9) as score from su join sy on symbol_id = id),
 rk as (select *, row_number() over (partition by query_id order by score desc, id) as r0 from ma),
 cn as (select *, count(*) filter (r0 <= {{k}} and t) over (partition by query_id) as a, count(*) filter (r0 > {{k}} and t) over (partition by query_id) as b, count(*) filter (r0 <= {{k}} and not t) over (partition by query_id) as p from rk),
 rm as (select *, greatest(0, least(2 - a, b, p)) as room, row_number() over (partition by query_id, r0 <= {{k}}, t order by r0) as best, row_number() over (partition by query_id, r0 <= {{k}}, t order by r0 desc) as worst from cn),
 pool as (select query_id, id, score, modality, row_number() over (partition by query_id order by score desc, id) as rank from rm where (r0 <= {{k}} and (t or worst > room)) or (r0 > {{k}} and t and best <= room))"""
_POOL10, _POOL40 = (_POOL.replace("{k}", str(k)).replace("{d}", str(4 * k)) for k in (10, 40))


def first_symbols(spark, d):
    return code.first_definitions(table(spark, d, "symbols").distinct())


def edges_by_id(spark, d):
    """Call edges between symbols by id: src, dst, confidence, edge_id."""
    ids = first_symbols(spark, d).select("repo_id", "qualname", "symbol_id")
    calls = table(spark, d, "stops").select("repo_id", "qualname", F.explode("calls_here").alias("callee")).distinct()
    both = calls.join(ids.withColumnRenamed("symbol_id", "src"), ["repo_id", "qualname"]).join(ids.select("repo_id", F.col("qualname").alias("callee"), F.col("symbol_id").alias("dst")), ["repo_id", "callee"])
    return both.filter("src <> dst").select("src", "dst").distinct().withColumn("confidence", F.lit(None).cast("double")).withColumn("edge_id", F.struct("src", "dst"))


def symbol_docs(spark, d):
    return code.chunk_headers(first_symbols(spark, d)).select(F.col("symbol_id").alias("doc_id"), F.col("header").alias("text"))


def pool(spark, d, k=10):
    symbols = first_symbols(spark, d)
    topics = more._topics(spark, d)
    lexical = retrieval.bm25(symbol_docs(spark, d), topics, 4 * k).withColumnRenamed("doc_id", "id")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = vectors.join(topics.select(F.col("query_id").alias("id")), "id").withColumnRenamed("id", "query_id")
    dense = retrieval.exact_knn(vectors.join(symbols.select(F.col("symbol_id").alias("id")), "id", "left_semi"), asked, 4 * k)
    tests = symbols.filter(is_test_path(F.col("path"))).select(F.col("symbol_id").alias("id"))
    return retrieval.hybrid(lexical, dense, edges_by_id(spark, d), tests, k)


@query(f"with {_POOL10} select query_id, id, score, modality, rank from pool")
def f8_hybrid(spark, d):
    return pool(spark, d)


_ALIVE = "(select distinct assertion_id, subject_qualname as subject from assertions where status = 'active')"
_MIXED = f"""{_POOL40}, {more._bm25_sql('c', more._CLAIM_DOCS, 40)}, mb as (select query_id, id, rank as at_, unnest(string_split(modality, '+')) as m, case when contains(modality, 'lexical') or contains(modality, 'dense') then 0 when contains(modality, 'graph') then 1 else 2 end as tier from pool),
 sv as (select query_id, 'source_' || m as list, row_number() over (partition by query_id, m order by at_, id) as rank, 'source' as candidate_type, id, tier from mb),
 ps as (select query_id, qualname as subject, min(rank) as r from pool join sy on symbol_id = id group by all),
 atc as (select query_id, 'assertion_subject' as list, row_number() over (partition by query_id order by r, assertion_id) as rank, 'assertion' as candidate_type, assertion_id as id, 2 as tier from ps join {_ALIVE} using (subject)),
 pr0 as (select query_id, subject, min(rank) as r, arg_min(doc_id, rank) as a from clex join {_ALIVE} on assertion_id = doc_id group by all),
 pr as (select query_id, 'source_assertions' as list, rank, 'source' as candidate_type, id, 2 as tier from (select query_id, subject, row_number() over (partition by query_id order by r, a) as rank from pr0) join (select qualname as subject, min(symbol_id) as id from sy group by all) using (subject)),
 cv as (select query_id, 'assertion_lexical' as list, rank, 'assertion' as candidate_type, doc_id as id, 2 as tier from clex union all select * from atc union all select * from pr),
 av as (select * from sv where query_id in (select query_id from cv) union all select * from cv),
 on1 as (select query_id, list, candidate_type, id, min(rank) as rank, min(tier) as tier from av group by all),
 fu as (select query_id, candidate_type, id, round(sum(case list when 'source_graph' then 0.3 when 'assertion_subject' then 0.5 when 'source_assertions' then 0.5 else 1.0 end / (60 + rank)), 9) as score, min(tier) as tier, array_to_string(list_sort(list_distinct(list(list))), '+') as lists from on1 group by all),
 mx as (select * from (select *, row_number() over (partition by query_id order by score desc, (candidate_type <> 'source')::int, id) as rank from fu where tier <= {{t}}) where rank <= 10
  union all select query_id, 'source', id, score, case when contains(modality, 'lexical') or contains(modality, 'dense') then 0 when contains(modality, 'graph') then 1 else 2 end, modality, rank from pool where rank <= 10 and query_id not in (select query_id from cv))"""


def _mixed(spark, d, max_tier=2):
    active = table(spark, d, "assertions").filter("status = 'active'").select("assertion_id", F.col("subject_qualname").alias("subject")).distinct()
    names = first_symbols(spark, d).select(F.col("symbol_id").alias("id"), "qualname")
    hits = more._claim_hits(spark, d, 40).withColumnRenamed("doc_id", "assertion_id").select("query_id", "assertion_id", "rank")
    return mixed.mixed_search(pool(spark, d, 40), hits, active, names, 10, max_tier)


@query(f"with {_MIXED.replace("{t}", "2")} select query_id, candidate_type, id, score, tier, lists, rank from mx")
def f19_mixed_search(spark, d):
    return _mixed(spark, d)


@query(f"with {_MIXED.replace("{t}", "1")} select query_id, candidate_type, id, score, tier, lists, rank from mx where tier <= 1")
def b3_facts_only(spark, d):
    """Claims leave before the page is cut, so that sources take their places."""
    return _mixed(spark, d, 1)


@query(f"""with {_MIXED.replace("{t}", "2")} select query_id, rank, json_object('key', candidate_type || ':' || id, 'score', printf('%.6f', score), 'tier', case tier when 0 then 'parsed' when 1 then 'resolved' else 'inferred' end, 'via', lists)::varchar as json from mx""")
def f20_candidate_json(spark, d):
    return mixed.candidate_json(_mixed(spark, d))


@query(f"with {_POOL10}, mb as (select query_id, id, rank as at_, unnest(string_split(modality, '+')) as modality from pool) select query_id, modality, id, row_number() over (partition by query_id, modality order by at_, id) as rank from mb")
def f16_pool_order(spark, d):
    p = pool(spark, d)
    return retrieval.pool_order(p.select("query_id", F.explode(F.split("modality", r"\+")).alias("modality"), "id"), p)


_VOTES = f"""{more._bm25_sql('c', more._CLAIM_DOCS, 40)}, vt as (select query_id, 'assertion_lexical' as list, rank, 'assertion' as candidate_type, doc_id as id, 2 as tier from clex)"""


def _claim_votes(spark, d):
    return more._claim_hits(spark, d, 40).select("query_id", F.lit("assertion_lexical").alias("list"), "rank", F.lit("assertion").alias("candidate_type"), F.col("doc_id").alias("id"), F.lit(2).alias("tier"))


@query(f"with {_VOTES} select query_id, candidate_type, id, list, rank, 1.0::double as weight, round(1.0 / (60 + rank), 9) as value from vt")
def f14_contributions(spark, d):
    return mixed.contributions(_claim_votes(spark, d))


@query(rf"""with {_VOTES}, t as (select distinct assertion_id as id, subject_qualname as subject, kind, trim(regexp_replace(lower(claim), '\s+', ' ', 'g')) as said from assertions),
 j as (select vt.query_id, id, min(said) over (partition by query_id, subject, kind) <> max(said) over (partition by query_id, subject, kind) as differ from vt join t using (id)) select distinct query_id, id from j where differ""")
def f14_conflicts(spark, d):
    claims = table(spark, d, "assertions").select("assertion_id", F.col("subject_qualname").alias("subject"), "kind", "claim")
    return mixed.conflicting(_claim_votes(spark, d), claims)


_CHUNKS = """(with m as (select repo_id, parent_qualname, string_agg(name, ', ' order by coalesce(line_start, 1073741824), symbol_id) as names from (select distinct * from symbols) where parent_qualname is not null group by all),
 b as (select s.symbol_id, {h} as header, concat_ws(chr(10), case when length(docstring) > 0 then '""\"' || trim(docstring, ' ' || chr(9) || chr(10) || chr(13)) || '""\"' end, case when m.names is not null then (case when kind = 'class' then '# methods: ' else '# defines: ' end) || m.names end) as body
  from (select distinct * from symbols) s left join m on m.repo_id = s.repo_id and m.parent_qualname = s.qualname where kind in ('class', 'module')) select symbol_id, header || chr(10) || body as text from b where length(body) > 0)""".format(h=_HEADER)


def _rerank_docs(spark, d):
    chunks = code.container_chunks(table(spark, d, "symbols").distinct()).select("symbol_id", "text")
    return retrieval.rerank_documents(code.chunk_headers(first_symbols(spark, d)), chunks)


@query(f"with {_S} select s.symbol_id as id, substr(coalesce(nullif(c.text, ''), nullif({_HEADER}, ''), qualname), 1, 4000) as text from sy s left join {_CHUNKS} c using (symbol_id)")
def f11_rerank_documents(spark, d):
    return _rerank_docs(spark, d)


_TOKS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'))".format
_F1 = f"case when len(list_intersect({_TOKS('q.query')}, {_TOKS('t.text')})) = 0 then 0.0 else round(2.0 * len(list_intersect({_TOKS('q.query')}, {_TOKS('t.text')})) / (len({_TOKS('q.query')}) + len({_TOKS('t.text')})), 6) end"


@query(f"""with {_S}, {more._bm25_sql('x', _DOCS, 40)}, t as (select s.symbol_id as id, substr(coalesce(nullif(c.text, ''), nullif({_HEADER}, ''), qualname), 1, 4000) as text from sy s left join {_CHUNKS} c using (symbol_id)),
 r as (select x.query_id, x.doc_id as id, {_F1} as score, x.rank as was from xlex x join {more._TOPICS} q on q.query_id = x.query_id join t on t.id = x.doc_id)
 select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, was) as rank from r) where rank <= 10""")
def f10_rerank(spark, d):
    """The stand-in scorer is the overlap of query and document; a model takes its place as a pandas UDF."""
    topics = more._topics(spark, d)
    hits = retrieval.bm25(symbol_docs(spark, d), topics, 40).withColumnRenamed("doc_id", "id")
    return retrieval.rerank(hits, topics, _rerank_docs(spark, d), mining.token_f1)


@query("""with t as (select distinct sha256(text) as text_hash, text from documents where text is not null), k as (select distinct sha256(text) as text_hash from documents where text is not null and source = 'commit_log'),
 n as (select * from t where text_hash not in (select text_hash from k)), w as (select text_hash, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as w from n), c as (select text_hash, ('0x' || substr(md5(w), 1, 1))::int as b, count(*) as c from w group by all),
 g as (select n.text_hash, b.b, coalesce(c.c, 0) as c from n cross join range(16) b(b) left join c on c.text_hash = n.text_hash and c.b = b.b)
 select text_hash, string_agg(c::varchar, ' ' order by b) as embedding from g group by all""")
def f22_embed_missing(spark, d):
    """Texts of commits count as embedded already."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    known = table(spark, d, "documents").filter("source = 'commit_log' AND text IS NOT NULL").select(F.sha2("text", 256).alias("text_hash"), F.lit("hash-16").alias("model"))
    out = retrieval.embed_missing(docs, known, retrieval.hash_embedder, "hash-16")
    return out.select("text_hash", F.array_join(F.transform("embedding", lambda x: x.cast("int")), " ").alias("embedding"))


@query(f"with {_S}, {more._bm25_sql('x', _DOCS, 10)} select x.query_id, x.rank, x.score, s.symbol_id, s.qualname, s.kind, s.path, s.line_start, s.line_end, {_TEST} as is_test from xlex x join sy s on s.symbol_id = x.doc_id")
def j1_hydrated_hits(spark, d):
    hits = retrieval.bm25(symbol_docs(spark, d), more._topics(spark, d), 10).withColumnRenamed("doc_id", "symbol_id")
    s = first_symbols(spark, d).select("symbol_id", "qualname", "kind", "path", "line_start", "line_end", is_test_path(F.col("path")).alias("is_test"))
    return hits.join(s, "symbol_id").select("query_id", "rank", "score", "symbol_id", "qualname", "kind", "path", "line_start", "line_end", "is_test")


@query(f"with {_S} select s.symbol_id, s.qualname, coalesce(c.text, '') as chunk from sy s left join {_CHUNKS} c using (symbol_id)")
def j2_optional_chunk(spark, d):
    chunks = code.container_chunks(table(spark, d, "symbols").distinct()).select("symbol_id", F.col("text").alias("chunk"))
    return first_symbols(spark, d).select("symbol_id", "qualname").join(chunks, "symbol_id", "left").withColumn("chunk", F.coalesce("chunk", F.lit("")))


@query(f"""with {_CE} select ce.src, a.qualname as caller, ce.dst, b.qualname as callee, row_number() over (partition by ce.src order by b.qualname, ce.dst) as callee_place, row_number() over (partition by ce.dst order by a.qualname, a.line_start nulls first, ce.src) as caller_place
 from ce join sy a on a.symbol_id = ce.src join sy b on b.symbol_id = ce.dst""")
def j5_callees_callers(spark, d):
    s = first_symbols(spark, d).select("symbol_id", "qualname", "line_start")
    rows = edges_by_id(spark, d).select("src", "dst").join(s.select(F.col("symbol_id").alias("src"), F.col("qualname").alias("caller"), F.col("line_start").alias("at")), "src").join(s.select(F.col("symbol_id").alias("dst"), F.col("qualname").alias("callee")), "dst")
    out, into = W.partitionBy("src").orderBy("callee", "dst"), W.partitionBy("dst").orderBy("caller", F.col("at").asc_nulls_first(), "src")
    return rows.select("src", "caller", "dst", "callee", F.row_number().over(out).alias("callee_place"), F.row_number().over(into).alias("caller_place"))


@query(f"""with {_CE}, x as (select src as node, 'callee' as direction, dst as other from ce union select dst, 'caller', src from ce) select * from (select *, row_number() over (partition by node, direction order by other) as place from x) where place <= 10""")
def v6_related(spark, d):
    return retrieval.related(edges_by_id(spark, d))


@query(f"""with {_CE}, x as (select src as node, 'callee' as direction, dst as other from ce union select dst, 'caller', src from ce) select * from (select *, row_number() over (partition by node, direction order by other) as place from x) where place <= 3""")
def r3_first_three(spark, d):
    return retrieval.related(edges_by_id(spark, d), 3)


@query(f"""with {_CE} select distinct a.path as src_path, b.path as dst_path, a.repo_id from ce join sy a on a.symbol_id = ce.src join sy b on b.symbol_id = ce.dst where a.path <> b.path""")
def j16_file_inbound(spark, d):
    s = first_symbols(spark, d).select("symbol_id", "path", "repo_id")
    rows = edges_by_id(spark, d).select("src", "dst").join(s.select(F.col("symbol_id").alias("src"), F.col("path").alias("src_path"), "repo_id"), "src").join(s.select(F.col("symbol_id").alias("dst"), F.col("path").alias("dst_path")), "dst")
    return rows.filter("src_path <> dst_path").select("src_path", "dst_path", "repo_id").distinct()


@query(f"""with {_CE}, o as (select distinct src as id from ce), i as (select distinct b.path, b.repo_id from ce join sy a on a.symbol_id = ce.src join sy b on b.symbol_id = ce.dst where a.path <> b.path),
 f as (select distinct repo_id, path, {_TEST} as is_test from sy)
 select is_test, count(*) as files, count(i.path) as inbound, round(count(i.path)::double / count(*), 6) as share from f left join i using (repo_id, path) group by all""")
def d5_file_coverage(spark, d):
    files = first_symbols(spark, d).select("repo_id", "path").distinct().withColumn("is_test", is_test_path(F.col("path")))
    hit = j16_file_inbound(spark, d).select("repo_id", F.col("dst_path").alias("path")).distinct().withColumn("hit", F.lit(True))
    return files.join(hit, ["repo_id", "path"], "left").groupBy("is_test").agg(F.count("*").alias("files"), F.count("hit").alias("inbound"), F.round(F.count("hit") / F.count("*"), 6).alias("share"))


@query(f"""with {_CE}, o as (select distinct src as id from ce) select {_TEST} as is_test, kind, count(*) as symbols, count(o.id) as outbound, round(count(o.id)::double / count(*), 6) as share from sy left join o on o.id = symbol_id group by all""")
def d5_symbol_coverage(spark, d):
    out = edges_by_id(spark, d).select(F.col("src").alias("symbol_id")).distinct().withColumn("hit", F.lit(True))
    rows = first_symbols(spark, d).select("symbol_id", "kind", is_test_path(F.col("path")).alias("is_test")).join(out, "symbol_id", "left")
    return rows.groupBy("is_test", "kind").agg(F.count("*").alias("symbols"), F.count("hit").alias("outbound"), F.round(F.count("hit") / F.count("*"), 6).alias("share"))


_KIND = "({0}.kind in ('function', 'method', 'class') and not " + _TEST.replace("path", "{0}.path").replace("{0}.pathname", "pathname") + ")"


@query(f"with {_CE} select ce.src, ce.dst from ce join sy a on a.symbol_id = ce.src join sy b on b.symbol_id = ce.dst where {_KIND.replace('{0}', 'a')} and {_KIND.replace('{0}', 'b')}")
def j4_call_graph(spark, d):
    keep = first_symbols(spark, d).filter(F.col("kind").isin("function", "method", "class") & ~is_test_path(F.col("path"))).select("symbol_id")
    e = edges_by_id(spark, d).select("src", "dst")
    return e.join(keep.withColumnRenamed("symbol_id", "src"), "src", "left_semi").join(keep.withColumnRenamed("symbol_id", "dst"), "dst", "left_semi").select("src", "dst")


@query("""with p as (select tour_id as query_id, qualname as subject, min(stop_order) as r from stops group by all)
 select * from (select query_id, assertion_id, row_number() over (partition by query_id order by r, assertion_id) as rank from p join (select distinct assertion_id, subject_qualname as subject from assertions where status = 'active') using (subject)) where rank <= 3""")
def j8_capped_claims(spark, d):
    p = table(spark, d, "stops").groupBy(F.col("tour_id").alias("query_id"), F.col("qualname").alias("subject")).agg(F.min("stop_order").alias("rank"))
    active = table(spark, d, "assertions").filter("status = 'active'").select("assertion_id", F.col("subject_qualname").alias("subject"))
    return mixed.attached_claims(p, active, cap=3)


@query(f"""with {_CE}, cl as (select subject_qualname as qualname, count(distinct assertion_id) as claims from assertions where status = 'active' group by all), o as (select src as id, count(*) as n from ce group by all), i as (select dst as id, count(*) as n from ce group by all)
 select symbol_id, qualname, coalesce(o.n, 0) as callees, coalesce(i.n, 0) as callers, coalesce(claims, 0) as claims from sy left join o on o.id = symbol_id left join i on i.id = symbol_id left join cl using (qualname)""")
def t11_symbol_profile(spark, d):
    e = edges_by_id(spark, d)
    n = lambda end, name: e.groupBy(F.col(end).alias("symbol_id")).agg(F.count("*").alias(name))
    claims = table(spark, d, "assertions").filter("status = 'active'").groupBy(F.col("subject_qualname").alias("qualname")).agg(F.count_distinct("assertion_id").alias("claims"))
    rows = first_symbols(spark, d).select("symbol_id", "qualname").join(n("src", "callees"), "symbol_id", "left").join(n("dst", "callers"), "symbol_id", "left").join(claims, "qualname", "left")
    return rows.select("symbol_id", "qualname", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("callees", "callers", "claims")))
