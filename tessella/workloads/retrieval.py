"""Batch retrieval: the project's gold queries against all documents, and call-graph analytics."""

from pyspark.sql import functions as F

from tessella.functions.text import query_terms, tier_of, tokens
from tessella.operators import graph, retrieval
from tessella.plans.catalog import query, table

# sources that stand for test code
_TESTS = ("run_logs", "judge_notes")

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')".format
_Q = "(select doc_id as query_id, text as query from documents where source = 'gold_queries' and text is not null)"
_TERMS = rf"""(select query_id, term, generate_subscripts(ts, 1) - 1 as i, unnest(ts) as token, len(ts) as n from
 (select query_id, term, {_TOK('word')} as ts from (select query_id, generate_subscripts(ws, 1) as term, unnest(ws) as word from
 (select query_id, list_filter(string_split_regex(regexp_replace(query, '[\x00-\x1f\x7f"*():^-]', ' ', 'g'), '\s+'), lambda x: x <> '') as ws from {_Q}))))"""
_BM25 = f"""w as (select doc_id, {_TOK('text')} as ts from documents where text is not null),
 s as (select count(*) as n_docs, avg(len(ts)) as avg_len from w),
 t as {_TERMS},
 p as (select doc_id, len(ts) as l, generate_subscripts(ts, 1) - 1 as pos, unnest(ts) as token from w),
 h as (select query_id, term, doc_id, l, pos - i as start, n, count(*) as c from p join t using (token) group by all having count(*) = n),
 tf as (select query_id, term, doc_id, l, count(*) as tf from h group by all),
 df as (select query_id, term, count(*) as df from tf group by all),
 sc as (select query_id, doc_id, round(sum(case when ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n_docs - df + 0.5) / (df + 0.5)) end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len))), 6) as score
  from tf join df using (query_id, term) cross join s group by all),
 lex as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc)"""
_DOT = "list_sum(list_transform(list_zip(q.e, v.e), lambda x: x[1] * x[2]))"
_KNN = f"""e as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
 dn as (select *, row_number() over (partition by query_id order by score desc, id) as rank from
  (select q.vec_id as query_id, v.vec_id as id, round({_DOT}, 6) as score from e q, e v where q.vec_id in (select query_id from {_Q})))"""


def _docs(spark, d):
    return table(spark, d, "documents")


def _gold(spark, d):
    return _docs(spark, d).filter("source = 'gold_queries' AND text IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query(rf"select query_id, array_to_string(list_filter(string_split_regex(regexp_replace(query, '[\x00-\x1f\x7f\"*():^-]', ' ', 'g'), '\s+'), lambda x: x <> ''), ' OR ') as terms from (select doc_id as query_id, text as query from documents where text is not null)")
def f1_query_terms(spark, d):
    q = _docs(spark, d).filter("text IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return q.select("query_id", F.array_join(query_terms(F.col("query")), " OR ").alias("terms"))


@query(f"with {_BM25} select query_id, doc_id, score, rank from lex where rank <= 10")
def f2_bm25(spark, d):
    return retrieval.bm25(_docs(spark, d).select("doc_id", "text"), _gold(spark, d))


_KNN_ALL = _KNN.replace(f"q.vec_id in (select query_id from {_Q})", "q.vec_id % 20 = 0")


@query(f"with {_KNN_ALL} select query_id, id, score, rank from dn where rank <= 10")
def f3_dense_knn(spark, d):
    v = _vectors(spark, d)
    return retrieval.exact_knn(v, v.filter("id % 20 = 0").withColumnRenamed("id", "query_id"))


_VOTES = "votes as (select query_id, 'lexical' as modality, rank, doc_id as id from lex where rank <= 40 union all select query_id, 'dense', rank, id from dn where rank <= 40)"


def _votes(spark, d):
    gold = _gold(spark, d)
    lexical = retrieval.bm25(_docs(spark, d).select("doc_id", "text"), gold, k=40).select("query_id", F.lit("lexical").alias("modality"), "rank", F.col("doc_id").alias("id"))
    vectors = _vectors(spark, d)
    asked = vectors.join(gold.select(F.col("query_id").alias("id")), "id").withColumnRenamed("id", "query_id")
    dense = retrieval.exact_knn(vectors, asked, k=40).select("query_id", F.lit("dense").alias("modality"), "rank", "id")
    return lexical.unionByName(dense)


_SUM = "sum(1.0 / (60 + rank)) as s, array_to_string(list_sort(list_distinct(list(modality))), '+') as modality"


@query(f"""with {_BM25}, {_KNN}, {_VOTES}, f as (select query_id, id, {_SUM} from votes group by all),
 g as (select query_id, id, round(s, 9) as score, modality, row_number() over (partition by query_id order by round(s, 9) desc, id) as rank from f)
 select * from g where rank <= 10""")
def f6_rank_fusion(spark, d):
    return retrieval.fuse(_votes(spark, d))


@query(f"""with {_BM25}, {_KNN}, {_VOTES}, f as (select query_id, id, {_SUM} from votes group by all),
 m as (select f.query_id, f.id, f.modality, coalesce(source in {_TESTS}, false) as t, round(s * case when source in {_TESTS} then 0.5 else 1.0 end, 9) as score from f left join documents on doc_id = id),
 r as (select *, row_number() over (partition by query_id order by score desc, id) as r0 from m),
 c as (select *, count(*) filter (r0 <= 10 and t) over (partition by query_id) as a, count(*) filter (r0 > 10 and t) over (partition by query_id) as b, count(*) filter (r0 <= 10 and not t) over (partition by query_id) as p from r),
 k as (select *, greatest(0, least(2 - a, b, p)) as room, row_number() over (partition by query_id, r0 <= 10, t order by r0) as best, row_number() over (partition by query_id, r0 <= 10, t order by r0 desc) as worst from c)
 select query_id, id, score, modality, row_number() over (partition by query_id order by score desc, id) as rank from k where (r0 <= 10 and (t or worst > room)) or (r0 > 10 and t and best <= room)""")
def f7_reserved_test_slots(spark, d):
    tests = _docs(spark, d).filter(F.col("source").isin(*_TESTS)).select(F.col("doc_id").alias("id"))
    return retrieval.fuse(_votes(spark, d), tests=tests)


@query(f"""with {_BM25}, {_KNN}, {_VOTES}, sd as (select query_id, id, min(rank * 10 + case modality when 'lexical' then 0 else 1 end) as pos from votes group by all),
 pl as (select query_id, id, row_number() over (partition by query_id order by pos, id) as place from sd) select * from pl where place <= 10""")
def f9_seed_merge(spark, d):
    return retrieval.merge_seeds(_votes(spark, d), ["lexical", "dense"], 10)


@query("select m, case when m like '%lexical%' or m like '%dense%' then 0 when m like '%graph%' then 1 else 2 end as tier from (values ('lexical'),('dense'),('graph'),('inferred'),('dense+graph'),('graph+inferred'),('graph+lexical'),('other')) x(m)")
def f21_tier(spark, d):
    rows = spark.createDataFrame([(m,) for m in ("lexical", "dense", "graph", "inferred", "dense+graph", "graph+inferred", "graph+lexical", "other")], "m string")
    return rows.withColumn("tier", tier_of(F.col("m")))


# the call graph of the reading tours
_EDGES = """ed as (select distinct src, dst from (select repo_id || ':' || qualname as src, repo_id || ':' || unnest(calls_here) as dst from stops) where src <> dst),
 eg as (select src, dst, row_number() over (order by src, dst) as edge_id from ed)"""
_NB = """nb as (select * from (select *, row_number() over (partition by node, weight order by edge_id) as n from
 (select src as node, dst as other, edge_id, 1.0 as weight from eg union all select dst, src, edge_id, 0.35 from eg)) where n <= 24)"""
_SEEDS = "seeds as (select tour_id as query_id, repo_id || ':' || qualname as id, min(stop_order) as place from stops group by all)"


def call_edges(spark, d):
    stops = table(spark, d, "stops")
    name = lambda c: F.concat(F.col("repo_id"), F.lit(":"), c)
    pairs = stops.select("repo_id", "qualname", F.explode("calls_here").alias("callee")).select(name(F.col("qualname")).alias("src"), name(F.col("callee")).alias("dst"))
    return pairs.distinct().filter("src <> dst").withColumn("confidence", F.lit(None).cast("double")).withColumn("edge_id", F.struct("src", "dst"))


@query(f"with {_EDGES} select src, dst from ed")
def t1_call_graph(spark, d):
    return call_edges(spark, d).select("src", "dst")


@query(f"with {_EDGES}, {_NB} select node, other, weight::double as weight from nb")
def f4_neighbours(spark, d):
    return retrieval.neighbours(call_edges(spark, d))


@query(f"""with {_EDGES}, {_NB}, {_SEEDS}, g1 as (select s.query_id, nb.other as id, (1.0::double / s.place) * weight * 0.45 as a from seeds s join nb on nb.node = s.id),
 f1 as (select query_id, id, max(a) as a from g1 where (query_id, id) not in (select (query_id, id) from seeds) group by all),
 g2 as (select f1.query_id, nb.other as id, f1.a * weight * 0.45 * 0.45 as a from f1 join nb on nb.node = f1.id),
 s as (select query_id, id, round(sum(a), 6) as score from (select * from g1 union all select * from g2) where (query_id, id) not in (select (query_id, id) from seeds) group by all),
 r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) select * from r where rank <= 10""")
def f5_expand(spark, d):
    seeds = table(spark, d, "stops").groupBy(F.col("tour_id").alias("query_id"), F.concat_ws(":", "repo_id", "qualname").alias("id")).agg(F.min("stop_order").alias("place"))
    return retrieval.expand(call_edges(spark, d), seeds)


def _pagerank_sql(n: int) -> str:
    steps = [f"""with {_EDGES}, nd as materialized (select src as id from ed union select dst from ed), dg as materialized (select src, count(*) as k from ed group by all),
 r0 as materialized (select id, 1.0::double / (select count(*) from nd) as r from nd)"""]
    for i in range(n):
        steps.append(f"""r{i + 1} as materialized (select nd.id, 0.15 / (select count(*) from nd) + 0.85 * (coalesce(g.got, 0) + (select coalesce(sum(r), 0) from r{i} where id not in (select src from dg)) / (select count(*) from nd)) as r
 from nd left join (select ed.dst, sum(r / k) as got from ed join r{i} on r{i}.id = ed.src join dg on dg.src = ed.src group by all) g on g.dst = nd.id)""")
    return ", ".join(steps) + f" select id, round(r, 9) as rank from r{n}"


@query(_pagerank_sql(8))
def t2_pagerank(spark, d):
    """Eight iterations, for the unrolled SQL; t2_pagerank_converged is the whole job."""
    return graph.pagerank(call_edges(spark, d), iterations=8).select("id", F.round("rank", 9).alias("rank"))


@query()
def t2_pagerank_converged(spark, d):
    return graph.pagerank(call_edges(spark, d)).select("id", F.round("rank", 9).alias("rank"))


_REACH = f"""with recursive {_EDGES}, reach(a, b) as (select src, dst from ed union select reach.a, ed.dst from reach join ed on ed.src = reach.b),
 nd as (select src as id from ed union select dst from ed),
 scc as (select nd.id, least(nd.id, min(x.b)) as component from nd left join (select r.a, r.b from reach r join reach q on q.a = r.b and q.b = r.a) x on x.a = nd.id group by nd.id)"""


@query(f"{_REACH} select id, component from scc")
def t3_components(spark, d):
    return graph.strong_components(call_edges(spark, d))


@query(f"""{_REACH}, cl as (select distinct x.component as a, y.component as b from ed join scc x on x.id = ed.src join scc y on y.id = ed.dst where x.component <> y.component),
 pth(a, depth) as (select distinct component, 0 from scc union select cl.a, pth.depth + 1 from pth join cl on cl.b = pth.a) select a as component, max(depth) as depth from pth group by all""")
def t4_depths(spark, d):
    edges = call_edges(spark, d)
    return graph.depths(edges, graph.strong_components(edges))


@query(f"with {_EDGES} select dst as callee, count(distinct src) as callers from ed group by all")
def t8_caller_counts(spark, d):
    return call_edges(spark, d).groupBy(F.col("dst").alias("callee")).agg(F.count_distinct("src").alias("callers"))


def _sql_metrics() -> str:
    return f"""with {_KNN_ALL}, h as (select dn.query_id, dn.rank - 1 as rank, (a.label = b.label)::int as hit, a.label from dn join embeddings a on a.vec_id = dn.query_id join embeddings b on b.vec_id = dn.id
  where dn.rank between 2 and 11),
 n as (select label, count(*) - 1 as relevant from embeddings group by all),
 x as (select *, sum(hit) over (partition by query_id order by rank) as hits from h),
 q as (select query_id, label, sum(hit) as found, max(hit) as hit, sum(hit / log2(rank + 1)) as dcg, sum(hit * hits / rank) as ap, min(case when hit = 1 then rank end) as first_rank from x group by all)
 select query_id, q.label, round(found / relevant, 6) as recall, hit, round(coalesce(dcg / nullif((select sum(1 / log2(i + 1)) from range(1, 11) t(i) where i <= least(relevant, 10)), 0), 0), 6) as ndcg,
  round(coalesce(ap / nullif(least(relevant, 10), 0), 0), 6) as ap, round(coalesce(1.0 / first_rank, 0), 6) as rr from q join n on n.label = q.label where relevant > 0"""


def label_hits(spark, d):
    """Per query vector its ten nearest others, and whether they carry its label."""
    v = _vectors(spark, d)
    near = retrieval.exact_knn(v, v.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), k=11).filter("rank >= 2").withColumn("rank", F.col("rank") - 1)
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    mine = near.join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    both = mine.join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("other")), "id")
    return both.select("query_id", "label", "rank", (F.col("label") == F.col("other")).cast("int").alias("hit"))


@query(_sql_metrics())
def m1_m4_ranking_metrics(spark, d):
    from tessella.operators.stats import ranking_metrics

    relevant = table(spark, d, "embeddings").groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    return ranking_metrics(label_hits(spark, d), relevant)


@query(f"""select label, count(*) as n, round(avg(recall), 4) as recall, round(avg(hit), 4) as hit, round(avg(ndcg), 4) as ndcg, round(avg(ap), 4) as map, round(avg(rr), 4) as mrr
 from ({_sql_metrics()}) group by grouping sets ((), (label))""")
def m5_scorecards(spark, d):
    per_query = m1_m4_ranking_metrics(spark, d)
    per_query.createOrReplaceTempView("tessella_per_query")
    return spark.sql("""SELECT label, count(*) AS n, round(avg(recall), 4) AS recall, round(avg(hit), 4) AS hit, round(avg(ndcg), 4) AS ndcg, round(avg(ap), 4) AS map, round(avg(rr), 4) AS mrr
      FROM tessella_per_query GROUP BY GROUPING SETS ((), (label))""")
