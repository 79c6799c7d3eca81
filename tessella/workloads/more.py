"""Mixed retrieval over documents and claims, bootstrap intervals, and a streaming fold."""

from pyspark.sql import functions as F

from tessella.operators import bootstrap, claims as C, mixed, retrieval
from tessella.plans.catalog import query, table
from tessella.streaming import folds
from tessella.workloads import claims as claim_queries, retrieval as retrieval_queries

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')".format
# topics of every twentieth tour
_TOPICS = "(select distinct tour_id as query_id, topic as query from stops where tour_id % 20 = 0 and topic is not null)"


def _bm25_sql(x: str, docs: str, k: int) -> str:
    """CTEs that end in {x}lex: BM25 of the topics over ``docs`` (doc_id, text)."""
    return rf"""{x}w as (select doc_id, {_TOK('text')} as ts from {docs} where text is not null), {x}s as (select count(*) as n_docs, avg(len(ts)) as avg_len from {x}w),
 {x}q as (select query_id, term, generate_subscripts(ts, 1) - 1 as i, unnest(ts) as token, len(ts) as n from (select query_id, term, {_TOK('word')} as ts from (select query_id, generate_subscripts(ws, 1) as term, unnest(ws) as word from
  (select query_id, list_filter(string_split_regex(regexp_replace(query, '[\x00-\x1f\x7f"*():^-]', ' ', 'g'), '\s+'), lambda x: x <> '') as ws from {_TOPICS})))),
 {x}p as (select doc_id, len(ts) as l, generate_subscripts(ts, 1) - 1 as pos, unnest(ts) as token from {x}w), {x}h as (select query_id, term, doc_id, l, pos - i as start, n, count(*) as c from {x}p join {x}q using (token) group by all having count(*) = n),
 {x}tf as (select query_id, term, doc_id, l, count(*) as tf from {x}h group by all), {x}df as (select query_id, term, count(*) as df from {x}tf group by all),
 {x}sc as (select query_id, doc_id, round(sum(case when ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n_docs - df + 0.5) / (df + 0.5)) end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len))), 6) as score
  from {x}tf join {x}df using (query_id, term) cross join {x}s group by all), {x}lex as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from {x}sc) where rank <= {k})"""


_CLAIM_DOCS = "(select distinct assertion_id as doc_id, 'kind: ' || kind || chr(10) || 'subject: ' || subject_qualname || chr(10) || 'claim: ' || claim as text from assertions where status = 'active')"


def _topics(spark, d):
    return table(spark, d, "stops").filter("tour_id % 20 = 0 AND topic IS NOT NULL").select(F.col("tour_id").alias("query_id"), F.col("topic").alias("query")).distinct()


def _claim_hits(spark, d, k):
    a = table(spark, d, "assertions").filter("status = 'active'")
    text = F.concat(F.lit("kind: "), F.col("kind"), F.lit("\nsubject: "), F.col("subject_qualname"), F.lit("\nclaim: "), F.col("claim"))
    return retrieval.bm25(a.select(F.col("assertion_id").alias("doc_id"), text.alias("text")).distinct(), _topics(spark, d), k)


@query(f"with {_bm25_sql('c', _CLAIM_DOCS, 10)} select query_id, doc_id as assertion_id, score, rank from clex")
def f12_claim_search(spark, d):
    return _claim_hits(spark, d, 10).withColumnRenamed("doc_id", "assertion_id")


@query(f"""with {_bm25_sql('c', _CLAIM_DOCS, 40)}, {_bm25_sql('x', 'documents', 40)},
 v as (select query_id, 'assertion_lexical' as list, rank, 'assertion' as candidate_type, doc_id as id, 2 as tier from clex union all select query_id, 'source_lexical', rank, 'source', doc_id, 0 from xlex),
 g as (select query_id, candidate_type, id, round(sum(1.0 / (60 + rank)), 9) as score, min(tier) as tier, array_to_string(list_sort(list_distinct(list(list))), '+') as lists from v group by all)
 select * from (select *, row_number() over (partition by query_id order by score desc, (candidate_type <> 'source')::int, id) as rank from g) where rank <= 10""")
def f14_mixed_fusion(spark, d):
    claims = _claim_hits(spark, d, 40).select("query_id", F.lit("assertion_lexical").alias("list"), "rank", F.lit("assertion").alias("candidate_type"), F.col("doc_id").alias("id"), F.lit(2).alias("tier"))
    docs = retrieval.bm25(table(spark, d, "documents").select("doc_id", "text"), _topics(spark, d), 40)
    sources = docs.select("query_id", F.lit("source_lexical").alias("list"), "rank", F.lit("source").alias("candidate_type"), F.col("doc_id").alias("id"), F.lit(0).alias("tier"))
    return mixed.mixed_fusion(claims.unionByName(sources))


_SUBJ = "(select distinct assertion_id, subject_qualname as subject from assertions)"


@query(f"""with {_bm25_sql('c', _CLAIM_DOCS, 40)}, f as (select query_id, subject, min(rank) as r, arg_min(doc_id, rank) as a from clex join {_SUBJ} on assertion_id = doc_id group by all)
 select query_id, subject, row_number() over (partition by query_id order by r, a) as rank, 'assertion:' || a as via from f""")
def f18_promoted_sources(spark, d):
    subj = table(spark, d, "assertions").select("assertion_id", F.col("subject_qualname").alias("subject")).distinct()
    return mixed.promoted_sources(_claim_hits(spark, d, 40).withColumnRenamed("doc_id", "assertion_id").join(subj, "assertion_id").select("query_id", "rank", "assertion_id", "subject"))


@query("""with p as (select tour_id as query_id, qualname as subject, min(stop_order) as r from stops group by all)
 select query_id, assertion_id, row_number() over (partition by query_id order by r, assertion_id) as rank from p join (select distinct assertion_id, subject_qualname as subject from assertions where status = 'active') using (subject)""")
def f17_attached_claims(spark, d):
    pool = table(spark, d, "stops").groupBy(F.col("tour_id").alias("query_id"), F.col("qualname").alias("subject")).agg(F.min("stop_order").alias("rank"))
    active = table(spark, d, "assertions").filter("status = 'active'").select("assertion_id", F.col("subject_qualname").alias("subject"))
    return mixed.attached_claims(pool, active)


def _boot(values: str, resamples: int = 200) -> str:
    return f"""with v as ({values}), c as (select *, row_number() over (order by cluster) - 1 as pick from (select cluster, sum(value) as s, count(value) as m from v group by cluster)), n as (select count(*) as n from c),
 dr as (select b, i, ('0x' || substr(md5('20-' || b || '-' || i), 1, 8))::bigint % n as pick from range({resamples}) t(b), range((select n from n)) u(i), n),
 r as (select b, round(sum(s) / sum(m), 9) as value from dr join c using (pick) group by b), o as (select value, row_number() over (order by value) - 1 as i, count(*) over () as k from r)
 select p, value from o, (values (0.025::double), (0.975::double)) t(p) where i = least(k - 1, floor(p * k))"""


def _boot_by(values: str, resamples: int = 2000) -> str:
    """CTEs that end in bo(grp, low, high): the bootstrap interval of each group of (grp, cluster, value)."""
    return f"""bv as ({values}), bc as (select *, row_number() over (partition by grp order by cluster) - 1 as pick from (select grp, cluster, sum(value) as s, count(value) as m from bv group by grp, cluster)), bn as (select grp, count(*) as n from bc group by grp),
 bd as (select grp, b, i, ('0x' || substr(md5('20-' || b || '-' || i), 1, 8))::bigint % n as pick from bn cross join range({resamples}) t(b) cross join range((select max(n) from bn)) u(i) where i < n),
 br as (select grp, b, round(sum(s) / sum(m), 9) as value from bd join bc using (grp, pick) group by all), bq as (select grp, value, row_number() over (partition by grp order by value) - 1 as i, count(*) over (partition by grp) as k from br),
 bo as (select grp, min(value) filter (i = least(k - 1, floor(0.025 * k))) as low, max(value) filter (i = least(k - 1, floor(0.975 * k))) as high from bq group by grp)"""


def _ndcg_by_label(spark, d):
    return retrieval_queries.m1_m4_ranking_metrics(spark, d).select(F.col("label").alias("cluster"), F.col("ndcg").alias("value"))


def _deltas(spark, d):
    return retrieval_queries.m1_m4_ranking_metrics(spark, d).select(F.col("query_id").alias("cluster"), (F.col("ndcg") - F.col("recall")).alias("value"))


@query(_boot("select label as cluster, ndcg as value from (" + retrieval_queries._sql_metrics() + ")"))
def m7_m8_cluster_bootstrap(spark, d):
    """The SQL's 200 resamples; m7_m8_cluster_bootstrap_2000 is the whole job."""
    return bootstrap.interval(_ndcg_by_label(spark, d), resamples=200)


@query(_boot("select label as cluster, ndcg as value from (" + retrieval_queries._sql_metrics() + ")", 2000))
def m7_m8_cluster_bootstrap_2000(spark, d):
    return bootstrap.interval(_ndcg_by_label(spark, d))


@query(_boot("select query_id as cluster, ndcg - recall as value from (" + retrieval_queries._sql_metrics() + ")"))
def m9_paired_delta(spark, d):
    """The SQL's 200 resamples; m9_paired_delta_2000 is the whole job."""
    return bootstrap.interval(_deltas(spark, d), resamples=200)


@query(_boot("select query_id as cluster, ndcg - recall as value from (" + retrieval_queries._sql_metrics() + ")", 2000))
def m9_paired_delta_2000(spark, d):
    return bootstrap.interval(_deltas(spark, d))


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_event_windows(spark, d):
    given = table(spark, d, "events").schema
    stream = spark.readStream.schema(given).option("pathGlobFilter", "events.parquet").parquet(d)
    return folds.run_to_end(folds.windowed_counts(stream))


@query(f"""select assertion_id as key, verdict as status, created_at as ts from (select *, row_number() over (partition by assertion_id order by created_at, verdict_id) as n from {claim_queries._KNOWN} where verdict in ('refuted', 'unsupported')) where n = 1""")
def fold_first_rejection(spark, d):
    v = C.known_verdicts(table(spark, d, "verdicts")).filter(F.col("verdict").isin(*C.VETOES))
    return folds.first_terminal(v.select(F.col("assertion_id").alias("key"), F.col("created_at").alias("ts"), F.col("verdict_id").alias("seq"), F.col("verdict").alias("status")))
