"""Claims, verdicts and citations."""

from pyspark.sql import functions as F

from tessella.operators import claims as C, leaks, stats
from tessella.plans.catalog import query, table

_WORD = "nullif(regexp_replace(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13))), '[ \\t_-]+', '_', 'g'), '')".format
_KNOWN = f"(select verdict_id, assertion_id, {_WORD('judge')} as judge, case when {_WORD('verdict')} in ('supported','refuted','unsupported') then {_WORD('verdict')} end as verdict, created_at from (select distinct * from verdicts))"
_LATEST = f"(select * from (select *, row_number() over (partition by assertion_id, judge order by created_at desc, verdict_id desc) n_ from {_KNOWN} where verdict is not null) where n_ = 1)"
_CLAIMS = "(select distinct assertion_id, status from assertions)"
_CITED = r"(select distinct assertion_id, regexp_extract(c, '^(.*):([0-9]+)-([0-9]+)$', 1) as path, regexp_extract(c, '^(.*):([0-9]+)-([0-9]+)$', 2)::int as line_start, regexp_extract(c, '^(.*):([0-9]+)-([0-9]+)$', 3)::int as line_end from (select assertion_id, unnest(citations) as c from adjudications))"


def _t(spark, d):
    return table(spark, d, "assertions"), table(spark, d, "verdicts")


@query(f"select assertion_id, judge, verdict, verdict_id from {_LATEST}")
def r9_latest_verdict(spark, d):
    return C.latest_verdicts(table(spark, d, "verdicts"))


@query(f"select assertion_id, string_agg(judge || ':' || verdict, ', ' order by verdict_id) as verdicts from {_KNOWN} where verdict is not null and judge is not null group by all")
def f13_verdict_rollup(spark, d):
    return C.verdict_rollup(table(spark, d, "verdicts"))


@query(f"""with v as (select assertion_id, bool_or(verdict in ('refuted','unsupported')) as veto, bool_or(verdict = 'supported') as ok from {_KNOWN} where verdict is not null group by all),
 r as (select assertion_id, case when status <> 'active' then 'status' when veto then 'vetoed' when ok then 'eligible' else 'verdict_required' end as reason from {_CLAIMS} left join v using (assertion_id))
 select assertion_id, reason, reason = 'eligible' as eligible from r""")
def b4_serving_policy(spark, d):
    return C.serving(*_t(spark, d))


@query(f"""with v as (select assertion_id, bool_or(verdict in ('refuted','unsupported')) as veto, bool_or(verdict = 'supported') as ok from {_KNOWN} where verdict is not null group by all),
 r as (select assertion_id, case when status <> 'active' then 'status' when veto then 'vetoed' when ok then 'eligible' else 'eligible_pending' end as reason from {_CLAIMS} left join v using (assertion_id))
 select reason, count(*) as n from r group by all""")
def b4_pending_policy_counts(spark, d):
    return C.serving(*_t(spark, d), require_verdict=False).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"select assertion_id, case when status = 'active' and assertion_id in (select assertion_id from {_KNOWN} where verdict in ('refuted','unsupported')) then 'rejected' else status end as status from {_CLAIMS}")
def fold_p2(spark, d):
    return C.folded_status(*_t(spark, d))


@query(f"select distinct assertion_id, created_at from assertions where status = 'active' and assertion_id not in (select assertion_id from {_KNOWN} where verdict = 'supported')")
def j6_unjudged(spark, d):
    return C.unjudged(*_t(spark, d))


@query(f"select s.status, count(a.assertion_id) as n from (values ('active'),('rejected'),('stale'),('withdrawn')) s(status) left join {_CLAIMS} a using (status) group by all")
def status_p12(spark, d):
    keys = spark.createDataFrame([(s,) for s in (*C.STATUSES, "withdrawn")], "status string")
    n = table(spark, d, "assertions").select("assertion_id", "status").distinct().groupBy("status").count()
    return keys.join(n, "status", "left").select("status", F.coalesce("count", F.lit(0)).alias("n"))


@query(f"select assertion_id, path, line_start, line_end from {_CITED}")
def citations_p13(spark, d):
    return C.citations(table(spark, d, "adjudications"))


@query(f"select *, coalesce(max(line_end) over (partition by assertion_id, path order by line_start, line_end desc rows between unbounded preceding and 1 preceding) >= line_end, false) as covered from {_CITED}")
def j13_covered_citations(spark, d):
    return C.covered(C.citations(table(spark, d, "adjudications")))


@query(f"select c.assertion_id, s.symbol_id from {_CITED} c join (select distinct symbol_id, path, line_start, line_end from symbols) s using (path, line_start, line_end)")
def j11_cited_symbols(spark, d):
    s = table(spark, d, "symbols").select("symbol_id", "path", "line_start", "line_end").distinct()
    return C.citations(table(spark, d, "adjudications")).join(s, ["path", "line_start", "line_end"]).select("assertion_id", "symbol_id")


@query(f"""with e as (select assertion_id, string_agg(path || ':' || line_start || '-' || line_end, ', ' order by path, line_start, line_end) as evidence from {_CITED} group by all)
 select assertion_id, 'kind: ' || kind || chr(10) || 'subject: ' || subject_qualname || chr(10) || 'claim: ' || claim || chr(10) || 'evidence: ' || coalesce(evidence, '') as document
 from (select distinct assertion_id, kind, subject_qualname, claim from assertions where status = 'active') left join e using (assertion_id)""")
def canonical_p6(spark, d):
    return C.canonical_documents(table(spark, d, "assertions"), C.citations(table(spark, d, "adjudications")))


@query(r"""select subject_qualname, kind, count(*) as n_claims from (select distinct subject_qualname, kind, regexp_replace(lower(trim(claim, ' ' || chr(9) || chr(10) || chr(13))), '[ \t\r\n]+', ' ', 'g') as s
 from assertions where status = 'active') group by all having count(*) > 1""")
def f15_conflicts(spark, d):
    return C.conflicts(table(spark, d, "assertions"))


@query("select distinct a.assertion_id, s.symbol_id from assertions a left join (select qualname, min(symbol_id) as symbol_id from symbols group by all) s on s.qualname = a.subject_qualname")
def j10_relink(spark, d):
    return C.relinked(table(spark, d, "assertions"), table(spark, d, "symbols"))


_ALIAS = f"case {_WORD('label')} when 'supported' then 'supported' when 'not_supported' then 'refuted' when 'uncertain' then 'unsupported' end"


@query(f"select cause, {_ALIAS} as verdict, count(*) as n from (select distinct * from adjudications) group by all")
def labels_p15(spark, d):
    w = C.word("label")
    v = F.lit(None).cast("string")
    for said, means in C.LABELS.items():
        v = F.when(w == said, means).otherwise(v)
    return table(spark, d, "adjudications").distinct().select("cause", v.alias("verdict")).groupBy("cause", "verdict").agg(F.count("*").alias("n"))


_Z = "1.959964"


@query(f"""with o as (select judge, count(*)::double as n, sum((verdict = 'supported')::int)::double as s from {_LATEST} group by all)
 select judge, n::bigint as n, round(s / n, 6) as rate, round(greatest(0, (s / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) - {_Z} * sqrt(s / n * (1 - s / n) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n)), 6) as low,
  round(least(1, (s / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) + {_Z} * sqrt(s / n * (1 - s / n) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n)), 6) as high from o""")
def m14_wilson(spark, d):
    o = C.latest_verdicts(table(spark, d, "verdicts")).groupBy("judge").agg(F.count("*").alias("n"), F.sum((F.col("verdict") == "supported").cast("int")).alias("s"))
    low, high = stats.wilson(F.col("s"), F.col("n"))
    return o.select("judge", "n", F.round(F.col("s") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""with o as (select assertion_id as c, (verdict = 'supported')::int::double as y from {_LATEST}), t as (select count(*)::double as n, avg(y) as p from o), g as (select c, count(*)::double as m, avg(y) as r from o group by all),
 s as (select n, count(*)::double as k, sum(m * r * (1 - r)) as w, sum(m * (r - p) * (r - p)) as b, sum(m * m) as mm from g cross join t group by n),
 x as (select n, k, w / (n - k) as mw, b / (k - 1) as mb, (n - mm / n) / (k - 1) as m0 from s), i as (select *, least(1, greatest(0, case when mb + (m0 - 1) * mw > 0 then (mb - mw) / (mb + (m0 - 1) * mw) else 0 end)) as icc from x)
 select n::bigint as n, k::bigint as clusters, round(icc, 6) as icc, round(1 + (m0 - 1) * icc, 6) as deff from i""")
def m15_kish(spark, d):
    v = C.latest_verdicts(table(spark, d, "verdicts"))
    return stats.kish_correction(v.select(F.col("assertion_id").alias("cluster"), (F.col("verdict") == "supported").cast("double").alias("outcome")))


@query(f"""with v as (select distinct judge, cause, {_ALIAS} as verdict, assertion_id from adjudications), j as (select {_WORD('judge')} as judge, cause, verdict from v)
 select judge, count(*) as n, sum((cause <> 'judged')::int)::bigint as failures, round(sum((verdict = 'supported' and cause = 'judged')::int)::double / count(*), 6) as faithful,
  round(sum((verdict = 'supported' and cause = 'judged')::int)::double / nullif(sum((verdict in ('supported','refuted') and cause = 'judged')::int), 0), 6) as of_decided from j group by all""")
def m16_faithfulness(spark, d):
    w = C.word("label")
    v = F.lit(None).cast("string")
    for said, means in C.LABELS.items():
        v = F.when(w == said, means).otherwise(v)
    rows = table(spark, d, "adjudications").select("judge", "cause", v.alias("verdict"), "assertion_id").distinct().select(C.word("judge").alias("judge"), "cause", "verdict")
    judged = F.col("cause") == "judged"
    good = F.count(F.when(judged & (F.col("verdict") == "supported"), 1))
    decided = F.count(F.when(judged & F.col("verdict").isin("supported", "refuted"), 1))
    return rows.groupBy("judge").agg(
        F.count("*").alias("n"), F.count(F.when(~judged, 1)).alias("failures"), F.round(good / F.count("*"), 6).alias("faithful"), F.round(F.try_divide(good, decided), 6).alias("of_decided")
    )


@query(f"""with o as (select judge, count(*) as n from (select {_WORD('judge')} as judge from verdicts) group by all) select judge, n, round(1 - pow(0.05, 1.0 / n), 6) as upper from o""")
def m20_zero_failure_bound(spark, d):
    o = table(spark, d, "verdicts").select(C.word("judge").alias("judge")).groupBy("judge").agg(F.count("*").alias("n"))
    return o.withColumn("upper", F.round(1 - F.pow(F.lit(0.05), 1 / F.col("n")), 6))


_SQ = r"trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g'))"


@query(f"""with s as (select min(assertion_id) as secret_id, {_SQ.replace('text', 'claim')} as t from assertions where claim is not null group by t), x as (select min(doc_id) as text_id, {_SQ} as t from documents where text is not null group by t),
 a as (select distinct secret_id, substr(t, p, 32) as g from (select secret_id, t, unnest(generate_series(1, length(t) - 31)) as p from s where length(t) >= 32)),
 b as (select distinct text_id, substr(t, p, 32) as g from (select text_id, t, unnest(generate_series(1, length(t) - 31)) as p from x where length(t) >= 32))
 select distinct secret_id, text_id from a join b using (g)""")
def j14_leaks(spark, d):
    secrets = table(spark, d, "assertions").select(F.col("assertion_id").alias("secret_id"), F.col("claim").alias("text"))
    return leaks.shared_windows(secrets, table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"))


_LEAK = f"""s as (select min(assertion_id) as secret_id, {_SQ.replace('text', 'claim')} as t from assertions where claim is not null group by t), x as (select min(doc_id) as text_id, {_SQ} as t from documents where text is not null group by t),
 a as (select distinct secret_id, substr(t, p, 32) as g from (select secret_id, t, unnest(generate_series(1, length(t) - 31)) as p from s where length(t) >= 32)),
 b as (select distinct text_id, substr(t, p, 32) as g from (select text_id, t, unnest(generate_series(1, length(t) - 31)) as p from x where length(t) >= 32))"""


def _leaking(spark, d):
    secrets = table(spark, d, "assertions").select(F.col("assertion_id").alias("secret_id"), F.col("claim").alias("text"))
    return leaks.leaking(secrets, table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"))


@query(f"with {_LEAK} select distinct text_id from b where g in (select g from a)")
def j14_leaking_texts(spark, d):
    """Texts that hold a passage of any claim; linear, where the pairs of j14_leaks are not."""
    return _leaking(spark, d)[0].select("text_id")


@query(f"with {_LEAK} select distinct secret_id from a where g in (select g from b)")
def j14_leaked_secrets(spark, d):
    return _leaking(spark, d)[1].select("secret_id")
