"""Prose functions over all documents, and descriptive statistics."""

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import budget, mining, stats
from tessella.plans.catalog import query, table

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')".format
_SQ = r"trim(regexp_replace({}, '[ \t\n\r\f\x0b]+', ' ', 'g'))".format
_SUBJECT = "split_part(text, chr(10), 1)"


def _docs(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL")


@query(r"""select doc_id, trim(regexp_replace(text, '(\n[ \t\r]*([A-Za-z][A-Za-z0-9-]*:[ \t][^\n]*)?)+$', ''), ' ' || chr(9) || chr(10) || chr(13)) as prose from documents where text is not null""")
def x3_strip_trailers(spark, d):
    return _docs(spark, d).select("doc_id", X.without_trailers(F.col("text")).alias("prose"))


@query("select doc_id, regexp_replace(text, '```.*?```', chr(10), 'gs') as prose from documents where text is not null")
def x6_strip_fences(spark, d):
    return _docs(spark, d).select("doc_id", X.without_fences(F.col("text")).alias("prose"))


@query(f"""with t as (select doc_id, list_distinct({_TOK('split_part(text, chr(10), 1)')}) as q, list_distinct({_TOK('text')}) as s from documents where text is not null)
 select doc_id, case when len(q) = 0 then 0 else round(len(list_intersect(q, s))::double / len(q), 6) end as overlap from t""")
def x8_source_overlap(spark, d):
    return _docs(spark, d).select("doc_id", F.round(mining.overlap(F.split(F.col("text"), "\n")[0], F.col("text")), 6).alias("overlap"))


_BLIND = f"list_filter({_TOK('claim')}, lambda t: not list_contains({_TOK('subject_qualname')}, t))"


@query(f"select distinct assertion_id, array_to_string({_BLIND}, ' ') as blind from assertions")
def x9_blind_claims(spark, d):
    a = table(spark, d, "assertions").select("assertion_id", "claim", "subject_qualname").distinct()
    return a.select("assertion_id", F.array_join(mining.blind(F.col("claim"), F.col("subject_qualname")), " ").alias("blind"))


_CODE = rf"(len(regexp_extract_all(claim, '[=(){{}}\[\]]'))::double / nullif(len(list_filter(string_split_regex(claim, '[ \t\n\r\f\x0b]+'), lambda w: w <> '')), 0))"
_CLASS = f"""(select *, case when reject is null and row_number() over (partition by lower({_SQ('claim')}), subject_qualname, reject order by assertion_id) > 1 then 'duplicate' else reject end as verdict from
 (select *, case when len(list_filter(string_split({_SQ('claim')}, ' '), lambda w: w <> '')) < 5 then 'too_short' when coalesce({_CODE} >= 1, false) then 'code_like' when len({_BLIND}) < 3 then 'name_only' end as reject
 from (select distinct assertion_id, claim, subject_qualname from assertions)))"""


def _candidates(spark, d):
    return table(spark, d, "assertions").select(F.col("assertion_id").alias("id"), F.col("claim").alias("query"), F.col("subject_qualname").alias("names")).distinct()


@query(f"select assertion_id as id, verdict as reject from {_CLASS}")
def x11_classify(spark, d):
    return mining.classified(_candidates(spark, d)).select("id", "reject")


@query(f"select coalesce(verdict, 'kept') as outcome, count(*) as n from {_CLASS} group by all")
def d10_funnel(spark, d):
    return mining.classified(_candidates(spark, d)).groupBy(F.coalesce("reject", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""with b as (select distinct assertion_id as id, array_to_string({_BLIND}, ' ') as t, subject_qualname as relevant from assertions),
 w as (select *, min(relevant) over (partition by t) = max(relevant) over (partition by t) as one, row_number() over (partition by t, relevant order by id) as n from b) select id, relevant from w where one and n = 1""")
def x12_unambiguous(spark, d):
    b = _candidates(spark, d).select("id", F.array_join(mining.blind(F.col("query"), F.col("names")), " ").alias("text"), F.col("names").alias("relevant"))
    return mining.unambiguous(b).select("id", "relevant")


@query(f"""with b as (select distinct assertion_id, len({_BLIND}) as n from assertions) select k as min_blind, sum((n >= k)::int)::bigint as kept from b, (values (2),(3),(4),(5)) t(k) group by all""")
def x15_blind_sensitivity(spark, d):
    n = _candidates(spark, d).select(F.size(mining.blind(F.col("query"), F.col("names"))).alias("n"))
    kept = n.agg(*(F.count(F.when(F.col("n") >= k, 1)).alias(str(k)) for k in (2, 3, 4, 5)))
    return kept.unpivot([], ["2", "3", "4", "5"], "min_blind", "kept").withColumn("min_blind", F.col("min_blind").cast("int"))


@query(f"select doc_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) as slug from documents where text is not null")
def x20_slug(spark, d):
    return _docs(spark, d).select("doc_id", X.slug(F.col("text")).alias("slug"))


# Fixed values, held here on their own: subjects that say nothing about purpose.
_STOCK = (
    r"(?i)^(wip|fixup|squash|fix|fixes|fixed|bug ?fix|update|updates|updated|cleanup|clean ?up|refactor|refactoring|misc|minor|tweak|tweaks|nit|nits|typo|typos|lint|format|formatting|style|rename"
    r"|address (review|comments|feedback)|review (fixes|feedback)|pr feedback|comments|bump|bump (version|deps|dependencies)|version bump|release|initial commit|first commit|init|initial|checkpoint|save|temp|tmp"
    r"|test|tests|more tests|add tests|docs|doc|documentation|readme|chore|revert.*|merge.*|v?\d+(\.\d+)*)$"
)
_STRIP = rf"trim(regexp_replace(regexp_replace({_SQ(_SUBJECT)}, '^[A-Za-z][A-Za-z0-9_.]*(\([^)]*\))?!?: *', ''), '\.+$', ''))"


@query(f"select doc_id, ({_STRIP} = '' or regexp_matches({_STRIP}, '{_STOCK}') or len(string_split({_STRIP}, ' ')) <= 2) as boilerplate from documents where text is not null")
def b11_boilerplate(spark, d):
    return _docs(spark, d).select("doc_id", X.is_boilerplate(F.split(F.col("text"), "\n")[0]).alias("boilerplate"))


@query(f"select doc_id, coalesce({_CODE.replace('claim', 'text')} >= 1, false) as code from documents where text is not null")
def b13_looks_like_code(spark, d):
    return _docs(spark, d).select("doc_id", X.looks_like_code(F.col("text")).alias("code"))


@query(f"""with t as (select distinct assertion_id, list_distinct({_TOK('claim')}) as a, list_distinct({_TOK('reasoning')}) as b, reasoning from adjudications)
 select assertion_id, md5(reasoning) as reasoning, case when len(list_intersect(a, b)) = 0 then 0 else round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) end as f1 from t""")
def m23_token_f1(spark, d):
    a = table(spark, d, "adjudications").select("assertion_id", "claim", "reasoning").distinct()
    return a.select("assertion_id", F.md5("reasoning").alias("reasoning"), F.round(mining.token_f1(F.col("claim"), F.col("reasoning")), 6).alias("f1"))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings)
 select a.vec_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda x: x[1] * x[2])) / sqrt(list_sum(list_transform(a.e, lambda x: x * x)) * list_sum(list_transform(b.e, lambda x: x * x))), 5) as cosine
 from e a join e b on b.vec_id = a.vec_id + 1""")
def m24_cosine(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    return pairs.select("vec_id", F.round(dot("e", "f") / F.sqrt(dot("e", "e") * dot("f", "f")), 5).alias("cosine"))


_PS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)


@query("""with v as (select value, row_number() over (order by value) - 1 as i, count(*) over () as n from events where value is not null)
 select p, value from v, (values (0.0::double),(0.1),(0.25),(0.5),(0.75),(0.9),(0.99),(1.0)) t(p) where i = least(n - 1, floor(p * n))""")
def d11_percentiles(spark, d):
    return stats.nearest_rank(table(spark, d, "events").select("value"), list(_PS))


@query("select least(floor(confidence * 10) * 10, 90)::int as decile, count(*) as n from (select distinct assertion_id, confidence from assertions) where confidence is not null group by all")
def d11_deciles(spark, d):
    a = table(spark, d, "assertions").select("assertion_id", "confidence").distinct().filter("confidence IS NOT NULL")
    return a.groupBy(F.least(F.floor(F.col("confidence") * 10) * 10, F.lit(90)).cast("int").alias("decile")).agg(F.count("*").alias("n"))


@query("""select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(stddev_samp(value) / avg(value), 6) as cv, min(value) as low, round(median(value), 6) as median, max(value) as high from events group by all""")
def d13_spread(spark, d):
    v = F.col("value")
    events = table(spark, d, "events").select(F.col("event_type").alias("group"), "value")
    g = events.groupBy("group").agg(
        F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.round(F.try_divide(F.stddev_samp(v), F.avg(v)), 6).alias("cv"), F.min(v).alias("low"), F.max(v).alias("high"),
    )
    return g.join(stats.medians(events), "group", "left").select(F.col("group").alias("event_type"), "n", "mean", "sd", "cv", "low", F.round("median", 6).alias("median"), "high")


@query("""with g as (select event_type as c, count(*) as m, avg(value) as mean, var_pop(value) as v from events where value is not null group by all), t as (select avg(value) as grand, count(distinct event_type) as k from events where value is not null),
 s as (select count(*) as g, sum(m)::double as n, avg(m) as size, max(k) as k, sum(m * (mean - grand) * (mean - grand)) as b, sum(m * v) as w from g cross join t where m > 1),
 x as (select *, b / (g - 1) as msb, w / (n - g) as msw from s) select round(greatest(1.0, coalesce(case when k > 1 and msb + (size - 1) * msw > 0 then 1 + (size - 1) * (msb - msw) / (msb + (size - 1) * msw) end, 1.0)), 6) as deff from x""")
def m10_design_effect(spark, d):
    return stats.design_effect(table(spark, d, "events").filter("value IS NOT NULL").select(F.col("event_type").alias("cluster"), "value"))


@query("""with s as (select event_type, stddev_samp(value) as sd, count(*) as n from events where value is not null group by all)
 select event_type, round(1.959964 * sd / sqrt(n), 6) as half_width, ceil(pow((1.959964 + 0.841621) * sd / 1.0, 2))::bigint as needed from s""")
def m11_required_n(spark, d):
    s = table(spark, d, "events").filter("value IS NOT NULL").groupBy("event_type").agg(F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))
    return s.select("event_type", F.round(stats.Z95 * F.col("sd") / F.sqrt("n"), 6).alias("half_width"), stats.required_n(F.col("sd"), 1.0).cast("long").alias("needed"))


@query("""with k as (select repo_id, count(*) as q from (select distinct * from symbols) group by all), m as (select count(*)::double as m, avg(q) as q from k)
 select icc, round(m * q / (1 + (q - 1) * icc), 6) as effective_n from m, (values (0.0::double),(0.01),(0.026),(0.1)) t(icc)""")
def m30_effective_n(spark, d):
    m = table(spark, d, "symbols").distinct().groupBy("repo_id").count().agg(F.count("*").alias("m"), F.avg("count").alias("q"))
    icc = spark.createDataFrame([(x,) for x in (0.0, 0.01, 0.026, 0.1)], "icc double")
    return icc.crossJoin(m).select("icc", F.round(F.col("m") * F.col("q") / (1 + (F.col("q") - 1) * F.col("icc")), 6).alias("effective_n"))


@query("""with r as (select tour_id as grp, symbol_id as id, min(stop_order) as rank, max(line_end - line_start + 1) as size from stops group by all)
 select r.grp as "group", sum(size) as offered, count(*) as n from r group by all""")
def r6_offered(spark, d):
    return _tour_items(spark, d).groupBy("group").agg(F.sum("size").alias("offered"), F.count("*").alias("n"))


def _tour_items(spark, d):
    s = table(spark, d, "stops").groupBy(F.col("tour_id").alias("group"), F.col("symbol_id").alias("id"))
    return s.agg(F.min("stop_order").alias("rank"), F.max(F.col("line_end") - F.col("line_start") + 1).cast("long").alias("size"))


@query("""with recursive r as (select tour_id as grp, symbol_id as id, min(stop_order) as rank, max(line_end - line_start + 1) as size from stops group by all),
 o as (select *, row_number() over (partition by grp order by rank, id) as i from r),
 f(grp, i, room) as (select grp, 0::bigint, 100::bigint from (select distinct grp from o) union all select f.grp, o.i, case when o.size <= f.room then f.room - o.size else f.room end from f join o on o.grp = f.grp and o.i = f.i + 1)
 select o.grp as "group", o.id, o.size <= f.room as taken from o join f on f.grp = o.grp and f.i = o.i - 1""")
def r6_line_budget(spark, d):
    return budget.take_within(_tour_items(spark, d), 100)


@query("""select kind, count(*) as n, round(avg((docstring is not null and trim(docstring) <> '')::int), 6) as documented, round(avg(starts_with(name, '_')::int), 6) as private from (select distinct * from symbols) group by all""")
def d12_profile(spark, d):
    s = table(spark, d, "symbols").distinct()
    doc = F.coalesce(F.trim("docstring") != "", F.lit(False)).cast("int")
    return s.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(doc), 6).alias("documented"), F.round(F.avg(F.startswith("name", F.lit("_")).cast("int")), 6).alias("private"))


@query("""with c as (select distinct unnest(calls_here) as q from stops), s as (select distinct qualname as q from symbols)
 select 'missing' as part, count(*) as n from (select q from c except select q from s) union all select 'both', count(*) from (select q from c intersect select q from s) union all select 'either', count(*) from (select q from c union select q from s)""")
def s1_set_operations(spark, d):
    c = table(spark, d, "stops").select(F.explode("calls_here").alias("q")).distinct()
    s = table(spark, d, "symbols").select(F.col("qualname").alias("q")).distinct()
    n = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return n(c.exceptAll(s).distinct(), "missing").unionByName(n(c.intersect(s), "both")).unionByName(n(c.union(s).distinct(), "either"))


@query("""with c as (select n.n_name as src, m.n_name as dst, count(*) as n from lineitem l join orders o on o.o_orderkey = l.l_orderkey join customer c on c.c_custkey = o.o_custkey join supplier s on s.s_suppkey = l.l_suppkey
 join nation n on n.n_nationkey = c.c_nationkey join nation m on m.n_nationkey = s.s_nationkey where n.n_nationkey <> m.n_nationkey group by all) select src, dst, n, row_number() over (partition by src order by n desc, dst) as rank from c qualify rank <= 3""")
def j4_trade_graph(spark, d):
    from pyspark.sql import Window as W

    t = lambda n: table(spark, d, n)
    buyer = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("src"))
    seller = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("dst"))
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(seller, F.col("l_suppkey") == F.col("s_suppkey"))
    sold = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(buyer, F.col("o_custkey") == F.col("c_custkey"))
    n = sold.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(F.col("n").desc(), "dst"))).filter("rank <= 3")
