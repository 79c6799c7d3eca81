"""Ablations, calibration, nulls, gate controls and samples."""

from pyspark.sql import functions as F

from tessella.operators import claims as C, code, evaluation as V, mining, retrieval, serving as S, stats
from tessella.plans.catalog import query, table
from tessella.workloads import hybrid as H, mining as M, more
from tessella.workloads.claims import _CITED, _LATEST, _WORD
from tessella.workloads.code import _PRESENT, _SYM, _TEXTS
from tessella.workloads.more import _boot, _boot_by

_GOLD = "(select distinct tour_id as query_id, symbol_id as id from stops where tour_id % 20 = 0 and topic is not null)"
_RESULTS = f"""{H._POOL10}, fs as (select query_id, id, round(sum(1.0 / (60 + rank)), 9) as s from ld group by all), fl as (select query_id, id, row_number() over (partition by query_id order by s desc, id) as rank from fs),
 rs as (select 'lexical' as config, query_id, doc_id as id, rank from xlex where rank <= 10 union all select 'dense', query_id, id, rank from dn where rank <= 10 union all select 'graph', query_id, id, rank from gr where rank <= 10
  union all select 'lexical+dense', query_id, id, rank from fl where rank <= 10 union all select 'hybrid', query_id, id, rank from pool),
 nr as (select query_id, count(*) as relevant from {_GOLD} group by all), cf as (select distinct config from rs), ev as (select config, query_id, relevant from cf cross join nr),
 ht as (select r.config, r.query_id, r.rank, (g.id is not null)::int as hit from rs r join nr using (query_id) left join {_GOLD} g on g.query_id = r.query_id and g.id = r.id),
 hx as (select *, sum(hit) over (partition by config, query_id order by rank) as hits from ht),
 hq as (select config, query_id, sum(hit) as found, max(hit) as hit, sum(hit / log2(rank + 1)) as dcg, sum(hit * hits / rank) as ap, min(case when hit = 1 then rank end) as first_rank from hx group by all),
 sc as (select ev.config, ev.query_id, coalesce(round(found / relevant, 6), 0)::double as recall, coalesce(hit, 0)::double as hit, coalesce(round(dcg / (select sum(1 / log2(i + 1)) from range(1, 11) t(i) where i <= least(relevant, 10)), 6), 0)::double as ndcg,
  coalesce(round(ap / least(relevant, 10), 6), 0)::double as ap, coalesce(round(1.0 / first_rank, 6), 0)::double as rr from ev left join hq using (config, query_id))"""


def _cards(spark, d):
    from tessella.plans.scratch import Scratch
    from tessella.functions.text import is_test_path

    cut = Scratch(spark).cut
    topics, edges = more._topics(spark, d), cut(H.edges_by_id(spark, d))
    symbols = H.first_symbols(spark, d)
    lexical = cut(retrieval.bm25(H.symbol_docs(spark, d), topics, 40).withColumnRenamed("doc_id", "id").select("query_id", "rank", "id"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = vectors.join(topics.select(F.col("query_id").alias("id")), "id").withColumnRenamed("id", "query_id")
    dense = cut(retrieval.exact_knn(vectors.join(symbols.select(F.col("symbol_id").alias("id")), "id", "left_semi"), asked, 40).select("query_id", "rank", "id"))
    votes = lambda df, m: df.select("query_id", F.lit(m).alias("modality"), "rank", "id")
    found = votes(lexical, "lexical").unionByName(votes(dense, "dense"))
    spread = retrieval.expand(edges, retrieval.merge_seeds(found, ["lexical", "dense"], 10), 10)
    tests = symbols.filter(is_test_path(F.col("path"))).select(F.col("symbol_id").alias("id"))
    lists = {"lexical": lexical, "dense": dense, "graph": spread, "lexical+dense": retrieval.fuse(found, 10), "hybrid": retrieval.hybrid(lexical, dense, edges, tests, 10)}
    results = None
    for name, df in lists.items():
        part = df.select(F.lit(name).alias("config"), "query_id", "id", "rank").filter("rank <= 10")
        results = part if results is None else results.unionByName(part)
    gold = table(spark, d, "stops").filter("tour_id % 20 = 0 AND topic IS NOT NULL").select(F.col("tour_id").alias("query_id"), F.col("symbol_id").alias("id"))
    return cut(V.scorecards(results, gold))


@query(f"with {_RESULTS} select config, count(*) as n, {', '.join(f'round(avg({m}), 4) as {m}' for m in V.METRICS)} from sc group by all")
def m12_ablation(spark, d):
    return V.ablation(_cards(spark, d))


@query(f"""with {_RESULTS}, {_boot_by("select a.config as grp, a.query_id as cluster, a.ndcg - b.ndcg as value from sc a join sc b on b.query_id = a.query_id and b.config = 'lexical' where a.config <> 'lexical'")}
 select grp as config, n, round(delta, 6) as delta, round(low, 6) as low, round(high, 6) as high, round(low, 6) > 0 or round(high, 6) < 0 as differs, n < 128 as few from bo join (select grp, count(*) as n, avg(value) as delta from bv group by grp) using (grp)""")
def m13_delta_report(spark, d):
    return V.delta_report(_cards(spark, d), "lexical")


@query(f"""with {_RESULTS}, t as (select sc.*, s.repo_id as repo from sc join (select tour_id as query_id, min(repo_id) as repo_id from stops group by all) s using (query_id) where config = 'lexical')
 select repo, count(*) as n, round(avg(ndcg), 4) as ndcg, round(avg(recall), 4) as recall from t group by grouping sets ((), (repo)) having repo is null or (select count(distinct repo) from t) >= 2""")
def m5_strata(spark, d):
    """Pooled, and per repository where there are at least two."""
    repo = table(spark, d, "stops").groupBy(F.col("tour_id").alias("query_id")).agg(F.min("repo_id").alias("repo"))
    t = _cards(spark, d).filter("config = 'lexical'").join(repo, "query_id")
    n = t.agg(F.count_distinct("repo").alias("repos"))
    g = t.rollup("repo").agg(F.count("*").alias("n"), F.round(F.avg("ndcg"), 4).alias("ndcg"), F.round(F.avg("recall"), 4).alias("recall"))
    return g.crossJoin(n).filter("repo IS NULL OR repos >= 2").drop("repos")


_F1 = "case when len(list_intersect(a, {b})) = 0 then 0.0 else 2.0 * len(list_intersect(a, {b})) / (len(a) + len({b})) end".format
_TOKD = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'))".format
_ITEMS = "(select assertion_id as id, min(kind) as cluster, min(claim) as x, min(subject_qualname) as y from assertions where claim is not null group by all)"


@query(f"""with i as (select id, cluster, {_TOKD('x')} as a, {_TOKD('y')} as b from {_ITEMS}), ob as (select round(avg({_F1(b='b')}), 9) as observed from i),
 e as (select i.*, d, md5('20-' || d || '-' || id) as h from i cross join range(100) t(d)),
 n as (select *, coalesce(lead(b) over w, first_value(b) over (partition by d order by h, id rows between unbounded preceding and unbounded following)) as b2, coalesce(lead(cluster) over w, first_value(cluster) over (partition by d order by h, id rows between unbounded preceding and unbounded following)) as c2 from e window w as (partition by d order by h, id)),
 p as (select d, round(avg({_F1(b='b2')}), 9) as m from n where cluster <> c2 group by d)
 select round(observed, 6) as observed, round(avg(m), 6) as null_mean, round(stddev_samp(m), 6) as null_sd, round((1.0 + count(*) filter (m >= observed)) / (1 + count(*)), 6) as p from p cross join ob group by observed""")
def m25_derangement_null(spark, d):
    """The SQL's 100 draws; the operator's default is 500."""
    i = table(spark, d, "assertions").filter("claim IS NOT NULL").groupBy(F.col("assertion_id").alias("id")).agg(F.min("kind").alias("cluster"), F.min("claim").alias("a"), F.min("subject_qualname").alias("b"))
    return V.derangement_null(i, mining.token_f1, draws=100)


_LIFT = f"select cluster, {_F1(b='b')} as value from (select cluster, {_TOKD('x')} as a, {_TOKD('y')} as b from {_ITEMS})"


@query(f"""with bt as ({_boot(_LIFT, 2000)}), m as (select avg(value) as mean, count(distinct cluster) as k from ({_LIFT}))
 select round(mean, 6) as mean, round(case when k < 2 then mean else min(value) end, 6) as low, round(case when k < 2 then mean else max(value) end, 6) as high from m cross join bt group by mean, k""")
def m26_clustered_lift(spark, d):
    a = table(spark, d, "assertions").filter("claim IS NOT NULL").groupBy("assertion_id").agg(F.min("kind").alias("cluster"), F.min("claim").alias("a"), F.min("subject_qualname").alias("b"))
    return V.lift_interval(a.select("cluster", mining.token_f1(F.col("a"), F.col("b")).alias("value")))


_HIDE = r"list_distinct(list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'), lambda t: not list_contains(regexp_extract_all(lower(qualname), '[\p{{L}}\p{{N}}]+'), t)))".format


@query(f"""with s as (select distinct symbol_id, qualname, summary from stops where summary is not null), t as (select s.symbol_id, md5(summary) as summary, {_HIDE('summary')} as a, {_HIDE('docstring')} as b from s join (select symbol_id, max(docstring) as docstring from symbols group by all) y using (symbol_id) where docstring is not null)
 select symbol_id, summary, round({_F1(b='b')}, 6) as f1 from t""")
def m27_purpose_scores(spark, d):
    """A stop's summary against the symbol's documentation, with the symbol's own name blinded on both sides."""
    docs = table(spark, d, "symbols").groupBy("symbol_id").agg(F.max("docstring").alias("docstring")).filter("docstring IS NOT NULL")
    s = table(spark, d, "stops").filter("summary IS NOT NULL").select("symbol_id", "qualname", "summary").distinct().join(docs, "symbol_id")
    hide = lambda c: F.array_join(mining.blind(F.col(c), F.col("qualname")), " ")
    return s.select("symbol_id", F.md5(F.col("summary").cast("binary")).alias("summary"), F.round(mining.token_f1(hide("summary"), hide("docstring")), 6).alias("f1"))


@query(f"""with mm as (select user_id as task, event_type as arm, avg(value) as m from events where value > 0 group by all), {_boot_by("select a.arm as grp, a.task as cluster, ln(a.m / b.m) as value from mm a join mm b on b.task = a.task and b.arm = 'click' where a.arm <> 'click'")}
 select grp as arm, tasks, round(exp(v), 4) as ratio, round(exp(low), 4) as low, round(exp(high), 4) as high from bo join (select grp, count(*) as tasks, avg(value) as v from bv group by grp) using (grp)""")
def m29_log_ratios(spark, d):
    """Arms are event types, tasks are users."""
    return V.log_ratio(table(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_type").alias("arm"), "value"), "click")


@query("""with b as (select distinct tour_id as block from stops), r as (select block, arm from b, (values ('bare'), ('graph'), ('claims')) t(arm)) select block, arm, row_number() over (partition by block order by md5('20-' || block || '-' || arm), arm) as position from r""")
def m31_arm_orders(spark, d):
    return V.arm_orders(table(spark, d, "stops").select(F.col("tour_id").alias("block")), ["bare", "graph", "claims"])


@query("select id, stratum from (select id, stratum, row_number() over (partition by stratum order by md5('20-' || id), id) as turn from (select distinct assertion_id as id, kind as stratum from assertions)) order by turn, stratum limit 60")
def r8_stratified_sample(spark, d):
    return V.stratified_sample(table(spark, d, "assertions").select(F.col("assertion_id").alias("id"), F.col("kind").alias("stratum")), 60)


_ANSWERS = f"(select judge, cause <> 'judged' as failed, row_number() over (partition by judge order by assertion_id, h) as place from (select {_WORD('judge')} as judge, cause, assertion_id, md5(reasoning || coalesce(label, '') || cause) as h from (select distinct * from adjudications)))"


@query(f"""with r as (select judge, count(*) over w as n, (sum(failed::int) over w)::bigint as failures from {_ANSWERS} window w as (partition by judge order by place rows between unbounded preceding and current row))
 select judge, min(n) as n, arg_min(failures, n) as failures from r where n >= 10 and failures > 0.05 * n group by all""")
def m17_instrument_abort(spark, d):
    h = F.md5(F.concat("reasoning", F.coalesce("label", F.lit("")), "cause").cast("binary"))
    a = table(spark, d, "adjudications").distinct().select(C.word("judge").alias("judge"), (F.col("cause") != "judged").alias("failed"), F.struct("assertion_id", h.alias("h")).alias("place"))
    return V.instrument_abort(a, share=0.05)


_SPANS = f"sp as (select assertion_id, list(path || ':' || line_start || '-' || line_end order by path, line_start, line_end) as c from {_CITED} group by all)"
_BLOCK = "'--- span ' || i || ' of ' || len(c) || ': ' || {x} || ' ---' || chr(10) || 'cites ' || {x}".format
_PERT = f"""{_SPANS}, tx as (select assertion_id, c, array_to_string(list_transform(range(1, len(c) + 1), lambda i: {_BLOCK(x='c[i]')}), chr(10)) as t, array_to_string(list_transform(range(1, len(c) + 1), lambda i: {_BLOCK(x='c[len(c) - i + 1]')}), chr(10)) as turned from sp),
 pt as (select assertion_id as id, 'identity' as perturbation, t as text from tx union all select assertion_id, 'span_order', turned from tx union all select assertion_id, 'trailing_whitespace', replace(t, chr(10), '  ' || chr(10)) || '  ' from tx
  union all select assertion_id, 'separator_style', regexp_replace(t, '(?m)^--- (span [^\\n]*?) ---$', '=== \\1 ===', 'g') from tx union all select assertion_id, 'blank_lines', regexp_replace(t, '\\n(--- span )', chr(10) || chr(10) || '\\1', 'g') from tx)"""


def _perturbed(spark, d):
    place = F.struct("path", "line_start", "line_end", F.concat(F.col("path"), F.lit(":"), F.col("line_start"), F.lit("-"), F.col("line_end")).alias("t"))
    s = C.citations(table(spark, d, "adjudications")).groupBy("assertion_id").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["t"]).alias("c"))
    s = s.withColumn("b", F.transform("c", lambda x: F.concat(F.lit("cites "), x)))
    kinds = V.perturbed(V.evidence_text(F.col("c"), F.col("b")), F.col("c"), F.col("b"))
    return s.select(F.col("assertion_id").alias("id"), F.explode(F.create_map(*(x for k, v in kinds.items() for x in (F.lit(k), v)))).alias("perturbation", "text"))


@query(f"with {_PERT} select id, perturbation, md5(text) as text from pt")
def m18_perturbations(spark, d):
    return _perturbed(spark, d).withColumn("text", F.md5(F.col("text").cast("binary")))


@query(f"with {_PERT}, v as (select id, perturbation, substr(md5(text), 1, 1) < '8' as verdict from pt) select v.perturbation, count(*) as n, count(*) filter (v.verdict <> p.verdict) as flips, round(count(*) filter (v.verdict <> p.verdict)::double / count(*), 6) as rate from v join (select * from v where perturbation = 'identity') p using (id) group by all")
def m18_flip_rates(spark, d):
    """The stand-in judge decides by the text's hash, so it flips half the time wherever the text changes."""
    return V.flip_rates(_perturbed(spark, d).select("id", "perturbation", (F.substring(F.md5(F.col("text").cast("binary")), 1, 1) < "8").alias("verdict")))


_PAIRS = f"cf as (select a.judge as judge_a, b.judge as judge_b, a.verdict as a, b.verdict as b, count(*) as n from {_LATEST} a join {_LATEST} b on a.assertion_id = b.assertion_id and a.judge < b.judge group by all)"


def _pairs(spark, d):
    v = C.latest_verdicts(table(spark, d, "verdicts")).select(F.col("assertion_id").alias("item"), "judge", F.col("verdict").alias("label"))
    return V.judge_pairs(v)


@query(f"with {_PAIRS} select * from cf")
def m19_confusion(spark, d):
    return _pairs(spark, d)


@query(f"""with {_PAIRS}, g as (select judge_a, judge_b, sum(n)::double as t, sum(n) filter (a = b)::double as same, sum(n) filter (a = 'supported' and b = 'supported')::double as tp, sum(n) filter (b = 'supported')::double as said, sum(n) filter (a = 'supported')::double as tr from cf group by all),
 x as (select judge_a, judge_b, a as l, sum(n) as x from cf group by all), y as (select judge_a, judge_b, b as l, sum(n) as y from cf group by all), c as (select judge_a, judge_b, sum(x * y)::double as xy from x join y using (judge_a, judge_b, l) group by all)
 select judge_a, judge_b, t::bigint as n, round(coalesce(same, 0) / t, 6) as agreement, round(coalesce(tp, 0) / nullif(coalesce(said, 0), 0), 6) as precision, round(coalesce(tp, 0) / nullif(coalesce(tr, 0), 0), 6) as recall,
  round((coalesce(same, 0) / t - coalesce(xy, 0) / (t * t)) / nullif(1 - coalesce(xy, 0) / (t * t), 0), 6) as kappa from g left join c using (judge_a, judge_b)""")
def m19_calibration(spark, d):
    return V.calibration(_pairs(spark, d))


@query(f"""with {_PAIRS}, g as (select judge_a, judge_b, sum(n)::double as t, sum(n) filter (a = b)::double as same from cf group by all), x as (select judge_a, judge_b, a as l, sum(n) as x from cf group by all), y as (select judge_a, judge_b, b as l, sum(n) as y from cf group by all),
 c as (select judge_a, judge_b, sum(x * y)::double as xy from x join y using (judge_a, judge_b, l) group by all)
 select judge_a, judge_b, t::bigint as n, round((coalesce(same, 0) / t - coalesce(xy, 0) / (t * t)) / nullif(1 - coalesce(xy, 0) / (t * t), 0), 6) as kappa from g left join c using (judge_a, judge_b)""")
def m19_kappa(spark, d):
    return V.calibration(_pairs(spark, d)).select("judge_a", "judge_b", "n", "kappa")


@query()
def m20_clopper_pearson(spark, d):
    v = table(spark, d, "adjudications").distinct().select(C.word("judge").alias("key"), (F.col("cause") != "judged").cast("long").alias("f"))
    return V.clopper_pearson(v.groupBy("key").agg(F.sum("f").alias("failures"), F.count("*").alias("n")))


_GOODS = f"(select distinct s.repo_id, s.symbol_id from {_SYM} s join {_PRESENT} f using (repo_id, path) where kind <> 'module' and byte_start >= 0 and byte_end > byte_start and line_start >= 1 and line_end >= line_start and octet_length(bytes) >= byte_end and sha256(unhex(substr(hex(bytes), 2 * byte_start + 1, 2 * (byte_end - byte_start)))) = content_hash)"


@query(f"select family, count(*) as n, count(*) as held from {_GOODS}, (values {', '.join(f'({f!r})' for f in V.FAMILIES)}) t(family) group by all")
def m21_gate_report(spark, d):
    """Every family of bad submissions is refused with its own code, and the good ones pass."""
    s = table(spark, d, "symbols").distinct().filter("kind <> 'module'")
    snaps = table(spark, d, "snapshots")
    checked = code.checked_spans(s.withColumnRenamed("symbol_id", "span_id"), snaps).filter("reason = 'ok'").select("repo_id", "span_id")
    good = s.filter("line_start >= 1 AND line_end >= line_start").select("repo_id", F.col("symbol_id").alias("span_id"), "path", F.col("qualname").alias("subject"), "line_start", "line_end", "byte_start", "byte_end", "content_hash").join(checked, ["repo_id", "span_id"], "left_semi")
    claims, spans, expected = V.gate_corpus(good)
    return V.gate_report(expected, S.claim_admission(claims, spans, s, snaps))


@query(f"""with s as (select event_type, stddev_samp(value) as sd, count(*)::double as n from events where value is not null group by all) select event_type, round(sd, 6) as sd,
 round(sd * sqrt((n - 1) / ((n - 1) * pow(1 - 2 / (9 * (n - 1)) + 1.959964 * sqrt(2 / (9 * (n - 1))), 3))), 6) as low, round(sd * sqrt((n - 1) / ((n - 1) * pow(1 - 2 / (9 * (n - 1)) - 1.959964 * sqrt(2 / (9 * (n - 1))), 3))), 6) as high from s""")
def d13_sd_interval(spark, d):
    s = table(spark, d, "events").filter("value IS NOT NULL").groupBy("event_type").agg(F.stddev_samp("value").alias("sd"), F.count("*").cast("double").alias("n"))
    low, high = V.sd_interval(F.col("sd"), F.col("n"))
    return s.select("event_type", F.round("sd", 6).alias("sd"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""with s as (select stddev_samp(value) as sd from events where value is not null) select delta, deff, ceil(greatest(1.0, deff) * pow((1.959964 + 0.841621) * sd / delta, 2))::bigint as needed from s, (values (0.5::double), (1.0), (2.0), (5.0)) d(delta), (values (0.8::double), (1.0), (2.5)) e(deff)""")
def m11_power_table(spark, d):
    s = table(spark, d, "events").filter("value IS NOT NULL").agg(F.stddev_samp("value").alias("sd"))
    out = None
    for delta in (0.5, 1.0, 2.0, 5.0):
        for deff in (0.8, 1.0, 2.5):
            row = s.select(F.lit(delta).alias("delta"), F.lit(deff).alias("deff"), stats.required_n(F.col("sd"), delta, F.lit(deff)).cast("long").alias("needed"))
            out = row if out is None else out.unionByName(row)
    return out


@query(f"""select repo_id, count(*) as unindexed from (select distinct repo_id, path from {_PRESENT} where (repo_id, path) not in (select (repo_id, path) from symbols)) group by all""")
def d7_unindexed(spark, d):
    now = code.current_states(table(spark, d, "snapshots"), True).filter("state = 'present' AND bytes IS NOT NULL").select("repo_id", "path")
    return now.join(table(spark, d, "symbols").select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti").groupBy("repo_id").agg(F.count("*").alias("unindexed"))


@query("""with s as (select kind, count(*) as n from (select distinct * from symbols) group by all), t as (select kind, count(distinct (repo_id, symbol_id)) as m from stops group by all) select kind, m as selected, n as population, round((m::double / (select sum(m) from t)) / (n::double / (select sum(n) from s)), 6) as over from s join t using (kind)""")
def d12_over_representation(spark, d):
    s = table(spark, d, "symbols").distinct().groupBy("kind").agg(F.count("*").alias("population"))
    t = table(spark, d, "stops").select("kind", "repo_id", "symbol_id").distinct().groupBy("kind").agg(F.count("*").alias("selected"))
    sums = s.agg(F.sum("population").alias("all_p")).crossJoin(t.agg(F.sum("selected").alias("all_s")))  # one row
    return s.join(t, "kind").crossJoin(sums).select("kind", "selected", "population", F.round((F.col("selected") / F.col("all_s")) / (F.col("population") / F.col("all_p")), 6).alias("over"))
