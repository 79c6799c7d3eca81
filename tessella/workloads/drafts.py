"""Menus, drafts, and the rounds of generators and judges, with stand-ins for models."""

from pyspark.sql import functions as F

from tessella.operators import claims as C, code, drafts as D, serving as S
from tessella.plans.catalog import query, table
from tessella.workloads import hybrid as H
from tessella.workloads.code import _SYM, _TEST, _TEXTS
from tessella.workloads.serving import _CHECKS, checks

_CANDIDATES = f"(select repo_id, symbol_id, qualname from {_SYM} where kind in ('function','method') and line_end - line_start + 1 >= 3 and not starts_with(name, '_') and not {_TEST})"
_MENU = f"""{H._CE}, {_TEXTS}, src as (select symbol_id as id, qualname, max(strlen(body)) as size from vt join sy using (repo_id, symbol_id) where body is not null group by all), bs as (select distinct symbol_id as subject from {_CANDIDATES} where symbol_id in (select id from src)),
 nr0 as (select subject, id, min(side) as side from (select src as subject, dst as id, 0 as side from ce union all select dst, src, 1 from ce) where subject <> id group by all),
 nr as (select n.*, s.qualname, row_number() over (partition by subject, side order by qualname, id) as r, count(*) filter (side = 0) over (partition by subject) as nc, count(*) filter (side = 1) over (partition by subject) as nk
  from nr0 n join src s using (id) where size <= 4000 and subject in (select subject from bs)),
 n2 as (select *, least(nc, case when nk = 0 then 11 else 6 end) as f from nr), n3 as (select *, least(nk, 11 - f) as k from n2),
 mr as (select subject, id, case when side = 1 then 2 when r > f then 3 else 1 end as part, r from n3 where (side = 0 and r <= 11 - k) or (side = 1 and r <= k) union all select subject, subject, 0, 1 from bs),
 mn as (select subject, row_number() over (partition by subject order by part, r) as ref, id, case part when 0 then 'subject' when 2 then 'caller' else 'callee' end as part from mr)"""


def _sources(spark, d):
    v = code.verified_texts(table(spark, d, "symbols").distinct(), table(spark, d, "snapshots"))
    names = H.first_symbols(spark, d).select("repo_id", "symbol_id", "qualname")
    return v.join(names, ["repo_id", "symbol_id"]).groupBy(F.col("symbol_id").alias("id"), "qualname").agg(F.max(F.octet_length("body")).alias("size"), F.max(F.col("body").cast("string")).alias("text"))


def _candidates(spark, d):
    return code.candidate_symbols(table(spark, d, "symbols").distinct()).select("repo_id", "symbol_id", "qualname")


def _menu(spark, d):
    return D.menus(_candidates(spark, d).select(F.col("symbol_id").alias("subject")), H.edges_by_id(spark, d), _sources(spark, d))


@query(f"with {_MENU} select subject, ref, id, part from mn")
def menu_p17(spark, d):
    return _menu(spark, d)


@query(f"""with {_MENU}, dr as (select distinct subject as draft_id, subject, unnest([2, 1, 2, 99]) as ref from bs), h as (select distinct dr.draft_id, dr.ref, mn.id from dr left join mn using (subject, ref))
 select draft_id, coalesce(string_agg(id::varchar, ' ' order by ref) filter (id is not null), '') as ids, coalesce(string_agg(ref::varchar, ' ' order by ref) filter (id is null), '') as off_menu from h group by all""")
def resolve_p18(spark, d):
    menu = _menu(spark, d)
    drafts = menu.select(F.col("subject").alias("draft_id"), "subject").distinct().withColumn("refs", F.array(*map(F.lit, (2, 1, 2, 99))))
    out = D.resolved_drafts(drafts, menu)
    return out.select("draft_id", F.array_join("ids", " ").alias("ids"), F.array_join("off_menu", " ").alias("off_menu"))


@query(f"select symbol_id, qualname from {_CANDIDATES} where qualname not in (select subject_qualname from assertions where status = 'active' and generator = 'agent')")
def unlearned_p20(spark, d):
    return D.unlearned(_candidates(spark, d), table(spark, d, "assertions"), "agent").select("symbol_id", "qualname")


def _first_line_generator(prompts):
    """A stand-in: claims something of the first source and cites it."""
    return ['{"claim": "%s is defined here.", "refs": [1]}' % p.split("\n")[1][:40].replace('"', "'").replace("\\", "") for p in prompts]


@query(f"with {_MENU} select 'drafted' as outcome, count(*) as n from bs having count(*) > 0 union all select 'no_offers', count(*) from (select distinct symbol_id from {_CANDIDATES} where symbol_id not in (select subject from bs)) having count(*) > 0")
def learn_p20(spark, d):
    subjects = _candidates(spark, d).select(F.col("symbol_id").alias("subject"))
    out = D.learned(subjects, _menu(spark, d), _sources(spark, d).select("id", "text"), _first_line_generator)
    return out.groupBy("outcome").agg(F.count("*").alias("n"))


@query()
def parsed_p15(spark, d):
    notes = table(spark, d, "documents").filter("text IS NOT NULL AND source = 'judge_notes'")
    return notes.select("doc_id", D.parsed_verdict(F.col("text")).alias("v")).select("doc_id", "v.label", "v.verdict", "v.cause")


def _length_judge(prompts):
    """A stand-in: supports what has more evidence than a line."""
    return ['{"label": "%s", "reasoning": "by length"}' % ("supported" if len(p) > 200 else "not supported") for p in prompts]


_JUDGED = "(select assertion_id, claim, array_to_string(min(citations), chr(10)) as evidence from adjudications where claim is not null group by all)"


@query(f"select assertion_id, case when coalesce(length(evidence), 0) = 0 then 'refuted' when length('Claim: ' || claim || chr(10) || chr(10) || 'Evidence:' || chr(10) || evidence) > 200 then 'supported' else 'refuted' end as verdict, case when coalesce(length(evidence), 0) = 0 then 'no_evidence' else 'judged' end as cause from {_JUDGED}")
def adjudicate_p14(spark, d):
    a = table(spark, d, "adjudications").filter("claim IS NOT NULL").groupBy("assertion_id", "claim").agg(F.array_join(F.min("citations"), "\n").alias("evidence"))
    return D.adjudicated(a, _length_judge, "by-length").select("assertion_id", "verdict", "cause")


@query("""select skipped, count(*) as n from (select distinct assertion_id, coalesce(regexp_extract(split_part(regexp_replace(lower(trim(generator)), '^.*/', ''), ':', 1), '^[a-z]+') = 'pallas', false) as skipped from assertions where status = 'active') group by all""")
def judge_round_p16(spark, d):
    a = table(spark, d, "assertions").filter("status = 'active'").select("assertion_id", "generator").distinct()
    return D.judge_round(a, "pallas-3b:latest").groupBy("skipped").agg(F.count("*").alias("n"))


@query(f"""with {_CHECKS} select c.assertion_id, y.symbol_id, oc.outcome from (select distinct assertion_id, subject_qualname from assertions) c left join (select qualname, min(symbol_id) as symbol_id from symbols group by all) y on y.qualname = c.subject_qualname join oc using (assertion_id)""")
def restore_p21(spark, d):
    """Claims carried into a new index: tied to their subject again, and verified again."""
    a = table(spark, d, "assertions")
    return C.relinked(a, table(spark, d, "symbols")).join(S.outcomes(a, checks(spark, d)).select("assertion_id", "outcome"), "assertion_id")
