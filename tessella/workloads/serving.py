"""Claims and their evidence: checks, expiry, serving, admission and verified search."""

from pyspark.sql import functions as F

from tessella.operators import claims as C, code, retrieval, serving as S
from tessella.plans.catalog import query, table
from tessella.workloads import more
from tessella.workloads.claims import _CITED, _CLAIMS, _KNOWN
from tessella.workloads.code import _FIRST, _NOW, _SYM

_CUT = "sha256(unhex(substr(hex({0}), 2 * byte_start + 1, 2 * (byte_end - byte_start))))".format
_EV = f"ev as (select distinct c.assertion_id, s.repo_id, s.symbol_id as span_id, s.path, s.line_start, s.line_end, s.byte_start, s.byte_end, s.content_hash from {_CITED} c join {_SYM} s using (path, line_start, line_end))"
_BASE = f"""bs as (select distinct ev.repo_id, ev.span_id, f.mtime_ns as mtime0, f.size_bytes as size0, {_CUT('f.bytes')} as hash0 from ev join {_FIRST} f using (repo_id, path)
 where f.state = 'present' and f.bytes is not null and byte_start >= 0 and byte_end > byte_start and octet_length(f.bytes) >= byte_end)"""
_CHECKS = f"""{_EV}, {_BASE}, j as (select ev.*, b.mtime0, b.size0, b.hash0, n.state, n.bytes, n.mtime_ns, n.size_bytes, (n.state is null or n.state = 'absent') as gone, (n.state = 'unreadable' or n.bytes is null) as unread,
  not coalesce(byte_start >= 0 and byte_end > byte_start, false) as bad, coalesce(n.mtime_ns = b.mtime0 and n.size_bytes = b.size0 and b.hash0 = ev.content_hash, false) as fast0
  from ev left join bs b on b.repo_id = ev.repo_id and b.span_id = ev.span_id left join {_NOW} n on n.repo_id = ev.repo_id and n.path = ev.path),
 j2 as (select *, fast0 and not gone and not unread and not bad as fast, case when not gone and not unread and not bad and not fast0 and octet_length(bytes) >= byte_end then {_CUT('bytes')} end as observed from j),
 ck as (select *, case when gone then 'file_missing' when unread then 'unreadable' when bad then 'invalid_span' when fast then 'ok' when octet_length(bytes) < byte_end then 'span_truncated' when observed <> content_hash then 'hash_mismatch' else 'ok' end as reason,
  case when fast then 'stat' else 'hash' end as method, case when fast then mtime0 else mtime_ns end as verified_ns from j2),
 ff as (select assertion_id, span_id, reason, content_hash as expected, observed from (select *, row_number() over (partition by assertion_id order by span_id, repo_id) n_ from ck where reason <> 'ok') where n_ = 1),
 oc as (select c.assertion_id, c.status, case when n.n is null then 'no_evidence' when ff.reason is null then 'served' when ff.reason = 'unreadable' then 'unverifiable' else 'expired' end as outcome, ff.reason
  from {_CLAIMS} c left join (select assertion_id, count(*) as n from ck group by all) n using (assertion_id) left join ff using (assertion_id))"""


def spans(spark, d):
    return S.evidence_spans(C.citations(table(spark, d, "adjudications")), table(spark, d, "symbols"))


def checks(spark, d):
    s, snaps = spans(spark, d), table(spark, d, "snapshots")
    return S.two_stage(s, S.baselines(s, snaps), snaps)


def _claims(spark, d):
    return table(spark, d, "assertions")


@query(f"with {_EV}, {_BASE} select ev.assertion_id, ev.repo_id, ev.span_id, b.mtime0, b.size0, b.hash0 from ev left join bs b using (repo_id, span_id)")
def j7_baselines(spark, d):
    s = spans(spark, d)
    return S.with_baselines(s, S.baselines(s, table(spark, d, "snapshots"))).select("assertion_id", "repo_id", "span_id", "mtime0", "size0", "hash0")


@query(f"with {_CHECKS} select assertion_id, repo_id, span_id, reason, method, observed from ck")
def two_stage_p4(spark, d):
    return checks(spark, d).select("assertion_id", "repo_id", "span_id", "reason", "method", "observed")


@query(f"with {_CHECKS} select method, count(*) as n from ck where reason = 'ok' group by all")
def b18_stat_fast_path(spark, d):
    return checks(spark, d).filter("reason = 'ok'").groupBy("method").agg(F.count("*").alias("n"))


@query(f"with {_CHECKS} select distinct repo_id, span_id, verified_ns, content_hash as hash0 from ck where reason = 'ok' and method = 'hash'")
def rebaseline_p4(spark, d):
    return S.rebaselined(checks(spark, d))


@query(f"with {_CHECKS} select * from ff")
def first_failures_p5(spark, d):
    return S.first_failures(checks(spark, d))


@query(f"with {_CHECKS} select assertion_id, outcome, reason from oc where status = 'active'")
def verify_p7(spark, d):
    return S.outcomes(_claims(spark, d).filter("status = 'active'"), checks(spark, d)).select("assertion_id", "outcome", "reason")


@query(f"with {_CHECKS} select assertion_id from oc where status = 'active' and outcome = 'served'")
def servable_p7(spark, d):
    return S.servable(_claims(spark, d), checks(spark, d))[0]


# claims that the log already has: those that are stale in the table
@query(f"with {_CHECKS} select c.assertion_id, case when c.status = 'active' and o.outcome = 'expired' then 'stale' else c.status end as status from {_CLAIMS} c left join oc o on o.assertion_id = c.assertion_id and o.status = c.status")
def mark_stale_p3(spark, d):
    c = _claims(spark, d)
    return S.mark_stale(c, S.servable(c, checks(spark, d))[1], c.filter("status = 'stale'"))[0]


@query(f"with {_CHECKS} select ff.* from ff where assertion_id in (select assertion_id from oc where status = 'active' and outcome = 'expired') and assertion_id not in (select assertion_id from {_CLAIMS} where status = 'stale')")
def stale_log_p3(spark, d):
    c = _claims(spark, d)
    return S.mark_stale(c, S.servable(c, checks(spark, d))[1], c.filter("status = 'stale'"))[1]


@query(f"with {_CHECKS} select assertion_id, outcome = 'served' as reinstated from oc where status = 'stale'")
def reinstate_p10(spark, d):
    return S.reinstated(_claims(spark, d), checks(spark, d))


@query(f"""with {_CHECKS} select oc.assertion_id, case outcome when 'served' then 'fresh' when 'unverifiable' then 'unverifiable' else 'stale' end as state, reason, p.verified_ns, p.method
 from oc join (select assertion_id, min(verified_ns) as verified_ns, max(method) as method from ck group by all) p using (assertion_id) where status = 'active'""")
def serve_p8(spark, d):
    return S.served_assertions(_claims(spark, d), checks(spark, d))


@query(f"""with {_CHECKS} select assertion_id, p.verified_ns, p.method from oc join (select assertion_id, min(verified_ns) as verified_ns, max(method) as method from ck group by all) p using (assertion_id) where status = 'active' and outcome = 'served'""")
def serve_fresh_p8(spark, d):
    return S.served_assertions(_claims(spark, d), checks(spark, d), False, False).select("assertion_id", "verified_ns", "method")


@query(f"""with {_CHECKS}, a as (select outcome, coalesce(reason, case when outcome = 'no_evidence' then 'no_evidence' end) as reason, count(*) as n from oc where status = 'active' group by all)
 select sum(n)::bigint as checked, coalesce(sum(n) filter (outcome = 'served'), 0)::bigint as fresh, coalesce(sum(n) filter (outcome in ('expired', 'no_evidence')), 0)::bigint as expired, coalesce(sum(n) filter (outcome = 'unverifiable'), 0)::bigint as unverifiable,
  string_agg(reason || '=' || n, ', ' order by reason || '=' || n) as by_reason from a""")
def refresh_p9(spark, d):
    return S.refresh_report(_claims(spark, d), checks(spark, d))


@query(f"with {_EV} select distinct ev.assertion_id, ev.span_id, s.symbol_id from ev join {_SYM} s on s.repo_id = ev.repo_id and s.path = ev.path and s.byte_end = ev.byte_end and s.byte_start < ev.byte_start")
def j12_narrowed_citations(spark, d):
    return S.narrowed_citations(spans(spark, d), table(spark, d, "symbols"))


_FILES = f"(select repo_id, path, bytes from {_NOW} where state = 'present' and bytes is not null)"


@query(f"""with f as {_FILES}, nl as (select repo_id, path, i from (select repo_id, path, unnest(range(octet_length(bytes))) as i, hex(bytes) as h from f) where substr(h, 2 * i + 1, 2) = '0A'),
 s as (select distinct repo_id, symbol_id as span_id, path, byte_start, byte_end from symbols join f using (repo_id, path) where byte_start >= 0 and byte_end > byte_start and octet_length(bytes) >= byte_end)
 select s.repo_id, s.span_id, (count(*) filter (nl.i < s.byte_start) + 1)::int as line_start, (count(*) filter (nl.i < s.byte_end - 1) + 1)::int as line_end from s left join nl using (repo_id, path) group by s.repo_id, s.span_id""")
def span_lines_p13(spark, d):
    files = code.current_states(table(spark, d, "snapshots")).filter("state = 'present' AND bytes IS NOT NULL").select("repo_id", "path", "bytes")
    some = table(spark, d, "symbols").select("repo_id", F.col("symbol_id").alias("span_id"), "path", "byte_start", "byte_end").distinct()
    return S.line_numbers(some, files)


_SUBMITTED = "(select distinct assertion_id, subject_qualname as subject, claim, confidence from assertions)"


@query(f"""with {_EV}, j as (select ev.*, n.state, n.bytes, case when not coalesce(byte_start >= 0 and byte_end > byte_start and line_start >= 1 and line_end >= line_start, false) then 'invalid_span'
   when ev.path = '' or ev.path like '/%' or regexp_matches(ev.path, '(^|/)\\.\\.(/|$)') then 'span_escapes_repo' when coalesce(trim(content_hash), '') = '' then 'evidence_unverifiable' end as own,
  case when n.state is null or n.state = 'absent' then 'evidence_stale' when n.state = 'unreadable' or n.bytes is null then 'evidence_unverifiable' when not coalesce(byte_start >= 0 and byte_end > byte_start, false) then 'evidence_stale'
   when octet_length(n.bytes) < byte_end then 'evidence_stale' when {_CUT('n.bytes')} <> content_hash then 'evidence_stale' end as later from ev left join {_NOW} n using (repo_id, path)),
 p as (select assertion_id, count(*) as n, arg_min(own, span_id) filter (own is not null) as own, arg_min(later, span_id) filter (later is not null) as later from j group by all)
 select s.assertion_id, case when p.n is null then 'evidence_required' when coalesce(trim(claim), '') = '' then 'empty_claim' when own is not null then own when subject not in (select qualname from symbols where kind <> 'module') then 'unknown_subject' else later end as refusal
 from (select distinct assertion_id, subject, claim from {_SUBMITTED}) s left join p using (assertion_id)""")
def claim_gate_p1(spark, d):
    c = _claims(spark, d).select("assertion_id", F.col("subject_qualname").alias("subject"), "claim")
    return S.claim_admission(c, spans(spark, d), table(spark, d, "symbols").filter("kind <> 'module'"), table(spark, d, "snapshots"))


@query(f"""with {_EV} select s.assertion_id, case when n > 32 then 'too_many_spans' when length(claim) > 4096 then 'claim_too_long' when confidence is not null and (isnan(confidence) or confidence < 0 or confidence > 1) then 'bad_confidence' end as fault
 from (select distinct assertion_id, claim, confidence from assertions) s left join (select assertion_id, count(*) as n from ev group by all) using (assertion_id)""")
def b10_submission_limits(spark, d):
    return S.submission_limits(_claims(spark, d), spans(spark, d))


@query(f"select verdict_id, assertion_id, judge, verdict from {_KNOWN}")
def verdict_reader_p12(spark, d):
    return C.known_verdicts(table(spark, d, "verdicts")).select("verdict_id", "assertion_id", "judge", "verdict")


_GOOD = f"""good as (select assertion_id from (select a.assertion_id, bool_or(verdict in ('refuted','unsupported')) as veto, bool_or(verdict = 'supported') as ok from {_CLAIMS} a left join {_KNOWN} v using (assertion_id)
 where a.status = 'active' group by all) where not coalesce(veto, false))"""


@query(f"""with {_CHECKS}, {_GOOD}, {more._bm25_sql('c', more._CLAIM_DOCS, 400)}, h as (select query_id, doc_id as assertion_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from clex
 where doc_id in (select assertion_id from good) and doc_id in (select assertion_id from oc where outcome <> 'expired' and outcome <> 'unverifiable')) select * from h where rank <= 10""")
def f12_verified_search(spark, d):
    """Search over claims with refill: vetoed and expired hits make room; claims without spans stay, as the test data cites few."""
    c = _claims(spark, d)
    policy = C.serving(c, table(spark, d, "verdicts"), require_verdict=False).filter("eligible").select("assertion_id")
    served = S.outcomes(c, checks(spark, d)).filter("outcome IN ('served', 'no_evidence')").select("assertion_id")
    return S.verified_hits(more._claim_hits(spark, d, 400).withColumnRenamed("doc_id", "assertion_id"), policy, served, 10)


_GATE = next(sql for name, sql in __import__("tessella.plans.catalog", fromlist=["ORACLES"]).ORACLES.items() if name == "claim_gate_p1")


@query(f"select coalesce(refusal, 'admitted') as outcome, count(*) as n from ({_GATE}) group by all")
def d9_learn_report(spark, d):
    """Submissions by what became of them; the counts add up to all."""
    return claim_gate_p1(spark, d).groupBy(F.coalesce("refusal", F.lit("admitted")).alias("outcome")).agg(F.count("*").alias("n"))
