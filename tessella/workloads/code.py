"""Code-graph queries over symbols, snapshots and stops."""

from pyspark.sql import functions as F

from tessella.functions.text import is_test_path, module_qualname, path_escapes
from tessella.operators import code
from tessella.plans.catalog import query, table

_TEST = r"""(regexp_matches(replace(path,'\','/'), '(^|/)(tests|test|testing)/') or regexp_matches(replace(path,'\','/'), '(^|/)(test_[^/]*|[^/]*_test\.py|conftest\.py)$'))"""
_SYM = "(select distinct * from symbols)"
_NOW = "(select * from (select *, row_number() over (partition by repo_id, path order by mtime_ns desc nulls last, state, size_bytes desc nulls last) n_ from snapshots) where n_ = 1)"
_FIRST = "(select * from (select *, row_number() over (partition by repo_id, path order by mtime_ns asc nulls last, state, size_bytes desc nulls last) n_ from snapshots) where n_ = 1)"


def _symbols(spark, d):
    return table(spark, d, "symbols").distinct()


@query(f"select distinct path, {_TEST} as is_test from symbols")
def b1_is_test_path(spark, d):
    return table(spark, d, "symbols").select("path").distinct().withColumn("is_test", is_test_path(F.col("path")))


@query("select distinct path, replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '/__init__$', ''), '/', '.') as qualname from snapshots")
def b2_module_qualname(spark, d):
    return table(spark, d, "snapshots").select("path").distinct().withColumn("qualname", module_qualname(F.col("path")))


@query("""select path, (path = '' or path like '/%' or regexp_matches(path, '(^|/)\\.\\.(/|$)')) as escapes, count(*) as n from
 (select regexp_replace(c, ':[0-9]+-[0-9]+$', '') as path from (select unnest(citations) as c from adjudications)) group by all""")
def b7_path_escapes(spark, d):
    cited = table(spark, d, "adjudications").select(F.explode("citations").alias("c")).select(F.regexp_replace("c", r":[0-9]+-[0-9]+$", "").alias("path"))
    return cited.groupBy("path").agg(F.count("*").alias("n")).withColumn("escapes", path_escapes(F.col("path")))


@query(f"select repo_id, path, state, size_bytes, mtime_ns from {_NOW}")
def a5_current_state(spark, d):
    return code.current_states(table(spark, d, "snapshots").drop("bytes")).select("repo_id", "path", "state", "size_bytes", "mtime_ns")


@query(f"select repo_id, path, sha256(bytes) as content_hash, octet_length(bytes) as n_bytes from {_NOW} where state = 'present' and bytes is not null")
def e4_content_hash(spark, d):
    now = code.current_states(table(spark, d, "snapshots")).filter("state = 'present' AND bytes IS NOT NULL")
    return now.select("repo_id", "path", F.sha2("bytes", 256).alias("content_hash"), F.octet_length("bytes").cast("long").alias("n_bytes"))


@query(f"select repo_id, qualname, symbol_id from (select *, row_number() over (partition by repo_id, qualname order by path, line_start asc nulls last, symbol_id) n_ from {_SYM}) where n_ = 1")
def e5_first_definition(spark, d):
    return code.first_definitions(_symbols(spark, d)).select("repo_id", "qualname", "symbol_id")


@query(f"""with s as {_SYM} select s.repo_id, s.symbol_id, s.qualname, p.symbol_id as parent_id from s left join s p
 on p.repo_id = s.repo_id and contains(s.qualname, '.') and p.qualname = regexp_replace(s.qualname, '\\.[^.]*$', '')""")
def j3_parent_link(spark, d):
    return code.parent_links(_symbols(spark, d))


@query(f"""select repo_id, parent_qualname, string_agg(name, ', ' order by coalesce(line_start, 1073741824), symbol_id) as members from {_SYM}
 where parent_qualname is not null group by all""")
def d6_members(spark, d):
    return code.members(_symbols(spark, d)).withColumn("members", F.array_join("members", ", "))


@query(f"select repo_id, symbol_id, path, line_start from {_SYM} where kind in ('function','method') and line_end - line_start + 1 >= 3 and not starts_with(name, '_') and not {_TEST}")
def b6_candidate_symbols(spark, d):
    return code.candidate_symbols(_symbols(spark, d)).select("repo_id", "symbol_id", "path", "line_start")


_HEADER = r"""concat_ws(chr(10), '# ' || path || ' -- ' || kind || ' ' || qualname, case when contains(qualname, '.') then '# defined in: ' || regexp_replace(qualname, '\.[^.]*$', '') end,
 case when length(signature) > 0 then '# signature: ' || signature end,
 case when length(trim(split_part(trim(docstring, ' ' || chr(9) || chr(10) || chr(13)), chr(10), 1), ' ' || chr(13))) > 0 then '# purpose (from docstring): ' || substr(trim(split_part(trim(docstring, ' ' || chr(9) || chr(10) || chr(13)), chr(10), 1), ' ' || chr(13)), 1, 200) end)"""


@query(f"select repo_id, symbol_id, {_HEADER} as header from {_SYM}")
def e11_chunk_header(spark, d):
    return code.chunk_headers(_symbols(spark, d)).select("repo_id", "symbol_id", "header")


@query(f"""with s as {_SYM}, m as (select repo_id, parent_qualname, string_agg(name, ', ' order by coalesce(line_start, 1073741824), symbol_id) as names from s where parent_qualname is not null group by all),
 b as (select s.repo_id, s.symbol_id, {_HEADER} as header, concat_ws(chr(10), case when length(docstring) > 0 then '""\"' || trim(docstring, ' ' || chr(9) || chr(10) || chr(13)) || '""\"' end,
  case when m.names is not null then (case when kind = 'class' then '# methods: ' else '# defines: ' end) || m.names end) as body
  from s left join m on m.repo_id = s.repo_id and m.parent_qualname = s.qualname where kind in ('class', 'module'))
 select repo_id, symbol_id, header || chr(10) || body as text from b where length(body) > 0""")
def e12_container_chunks(spark, d):
    return code.container_chunks(_symbols(spark, d))


@query(f"""with s as {_SYM}, f as (select repo_id, path, bytes from {_NOW} where state = 'present' and bytes is not null),
 b as (select s.*, unhex(substr(hex(bytes), 2 * byte_start + 1, 2 * (byte_end - byte_start))) as part from s join f using (repo_id, path)
  where kind in ('function', 'method') and byte_start >= 0 and byte_end > byte_start)
 select repo_id, symbol_id, sha256(part) as hash, octet_length(part) as n_bytes from b where octet_length(part) > 0""")
def e12_source_slices(spark, d):
    files = code.current_states(table(spark, d, "snapshots")).filter("state = 'present' AND bytes IS NOT NULL").select("repo_id", "path", "bytes")
    some = _symbols(spark, d).filter("kind IN ('function', 'method') AND byte_start >= 0 AND byte_end > byte_start")
    part = F.substr("bytes", F.col("byte_start") + 1, F.col("byte_end") - F.col("byte_start"))
    rows = some.join(files, ["repo_id", "path"]).select("repo_id", "symbol_id", F.sha2(part, 256).alias("hash"), F.octet_length(part).cast("long").alias("n_bytes"))
    return rows.filter("n_bytes > 0")


_PRESENT = "(select repo_id, path, bytes from (select *, row_number() over (partition by repo_id, path order by mtime_ns desc nulls last, coalesce(state <> 'present', true), size_bytes desc nulls last) n_ from snapshots where path is not null) where n_ = 1 and state = 'present' and bytes is not null)"
#: The verified text of symbols: vt(repo_id, symbol_id, body), body a text.
_TEXTS = f"""vf as (select distinct s.repo_id, symbol_id, kind, line_start, line_end, bytes, lower(content_hash) as want, case when byte_start >= 0 and byte_end > byte_start then unhex(substr(hex(bytes), 2 * byte_start + 1, 2 * (byte_end - byte_start))) end as by_byte
  from symbols s join {_PRESENT} f using (repo_id, path)),
 vl as (select *, case when line_start >= 1 and line_end >= line_start then trim(array_to_string(list_slice(string_split(decode(bytes), chr(10)), line_start, line_end), chr(10)), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) end as by_line from vf),
 vt as (select distinct repo_id, symbol_id, case when kind = 'module' then case when sha256(bytes) = want then decode(bytes) end when sha256(by_byte) = want then decode(by_byte) when sha256(encode(by_line)) = want then by_line end as body from vl)"""


@query(f"with {_TEXTS} select repo_id, symbol_id, md5(body) as body, length(body) as n_chars from vt where body is not null")
def e12_verified_texts(spark, d):
    v = code.verified_texts(_symbols(spark, d), table(spark, d, "snapshots"))
    return v.select("repo_id", "symbol_id", F.md5("body").alias("body"), F.length(F.col("body").cast("string")).cast("long").alias("n_chars"))


@query(f"""with {_TEXTS} select s.repo_id, s.symbol_id, {_HEADER} || chr(10) || case when length(body) > 24000 then substr(body, 1, 24000) || chr(10) || '# ... [truncated: symbol exceeds MAX_CHUNK_CHARS]' else body end as text
 from {_SYM} s join vt using (repo_id, symbol_id) where kind in ('function', 'method') and length(body) > 0""")
def e12_source_chunks(spark, d):
    return code.source_chunks(_symbols(spark, d), table(spark, d, "snapshots"))


@query(f"""select b.repo_id, b.path, case when n.state is null or n.state = 'absent' then 'missing' when n.state = 'unreadable' then 'same'
 when b.size_bytes is not distinct from n.size_bytes and b.mtime_ns is not distinct from n.mtime_ns then 'same' else 'changed' end as drift from {_FIRST} b left join {_NOW} n using (repo_id, path)""")
def b16_drift(spark, d):
    s = table(spark, d, "snapshots").drop("bytes")
    return code.drift(code.first_states(s), code.current_states(s))


@query(f"""with x as (select case when n.state is null or n.state = 'absent' then 'missing' when n.state = 'unreadable' then 'same'
 when b.size_bytes is not distinct from n.size_bytes and b.mtime_ns is not distinct from n.mtime_ns then 'same' else 'changed' end as drift, b.repo_id from {_FIRST} b left join {_NOW} n using (repo_id, path))
 select repo_id, sum((drift = 'changed')::int)::bigint as changed, sum((drift = 'missing')::int)::bigint as missing, count(*) as files from x group by all""")
def d7_drift_counts(spark, d):
    n = lambda k: F.count(F.when(F.col("drift") == k, 1)).alias(k)
    return b16_drift(spark, d).groupBy("repo_id").agg(n("changed"), n("missing"), F.count("*").alias("files"))


_CHECKED = f"""(with s as (select repo_id, symbol_id as span_id, path, byte_start, byte_end, content_hash, qualname as subject, coalesce(docstring, 'x') as claim, line_start, line_end from {_SYM}),
 n as (select repo_id, path, state, bytes from {_NOW})
 select s.*, case when state is null or state = 'absent' then 'file_missing' when state = 'unreadable' or bytes is null then 'unreadable' when not coalesce(byte_start >= 0 and byte_end > byte_start, false) then 'invalid_span'
 when octet_length(bytes) < byte_end then 'span_truncated' when sha256(unhex(substr(hex(bytes), 2 * byte_start + 1, 2 * (byte_end - byte_start)))) <> content_hash then 'hash_mismatch' else 'ok' end as reason
 from s left join n using (repo_id, path))"""


def _spans(spark, d):
    s = _symbols(spark, d)
    return s.select("repo_id", F.col("symbol_id").alias("span_id"), "path", "byte_start", "byte_end", "content_hash", F.col("qualname").alias("subject"), F.coalesce("docstring", F.lit("x")).alias("claim"), "line_start", "line_end")


@query(f"select repo_id, span_id, path, reason from {_CHECKED}")
def spans_p4(spark, d):
    return code.checked_spans(_spans(spark, d), table(spark, d, "snapshots"))


@query(f"select repo_id, reason, count(*) as n from {_CHECKED} group by all")
def d8_refresh_report(spark, d):
    return spans_p4(spark, d).groupBy("repo_id", "reason").agg(F.count("*").alias("n"))


@query(f"""select repo_id, span_id, case when length(trim(claim)) = 0 then 'empty_claim' when not coalesce(byte_start >= 0 and byte_end > byte_start and line_start >= 1 and line_end >= line_start, false) then 'invalid_span'
 when regexp_matches(path, '(^|/)\\.\\.(/|$)') or path like '/%' then 'span_escapes_repo' when coalesce(trim(content_hash), '') = '' then 'evidence_unverifiable'
 when (repo_id, subject) not in (select (repo_id, qualname) from symbols where kind <> 'module') then 'unknown_subject'
 when reason = 'unreadable' then 'evidence_unverifiable' when reason <> 'ok' then 'evidence_stale' end as refusal from {_CHECKED}""")
def gate_p1(spark, d):
    return code.admission(_spans(spark, d), table(spark, d, "symbols").filter("kind <> 'module'"), table(spark, d, "snapshots"))


@query("select k.kind, count(s.symbol_id) as n from (values ('module'),('class'),('function'),('method'),('property')) k(kind) left join (select distinct * from symbols) s using (kind) group by all")
def d1_count_by_kind(spark, d):
    kinds = spark.createDataFrame([(k,) for k in ("module", "class", "function", "method", "property")], "kind string")
    return kinds.join(_symbols(spark, d).groupBy("kind").count(), "kind", "left").select("kind", F.coalesce("count", F.lit(0)).alias("n"))


@query()
def e1_extracted_symbols(spark, d):
    from tessella.operators.extract import extract_graph

    return extract_graph(table(spark, d, "snapshots"))[0].select("repo_id", "path", "kind", "qualname", "line_start", "line_end", "byte_start", "byte_end", "content_hash")


@query()
def e10_resolved_edges(spark, d):
    from tessella.operators.extract import extract_graph, resolve

    symbols, edges = extract_graph(table(spark, d, "snapshots"))
    return resolve(edges, symbols)


@query()
def d4_resolution_rates(spark, d):
    from tessella.operators.extract import extract_graph, resolution_rates, resolve

    symbols, edges = extract_graph(table(spark, d, "snapshots"))
    return resolution_rates(resolve(edges, symbols), symbols)


@query()
def d2_by_resolver(spark, d):
    return e10_resolved_edges(spark, d).groupBy("resolver").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))


@query()
def e3_body_offsets(spark, d):
    """Decorated definitions, with where the definition itself begins."""
    from tessella.operators.extract import extract_graph

    return extract_graph(table(spark, d, "snapshots"))[0].filter("body_byte_start > byte_start").select("repo_id", "qualname", "byte_start", "body_byte_start", "byte_end")


@query()
def narrowed_p11(spark, d):
    """Citations that leave out the decorators of the symbol they end with."""
    from tessella.operators import serving
    from tessella.operators.extract import extract_graph

    symbols = extract_graph(table(spark, d, "snapshots"))[0].filter("body_byte_start > byte_start").withColumn("symbol_id", F.xxhash64("repo_id", "qualname"))
    cited = symbols.select(F.col("symbol_id").alias("assertion_id"), "repo_id", F.col("symbol_id").alias("span_id"), "path", F.col("body_byte_start").alias("byte_start"), "byte_end")
    return serving.narrowed_citations(cited, symbols)
