"""Mining of labels from the prose of changes, and functions on identifiers and answers."""

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions.text import is_test_path
from tessella.operators import code, mining, retrieval
from tessella.plans.catalog import query, table
from tessella.workloads import hybrid as H, more
from tessella.workloads.code import _PRESENT, _SYM, _TEST, _TEXTS
from tessella.workloads.text import _STOCK

_WORDS = r"list_transform(regexp_extract_all(regexp_replace({}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z][a-z]+|[A-Z]+|[a-z]+|[0-9]+'), lambda w: lower(w))".format
_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOPWORDS) + "]"
_CONTENT = (r"list_filter(flatten(list_transform(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*'), lambda r: " + _WORDS("r") + r")), lambda w: not list_contains({1}, w) and length(w) > 1)").format
_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')".format
_SQ = r"trim(regexp_replace({}, '[ \t\n\r\f\x0b]+', ' ', 'g'))".format


def _symbols(spark, d):
    return table(spark, d, "symbols").distinct()


@query(f"select symbol_id, array_to_string({_WORDS('name')}, ' ') as words from {_SYM}")
def x1_identifier_words(spark, d):
    return _symbols(spark, d).select("symbol_id", F.array_join(X.identifier_words(F.col("name")), " ").alias("words"))


@query(f"select doc_id, md5(array_to_string({_CONTENT('text', _STOP)}, ' ')) as tokens from documents where text is not null")
def x2_content_tokens(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(F.array_join(X.content_tokens(F.col("text")), " ").cast("binary")).alias("tokens"))


@query()
def x4_units(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(X.text_units(F.col("text"))).alias("n", "unit"))


_COMMITS = "(select doc_id as commit_id, text, split_part(text, chr(10), 1) as subject, trim(regexp_replace(text, '(\\n[ \\t\\r]*([A-Za-z][A-Za-z0-9-]*:[ \\t][^\\n]*)?)+$', ''), ' ' || chr(9) || chr(10) || chr(13)) as prose from documents where text is not null and source = 'commit_log')"


def _commits(spark, d):
    c = table(spark, d, "documents").filter("text IS NOT NULL AND source = 'commit_log'")
    return c.select(F.col("doc_id").alias("commit_id"), "text", F.split("text", "\n")[0].alias("subject"), X.without_trailers(F.col("text")).alias("prose"))


_BARE = rf"trim(regexp_replace(regexp_replace({_SQ('subject')}, '^[A-Za-z][A-Za-z0-9_.]*(\([^)]*\))?!?: *', ''), '\.+$', ''))"


@query(f"""with c as {_COMMITS}, f as (select distinct commit_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_/]+\\.py')) as path from c), lv as (select distinct path from {_PRESENT} where not {_TEST}),
 t as (select * from f where path in (select path from lv)), n as (select commit_id, count(*) as n_live, count(*) filter (path in (select path from symbols)) as n_pool from t group by all)
 select commit_id, case when coalesce(length(prose), 0) = 0 then 'no_prose' when {_BARE} = '' or regexp_matches({_BARE}, '{_STOCK}') or len(string_split({_BARE}, ' ')) <= 2 then 'boilerplate' when n_live is null then 'no_live_file' when n_pool = 0 then 'no_symbols' end as skip from c left join n using (commit_id)""")
def b14_commit_eligibility(spark, d):
    c = _commits(spark, d)
    live = code.current_states(table(spark, d, "snapshots").drop("bytes"), True).filter("state = 'present'").select("path").filter(~is_test_path(F.col("path")))
    held = code.current_states(table(spark, d, "snapshots"), True).filter("state = 'present' AND bytes IS NOT NULL").select("path")
    return mining.eligibility(c, mining.commit_files(c), live.join(held, "path", "left_semi"), _symbols(spark, d))


@query()
def x5_labels(spark, d):
    """What commit messages say of the symbols of the files they name (J15, B12)."""
    c = _commits(spark, d)
    return mining.mined_labels(c, mining.commit_files(c), _symbols(spark, d))


@query()
def x13_mined_queries(spark, d):
    """Labels of commits that may be mined, with the reason why they make no query, or null."""
    ok = b14_commit_eligibility(spark, d).filter("skip IS NULL").select("commit_id")
    labels = x5_labels(spark, d).join(ok, "commit_id", "left_semi").join(_symbols(spark, d).select("symbol_id", "qualname", "docstring"), "symbol_id")
    rows = labels.select(F.xxhash64("commit_id", "symbol_id").alias("id"), "commit_id", "symbol_id", F.col("label").alias("query"), F.col("qualname").alias("names"), F.lit(1).alias("n_relevant"), F.col("docstring").alias("source"))
    return mining.classified(rows).select("commit_id", "symbol_id", "query", "reject")


_J = "(select distinct assertion_id, subject_qualname, claim, reasoning, evidence from adjudications)"


@query(f"""with t as (select assertion_id, md5(reasoning || coalesce(evidence, '')) as row_, {_CONTENT('claim', _STOP)} as a, {_CONTENT('reasoning', _STOP)} as b, {_CONTENT("coalesce(evidence, '')", _STOP)} as g from {_J})
 select assertion_id, row_, array_to_string(list_sort(list_filter(list_distinct(a), lambda t: list_contains(b, t) and not list_contains(g, t) and length(t) >= 6)), ' ') as suspects from t""")
def x10_suspect_tokens(spark, d):
    a = table(spark, d, "adjudications").select("assertion_id", "subject_qualname", "claim", "reasoning", "evidence").distinct()
    none = F.coalesce("evidence", F.lit(""))
    return a.select("assertion_id", F.md5(F.concat("reasoning", none).cast("binary")).alias("row_"), F.array_join(mining.suspect_tokens(F.col("reasoning"), F.col("claim"), none), " ").alias("suspects"))


_FAM = "(case when regexp_extract(n, '^[a-z]+') <> '' then regexp_extract(n, '^[a-z]+') else n end)"


@query(f"""with m as (select distinct judge as model from verdicts union select generator from assertions where generator is not null), x as (select model, split_part(regexp_replace(lower(trim(model)), '^.*/', ''), ':', 1) as n from m)
 select model, {_FAM} as family, case when {_FAM} in ('anthropic', 'opus', 'sonnet', 'haiku') then 'claude' when {_FAM} in ('bakllava', 'llava', 'codellama', 'tinyllama') then 'llama' when {_FAM} in ('qwq', 'qvq') then 'qwen' else {_FAM} end as lineage from x""")
def b15_model_family(spark, d):
    m = table(spark, d, "verdicts").select(F.col("judge").alias("model")).union(table(spark, d, "assertions").filter("generator IS NOT NULL").select("generator")).distinct()
    return m.select("model", X.model_family(F.col("model")).alias("family"), X.model_lineage(F.col("model")).alias("lineage"))


@query("""with c as (select distinct tour_id, symbol_id, unnest(calls_here) as q from stops) select tour_id, symbol_id, count(*) as named, count(*) filter (q not in (select qualname from symbols)) as missing, count(*) filter (q not in (select qualname from symbols)) = 0 as valid from c group by all""")
def x14_index_validation(spark, d):
    """All or nothing: a stop counts only if everything it names is indexed."""
    c = table(spark, d, "stops").select("tour_id", "symbol_id", F.explode("calls_here").alias("qualname")).distinct()
    known = table(spark, d, "symbols").select("qualname").distinct().withColumn("known", F.lit(True))
    g = c.join(known, "qualname", "left").groupBy("tour_id", "symbol_id").agg(F.count("*").alias("named"), F.count(F.when(F.col("known").isNull(), 1)).alias("missing"))
    return g.withColumn("valid", F.col("missing") == 0)


_PARAMS = r"string_split(regexp_extract(coalesce(signature, ''), '\(([^)]*)\)', 1), ',')"


@query(f"select symbol_id, array_to_string(list_concat({_WORDS('name')}, flatten(list_transform({_PARAMS}, lambda p: {_WORDS('split_part(split_part(p, chr(58), 1), chr(61), 1)')}))), ' ') as purpose from {_SYM}")
def x16_name_purpose(spark, d):
    return _symbols(spark, d).select("symbol_id", mining.name_purpose(F.col("name"), F.col("signature")).alias("purpose"))


@query()
def x16_docstring_purpose(spark, d):
    return _symbols(spark, d).select("symbol_id", mining.docstring_purpose(F.col("docstring"), F.col("name"), F.col("signature")).alias("purpose"))


@query(f"with {_TEXTS}, t as (select symbol_id, {_CONTENT('body', _STOP)} as w from vt where body is not null) select symbol_id, md5(array_to_string(list_transform(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: x), ' ')) as purpose from t")
def x16_body_purpose(spark, d):
    v = code.verified_texts(_symbols(spark, d), table(spark, d, "snapshots"))
    return v.select("symbol_id", F.md5(mining.body_purpose(F.col("body").cast("string")).cast("binary")).alias("purpose"))


@query()
def x17_one_purpose(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", X.one_purpose(F.col("text")).alias("purpose"))


@query()
def x18_blind_sources(spark, d):
    s = _symbols(spark, d).filter("kind IN ('function', 'method')").select("repo_id", "symbol_id")
    v = code.verified_texts(_symbols(spark, d), table(spark, d, "snapshots")).join(s, ["repo_id", "symbol_id"], "left_semi")
    return v.select("symbol_id", X.without_docstring(F.col("body").cast("string")).alias("source"))


@query(f"with {_TEXTS} select symbol_id, contains({_SQ('body')}, {_SQ('docstring')}) as inside from vt join (select symbol_id, max(docstring) as docstring from {_SYM} group by all) s using (symbol_id) where body is not null and docstring is not null")
def x19_source_only(spark, d):
    """Whether the documentation that a view shows stands in the symbol's own source."""
    v = code.verified_texts(_symbols(spark, d), table(spark, d, "snapshots"))
    docs = _symbols(spark, d).groupBy("symbol_id").agg(F.max("docstring").alias("docstring")).filter("docstring IS NOT NULL")
    return v.join(docs, "symbol_id").select("symbol_id", F.contains(X.squeezed(F.col("body").cast("string")), X.squeezed(F.col("docstring"))).alias("inside"))


_HID = f"list_filter({_TOK('query')}, lambda t: not list_contains({_TOK('names')}, t))"
_CODE = rf"(len(regexp_extract_all(query, '[=(){{}}\[\]]'))::double / nullif(len(list_filter(string_split_regex(query, '[ \t\n\r\f\x0b]+'), lambda w: w <> '')), 0))"
_COPY = f"(length({_SQ('query')}) >= 32 and length({_SQ('source')}) >= 32 and len(list_filter(range(1, greatest(length({_SQ('query')}) - 30, 2)), lambda p: contains({_SQ('source')}, substr({_SQ('query')}, p::int, 32)))) > 0)"


@query(f"""with c as (select distinct s.tour_id * 1000 + s.stop_order as id, s.summary as query, s.qualname as names, len(s.calls_here) + 1 as n_relevant, y.docstring as source from stops s left join (select symbol_id, max(docstring) as docstring from symbols group by all) y using (symbol_id) where s.summary is not null),
 r as (select *, case when len(list_filter(string_split({_SQ('query')}, ' '), lambda w: w <> '')) < 5 then 'too_short' when coalesce({_CODE} >= 1, false) then 'code_like' when n_relevant > 5 then 'too_many' when len({_HID}) < 3 then 'name_only' when coalesce({_COPY}, false) then 'copied_into_source' end as rj from c)
 select id, names, case when rj is null and row_number() over (partition by lower({_SQ('query')}), names, rj order by id) > 1 then 'duplicate' else rj end as reject from r""")
def x11_all_filters(spark, d):
    docs = table(spark, d, "symbols").groupBy("symbol_id").agg(F.max("docstring").alias("source"))
    s = table(spark, d, "stops").filter("summary IS NOT NULL").join(docs, "symbol_id", "left")
    c = s.select((F.col("tour_id") * 1000 + F.col("stop_order")).alias("id"), F.col("summary").alias("query"), F.col("qualname").alias("names"), (F.size("calls_here") + 1).alias("n_relevant"), "source").distinct()
    return mining.classified(c).select("id", "names", "reject")


_ASKED = "(select distinct assertion_id as query_id, claim as query from assertions where assertion_id % 20 = 0 and claim is not null)"


@query(f"""with {H._S}, {more._bm25_sql('x', H._DOCS, 1000000).replace(more._TOPICS, _ASKED)}, s as (select distinct a.assertion_id as query_id, y.symbol_id from assertions a join sy y on y.qualname = a.subject_qualname where a.assertion_id % 20 = 0 and a.claim is not null)
 select query_id, min(rank) as rank from s join xlex x using (query_id) where x.doc_id = s.symbol_id group by all""")
def m28_label_validity(spark, d):
    """The rank of a claim's own symbol when the claim is asked."""
    a = table(spark, d, "assertions").filter("assertion_id % 20 = 0 AND claim IS NOT NULL")
    asked = a.select(F.col("assertion_id").alias("query_id"), F.col("claim").alias("query")).distinct()
    own = a.select(F.col("assertion_id").alias("query_id"), F.col("subject_qualname").alias("qualname")).distinct().join(H.first_symbols(spark, d).select("qualname", F.col("symbol_id").alias("doc_id")), "qualname")
    hits = retrieval.bm25(H.symbol_docs(spark, d), asked, None)
    return hits.join(own, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
