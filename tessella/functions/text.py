"""Column functions over paths, queries and prose; all built-in, none in Python."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters of a query that separate terms, besides blanks.
QUERY_SEPARATORS = r'[\x00-\x1f\x7f"*():^-]'
# Subjects of a change that say nothing about its purpose.
BOILERPLATE = (
    r"(?i)^(wip|fixup|squash|fix|fixes|fixed|bug ?fix|update|updates|updated|cleanup|clean ?up|refactor|refactoring|misc|minor|tweak|tweaks"
    r"|nit|nits|typo|typos|lint|format|formatting|style|rename|address (review|comments|feedback)|review (fixes|feedback)|pr feedback|comments"
    r"|bump|bump (version|deps|dependencies)|version bump|release|initial commit|first commit|init|initial|checkpoint|save|temp|tmp|test|tests"
    r"|more tests|add tests|docs|doc|documentation|readme|chore|revert.*|merge.*|v?\d+(\.\d+)*)$"
)
WORD = r"[\p{L}\p{N}]+"


def is_test_path(path) -> Column:
    """A test by directory (tests, test, testing) or by file name (test_*, *_test.py, conftest.py)."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return p.rlike(r"(^|/)(tests|test|testing)/") | p.rlike(r"(^|/)(test_[^/]*|[^/]*_test\.py|conftest\.py)$")


def module_qualname(path) -> Column:
    """Dotted name of a source path; a package's __init__ is the package."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\.py$", "")
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    keep = F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.array_join(keep, ".")


def path_escapes(path) -> Column:
    """A path that may leave its root: empty, absolute, with NUL or with a '..' component."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return path.isNull() | (p == "") | p.rlike(r"^(/|[A-Za-z]:)") | p.contains("\0") | p.rlike(r"(^|/)\.\.(/|$)")


def tokens(text) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def query_terms(query) -> Column:
    """Terms of a query: separators become blanks, the rest is split at blanks."""
    return F.filter(F.split(F.regexp_replace(query, QUERY_SEPARATORS, " "), r"\s+"), lambda t: t != "")


def squeezed(text) -> Column:
    """Runs of ASCII blanks as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " "))


def slug(text) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 60)


def without_fences(text) -> Column:
    """Fenced code blocks as line ends."""
    return F.regexp_replace(text, r"(?s)```.*?```", "\n")


def without_trailers(text) -> Column:
    """Text without the ``Key: value`` and blank lines at its end."""
    return F.btrim(F.regexp_replace(text, r"(\n[ \t\r]*([A-Za-z][A-Za-z0-9-]*:[ \t][^\n]*)?)+$", ""), F.lit(" \t\r\n"))


def code_ratio(text) -> Column:
    """Brackets and assignment signs per word."""
    return F.try_divide(F.regexp_count(text, F.lit(r"[=(){}\[\]]")), F.size(F.filter(F.split(text, r"[ \t\n\r\f\x0b]+"), lambda w: w != "")))


def looks_like_code(text) -> Column:
    return F.coalesce(code_ratio(text) >= 1.0, F.lit(False))


def is_boilerplate(subject) -> Column:
    """A change's subject that states no purpose: empty, a stock phrase, or two words and fewer."""
    s = squeezed(subject)
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z][A-Za-z0-9_.]*(\([^)]*\))?!?: *", ""), r"\.+$", ""))
    return (s == "") | s.rlike(BOILERPLATE) | (F.size(F.split(s, " ")) <= 2)


def tier_of(modality) -> Column:
    """Provenance tier of a modality label such as ``dense+graph``: the least of its parts."""
    parts = F.split(modality, r"\+")
    return F.array_min(F.transform(parts, lambda m: F.when(m.isin("lexical", "dense"), 0).when(m == "graph", 1).otherwise(2)))


# Words too common to carry meaning.
STOPWORDS = (
    "a an and are as at be been but by can could did do does for from had has have how if in into is it its more must no not of on one only or other our out over"
    " own same so some such than that the their them then there these they this those to too under up use used uses using was we were what when where which while who"
    " why will with would you your it's don't now new also both each every not"
).split()
# Families that go by another name.
LINEAGES = {
    "anthropic": "claude", "opus": "claude", "sonnet": "claude", "haiku": "claude",
    "bakllava": "llama", "llava": "llama", "codellama": "llama", "tinyllama": "llama", "qwq": "qwen", "qvq": "qwen",
}


def identifier_words(name) -> Column:
    """Lower-case words of an identifier: runs of capitals, capitalised words, small letters, digits."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"[A-Z]+(?![a-z])|[A-Z][a-z]*|[a-z]+|[0-9]+"), F.lit(0)), F.lower)


def content_tokens(text) -> Column:
    """Words of a text with identifiers split, without stopwords and single characters, in order."""
    raw = F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    words = F.flatten(F.transform(raw, identifier_words))
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS) & (F.length(w) > 1))


def text_units(prose) -> Column:
    """Bullets and sentences of a text, block by block; blanks inside them squeezed."""
    blocks = F.filter(F.transform(F.split(prose, r"\n[ \t]*\n"), lambda b: F.btrim(b, F.lit(" \t\r\n"))), lambda b: b != "")
    pieces = F.flatten(F.transform(blocks, lambda b: F.split(b, r"(?m)^[ \t]*(?:[-*+•]|\d+[.)])[ \t]+")))
    flat = F.filter(F.transform(pieces, squeezed), lambda p: p != "")
    return F.filter(F.flatten(F.transform(flat, lambda p: F.split(p, r"(?<=[.!?])\s+(?=[A-Z`\"'(—-])"))), lambda u: F.trim(u) != "")


def mentions(unit, name) -> Column:
    """Whether a unit names a symbol as code: an unmistakable name anywhere, any other in code's company.

    Unmistakable is a name with an underscore or a capital inside; company are backticks around it, a
    call, a dot before it, an assignment.
    """
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    core = F.btrim(name, F.lit("_"))
    bare = F.regexp_like(unit, F.concat(F.lit(r"(?<!\w)"), quoted, F.lit(r"(?!\w)")))
    plain = F.contains(core, F.lit("_")) | F.substr(core, F.lit(2)).rlike("[A-Z]")
    b = F.lit(r"\b")
    company = F.concat(F.lit(r"`[^`]*\b"), quoted, F.lit(r"\b[^`]*`|\b"), quoted, F.lit(r"\s*\(|\.\s*"), quoted, b, F.lit(r"|\b"), quoted, F.lit(r"\s*=[^=]"))
    return bare & (plain | F.regexp_like(unit, company))


def model_family(model) -> Column:
    """The leading letters of a model's name, without registry and tag."""
    name = F.split(F.substring_index(F.lower(F.trim(model)), "/", -1), ":")[0]
    lead = F.regexp_extract(name, r"^[a-z]+", 0)
    return F.when(lead != "", lead).otherwise(name)


def model_lineage(model) -> Column:
    """The family, or the one it descends from."""
    f = model_family(model)
    out = f
    for name, of in LINEAGES.items():
        out = F.when(f == name, of).otherwise(out)
    return out


def without_docstring(source) -> Column:
    """A definition's source without the string literal that follows its header."""
    return F.regexp_replace(source, r"(?s)\A((?:[ \t]*@[^\n]*\n)*[ \t]*(?:async[ \t]+)?(?:def|class)\b.*?:[ \t]*(?:#[^\n]*)?\n\s*)[rRuU]?(\"\"\"|''').*?\2", "$1")


def one_purpose(answer) -> Column:
    """A model's answer as one sentence of at most 40 words; never empty where the answer was not.

    Leaves out thoughts, fences, labels, list marks and openings such as "Here is ...:".
    """
    s = F.regexp_replace(answer, r"(?is)<think>.*?(</think>|\z)", " ")
    s = F.regexp_replace(s, r"```[^\n]*", " ")
    s = squeezed(s)
    s = F.regexp_replace(s, r"(?i)^(?:(?:here is|here's|sure)[^:.]*[:.]\s*)+", "")
    s = F.regexp_replace(s, r"(?i)^(?:[-*+•]|\d+[.)])\s+", "")
    s = F.regexp_replace(s, r"(?i)^\**(?:purpose|summary|answer)\**\s*:\s*", "")
    first = F.split(s, r"(?<=[.!?])\s+(?=[A-Z`\"'(—-])")[0]
    words = F.array_join(F.slice(F.split(first, " "), 1, 40), " ")
    return F.when(words != "", words).otherwise(squeezed(answer))
