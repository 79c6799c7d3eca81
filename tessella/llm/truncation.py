"""Texts that a field limit or a broken transfer cut short.

* **Length.**  Lengths of a source (in characters and in bytes) that occur far more often than
  their neighbours are candidate limits.  Per source a log-normal length distribution is fitted by
  maximum likelihood with the values at candidate limits as right-censored (EM over sufficient
  statistics).  The posterior that a value at a limit is censored is one less the share of that
  length which the fitted distribution explains.
* **Ending.**  What the text's last line is (prose, list item, table row, log line, code, trailer,
  JSON ...), whether it is closed (sentence end, balanced marks), whether it ends in a cut mark or
  half a character.  The *habits of the source* say which ends are natural without a sentence end:
  frames of last lines that complete inner lines, or a fair share of the source's texts, have too.
  A text that ends with its sentence, or closes its JSON, fence or table, is whole by definition.
* **Last word.**  Words are counted over the whole corpus, inside lines and at their ends.  A last
  word hardly seen elsewhere was cut itself; a common word that never ends a line, sentence or
  unsuspected text was followed by more.  Both are shares, as in a large table cuts leave every half
  word several times; a frame that ends mostly with such words is ended by cuts and is no habit.

What a kind of ending is worth is learned: the censoring posteriors are the labels.  A mixture of
truncated and whole texts is fitted by EM, in which a text at a candidate limit is truncated with its
censoring posterior beforehand, any other with one common chance, and the kinds of evidence are
independent given that.  A kind that no
limit shows is worth what its group (open, broken word, habit, no habit) is worth, and a group that no
limit shows the weak log odds of ``START``.
Truncated texts are held against whole ones of the same source, and open ends stay worth ``START`` unless limits
speak against it, so that learning from many limits does not unlearn what sources without limits show.
A text's score is the log odds of its own length's posterior and of its evidence.

One pass in Python writes features, word counts and frame counts (pre-counted per batch); all else
is joins and sums over small rows.  Look-ups of hot words and frames are salted.

Defined results: null, empty and blank texts are no cases.  A missing source is a source of its
own (shown as null) that may rely on the habits of all.  Repeated doc_ids give one row.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tessella.llm.docpairs import _CLOSERS, _STOP
from tessella.plans.scratch import Scratch
from tessella.plans.spread import spread

#: Salts of a look-up: a hot word or frame is spread over so many tasks.
SALTS = 8
#: Parameters of candidate limits: least count, and least ratio to the mean count of lengths nearby (within this factor, as a logarithm).
LEAST_AT_LIMIT, LEAST_RATIO, NEARBY = 8, 6.0, 0.2
#: The chance of a cut away from limits, beforehand, and the texts that counts for.
BASE, BASE_TEXTS = 0.05, 100.0
#: Bounds of a censoring posterior at a limit.
AT_LEAST, AT_MOST = 0.001, 0.999
#: Log odds of the kinds of evidence before anything is learned, and how many truncated texts at limits weigh as much.
START = {"open": 4.0, "broken": 4.0, "habit": -2.0, "no habit": 1.0, "rare": 1.0, "weak": 0.5, "known": -0.5, "usual": -1.0, "ended": -4.0, "goes on": 0.0, "longer": 2.0, "as long": 0.0}
START_TEXTS = 10.0
#: A frame is a habit if this many inner lines, and this share of a source's inner lines, have it, or this share of a source's texts end with it.
INNER_LINES, INNER_SHARE, END_SHARE, PROSE_SHARE = 3, 0.002, 0.01, 0.5
#: A word closes texts of a frame as a habit if so large a share of them ends with it.
CLOSING_SHARE = 0.005
#: ... and, as cuts at random end texts with any word or part of one, so many times more often than these would.
CLOSING_LIFT = 3.0
#: A word that stands inside texts less than so many times for each text that ends with it was cut itself.
INSIDE_PER_END = 0.25
#: If so large a share of the words that end texts of a frame are parts of words or never final, cuts end it and no habit.
PARTS_SHARE = 0.5
#: Beginnings of words are counted up to this length; longer ones count as themselves.
LONGEST_PART = 24
#: The largest sources, in each of which truncated texts are held against whole ones; the rest is taken together.
STRATA = 256

_MARK = re.compile(r"(?i)(?:[\[(<{]\s*(?:\.{2,}|…|truncated|cut(?: off)?|snip(?:ped)?|more|cont(?:inued|\.)?)\s*[\])>}]|\.{3,}|…)[\"'`]*$")
_SO_ON = re.compile(r"(?i)(?:so on|so forth|etc|et cetera|and more|the like|so weiter|usw|ainsi de suite|etcétera|así sucesivamente|等|など)[.,\s]*(?:\.{2,}|…)[\"'`]*$")
_END = re.compile(r"[.!?。！？।؟][)\"'`»”’*\]_』」]*$")
_CUT_PATH = re.compile(r"(?:^|[\s(`\"'])[\w.\-]*(?:/[\w.\-]*)+\.$")
_WHOLE_PATH = re.compile(r"\.\w{1,4}\.$")
_LOG = re.compile(r"^(?:\d{4}-\d\d-\d\d[T ])?\d\d:\d\d:\d\d\b")
_LIST = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+\S")
_TRAILER = re.compile(r"^([A-Za-z][\w-]{1,30}):\s+\S")
_CODE = re.compile(r"^[ \t]*(?:async[ \t]+def|def|class)[ \t]+\w+[ \t]*[(:]", re.M)
_LAST_WORD = re.compile(r"([A-Za-zÀ-ɏ]+)$")
_HUMP = re.compile(r"[A-ZÀ-Þ]+(?![a-zß-ɏ])|[A-ZÀ-Þ]?[a-zß-ɏ]+")
_WORDS = re.compile(r"[A-Za-zÀ-ɏ]+")
_FINAL_WORDS = re.compile(r"([A-Za-zÀ-ɏ]+)[`)\"'*\]]*(?:[.!?:;,]?\n|[.!?](?=\s))")

_FIELDS = [
    ("kind", pa.int8()), ("doc_id", pa.int64()), ("source", pa.string()), ("n_chars", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()),
    ("verdict", pa.int8()), ("frame", pa.string()), ("word", pa.string()), ("line_ended", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("digest", pa.int64()),
]
_ARROW = pa.schema(_FIELDS)
FEATURE_SCHEMA = "kind byte, doc_id long, source string, n_chars long, chars long, bytes long, verdict byte, frame string, word string, line_ended boolean, a long, b long, digest long"
DOC, WORD, FRAME = 0, 1, 2
WHOLE, OPEN, UNSURE = 0, 1, 2


def _at_end(pattern: re.Pattern, t: str) -> re.Match | None:
    """The match of a pattern that ends with ``$``, without a search of the whole text where its end shows that none is needed.

    A match that begins before the last 256 characters would be free of blanks or of letters and digits there.
    """
    pos = len(t) - 256
    if pos > 0:
        tail = t[pos:]
        if len(tail.split(None, 2)) > 1 and any(map(str.isalnum, tail)):
            m = pattern.search(t, pos)
            if m is None or m.start() > pos:
                return m
    return pattern.search(t)


def _unclosed_code(text: str) -> bool:
    """Whether code ends inside a bracket or string."""
    pos, depth = 0, 0
    while m := _STOP.search(text, pos):
        c, at, pos = m.group(), m.start(), m.end()
        if c == "#":
            end = text.find("\n", at)
            pos = len(text) if end < 0 else end
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c in "\"'":
            quote = text[at : at + 3] if text[at : at + 3] == c * 3 else c
            close = _CLOSERS[quote].match(text, at + len(quote))
            if not close:
                return len(quote) == 3 or "\n" not in text[at:]
            pos = close.end()
    return depth > 0


def _sig(token: str, literal: bool) -> str:
    """The shape of a line's last token."""
    if "`" in token:
        return "`"
    t = re.sub(r"\d+", "9", token)
    if "/" in t:
        return re.sub(r"[\w.\-]*/[\w/.\-]*?(\.[A-Za-z]\w*)?(?=[:,;)]|$)", lambda m: "P" + (m.group(1) or ""), t)
    if re.fullmatch(r"\([^\W_]+\)", t):
        return "()"
    if re.fullmatch(r"\w+(?:\.\w+)+", t):
        return "Q"
    if t.isalpha() and not literal:
        return "w"
    return t


def _line_frame(line: str) -> str | None:
    """The frame of a log line, list item or trailer; None for other lines."""
    s = line.rstrip()
    last = s.rsplit(None, 1)[-1] if s.split() else ""
    if _LOG.match(s):
        return "log|" + _sig(last, True)
    if _LIST.match(s):
        return "list|" + _sig(last, False)
    m = _TRAILER.match(s)
    if m:
        return f"trailer|{m.group(1)}|" + _sig(last, False)
    return None


def _unbalanced(line: str) -> bool:
    if line.count("`") % 2 or line.count("**") % 2:
        return True
    bare = re.sub(r"^\s*\d+[.)]", "", line)
    return any(bare.count(a) > bare.count(b) for a, b in ("()", "[]", "{}", "“”", "«»")) or bare.count('"') % 2 == 1


def ending(text: str) -> tuple[int, str, str | None, bool]:
    """(verdict, frame, last word, whether the last line was ended) of a text that is not blank."""
    text = text.replace("\r\n ", " ").replace("\r\n", "\n")  # CRLF before a blank is a stray wrap
    t = text.rstrip()
    ended = "\n" in text[len(t) :]
    lines = t.split("\n")
    last, before = lines[-1], lines[:-1]
    found = _at_end(_LAST_WORD, t)
    word = None
    if found:
        humps = _HUMP.findall(found.group(1))
        word = humps[-1].lower() if humps else None
    if t.endswith("�"):
        return OPEN, "character", None, ended
    if _at_end(_SO_ON, t):
        return WHOLE, "so on", None, ended
    if _at_end(_MARK, t):
        return OPEN, "mark", None, ended
    head = t.lstrip()
    if head[0] == "{" and '"' in head or head.startswith('[{"'):
        try:
            json.loads(head, strict=False)
            return WHOLE, "json", None, ended
        except (ValueError, RecursionError):
            if re.match(r'[\[{]+\s*"', head):
                return OPEN, "json", None, ended
    fences = sum(line.lstrip().startswith("```") for line in lines)
    if fences % 2:
        return OPEN, "fence", None, ended
    if last.strip().startswith("```"):
        return (WHOLE if last.strip() == "```" else OPEN), "fence", None, ended
    if re.fullmatch(r"`{1,2}", last.strip()):
        return OPEN, "fence", None, ended
    if last.lstrip().startswith("|"):
        above = next((x for x in reversed(before) if x.strip()), "")
        same = not above.lstrip().startswith("|") or above.count("|") == last.count("|")
        return (WHOLE if last.endswith("|") and len(last.strip()) > 1 and same else OPEN), "table", None, ended
    if any(_LOG.match(x) for x in (last, *before[-1:])):
        return UNSURE, (_line_frame(last) or "log|") if _LOG.match(last) else "log|short", None, ended
    if ("def" in text or "class" in text) and _CODE.search(text):
        first = last.split(None, 1)[0] if last.split() else ""
        return (OPEN if _unclosed_code(t) else UNSURE), "code|" + re.sub(r"\W.*", "", first), word, ended
    path_cut = bool(_at_end(_CUT_PATH, t)) and not _at_end(_WHOLE_PATH, t)
    odd = _unbalanced(last)
    if _at_end(_END, t) and not path_cut:
        return (OPEN if last.count("`") % 2 else WHOLE), "sentence", None, ended
    if path_cut or odd:
        return OPEN, "inside", None, ended
    frame = _line_frame(last)
    if frame is None:
        if last.lstrip().startswith("#"):
            frame = "heading"
        elif re.search(r"[.!?。！？]\s", last) or re.search(r"[。！？]", last):
            frame = "prose"
        elif not any(x.strip() for x in before):
            frame = "single"
        else:
            frame = "bare|" + re.sub(r"\d+", "9", last.strip())
    return UNSURE, frame, word, ended


def _count_inside(text: str, words: Counter, finals: Counter, frames: Counter, source) -> None:
    """Words and line frames of a text without its end."""
    t = text.rstrip()
    m = _at_end(_LAST_WORD, t)
    body = t[: m.start()] if m else t
    words.update(_WORDS.findall(body))
    finals.update(_FINAL_WORDS.findall(body))
    cut = t.rfind("\n")
    if cut >= 0:
        for line in t[:cut].split("\n"):
            f = _line_frame(line)
            if f is not None:
                frames[source, f] += 1


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def table(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

    words, finals, frames = Counter(), Counter(), Counter()

    def counts():
        split, ends = Counter(), Counter()
        for into, given in ((split, words), (ends, finals)):
            for w, n in given.items():
                for h in _HUMP.findall(w):
                    into[h.lower()] += n
        rows = [(WORD, None, None, None, None, None, None, None, w, None, n, ends[w], None) for w, n in split.items()]
        rows += [(FRAME, None, s, None, None, None, None, f, None, None, n, None, None) for (s, f), n in frames.items()]
        words.clear(), finals.clear(), frames.clear()
        return rows

    for b in batches:
        rows = []
        for i in range(b.num_rows):
            doc, source, n_chars, text, digest = (b.column(j)[i].as_py() for j in range(5))
            if not text.strip():
                continue
            verdict, frame, word, ended = ending(text)
            shown = text.rstrip("�")
            rows.append((DOC, doc, source, n_chars, len(text), len(shown.encode("utf-8", "surrogatepass")), verdict, frame, word, ended, None, None, digest))
            _count_inside(text, words, finals, frames, source)
            if len(words) + len(frames) > 200_000:
                rows += counts()
        if rows:
            yield table(rows)
    if rest := counts():
        yield table(rest)


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Censored log-normal fit of one source and unit; a row per candidate limit."""
    n, s1, s2 = (float(pdf[c].iloc[0]) for c in ("n", "s1", "s2"))
    limits = [(float(x), float(c)) for x, c in zip(pdf["length"], pdf["count"])]
    total = n + sum(c for _, c in limits)
    mu = s1 / n if n else sum(math.log(x) * c for x, c in limits) / max(1.0, total)
    var = max(1e-4, s2 / n - mu * mu) if n else 1.0
    for _ in range(60):
        e1, e2, sd = s1, s2, math.sqrt(var)
        for x, c in limits:
            z = (math.log(x) - mu) / sd
            tail = 0.5 * math.erfc(z / math.sqrt(2))
            hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail if tail > 1e-12 else z + 1 / max(z, 1.0)
            m = mu + sd * hazard
            v = var * max(1e-6, 1 + z * hazard - hazard * hazard)
            e1 += c * m
            e2 += c * (v + m * m)
        mu_new = e1 / total
        var = max(1e-4, e2 / total - mu_new * mu_new)
        if abs(mu_new - mu) < 1e-9:
            break
        mu = mu_new
    out = []
    for x, c in limits:
        z = (math.log(x) - mu) / math.sqrt(var)
        natural = total * math.exp(-z * z / 2) / (x * math.sqrt(2 * math.pi * var))
        out.append((pdf["source"].iloc[0], pdf["unit"].iloc[0], int(x), int(c), max(0.0, 1 - natural / c), mu, math.sqrt(var)))
    return pd.DataFrame(out, columns=["source", "unit", "length", "count", "posterior", "mu", "sigma"])


def length_limits(docs: DataFrame) -> DataFrame:
    """Candidate limits of (source, chars, bytes, digest) rows: source, unit, length, count, posterior, mu, sigma."""
    texts = docs.select("source", "chars", "bytes", "digest").distinct()  # copies of a text are no pile-up
    units = texts.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("u"))
    counts = units.select(F.coalesce("source", F.lit("\0")).alias("source"), "u.unit", "u.length").filter("length > 0").groupBy("source", "unit", "length").count()
    near = W.partitionBy("source", "unit").orderBy(F.round(F.log(F.col("length").cast("double")) * 10_000).cast("long")).rangeBetween(-round(NEARBY * 10_000), round(NEARBY * 10_000))
    lengths = F.floor(F.col("length") * math.exp(NEARBY)) - F.ceil(F.col("length") * math.exp(-NEARBY))  # that many others
    around = F.try_divide(F.sum("count").over(near) - F.col("count"), lengths)
    marked = counts.withColumn("limit", (F.col("count") >= LEAST_AT_LIMIT) & (F.col("count") >= LEAST_RATIO * F.coalesce(around, F.col("count"))))
    natural = ~F.col("limit")
    x = F.log(F.col("length").cast("double"))
    moments = marked.groupBy("source", "unit").agg(
        F.sum(F.when(natural, F.col("count")).otherwise(0)).cast("double").alias("n"),
        F.sum(F.when(natural, F.col("count") * x).otherwise(0.0)).alias("s1"),
        F.sum(F.when(natural, F.col("count") * x * x).otherwise(0.0)).alias("s2"),
    )
    tops = marked.filter("limit").drop("limit").join(moments, ["source", "unit"])
    return tops.groupBy("source", "unit").applyInPandas(_fit, "source string, unit string, length long, count long, posterior double, mu double, sigma double")


WHOLE_KIND = "whole"
FACTORS = ("kind", "word", "line", "told")


def kind_of_open(shape) -> F.Column:
    return F.concat(F.lit("open: "), shape)


class EvidenceModel:
    """Log odds of each value of each kind of evidence, and the chances of a cut away from limits: of all texts, and per stratum."""

    def __init__(self, base: float, odds: dict[str, dict[str, float]], rounds: int, chances: dict[str, float] | None = None):
        self.base, self.odds, self.rounds, self.chances = base, odds, rounds, chances or {}

    def chance(self) -> F.Column:
        """The chance of a cut away from limits in the text's source."""
        if not self.chances:
            return F.lit(self.base)
        return F.coalesce(F.create_map(*(F.lit(x) for kv in sorted(self.chances.items()) for x in kv))[F.col("stratum")], F.lit(self.base))

    def column(self, factor: str) -> F.Column:
        out = F.lit(0.0)  # a value never seen, or none, says nothing
        for value, x in sorted(self.odds[factor].items()):
            out = F.when(F.col(factor) == value, float(x)).otherwise(out)
        return out


def taught(t: np.ndarray, w: np.ndarray, shown: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """Log odds from weighed counts of truncated and whole texts, as far as limits have shown truncated ones (``shown``)."""
    trust = shown / (shown + START_TEXTS)
    return trust * (np.log(t) - np.log(w)) + (1 - trust) * otherwise


def fitted_evidence(cells: pd.DataFrame, rounds: int = 500, tolerance: float = 1e-7) -> EvidenceModel:
    """EM over counted cells: kind, word, line, told (null for none), p (null away from limits), n, and if given stratum.

    Truncated texts are held against the whole ones of their stratum: which kinds there are depends on the
    source, and so do limits, so that a kind of a source without limits would else seem as common in whole texts.
    What is not closed stays worth START, unless limits show it in whole texts more often than in truncated ones:
    how many are open differs from source to source, and guesses that lower its worth would feed themselves.
    Cells of kind WHOLE_KIND are texts known to be whole; they have no odds of their own.
    """
    known = (cells["kind"] == WHOLE_KIND).to_numpy(bool)
    cells = cells.assign(kind=cells["kind"].mask(known, None))
    n = cells["n"].to_numpy(float)
    p = cells["p"].to_numpy(float)
    at_limit = ~np.isnan(p)
    codes = {f: pd.factorize(cells[f]) for f in FACTORS}  # -1 for none
    group = {f: pd.factorize(np.array([v.split(":")[0] for v in values], object)) for f, (_, values) in codes.items()}
    start = {f: np.array([START[g] for g in names]) for f, (_, names) in group.items()}
    odds0 = {f: start[f][group[f][0]] for f in FACTORS}
    stratum, strata = pd.factorize(cells["stratum"]) if "stratum" in cells else (np.zeros(len(cells), int), [])
    k = max(1, len(strata))
    per = lambda x, some: np.bincount(stratum[some], x[some], k)
    base, chances, odds, done = BASE, np.full(k, BASE), odds0, 0
    for done in range(1, rounds + 1):
        chance = np.where(at_limit, p, chances[stratum])
        z = np.log(chance / (1 - chance))
        for f, (code, _) in codes.items():
            if len(odds[f]):
                z = z + np.where(code >= 0, odds[f][code], 0.0)
        r = np.where(known, 0.0, 1 / (1 + np.exp(-z)))
        new_base = (BASE * BASE_TEXTS + (n * r)[~at_limit].sum()) / (BASE_TEXTS + n[~at_limit].sum())
        own = (new_base * BASE_TEXTS + per(n * r, ~at_limit)) / (BASE_TEXTS + per(n, ~at_limit))
        new_chances = np.maximum(new_base, own)  # where few are cut, a text is judged by its evidence
        moved = max(abs(new_base - base), *np.abs(new_chances - chances))
        base, chances = new_base, new_chances
        for f, (code, values) in codes.items():
            some = code >= 0
            every = some | known if f == "kind" else some
            cut, whole_texts = per(n * r, some), per(n * (1 - r), every)
            all_texts = np.maximum(cut + whole_texts, 1e-9)
            least = 0.5 * cut.sum() * whole_texts.sum() / all_texts.sum() ** 2
            # a stratum counts as far as it has both truncated and whole texts (ratio of Mantel and Haenszel)
            sums = [np.bincount(code[some], x[some], len(values)) for x in (n * r * (whole_texts / all_texts)[stratum], n * (1 - r) * (cut / all_texts)[stratum], n * r * at_limit)]
            sums[0], sums[1] = sums[0] + least, sums[1] + least
            member, names = group[f]
            whole = [np.bincount(member, x, len(names)) for x in sums]  # per group of values
            new = taught(*sums, taught(*whole, start[f])[member])
            against = np.bincount(code[some], (n * (1 - r) * at_limit)[some], len(values)) > sums[2]
            new = np.where((names[member] == "open") & ~against, np.maximum(new, START["open"]), new)
            moved = max([moved, *np.abs(new - odds[f])])
            odds[f] = new
        if moved < tolerance:
            break
    return EvidenceModel(float(base), {f: dict(zip(codes[f][1], odds[f])) for f in FACTORS}, done, dict(zip(strata, map(float, chances))))


def learned(evidence: DataFrame, whole: DataFrame) -> EvidenceModel:
    """The model of all texts, those known to be whole (stratum, p) included; only counts per kind of evidence and rounded posterior reach the driver.

    Their number is bounded by the kinds (some hundreds) times a hundred posteriors times STRATA.
    """
    none = [F.lit(None).cast("string").alias(f) for f in FACTORS if f != "kind"]
    texts = evidence.select("stratum", *FACTORS, "p").unionByName(whole.select("stratum", F.lit(WHOLE_KIND).alias("kind"), *none, "p"))
    cells = texts.groupBy("stratum", *FACTORS, F.round("p", 2).alias("p")).agg(F.count("*").alias("n")).toPandas()
    cells["p"] = cells["p"].astype(float).clip(AT_LEAST, AT_MOST)
    return fitted_evidence(cells.sort_values(["stratum", *FACTORS, "p"], ignore_index=True))


def truncation_scores(docs: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, limits).  scores: doc_id, source, chars, verdict, score; a text is truncated if score > 0."""
    scratch = scratch or Scratch(docs.sparkSession)
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("n_chars").cast("long").alias("n_chars"), "text", F.xxhash64("text").alias("digest")
    ).filter(F.length("text") > 0)
    seen = scratch.cut(spread(given).mapInArrow(_features, FEATURE_SCHEMA))
    ends = seen.filter(F.col("kind") == DOC).drop("kind", "a", "b").dropDuplicates(["doc_id", "digest"])
    limits = scratch.cut(length_limits(ends))

    salt = F.pmod("doc_id", F.lit(SALTS)).alias("salt")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    key = F.coalesce("source", F.lit("\0"))
    at = limits.select("source", "unit", "length", "posterior")
    chars = at.filter("unit = 'chars'").select("source", F.col("length").alias("chars"), F.col("posterior").alias("p_chars"))
    reach = F.explode(F.sequence(F.col("length") - 3, F.col("length"))).alias("bytes")  # a byte limit may fall inside a character
    octets = at.filter("unit = 'bytes'").select("source", reach, "posterior").groupBy("source", "bytes").agg(F.max("posterior").alias("p_bytes"))
    p_bytes = F.when(F.col("bytes") != F.col("chars"), F.col("p_bytes"))
    ends = scratch.cut(
        ends.withColumn("shown", F.col("source"))
        .withColumn("source", key)
        .withColumn("salt", salt)
        .join(chars.select("*", salts), ["source", "chars", "salt"], "left")
        .join(octets.select("*", salts), ["source", "bytes", "salt"], "left")
        .withColumn("p", F.greatest("p_chars", p_bytes))  # null away from limits
        .withColumn("p", F.when(F.col("p").isNotNull(), F.least(F.lit(AT_MOST), F.greatest(F.lit(AT_LEAST), F.col("p")))))
        .drop("p_chars", "p_bytes")
    )

    # habits: frames that inner lines have, or a share of the source's distinct texts end with
    unsuspected = (F.col("verdict") != OPEN) & ~F.coalesce(F.col("p") >= 0.5, F.lit(False)) & ~F.coalesce(F.col("n_chars") - F.col("chars") > 8, F.lit(False))
    once = ends.select("source", "frame", "digest", "verdict", unsuspected.alias("clean")).distinct()
    tail = once.groupBy("source", "frame").agg(F.count(F.when(F.col("clean") & (F.col("verdict") == UNSURE), 1)).alias("n_end"), F.count("*").alias("n_any"))
    inner = seen.filter(F.col("kind") == FRAME).select(key.alias("source"), "frame", F.col("a").alias("n_inner"))
    both = tail.select("source", "frame", "n_end", "n_any", F.lit(0).cast("long").alias("n_inner")).unionByName(
        inner.select("source", "frame", F.lit(0).cast("long").alias("n_end"), F.lit(0).cast("long").alias("n_any"), "n_inner")
    )
    sums = [F.sum(c).alias(c) for c in ("n_end", "n_any", "n_inner")]
    frames = scratch.cut(both.groupBy("source", "frame").agg(*sums))
    sizes = frames.groupBy("source").agg(F.sum("n_any").alias("n_texts"), F.sum("n_inner").alias("n_lines"))
    least = F.when(F.col("frame") == "prose", PROSE_SHARE).otherwise(END_SHARE) * F.col("n_texts")
    # whole log lines and list items are inner lines elsewhere; their ends alone prove nothing
    by_ends = ~F.col("frame").rlike(r"^(log|list)\|") & (F.col("n_end") >= 3) & (F.col("n_end") >= least)
    by_lines = (F.col("n_inner") >= INNER_LINES) & (F.col("n_inner") >= INNER_SHARE * F.col("n_lines"))
    asked = ends.filter(F.col("verdict") == UNSURE)
    wanted = scratch.cut(asked.filter(F.col("word").isNotNull()).select("word", "digest").distinct().groupBy("word").agg(F.count("*").alias("n_ends")))
    vocabulary = scratch.cut(seen.filter(F.col("kind") == WORD).groupBy("word").agg(F.sum("a").alias("seen"), F.sum("b").alias("final")))
    # words that end unsuspected texts are final words too: of all texts, and of those with the same frame
    closing = asked.filter(F.col("word").isNotNull() & unsuspected).select("source", "frame", "word", "digest").distinct().groupBy("source", "frame", "word").agg(F.count("*").alias("n_closing"))
    closing = scratch.cut(closing)
    # a cut at random leaves a word or a part of it as often as words begin with that
    length = F.length("word")
    part = F.explode(F.sequence(F.lit(1), F.least(length, F.lit(LONGEST_PART))))
    parts = vocabulary.select("seen", F.col("word").alias("all"), part.alias("upto")).select(F.substring("all", F.lit(1), F.col("upto")).alias("word"), "seen")
    parts = parts.unionByName(vocabulary.filter(length > LONGEST_PART).select("word", "seen"))
    begun = parts.join(wanted.select("word"), "word", "left_semi").groupBy("word").agg(F.sum("seen").alias("begun"))
    lexicon = wanted.join(vocabulary, "word", "left").join(begun, "word", "left").join(closing.groupBy("word").agg(F.sum("n_closing").alias("all_closing")), "word", "left")
    lexicon = scratch.cut(lexicon.na.fill(0, ["seen", "final", "begun", "all_closing"]))
    final = F.col("final") + F.col("all_closing")
    never_final = (F.col("seen") >= 20) & (final < 0.002 * F.col("seen"))
    few_inside = F.col("seen") < F.greatest(F.lit(2), INSIDE_PER_END * F.col("n_ends"))
    a_part = never_final | (few_inside & (F.col("begun") >= 20) & (F.col("begun") >= 10 * F.col("seen")))
    ended_by = [F.sum("n_closing").alias("n"), F.sum(F.when(a_part, F.col("n_closing")).otherwise(0)).alias("n_parts")]
    closers = scratch.cut(closing.join(lexicon, "word").groupBy("source", "frame").agg(*ended_by))
    by_cuts = closers.filter(F.col("n_parts") >= PARTS_SHARE * F.col("n")).select("source", "frame", F.lit(True).alias("by_cuts"))  # whose ends are no habit
    habits = frames.join(sizes, "source").join(by_cuts, ["source", "frame"], "left").filter(by_lines | by_ends & F.col("by_cuts").isNull()).select("source", "frame").distinct()
    # a missing source may rely on the habits of every other
    habits = scratch.cut(habits.unionByName(habits.select(F.lit("\0").alias("source"), "frame")).distinct().withColumn("habit", F.lit(True)))
    usual = closing.join(closers.filter(F.col("n_parts") < PARTS_SHARE * F.col("n")), ["source", "frame"])
    usual = usual.filter((F.col("n_closing") >= 3) & (F.col("n_closing") >= CLOSING_SHARE * F.col("n")))
    places = vocabulary.agg(F.sum(F.col("seen") * (length + 1)).alias("places"))
    by_chance = F.coalesce(F.col("n") * F.col("begun") / F.col("places"), F.lit(0.0))
    usual = usual.join(lexicon.select("word", "begun"), "word").crossJoin(places)  # places is one row
    usual = usual.filter(F.col("n_closing") >= CLOSING_LIFT * by_chance + 2 * F.sqrt(by_chance)).select("source", "frame", "word", F.lit(True).alias("usual"))
    looked = (
        asked.join(habits.select("*", salts), ["source", "frame", "salt"], "left")
        .join(lexicon.select("*", salts), ["word", "salt"], "left")
        .join(usual.select("*", salts), ["source", "frame", "word", "salt"], "left")
    )
    open_word = F.col("usual").isNull() & (few_inside | never_final)
    weak_word = F.col("usual").isNull() & (final < 0.02 * F.col("seen"))
    rare_word = F.col("usual").isNull() & (F.col("seen") < 20) & (final <= 1)
    # a frame's habit is about ends with whole words
    free = F.col("word").isNotNull() & ~(F.col("habit") & F.startswith("frame", F.lit("bare|")))
    broken = F.coalesce(free & open_word, F.lit(False))
    word = F.when(broken | ~F.coalesce(free, F.lit(False)), F.lit(None).cast("string")).when(rare_word, "rare").when(weak_word, "weak").when(F.col("usual"), "usual").otherwise("known")
    shape = F.split("frame", r"\|")[0]
    kind = F.concat_ws(": ", F.when(broken, "broken").when(F.col("habit"), "habit").otherwise("no habit"), shape)
    unsure = looked.select("source", "doc_id", "shown", "chars", "n_chars", "line_ended", "p", "frame", kind.alias("kind"), word.alias("word"))
    opened = ends.filter(F.col("verdict") == OPEN).select("source", "doc_id", "shown", "chars", "n_chars", "line_ended", "p", "frame", kind_of_open(shape).alias("kind"), F.lit(None).cast("string").alias("word"))
    largest = [r["source"] for r in sizes.orderBy(F.desc("n_texts"), "source").limit(STRATA).collect()]
    stratum = F.when(F.col("source").isin(largest), F.col("source")).otherwise("\0rest")
    evidence = unsure.unionByName(opened).withColumn("stratum", stratum).withColumn("line", F.when(F.startswith("kind", F.lit("open")), F.lit(None).cast("string")).when(F.col("line_ended"), "ended").otherwise("goes on"))
    evidence = scratch.cut(evidence.withColumn("told", F.when(F.col("n_chars") - F.col("chars") > 2, "longer").otherwise("as long")).drop("n_chars", "line_ended", "source"))
    model = learned(evidence, ends.filter(F.col("verdict") == WHOLE).select(stratum.alias("stratum"), "p"))
    chance = F.coalesce(F.col("p"), model.chance())
    score = F.log(chance / (1 - chance))
    for factor in FACTORS:
        score = score + model.column(factor)
    scored = evidence.select("doc_id", F.col("shown").alias("source"), "chars", "frame", score.alias("score"))
    whole = ends.filter(F.col("verdict") == WHOLE).select("doc_id", F.col("shown").alias("source"), "chars", "frame", F.lit(-20.0).alias("score"))
    return whole.unionByName(scored), limits


def truncated(docs: DataFrame) -> DataFrame:
    """(doc_id, source) of the truncated texts."""
    return truncation_scores(docs)[0].filter("score > 0").select("doc_id", "source").distinct()


def truncation_rates(docs: DataFrame) -> DataFrame:
    """Per source: texts that are not blank, truncated ones, their share, and the limits found."""
    scores, limits = truncation_scores(docs)
    found = limits.filter("posterior >= 0.5").groupBy("source").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "length", "unit"))).alias("limits"))
    rates = scores.groupBy("source").agg(F.count("*").alias("n_texts"), F.count(F.when(F.col("score") > 0, 1)).alias("n_truncated"))
    key = F.coalesce(rates["source"], F.lit("\0")) == found["source"]
    return rates.join(found, key, "left").select(
        rates["source"], "n_texts", "n_truncated", F.round(F.col("n_truncated") / F.col("n_texts"), 6).alias("rate"), F.array_join("limits", ", ").alias("limits")
    )
