"""Functions paired with their documentation, from source files that need not parse.

A string- and comment-aware state machine goes over each file once.  Outside strings and comments
it counts brackets, which tells where logical lines end and delimits signatures; the indentation
of logical lines delimits bodies and scopes (the language's braces).  A definition's documentation
is its docstring, or else the unbroken run of comment lines right above it and its decorators.

The machine recovers where a file does not parse: an unclosed string ends with its line, an
unclosed triple quote is skipped, a ``def`` or ``class`` at the start of a line ends unclosed
brackets, and merge-conflict markers are passed over.

Files are independent, so this is one narrow stage over the scan: picking the current state of each
path groups keys and places of rows only (``operators.code``).

Defined results: only paths whose state with the largest mtime_ns is 'present' and has bytes count
(of equal times, 'present' wins, then the larger size_bytes); repeated rows count once.  Bytes that are
no UTF-8 are read with replacement marks, a byte-order mark is dropped, CR and CRLF end lines as LF
does.  Empty files and files without definitions give no rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.operators.code import current_states
from tessella.plans.ship import ship

_STOP = re.compile(r"""["'#()\[\]{}\n]|\\\n""")
_HEAD = re.compile(r"(?:async[ \t\\\n]+)?def[ \t\\\n]+([^\W\d]\w*)|class[ \t\\\n]+([^\W\d]\w*)|@")
_RESTART = re.compile(r"[ \t]*(?:async[ \t]+def|def|class)[ \t]+[^\W\d]\w*[ \t]*[(:\[]")
_MARKER = re.compile(r"(?:<{7}|={7}|>{7}|\|{7})(?=[ \n]|\Z)")
_CLOSERS = {
    '"""': re.compile(r'(?:[^\\]|\\.)*?"""', re.S),
    "'''": re.compile(r"(?:[^\\]|\\.)*?'''", re.S),
    '"': re.compile(r'(?:[^\\\n"]|\\.)*"', re.S),
    "'": re.compile(r"(?:[^\\\n']|\\.)*'", re.S),
}
_PREFIX = re.compile(r"(?<!\w)[A-Za-z]{1,2}\Z")


@dataclass
class Definition:
    qualname: str
    name: str
    line: int
    first_line: int  # of its decorators
    indent: int
    signature: str
    parameters: list[str]
    doc: str | None = None
    from_comment: bool = False
    last_line: int = 0


@dataclass
class _Line:
    """A logical line: where it begins and ends, its strings and where its comment starts."""

    start: int
    end: int
    number: int
    strings: list[tuple[int, int, int]] = field(default_factory=list)  # prefix start, quote start, end
    comments: list[tuple[int, int]] = field(default_factory=list)


def logical_lines(text: str) -> Iterator[_Line]:
    """The logical lines of ``text`` (with LF line ends), comment-only and blank ones included."""
    pos, number, depth, size = 0, 1, 0, len(text)
    line, newlines = _Line(0, 0, 1), 0
    while pos < size:
        m = _STOP.search(text, pos)
        if not m:
            break
        c, at = m.group(), m.start()
        pos = m.end()
        if c == "\n":
            newlines += 1
            if depth and not _RESTART.match(text, pos):
                continue
            depth = 0
            line.end = at
            yield line
            number += newlines
            line, newlines = _Line(pos, 0, number), 0
        elif c == "\\\n":
            newlines += 1
        elif c == "#":
            end = text.find("\n", at)
            pos = size if end < 0 else end
            line.comments.append((at, pos))
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        else:
            quote = text[at : at + 3] if text[at : at + 3] == c * 3 else c
            close = _CLOSERS[quote].match(text, at + len(quote))
            if close:
                pos = close.end()
                prefix = _PREFIX.search(text, max(line.start, at - 2), at)
                line.strings.append((prefix.start() if prefix else at, at, pos))
                newlines += text.count("\n", at, pos)
            elif len(quote) == 3:
                pos = at + 3
            else:
                end = text.find("\n", at)
                pos = size if end < 0 else end
    line.end = size
    yield line


def _docstring(text: str, line: _Line, start: int) -> str | None:
    """The value of the line's first statement, if that is a plain string."""
    at, parts, depth = start, [], 0
    strings = [s for s in line.strings if s[0] >= start]
    end = line.end
    while at < end:
        c = text[at]
        if strings and at == strings[0][0]:
            begin, quote, stop = strings.pop(0)
            if text[begin:quote].lower() not in ("", "u", "r"):
                return None
            parts.append(text[begin:stop])
            at = stop
        elif c in " \t\n\\":
            at += 1
        elif c == "(" and not parts:
            depth, at = depth + 1, at + 1
        elif c == ")" and depth:
            depth, at = depth - 1, at + 1
        elif c == "#":
            nl = text.find("\n", at)
            at = end if nl < 0 else nl
        elif c == ";" and parts and not depth:
            break
        else:
            return None
    if not parts:
        return None
    out = []
    for p in parts:
        try:
            out.append(ast.literal_eval(p))
        except (ValueError, SyntaxError):
            out.append(p.lstrip("uUrR").strip("\"'"))
    return "".join(out)


def _header_end(text: str, line: _Line, start: int) -> int:
    """Where the colon that ends a definition's header stands."""
    depth, at, inside = 0, start, {s[1]: s[2] for s in line.strings}
    comments = dict(line.comments)
    while at < line.end:
        c = text[at]
        if at in inside:
            at = inside[at]
            continue
        if at in comments:
            at = comments[at]
            continue
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth <= 0:
            return at
        at += 1
    return line.end


def _parameters(signature: str) -> list[str]:
    """Parameter names of a signature, by splitting at commas outside brackets and strings."""
    signature = re.sub(r"""("|')(?:[^\\]|\\.)*?\1""", "''", signature)
    open_at = signature.find("(")
    if open_at < 0:
        return []
    depth, part, parts = 0, "", []
    for c in signature[open_at + 1 :]:
        if c == ")" and not depth:
            break
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            parts.append(part)
            part = ""
        else:
            part += c
    names = (re.match(r"\s*\**\s*([^\W\d]\w*)", p) for p in [*parts, part])
    return [m.group(1) for m in names if m]


def definitions(text: str, module: str) -> tuple[list[Definition], list[str]]:
    """Every function and method of a file, in order, and the file's lines."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    scopes: list[tuple[int, str, Definition | None]] = []
    out: list[Definition] = []
    comment_lines: set[int] = set()
    decorated: int | None = None
    waiting: Definition | None = None  # a definition whose first statement has not come yet
    last_code = 0
    for line in logical_lines(text):
        body = line.start
        while body < line.end and text[body] in " \t\f":
            body += 1
        if body >= line.end:
            continue
        if text[body] == "#":
            if line.number <= len(lines):
                comment_lines.add(line.number)
            continue
        if body == line.start and _MARKER.match(text, body):
            continue
        indent = len(text[line.start : body].expandtabs(8))
        while scopes and indent <= scopes[-1][0]:
            done = scopes.pop()[2]
            if done:
                done.last_line = last_code
        end_line = line.number + text.count("\n", line.start, line.end)
        if waiting:
            waiting.doc = _docstring(text, line, body) if indent > waiting.indent else None
            waiting = None
        head = _HEAD.match(text, body)
        if head and head.group().startswith("@"):
            decorated = decorated or line.number
        elif head and not text[head.end() : head.end() + 1].isidentifier():
            name = head.group(1) or head.group(2)
            qualname = ".".join([module, *(s[1] for s in scopes), name])
            if head.group(1):
                colon = _header_end(text, line, head.end())
                skip = [c for c in line.comments if c[0] < colon]
                raw, at = "", head.start(1)
                for a, b in skip:
                    raw, at = raw + text[at:a], b
                signature = re.sub(r"\s+", " ", (raw + text[at:colon]).replace("\\\n", " ")).strip()
                signature = re.sub(r",? \)", ")", signature).replace("( ", "(")
                d = Definition(qualname, name, line.number, decorated or line.number, indent, signature, _parameters(signature))
                out.append(d)
                rest = text[colon + 1 : line.end]
                if rest.strip() and not rest.lstrip().startswith("#"):
                    d.doc = _docstring(text, line, colon + 1)
                else:
                    waiting = d
                scopes.append((indent, name, d))
            else:
                scopes.append((indent, name, None))
            decorated = None
        else:
            decorated = None
        last_code = end_line
    for _, _, d in scopes:
        if d:
            d.last_line = last_code
    for d in out:
        if d.doc is None:
            n = d.first_line - 1
            while n in comment_lines:
                n -= 1
            if n + 1 < d.first_line:
                d.doc = "\n".join(re.sub(r"^#+[:!]?", "", s.strip()) for s in lines[n : d.first_line - 1])
                d.from_comment = True
    return out, lines


# Words that say nothing by themselves, next to a function's name.
FILLER = frozenset(
    "a an the this that it its of for to in on with by from and or is are be as at function method def class property coroutine"
    " helper helpers async wrapper routine procedure implementation implements".split()
)
# Words of placeholders and of notes that documentation is still to come.
PLACEHOLDER = frozenset(
    "todo fixme xxx tbd tba wip hack n na none null docstring docstrings documentation document documented undocumented doc docs"
    " description descriptions describe described me here goes go no not yet still written write writing needs need missing"
    " placeholder lorem ipsum summary add added fill later soon insert your text please some something blah foo bar stub unknown pending coming".split()
)
# Marks that open a note about work still to be done.
_NOTE = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|tbd|tba|wip|hack)\b")
# Directives for tools.
_DIRECTIVE = re.compile(
    r"(?i)^\W*(?:noqa\b|type:|pylint\b|pragma\b|fmt:|isort\b|mypy\b|flake8\b|ruff\b|pyright\b|nosec\b|yapf\b|black\b|coverage\b|bandit\b|noinspection\b|region\b|endregion\b|-\*-|vim:|coding[:=]|cython:|sourcery\b|pytype:|doctest:|lint:)"
)
# Section heads and tags of the common docstring layouts.
_HEADS = "args arguments parameters params keyword other attributes returns return yields yield raises raise throws except exceptions examples example notes note see also references todo warns warnings"
_TAG = re.compile(r"^\s*[:@]\s*(?:param|parameter|arg|argument|key|keyword|type|returns?|rtype|raises?|except|exception|var|ivar|cvar|yields?|ytype|throws?)\b[^:\n]*:?")
_SECTION = re.compile(rf"(?i)^\s*(?:{'|'.join(_HEADS.split())})(?:\s+(?:arguments|args|parameters|also))?\s*:?\s*$")
_ENTRY = re.compile(r"^\s*\*{0,2}[^\W\d]\w*\s*(?:\([^)]*\))?\s*:")
_UNDERLINE = re.compile(r"^\W*$")
_BANNER = re.compile(r"^\s*([=\-*#~_+])\1{1,}.*[=\-*#~_+]{2,}\s*$")
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")


def _stem(word: str) -> str:
    for end in ("ing", "ies", "ied", "es", "ed", "s", "e", "y"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


def name_words(*names: str) -> set[str]:
    return {_stem(w.lower()) for n in names for p in _WORD.findall(n) for w in (*_CAMEL.findall(p), p)}


def is_trivial(doc: str, name: str, parameters: list[str], from_comment: bool = False) -> bool:
    """Whether documentation says nothing that the names of function and parameters do not."""
    said: list[str] = []
    in_note = in_fields = False
    for raw in doc.split("\n"):
        s = raw.strip()
        if not s:
            in_note = False
            continue
        if _DIRECTIVE.match(s) or _BANNER.match(s) or _UNDERLINE.match(s):
            continue
        if in_note or _NOTE.match(s):  # a note runs to the end of its paragraph
            in_note = True
            continue
        if _SECTION.match(s):
            in_fields = True
            continue
        tag = _TAG.match(s)
        if tag:
            s = s[tag.end() :]
        elif in_fields:
            entry = _ENTRY.match(s)
            if entry:
                s = s[entry.end() :]
        if s.strip():
            said.append(s)
    text = " ".join(said)
    words = [w.lower() for w in _WORD.findall(text)]
    if from_comment and len(said) == 1 and len(words) <= 2 and text.isascii() and not re.search(r"[.!?:;,]\s*$", text):
        return True  # a section head
    known = name_words(name, *parameters) | {"self", "cls"}
    news = [w for w in words if w not in FILLER and _stem(w) not in known and not w.isdigit()]
    return all(w in PLACEHOLDER for w in news)


def summary_of(doc: str) -> str:
    return next((s.strip() for s in doc.split("\n") if _WORD.search(s)), "")


def module_of(path: str) -> str:
    parts = [p for p in re.sub(r"\.pyi?$", "", path.replace("\\", "/")).split("/") if p not in ("", ".")]
    return ".".join(parts[:-1] if parts and parts[-1] == "__init__" else parts)


def current_files(snapshots: DataFrame) -> DataFrame:
    """(repo_id, path, bytes) of the paths that are present now, one row each."""
    now = current_states(snapshots, present_first=True)
    return now.filter((F.col("state") == "present") & F.col("bytes").isNotNull()).select("repo_id", "path", "bytes")


PAIR_SCHEMA = "repo_id string, path string, qualname string, def_line int, signature string, summary string, doc string, code string"


def documented_functions(snapshots: DataFrame) -> DataFrame:
    """A row per definition with real documentation (see PAIR_SCHEMA)."""
    schema = pa.schema([(c, pa.int32() if c == "def_line" else pa.string()) for c in (f.strip().split(" ")[0] for f in PAIR_SCHEMA.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                repo, path, data = (b.column(j)[i].as_py() for j in range(3))
                found, lines = definitions(data.decode("utf-8", "replace"), module_of(path))
                rows = [
                    (repo, path, d.qualname, d.line, d.signature, summary_of(d.doc), d.doc, "\n".join(lines[d.first_line - 1 : d.last_line]))
                    for d in found
                    if d.doc is not None and not is_trivial(d.doc, d.name, d.parameters, d.from_comment)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ship(snapshots.sparkSession)
    return current_files(snapshots).mapInArrow(run, PAIR_SCHEMA)
