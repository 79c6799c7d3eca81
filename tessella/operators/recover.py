"""Statements of a source file that does not parse as a whole.

A string- and comment-aware state machine goes over the bytes once and yields logical lines.  It
recovers where the file is broken: an unclosed string ends with its line, an unclosed triple quote
is skipped, a line that begins with a word that no bracket can hold ends unclosed brackets, and
merge-conflict markers are passed over.  Each statement is parsed on its own, a compound one with a
stand-in for its body; what does not parse even so gives calls, bases and imports by its tokens.

Text is read as Latin-1, one character a byte, so that every position is a byte of the file.
"""

from __future__ import annotations

import ast
import keyword
import re
from bisect import bisect_left
from collections.abc import Iterator

_NAME = r"[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*"
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_" + "".join(map(chr, range(128, 256))))
_STOP = re.compile(r"""["'#()\[\]{}\n]|\\\r?\n""")
_HEAD = re.compile(rf"(?:async[ \t\\\r\n]+)?(def|class)[ \t\\\r\n]+({_NAME})")
#: A line that begins so is the start of a statement whatever brackets are open.
_RESTART = re.compile(
    rf"[ \t]*(?:(?:async[ \t]+def|def|class)[ \t]+{_NAME}[ \t]*[(:\[]|from[ \t]+[\w.]+[ \t]+import\b|try[ \t]*:|finally[ \t]*:"
    r"|(?:import|return|raise|while|with|assert|del|pass|break|continue|global|nonlocal|elif|except)\b(?![ \t]*[=.,)\]}]))"
)
_MARKER = re.compile(r"(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|\Z)")
_CLOSERS = {
    '"""': re.compile(r'(?:[^\\"]|\\.|"(?!""))*+"""', re.S),
    "'''": re.compile(r"(?:[^\\']|\\.|'(?!''))*+'''", re.S),
    '"': re.compile(r'(?:[^\\\n"]|\\.)*+"', re.S),
    "'": re.compile(r"(?:[^\\\n']|\\.)*+'", re.S),
}
_PREFIX = re.compile(r"(?<![A-Za-z0-9_\x80-\xff])[A-Za-z]{1,2}\Z")
_BLANK = " \t\r\n\f\v"
# What a clause needs before and after it to be a whole statement.
_BEFORE = {"elif": "if 1: pass\n", "else": "if 1: pass\n", "except": "try: pass\n", "finally": "try: pass\n", "case": "match 0:\n "}
_AFTER = {"try": ("\nfinally: pass", " pass\nfinally: pass"), "match": ("\n case _: pass",), "@": ("\ndef f(): pass",)}
# Words that a bracket may follow without a call.
_NO_CALL = frozenset(keyword.kwlist) - {"None", "True", "False"} | {"print", "exec"}
_FAILS = (SyntaxError, ValueError, RecursionError, MemoryError)
_AS = rf"(?:[ \t]+as[ \t]+({_NAME}))?"


_TOKEN = re.compile(r"""(?:[rRbBuUfF]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|\'\'\'(?:[^\\]|\\.)*?\'\'\'|\"(?:[^\"\\\n]|\\.)*\"|\'(?:[^\'\\\n]|\\.)*\')|\#[^\n]*|\\\n|[\s]+|[()\[\]{}:]|[^\s()\[\]{}:"'\#\\]+|.""", re.S)


def written_signature(header: str) -> str:
    """``name(parameters) -> result`` of a definition's source up to its first statement."""
    out, depth = [], 0
    body = re.sub(r"\A\s*(?:async\s+)?def\s+", "", header)
    for t in _TOKEN.findall(body):
        if t == ":" and depth == 0:
            break
        depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
        out.append(" " if t.isspace() or t == "\\\n" else "" if t.startswith("#") else t)
    s = re.sub(r"\A(\w+) (?=[(\[])", r"\1", re.sub(r" +", " ", "".join(out)).strip())
    return re.sub(r",? ?\)(?=$| ->)", ")", s.replace("( ", "("))


class Statement:
    """A logical line that holds code."""

    def __init__(self, text: str, start: int, end: int, line: int, indent: int, strings: list[tuple[int, int, int]], comments: list[tuple[int, int]]):
        self.text, self.start, self.line, self.indent, self.strings, self.comments = text, start, line, indent, strings, comments
        masked, at = [], start
        for a, b, blank in sorted([(s[0], s[2], "s") for s in strings] + [(c[0], c[1], " ") for c in comments]):
            masked += [text[at:a], blank * (b - a)]
            at = b
        # strings as runs of "s", comments as blanks: as long as the statement itself
        self.masked = "".join(masked) + text[at:end]
        self.code = self.masked.rstrip(_BLANK + ";\\")
        self.code_end = start + len(self.code)
        self.last_line = line + text.count("\n", start, self.code_end)
        self.word = re.match(r"\w*|@", self.code).group() or self.code[:1]
        self.is_decorator = self.word == "@"
        self.newlines = [start + m.start() for m in re.finditer("\n", self.code)]
        self._parsed: ast.Module | None | bool = False

    def source(self, a: int, b: int) -> str:
        return self.text[a:b].encode("latin-1").decode("utf-8", "replace")

    def line_of(self, at: int) -> int:
        return self.line + bisect_left(self.newlines, at)

    def at(self, line: int, column: int) -> int:
        """The byte in the file of a position in a tree."""
        n = line - self.line
        return column + (self.newlines[n - 1] if n else self.text.rfind("\n", 0, self.start)) + 1

    def _parse(self, a: int, b: int, before: str = "", after: str = "") -> ast.Module | None:
        """The tree of the bytes [a, b), with positions in the file."""
        try:
            tree = ast.parse(before.encode() + self.text[a:b].encode("latin-1") + after.encode())
        except _FAILS:
            return None
        skip = before.count("\n")
        column = a - (self.text.rfind("\n", 0, a) + 1) - (len(before) - before.rfind("\n") - 1)
        lines = self.line_of(a) - 1 - skip
        work = [tree]
        while work:
            node = work.pop()
            if hasattr(node, "lineno"):
                node.col_offset += column if node.lineno == skip + 1 else 0
                node.end_col_offset += column if node.end_lineno == skip + 1 else 0
                node.lineno += lines
                node.end_lineno += lines
            work.extend(ast.iter_child_nodes(node))
        return tree

    def tree(self) -> ast.Module | None:
        if self._parsed is False:
            self._parsed = None
            before = _BEFORE.get(self.word, "")
            for after in ("", *_AFTER.get(self.word, (" pass",))):
                if after != " pass" or self.code.endswith(":"):
                    self._parsed = self._parse(self.start, self.code_end, before, after)
                if self._parsed:
                    break
        return self._parsed

    def head(self) -> tuple[bool, str] | None:
        """(is a class, name) of a definition."""
        m = _HEAD.match(self.code)
        return (m.group(1) == "class", self.source(self.start + m.start(2), self.start + m.end(2))) if m else None

    def _definition(self):
        tree = self.tree()
        node = tree.body[0] if tree and len(tree.body) else None
        return node if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None

    def colon(self) -> int:
        """Where in the code the colon that ends a header stands."""
        depth = 0
        for m in re.finditer(r"[()\[\]{}:]", self.code):
            if m.group() == ":" and depth <= 0:
                return m.start()
            depth += (m.group() in "([{") - (m.group() in ")]}")
        return len(self.code)

    def has_inline_body(self) -> bool:
        return self.colon() + 1 < len(self.code)

    def signature(self, name: str) -> str:
        return written_signature(self.source(self.start, self.start + self.colon() + 1))

    def docstring(self) -> str | None:
        """The string that the statement is, if it is one."""
        if not self.strings or self.code.strip("s()" + _BLANK + "\\").split(";")[0].strip(_BLANK):
            return None
        tree = self.tree()
        return ast.get_docstring(tree, clean=False) if tree else None

    def inline_docstring(self) -> str | None:
        node = self._definition()
        return ast.get_docstring(node, clean=False) if node is not None and self.has_inline_body() else None

    def bases(self) -> Iterator[tuple[int, str]]:
        """(line, source) of a class's bases."""
        node = self._definition()
        if node is not None:
            for b in node.bases:
                yield b.lineno, self.source(self.at(b.lineno, b.col_offset), self.at(b.end_lineno, b.end_col_offset))
            return
        at = _HEAD.match(self.code).end()
        stop = self.colon()
        open_at = self.code.find("(", at, stop)
        if open_at < 0:
            return
        for a, b in _parts(self.code, open_at + 1, stop):
            part = self.code[a:b]
            if part.strip(_BLANK) and not re.match(rf"\s*(?:\*|{_NAME}\s*=(?!=))", part):
                a += len(part) - len(part.lstrip(_BLANK))
                b = a + len(self.code[a:b].rstrip(_BLANK))
                yield self.line_of(self.start + a), self.source(self.start + a, self.start + b)

    def trees(self) -> Iterator[ast.AST]:
        """What of the statement parses: it, or the formatted strings in it."""
        tree = self.tree()
        if tree:
            yield from tree.body[0].decorator_list if self.is_decorator else [tree]
            return
        for prefix, quote, end in self.strings:
            if "f" in self.text[prefix:quote].lower():
                found = self._parse(prefix, end)
                if found:
                    yield found

    def token_references(self) -> Iterator[tuple[str, str, int, str | None]]:
        """(kind, name, line, local name) where the statement does not parse."""
        if self.tree():
            return
        m = re.match(rf"(?:from[ \t]+(\.*[ \t]*(?:{_NAME}(?:\.{_NAME})*)?)[ \t]+)?import\b", self.code)
        if m:
            base = re.sub(r"\s", "", m.group(1) or "")
            for n in re.finditer(rf"({_NAME}(?:[ \t]*\.[ \t]*{_NAME})*){_AS}", re.sub(r"\\\r?\n", lambda x: " " * len(x.group()), self.code[m.end() :])):
                name = re.sub(r"\s", "", n.group(1))
                if name.isascii() and keyword.iskeyword(name):
                    continue
                utf = lambda x: x.encode("latin-1").decode("utf-8", "replace")
                line = self.line
                if m.group(1) is None:
                    yield "imports", utf(name), line, utf(n.group(2) or name.split(".")[0])
                else:
                    yield "imports", utf(f"{base}.{name}" if base else name), line, utf(n.group(2) or name)
            return
        found = []
        opened, partner = [], {}
        for b in re.finditer(r"[()\[\]{}]", self.code):
            if b.group() in "([{":
                opened.append(b.start())
                continue
            if opened:
                partner[b.start()] = opened.pop()
        head = _HEAD.match(self.code)
        for b in re.finditer(r"\(", self.code):
            end = b.start()
            while end and self.code[end - 1] in " \t":
                end -= 1
            if head and end <= head.end():
                continue  # the name of the definition
            begin = _callee(self.code, end, partner)
            if begin is not None:
                found.append((begin, end))
        for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
            yield "calls", self.source(self.start + a, self.start + b), self.line_of(self.start + a), None


def _callee(code: str, end: int, partner: dict[int, int]) -> int | None:
    """Where the name, attribute, subscript or call that ends at ``end`` begins; None if none does."""
    begin = None
    while end > 0:
        c = code[end - 1]
        if c in ")]":
            at = partner.get(end - 1)
            if at is None:
                return begin
            begin = end = at
            if end and (code[end - 1] in _WORD or code[end - 1] in ")]"):
                word = re.search(rf"{_NAME}\Z", code[max(0, end - 40) : end])
                if not word or word.group() not in _NO_CALL:
                    continue  # what is called or subscripted here
        elif c in _WORD:
            at = end
            while at and code[at - 1] in _WORD:
                at -= 1
            if code[at:end] in _NO_CALL or code[at].isdigit():
                return begin
            begin = end = at
        else:
            return begin
        before = end
        while before and code[before - 1] in " \t":
            before -= 1
        if not before or code[before - 1] != ".":
            return begin
        end = before - 1
        while end and code[end - 1] in " \t":
            end -= 1
    return begin


def _parts(code: str, at: int, stop: int) -> Iterator[tuple[int, int]]:
    """The parts between commas outside brackets, up to the closing bracket."""
    depth, begin = 0, at
    for m in re.finditer(r"[()\[\]{},]", code[at:stop]):
        c, here = m.group(), at + m.start()
        if c in ")]}" and not depth:
            stop = here
            break
        if c == "," and not depth:
            yield begin, here
            begin = here + 1
        depth += (c in "([{") - (c in ")]}")
    yield begin, stop


def statements(data: bytes) -> Iterator[Statement]:
    """The statements of a file, in order; blank and comment lines and conflict markers left out."""
    text = data.decode("latin-1")
    size, number, depth, newlines = len(text), 1, 0, 0
    pos = start = 3 if data.startswith(b"\xef\xbb\xbf") else 0
    strings: list[tuple[int, int, int]] = []
    comments: list[tuple[int, int]] = []
    unclosed: set[str] = set()  # quotes that nothing ahead closes

    def made(end: int) -> Iterator[Statement]:
        body = start
        while body < end and text[body] in " \t\f\r":
            body += 1
        if body >= end or (comments and comments[0][0] == body and "\n" not in text[body:end]) or (body == start and _MARKER.match(text, body)):
            return
        if not text[body:end].strip(_BLANK + "\\"):
            return
        yield Statement(text, body, end, number, len(text[start:body].replace("\f", "").expandtabs(8)), strings, comments)

    while pos < size:
        if pos == start and _MARKER.match(text, pos):
            end = text.find("\n", pos)
            pos = start = size if end < 0 else end + 1
            number += 1
            continue
        m = _STOP.search(text, pos)
        if not m:
            break
        c, at = m.group(), m.start()
        pos = m.end()
        if c == "\n":
            newlines += 1
            if depth and not _RESTART.match(text, pos) and not _MARKER.match(text, pos):
                continue
            depth = 0
            yield from made(at)
            number += newlines
            start, newlines, strings, comments = pos, 0, [], []
        elif c[0] == "\\":
            newlines += 1
        elif c == "#":
            end = text.find("\n", at)
            pos = size if end < 0 else end
            comments.append((at, pos))
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        else:
            quote = text[at : at + 3] if text[at : at + 3] == c * 3 else c
            close = None if quote in unclosed else _CLOSERS[quote].match(text, at + len(quote))
            if close:
                pos = close.end()
                prefix = _PREFIX.search(text, max(start, at - 3), at)
                strings.append((prefix.start() if prefix else at, at, pos))
                newlines += text.count("\n", at, pos)
            elif len(quote) == 3:
                unclosed.add(quote)
                pos = at + 3
            else:
                end = text.find("\n", at)
                pos = size if end < 0 else end
    yield from made(size)
