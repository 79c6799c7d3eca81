import ast

import pytest

from tessella.llm.docpairs import definitions, documented_functions, is_trivial, module_of

SOURCE = '''
"""Module."""
def plain(a, b=")", *rest, key: dict[str, int] = {}) -> int:
    """Counts the (open) brackets."""
    x = "def fake(): pass"  # def fake2():
    def inner():
        # comment first
        r"""Raw \\d docs."""
    return 1

# What the pair is for.
@deco(
    times=3,
)
@other  # why
async def decorated(x): return x

class Box:
    @property
    def size(self):
        b"""bytes are no docs"""

    # A stray comment.

    def none(self): pass
    def one(self): "Docs on one line."
    def f(self): f"no {1} docs"
    def joined(self):
        ("Two " 'parts.')
if True:
    def twice(): u'First kind.'
else:
    def twice():
        \'\'\'
        Second kind.
        \'\'\'
'''


def test_definitions_like_the_parser():
    found, _ = definitions(SOURCE, "m")
    tree = [n for n in ast.walk(ast.parse(SOURCE)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    assert [d.line for d in found] == sorted(n.lineno for n in tree)
    docs = {n.lineno: ast.get_docstring(n, clean=False) for n in tree}
    assert {d.line: None if d.from_comment else d.doc for d in found} == docs
    by_name = {d.qualname: d for d in found}
    assert by_name["m.plain"].signature == 'plain(a, b=")", *rest, key: dict[str, int] = {}) -> int'
    assert by_name["m.plain"].parameters == ["a", "b", "rest", "key"]
    assert by_name["m.decorated"].doc.strip() == "What the pair is for." and by_name["m.decorated"].from_comment
    assert by_name["m.Box.none"].doc is None and "m.plain.inner" in by_name


@pytest.mark.parametrize("text, names", [
    ("x = (1,\ndef a():\n    pass\nclass C:\n    def b(self):\n<<<<<<< ours\n        x = 1\n=======\n>>>>>>> theirs\n    def c(self): pass\n", ["m.a", "m.C.b", "m.C.c"]),
    ("def a():\n    x = 'open\ndef b(): pass\n", ["m.a", "m.b"]),
    ('def a():\n    """never closed\ndef b(): pass\n', ["m.a", "m.b"]),
    ("\tdef t():\n\t\tprint \"x\"\r\n\r\ndef u(): pass", ["m.t", "m.u"]),
    ("", []),
])
def test_files_that_do_not_parse(text, names):
    assert [d.qualname for d in definitions(text, "m")[0]] == names


@pytest.mark.parametrize("doc", ["", " \n", "---", "???", "TODO: write docs\nlater", "TODO", "Args:\n    row:\n    key (int):\nReturns:\n", ":param row:\n:return:", "The load row function.", "load_row", "Loads row", "N/A", "<describe me>", "Docstring goes here.", "noqa: C901"])
def test_trivial(doc):
    assert is_trivial(doc, "load_row", ["row", "key"])


@pytest.mark.parametrize("doc", ["Raises on stale rows.", "Args:\n    row: the stale one", "未解決の参照だけを残します。", "Bytes, never characters.", ":param row: what to keep back"])
def test_not_trivial(doc):
    assert not is_trivial(doc, "load_row", ["row", "key"])


def test_section_heads_are_comments_without_text():
    assert is_trivial(" helpers", "x", [], True) and is_trivial(" === gate ===", "x", [], True) and not is_trivial(" Never blocks.", "x", [], True)


def test_current_state_decides(rows):
    doc = b'def f():\n    """Keeps the newest state."""\n'
    s = rows(
        "repo_id string, path string, state string, mtime_ns long, bytes binary, doc string",
        ("r", "a.py", "present", 1, b"", "x"), ("r", "a.py", "present", 2, doc, "x"), ("r", "a.py", "present", 2, doc, "x"),
        ("r", "gone.py", "present", 1, doc, "x"), ("r", "gone.py", "absent", 2, None, "x"), ("r", "n.py", "present", 1, None, "x"), (None, "pkg/__init__.py", "present", None, b"\xff" + doc, "x"),
    )
    got = sorted((r.path, r.qualname, r.def_line) for r in documented_functions(s).collect())
    assert got == [("a.py", "a.f", 1)]
    assert documented_functions(s.limit(0)).count() == 0
    assert module_of("pkg/__init__.py") == "pkg"
