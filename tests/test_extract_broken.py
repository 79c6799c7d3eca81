import hashlib
import warnings
from pathlib import Path

import pytest

from tessella.operators.extract import _File

BROKEN = b'''"""Module\xc3\xa9."""
import os.path as osp, sys
from .b import (helper,
    Base as B)

class C(B, metaclass=M):
    """Doc of C."""

    @deco(1)
    def m(self, x=free(), *,
          k: int = 3) -> str:
        """Doc of m."""
        text = """
def hidden(): pass
"""
        print "a (b)", self.n(len(x)).up(f"{late(1)}")
        if x: inline()
        elif y(): pass
        return osp.join(x)  # not(a, call)

<<<<<<< ours
def after(a, (b, c)): return ours()
=======
def after(a): return theirs()
>>>>>>> theirs

def open_bracket():
    x = (one(),
    return two()
def last(): return three()
'''


def rows(data: bytes, path: str = "p/a.py"):
    out = _File(path, data).extract()
    return {r["qualname"]: r for r in reversed(out) if r["part"] == "symbol"}, {(r["qualname"].removeprefix("p.a"), r["kind"], r["dst_name"], r["line_start"], r["local_name"]) for r in out if r["part"] == "edge"}


def test_broken_file_keeps_bodies_and_edges():
    symbols, edges = rows(BROKEN)
    text = lambda q: BROKEN[symbols[q]["byte_start"] : symbols[q]["byte_end"]]
    assert set(symbols) == {"p.a", "p.a.C", "p.a.C.m", "p.a.after", "p.a.open_bracket", "p.a.last"}
    assert text("p.a.C.m").startswith(b"@deco(1)") and text("p.a.C.m").endswith(b"return osp.join(x)") and text("p.a.C").endswith(b"return osp.join(x)")
    assert text("p.a.after") == b"def after(a, (b, c)): return ours()" and text("p.a.open_bracket").endswith(b"return two()")
    m = symbols["p.a.C.m"]
    assert (m["kind"], m["line_start"], m["line_end"], m["docstring"], m["owner_class"]) == ("method", 9, 19, "Doc of m.", "p.a.C")
    assert m["signature"] == "m(self, x=free(), *, k: int = 3) -> str" and symbols["p.a.after"]["signature"] == "after(a, (b, c))"
    assert symbols["p.a"]["docstring"] == "Moduleé." and symbols["p.a.C"]["docstring"] == "Doc of C."
    for s in symbols.values():
        assert s["content_hash"] == hashlib.sha256(BROKEN[s["byte_start"] : s["byte_end"]]).hexdigest()
    assert edges == {
        ("", "imports", "os.path", 2, "osp"), ("", "imports", "sys", 2, "sys"), ("", "imports", ".b.helper", 3, "helper"), ("", "imports", ".b.Base", 3, "B"),
        (".C", "inherits", "B", 6, None), (".C", "calls", "deco", 9, None), (".C.m", "calls", "free", 10, None),
        (".C.m", "calls", "self.n", 16, None), (".C.m", "calls", "len", 16, None), (".C.m", "calls", "self.n(len(x)).up", 16, None), (".C.m", "calls", "late", 16, None),
        (".C.m", "calls", "inline", 17, None), (".C.m", "calls", "y", 18, None), (".C.m", "calls", "osp.join", 19, None),
        (".after", "calls", "ours", 22, None), (".after", "calls", "theirs", 24, None), (".open_bracket", "calls", "one", 28, None), (".open_bracket", "calls", "two", 29, None), (".last", "calls", "three", 30, None),
    }


@pytest.mark.parametrize("path", sorted(Path(__file__).resolve().parents[1].glob("tessella/*/*.py")), ids=lambda p: p.stem)
def test_statements_give_what_the_parser_gives(path):
    """A file that parses has the same rows with one broken statement at its end, but for that statement's."""
    data = path.read_bytes()
    whole, broken = rows(data), rows(data + b'\nprint "x"\n')
    assert broken[1] == whole[1]
    for q, s in whole[0].items():
        if s["kind"] != "module":
            assert broken[0][q] == s
        else:
            assert broken[0][q]["docstring"] == s["docstring"]


def test_unparsable_files_of_the_tables():
    import ast

    import pyarrow.parquet as pq

    d = Path("/root/testdata/sf0.01")
    if not d.exists():
        pytest.skip("no test tables")
    newest = {}
    for r in pq.read_table(d / "snapshots.parquet").to_pylist():
        k = (r["repo_id"], r["path"])
        if k not in newest or r["mtime_ns"] > newest[k]["mtime_ns"]:
            newest[k] = r
    found = {}
    for k, r in newest.items():
        if r["state"] == "present" and r["bytes"] is not None:
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    ast.parse(r["bytes"])
            except SyntaxError:
                found[k] = rows(r["bytes"], k[1])[0]
    asked = [r for r in pq.read_table(d / "symbols.parquet").to_pylist() if (r["repo_id"], r["path"]) in found]
    assert found and asked
    for r in asked:
        assert found[r["repo_id"], r["path"]][r["qualname"]]["content_hash"] == r["content_hash"]
