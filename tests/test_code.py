import subprocess

import pytest

from tessella.functions import text as X
from tessella.operators import code, extract
from pyspark.sql import functions as F


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("path, test", [("tests/a.py", True), ("a/test_b.py", True), ("b_test.py", True), ("conftest.py", True), ("a\\testing\\b.py", True), ("latest/a.py", False), ("tests.py", False), ("contest.py", False)])
def test_is_test_path(spark, path, test):
    assert one(spark, X.is_test_path(F.col("p")), p=path) is test


@pytest.mark.parametrize("path, name", [("a/b.py", "a.b"), ("a/__init__.py", "a"), ("./a.py", "a"), ("a\\b.py", "a.b")])
def test_module_qualname(spark, path, name):
    assert one(spark, X.module_qualname(F.col("p")), p=path) == name


@pytest.mark.parametrize("path, out", [("a/b.py", False), ("", True), (None, True), ("/a", True), ("a/../b", True), ("..", True), ("a..b/c", False)])
def test_path_escapes(spark, path, out):
    assert one(spark, X.path_escapes(F.col("p")), p=path) is out


A = b'''import os.path as osp
from .b import helper, Base as B
from pkg.b import free

class C(B):
    """Doc."""
    def m(self, x=free()):
        return self.n() + self.up() + osp.join(x)
    @deco
    def n(self): return lonely()

def local(): return C.n, local()
'''
B = b"class Base:\n    def up(self): pass\n    def n(self): pass\ndef free(): pass\ndef helper(): pass\n"
D = b"def lonely(): pass\ndef n(): pass\n"
SNAP = "repo_id string, path string, state string, bytes binary, mtime_ns long, size_bytes long"


def graph(spark):
    files = [("r", "pkg/a.py", "present", A, 1, 1), ("r", "pkg/b.py", "present", B, 1, 1), ("r", "d.py", "present", D, 1, 1), ("r", "broken.py", "present", b"def ok():\n  x = (\nclass K:\n  def f(self): pass\n", 1, 1), ("r", "gone.py", "absent", None, 2, None), ("r", "empty.py", "present", b"", 1, 0)]
    return extract.extract_graph(spark.createDataFrame(files, SNAP))


def test_extraction_and_resolution(spark):
    symbols, edges = graph(spark)
    got = {r.qualname: r for r in symbols.collect()}
    assert {"pkg.a", "pkg.a.C", "pkg.a.C.m", "pkg.a.C.n", "pkg.a.local", "broken.ok", "broken.K.f", "empty"} <= set(got)
    n = got["pkg.a.C.n"]
    assert A[n.byte_start : n.byte_end].startswith(b"@deco") and n.kind == "method" and got["pkg.a.C"].docstring == "Doc."
    r = {(x.src, x.dst_name): (x.dst, x.resolver, x.confidence) for x in extract.resolve(edges, symbols).collect()}
    assert r["pkg.a.C.m", "self.n"] == ("pkg.a.C.n", "self", 0.95)
    assert r["pkg.a.C.m", "self.up"] == ("pkg.b.Base.up", "self_inherited", 0.85) or r["pkg.a.C.m", "self.up"][1] is None
    assert r["pkg.a.C.m", "free"] == ("pkg.b.free", "import_alias", 0.85)
    assert r["pkg.a.C.n", "lonely"] == ("d.lonely", "unique", 0.75)
    assert r["pkg.a.local", "local"] == ("pkg.a.local", "module_local", 0.9)
    assert r["pkg.a.C.m", "osp.join"][0] is None
    assert len(r) == edges.select("src", "dst_name").distinct().count()  # unresolved edges stay
    rates = extract.resolution_rates(extract.resolve(edges, symbols), symbols).first()
    assert rates.edges == rates.resolved + rates.external + rates.ambiguous


def test_inherited_through_a_named_base(spark):
    src = b"class Base:\n    def up(self): pass\nclass Mid(Base): pass\nclass C(Mid):\n    def m(self): self.up()\n"
    symbols, edges = extract.extract_graph(spark.createDataFrame([("r", "x.py", "present", src, 1, 1)], SNAP))
    r = {x.dst_name: (x.dst, x.resolver) for x in extract.resolve(edges, symbols).filter("kind = 'calls'").collect()}
    assert r == {"self.up": ("x.Base.up", "self_inherited")}


def test_span_reasons(spark):
    snaps = spark.createDataFrame([("r", "a", "present", b"hello", 2, 5), ("r", "a", "present", b"old", 1, 3), ("r", "u", "unreadable", None, 1, None), ("r", "g", "absent", None, 1, None)], SNAP)
    h = "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    spans = spark.createDataFrame([("r", 1, "a", 0, 5, h), ("r", 2, "a", 0, 4, h), ("r", 3, "a", 0, 9, h), ("r", 4, "u", 0, 1, h), ("r", 5, "g", 0, 1, h), ("r", 6, "none", 0, 1, h), ("r", 7, "a", 3, 3, h), ("r", 8, "a", None, 3, h)], "repo_id string, span_id long, path string, byte_start int, byte_end int, content_hash string")
    got = {r.span_id: r.reason for r in code.checked_spans(spans, snaps).collect()}
    assert got == {1: "ok", 2: "hash_mismatch", 3: "span_truncated", 4: "unreadable", 5: "file_missing", 6: "file_missing", 7: "invalid_span", 8: "invalid_span"}


def test_source_chunks_of_wrong_spans(spark):
    snaps = spark.createDataFrame([("r", "a", "present", "é = 1".encode(), 2, 5)], SNAP)
    syms = spark.createDataFrame([("r", 1, "a", "function", "f", "a.f", None, 1, 2, b, 6, None, None) for b in (0, 1)], "repo_id string, symbol_id long, path string, kind string, name string, qualname string, parent_qualname string, line_start int, line_end int, byte_start int, byte_end int, docstring string, signature string")
    got = sorted(r.text.split("\n")[-1] for r in code.source_chunks(syms, snaps).collect())
    assert got == ["é = 1", "\ufffd = 1"]


def test_index_of_a_tree(spark, tmp_path):
    from tessella.api import Index

    tree = tmp_path / "tree"
    (tree / "pkg" / "__pycache__").mkdir(parents=True)
    (tree / "pkg" / "a.py").write_bytes(A)
    (tree / "pkg" / "b.py").write_bytes(B)
    (tree / "pkg" / "__pycache__" / "x.py").write_text("def hidden(): pass\n")
    index = Index.build(spark, str(tmp_path / "index"), {"r": str(tree)})
    assert index.stats()["symbols"]["class"] == 2
    names = {r.symbol_id: r.qualname for r in index.table("symbols").collect()}
    hits = [names[r.symbol_id] for r in index.search({1: "helper", 2: "self.up"}).orderBy("query_id", "rank").collect()]
    assert "pkg.b.helper" in hits and "pkg.a.C.m" in hits
    assert "pkg.b.free" in index.get_symbol("r", "pkg.a.C.m")["callees"] and not any("hidden" in n for n in names.values())


def test_git_listing(tmp_path):
    from tessella.sources.files import tracked_files

    assert tracked_files(str(tmp_path)) is None
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert tracked_files(str(tmp_path)) is None  # nothing tracked
    (tmp_path / "a.py").write_text("x = 1\n")
    subprocess.run(["git", "-C", str(tmp_path), "add", "a.py"], check=True)
    assert tracked_files(str(tmp_path)) == ["a.py"]


def test_states_of_files_and_of_frames_are_picked_alike(spark, rows, tmp_path):
    from pyspark.sql import functions as F

    from tessella.operators import code

    schema = "repo_id string, path string, state string, bytes binary, mtime_ns long, size_bytes long, _at string"
    data = [("r", f"p{i % 40}", ("present", "absent", "unreadable")[i * 7 % 3], b"%d" % (i % 9), (None, i * 13 % 5)[i % 4 > 0], i % 9, "x") for i in range(300)]
    data += [("r", "only", "present", b"1", 1, 1, "x"), (None, "only", "present", b"2", None, None, "x"), ("r", None, "present", b"3", 1, 1, "x")] * 2
    frame = rows(schema, *data)
    frame.repartition(3).write.parquet(str(tmp_path / "s"))
    key = ["repo_id", "path", "state", "mtime_ns", "size_bytes"]
    for pick in (code.current_states, lambda s: code.current_states(s, True), code.first_states):
        a, b = (sorted(map(repr, pick(s).select(*key, "bytes").collect())) for s in (frame, spark.read.parquet(str(tmp_path / "s"))))
        assert a == b and len(a) == 42
    assert pick(spark.read.parquet(str(tmp_path / "s")).filter("false")).count() == 0
    assert code.current_states(spark.read.parquet(str(tmp_path / "s")).select("path", "repo_id", "state", "mtime_ns", F.lit(1).alias("n"))).count() == 42
