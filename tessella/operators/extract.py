"""Symbols and reference edges from source files, and the names the edges resolve to.

Extraction is the one stage that needs a parser: a narrow pass per file in Python.  Files that do
not parse are taken statement by statement (``recover``): indentation delimits definitions, each
statement is parsed on its own, and one that does not parse gives its references by tokens.
Resolution is joins only, one per strategy, tried in order of confidence.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tessella.operators import recover
from tessella.operators.code import current_states
from tessella.plans.scratch import Scratch

_ROW = (
    "part string, repo_id string, path string, ord int, kind string, name string, qualname string, parent_qualname string, module string, owner_class string,"
    " line_start int, line_end int, byte_start int, byte_end int, body_byte_start int, content_hash string, docstring string, signature string, dst_name string, local_name string"
)
# How much each way of resolving a name is trusted.
CONFIDENCE = {"exact": 1.0, "self": 0.95, "module_local": 0.90, "self_inherited": 0.85, "import_alias": 0.85, "class_attr": 0.85, "unique": 0.75}


def module_name(path: str) -> str:
    parts = [p for p in re.sub(r"\.py$", "", path.replace("\\", "/")).split("/") if p not in ("", ".")]
    return ".".join(parts[:-1] if len(parts) > 1 and parts[-1] == "__init__" else parts)


class _File:
    """One file's rows, collected by an explicit stack so that deep nesting needs no recursion."""

    def __init__(self, path: str, data: bytes):
        self.data, self.module = data, module_name(path)
        self.starts = [0]
        for m in re.finditer(b"\n", data):
            self.starts.append(m.end())
        self.rows: list[dict] = []
        self.text = data.decode("utf-8", "replace")

    def at(self, line: int, col: int) -> int:
        return min(len(self.data), self.starts[min(line, len(self.starts)) - 1] + col)

    def symbol(self, kind, name, qualname, parent, owner, lines, span, doc=None, signature=None, body=None):
        self.rows.append(
            {"part": "symbol", "kind": kind, "name": name, "qualname": qualname, "parent_qualname": parent, "module": self.module, "owner_class": owner, "line_start": lines[0], "line_end": lines[1]}
            | {"byte_start": span[0], "byte_end": span[1], "content_hash": hashlib.sha256(self.data[span[0] : span[1]]).hexdigest(), "docstring": doc, "signature": signature, "body_byte_start": span[0] if body is None else body}
        )

    def edge(self, scope, kind, dst, line, local=None):
        self.rows.append({"part": "edge", "kind": kind, "qualname": scope[0], "module": self.module, "owner_class": scope[2], "line_start": line, "dst_name": dst, "local_name": local})

    def extract(self) -> list[dict]:
        n_lines = max(1, len(self.starts) - (self.data.endswith(b"\n") and len(self.starts) > 1))
        try:
            tree = ast.parse(self.data)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            self._by_statement(n_lines)
            return self.rows
        self.symbol("module", self.module.rpartition(".")[2], self.module, None, None, (1, n_lines), (0, len(self.data)), _doc(tree))
        work = [(child, (self.module, "module", None)) for child in reversed(list(ast.iter_child_nodes(tree)))]
        while work:
            node, scope = work.pop()
            inner = scope
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = self._definition(node, scope)
                outer = [(d, scope) for d in node.decorator_list]  # decorators run outside
                rest = [(c, inner) for c in ast.iter_child_nodes(node) if c not in node.decorator_list]
                work.extend(reversed(outer + rest))
                continue
            self._reference(node, scope)
            work.extend((c, scope) for c in reversed(list(ast.iter_child_nodes(node))))
        return self.rows

    def _reference(self, node, scope) -> None:
        if isinstance(node, ast.Call):
            self.edge(scope, "calls", self._source(node.func), node.lineno)
        elif isinstance(node, ast.Import):
            for a in node.names:
                self.edge(scope, "imports", a.name, node.lineno, a.asname or a.name.split(".")[0])
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            for a in node.names:
                if a.name != "*":
                    self.edge(scope, "imports", f"{base}.{a.name}" if base else a.name, node.lineno, a.asname or a.name)

    def _source(self, node) -> str:
        return self.data[self.at(node.lineno, node.col_offset) : self.at(node.end_lineno, node.end_col_offset)].decode("utf-8", "replace")

    def _signature(self, node) -> str:
        """Name, parameters and result as they are written, with blanks squeezed and comments left out."""
        start = self.at(node.lineno, node.col_offset)
        first = node.body[0]
        decorators = getattr(first, "decorator_list", None)
        stop = self.at(decorators[0].lineno, decorators[0].col_offset) if decorators else self.at(first.lineno, first.col_offset)
        return recover.written_signature(self.data[start:stop].decode("utf-8", "replace"))

    def _definition(self, node, scope):
        qualname = f"{scope[0]}.{node.name}"
        is_class = isinstance(node, ast.ClassDef)
        kind = "class" if is_class else "method" if scope[1] == "class" else "function"
        line, start = node.lineno, self.at(node.lineno, node.col_offset)
        if node.decorator_list:  # the span begins at the first @
            first = node.decorator_list[0]
            start = self.data.rfind(b"@", 0, self.at(first.lineno, first.col_offset))
            line = self.data.count(b"\n", 0, start) + 1
        signature = None
        if not is_class:
            signature = self._signature(node)
        self.symbol(kind, node.name, qualname, scope[0], scope[0] if scope[1] == "class" else scope[2], (line, node.end_lineno), (start, self.at(node.end_lineno, node.end_col_offset)), _doc(node), signature, self.at(node.lineno, node.col_offset))
        if is_class:
            for b in node.bases:
                self.edge((qualname, "class", None), "inherits", self._source(b), b.lineno)
        # the class that encloses what is inside: this one, or the one around
        return (qualname, kind, qualname if is_class else (scope[0] if scope[1] == "class" else scope[2]))

    def _by_statement(self, n_lines: int) -> None:
        """The rows of a file that does not parse."""
        module = (self.module, "module", None)
        self.symbol("module", self.module.rpartition(".")[2], self.module, None, None, (1, n_lines), (0, len(self.data)))
        scopes: list[tuple[int, tuple, dict]] = [(-1, module, self.rows[0])]
        first = self.rows[0]  # the row whose first statement comes next
        decorators: tuple[int, int] | None = None
        for st in recover.statements(self.data):
            while len(scopes) > 1 and st.indent <= scopes[-1][0]:
                self._close(scopes.pop()[2])
            if first is not None and (len(scopes) == 1 or first is scopes[-1][2]):
                first["docstring"] = st.docstring()
            first = None
            scope = scopes[-1][1]
            head = st.head()
            if head is None:
                self._references_of(st, scope)
                for _, _, row in scopes[1:]:
                    row["line_end"], row["byte_end"] = st.last_line, st.code_end
                if not st.is_decorator:
                    decorators = None
                elif decorators is None:
                    decorators = (st.line, st.start)
                continue
            is_class, name = head
            kind = "class" if is_class else "method" if scope[1] == "class" else "function"
            qualname = f"{scope[0]}.{name}"
            owner = scope[0] if scope[1] == "class" else scope[2]
            line, start = decorators or (st.line, st.start)
            decorators = None
            self.symbol(kind, name, qualname, scope[0], owner, (line, st.last_line), (start, st.code_end), st.inline_docstring(), None if is_class else st.signature(name), st.start)
            for _, _, row in scopes[1:]:
                row["line_end"], row["byte_end"] = st.last_line, st.code_end
            inner = (qualname, kind, qualname if is_class else owner)
            first = None if st.has_inline_body() else self.rows[-1]
            scopes.append((st.indent, inner, self.rows[-1]))
            if is_class:
                for at, base in st.bases():
                    self.edge((qualname, "class", None), "inherits", base, at)
            self._references_of(st, inner)
        for _, _, row in scopes[1:]:
            self._close(row)

    def _close(self, row: dict) -> None:
        row["content_hash"] = hashlib.sha256(self.data[row["byte_start"] : row["byte_end"]]).hexdigest()

    def _references_of(self, st: recover.Statement, scope) -> None:
        for tree in st.trees():
            work = [tree]
            while work:
                node = work.pop()
                self._reference(node, scope)
                work.extend(reversed(list(ast.iter_child_nodes(node))))
        for kind, dst, line, local in st.token_references():
            self.edge(scope, kind, dst, line, local)


def _doc(node) -> str | None:
    return ast.get_docstring(node, clean=False)


def extract_graph(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) of the files that are present now; first definitions only, edges numbered per repository order."""

    schema = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in (f.split(" ") for f in _ROW.replace(", ", ",").split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                repo, path, data = (b.column(j)[i].as_py() for j in range(3))
                rows = [r | {"repo_id": repo, "path": path, "ord": n} for n, r in enumerate(_File(path, data).extract())]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

    files = current_states(snapshots).filter("state = 'present' AND bytes IS NOT NULL").select("repo_id", "path", "bytes")
    rows = Scratch(snapshots.sparkSession).cut(files.mapInArrow(run, _ROW))
    first = W.partitionBy("repo_id", "qualname").orderBy("path", "ord")
    symbols = rows.filter("part = 'symbol'").withColumn("n", F.row_number().over(first)).filter("n = 1").drop("part", "ord", "n", "dst_name", "local_name")
    edges = rows.filter("part = 'edge'").select("repo_id", "path", "ord", F.col("qualname").alias("src"), "module", "owner_class", "kind", "dst_name", "local_name", F.col("line_start").alias("line"))
    return symbols, edges


def resolve(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``dst`` (qualname), ``resolver``, ``confidence`` and ``tier`` to edges; unresolved ones stay, at tier 0."""
    key = ["repo_id", "path", "ord"]
    known = symbols.select("repo_id", F.col("qualname").alias("q"), F.col("kind").alias("k"))
    imports = edges.filter("kind = 'imports' AND local_name IS NOT NULL")
    alias = imports.groupBy("repo_id", "module", F.col("local_name").alias("local")).agg(F.max_by("dst_name", F.struct("path", "ord")).alias("target"))
    by_name = symbols.groupBy("repo_id", F.col("name").alias("base")).agg(F.count("*").alias("n"), F.first("qualname").alias("q"), F.first("kind").alias("k"), F.first("parent_qualname").alias("p"))
    one_class = symbols.filter("kind = 'class'").groupBy("repo_id", F.col("name").alias("base")).agg(F.count("*").alias("n"), F.first("qualname").alias("class_q")).filter("n = 1").drop("n")

    def find(df: DataFrame, want, name: str) -> DataFrame:
        hit = known.select("repo_id", F.col("q").alias(f"_{name}"), F.col("q").alias(name))
        return df.withColumn(f"_{name}", want).join(hit, ["repo_id", f"_{name}"], "left").drop(f"_{name}")

    head, tail = F.substring_index("dst_name", ".", 1), F.expr("substr(dst_name, length(substring_index(dst_name, '.', 1)) + 2)")
    e = edges.withColumn("head", head).withColumn("tail", tail)
    e = e.join(alias.withColumnRenamed("local", "head"), ["repo_id", "module", "head"], "left")
    dotted = F.col("tail") != ""

    # bases as class qualnames, then up to three levels of inheritance; paths keep depth-first order
    b = e.filter("kind = 'inherits'").select("repo_id", F.col("src").alias("cls"), "module", "dst_name", "ord", "target", "tail")
    b = find(b, F.col("dst_name"), "b1")
    b = find(b, F.concat_ws(".", "module", "dst_name"), "b2")
    b = find(b, F.when(F.col("target").isNotNull(), F.when(F.col("tail") != "", F.concat_ws(".", "target", "tail")).otherwise(F.col("target"))), "b3")
    b = b.withColumn("base", F.substring_index("dst_name", ".", -1)).join(one_class, ["repo_id", "base"], "left")
    bases = b.select("repo_id", "cls", F.col("ord").alias("o"), F.coalesce("b1", "b2", "b3", "class_q").alias("up")).filter("up IS NOT NULL")
    line = bases.select("repo_id", "cls", "up", F.array("o").alias("way"))
    levels = line
    for _ in range(2):
        step = bases.select("repo_id", F.col("cls").alias("up"), F.col("o").alias("o2"), F.col("up").alias("up2"))
        line = line.join(step, ["repo_id", "up"]).select("repo_id", "cls", F.col("up2").alias("up"), F.array_append("way", F.col("o2")).alias("way"))
        levels = levels.unionByName(line)

    attr = F.when(F.col("head").isin("self", "cls") & dotted & ~F.contains("tail", F.lit(".")), F.col("tail"))
    e = find(e, F.col("dst_name"), "exact")
    e = find(e, F.concat_ws(".", F.col("owner_class"), attr), "self").withColumn("self", F.when(attr.isNotNull() & F.col("owner_class").isNotNull(), F.col("self")))
    asked = e.filter(attr.isNotNull() & F.col("owner_class").isNotNull() & F.col("self").isNull()).select(*key, F.col("owner_class").alias("cls"), attr.alias("attr"))
    up = asked.join(levels, ["repo_id", "cls"]).withColumn("q", F.concat_ws(".", "up", "attr")).join(known.drop("k"), ["repo_id", "q"])
    inherited = up.groupBy(*key).agg(F.min_by("q", "way").alias("self_inherited"))
    e = e.join(inherited, key, "left")
    e = find(e, F.when(~dotted, F.concat_ws(".", "module", "dst_name")), "module_local")
    e = find(e, F.when(dotted, F.concat_ws(".", "target", "tail")).otherwise(F.col("target")), "import_alias").withColumn("import_alias", F.when(F.col("target").isNotNull(), F.col("import_alias")))
    e = find(e, F.when(dotted & ~F.col("head").isin("self", "cls"), F.concat_ws(".", "module", "dst_name")), "class_attr")
    e = e.join(by_name.withColumnRenamed("base", "head"), ["repo_id", "head"], "left")
    lone = F.when(~dotted & (F.col("n") == 1) & ((F.col("k") != "method") | F.col("p").eqNullSafe(F.col("owner_class"))), F.col("q"))
    e = e.withColumn("unique", lone)
    order = ["exact", "self", "self_inherited", "module_local", "import_alias", "class_attr", "unique"]
    resolver, confidence = F.lit(None).cast("string"), F.lit(None).cast("double")
    for r in reversed(order):
        resolver = F.when(F.col(r).isNotNull(), r).otherwise(resolver)
        confidence = F.when(F.col(r).isNotNull(), CONFIDENCE[r]).otherwise(confidence)
    dst = F.coalesce(*order)
    return e.select(*key, "src", "kind", "dst_name", "line", dst.alias("dst"), resolver.alias("resolver"), confidence.alias("confidence"), F.when(dst.isNull(), 0).otherwise(1).alias("tier"))


def resolution_rates(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per repository: edges, resolved, external (no symbol has the name) and ambiguous ones, and two rates."""
    names = symbols.select("repo_id", F.col("name").alias("base")).distinct().withColumn("inside", F.lit(True))
    r = resolved.withColumn("base", F.substring_index("dst_name", ".", -1)).join(names, ["repo_id", "base"], "left")
    done = F.col("dst").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    g = r.groupBy("repo_id").agg(F.count("*").alias("edges"), n(done).alias("resolved"), n(~done & F.col("inside").isNull()).alias("external"), n(~done & F.col("inside").isNotNull()).alias("ambiguous"))
    rate = lambda d: F.round(F.coalesce(F.try_divide("resolved", d), F.lit(0.0)), 6)
    return g.select("*", rate(F.col("edges")).alias("rate"), rate(F.col("resolved") + F.col("ambiguous")).alias("rate_of_internal"))
