"""Flat, linked tables from deeply nested JSON records, by Dewey labelling.

Every node of a record, wherever it lies, gets an ordinal path label such as ``0.2.1``: the label of
the value that holds it plus its own ordinal.  Cutting components off a label gives the labels of what
encloses the node, so parent links need no join.  Nodes are grouped into tables by their schema path
(the fields on the way down); a row carries its own label, its parent's label, the names of the named
objects around it, and its other fields as ``attributes``.  Objects in fields are nodes of their own, so
nothing of a record is lost.

The walk of one record touches that record alone, so the operator is a single narrow stage over
the scan: no shuffle but the removal of repeated rows, and nothing grows with the corpus.

Defined results: a null, blank or incomplete payload gives no rows; so do payloads that are JSON
but hold no object.  Records may lie in any number of wrappers, and payloads may be nested to any depth:
the walk and, beyond the parser's own depth, the parser keep a stack of their own.  Objects without a (non-blank, textual) name give no row; what lies inside
them hangs from the nearest named ancestor.  A field may hold a list of objects or names, one
object, one name, or a mapping of names to objects; ``null`` and other scalars count as absent.
Records inside wrappers (objects or JSON strings) are found wherever they begin.  Repeated input
rows give one set of rows.  Columns other than the two named ones are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.plans.ship import ship

# The container fields, by their name without case and joining signs, and the kind
# of node each holds.
CONTAINERS = {"mcpservers": "mcp_server", "plugins": "plugin", "tools": "tool", "agents": "agent"}
# Kinds that name an enclosing object.
ENCLOSING = ("mcp_server", "plugin", "agent")
# Kinds that become tables.
TABLES = ("mcp_server", "plugin", "tool")
NODE_SCHEMA = (
    "record_id long, child string, parent string, name string, label string, parent_label string,"
    " parent_child string, schema_path string, attributes string, node_label string"
)
_ARROW = pa.schema(
    [("record_id", pa.int64())]
    + [(c, pa.string()) for c in ("child", "parent", "name", "label", "parent_label", "parent_child", "schema_path", "attributes", "node_label")]
)


def _field(key: str) -> str | None:
    return CONTAINERS.get("".join(c for c in key.lower() if c.isalnum()))


def read_json(text: str):
    """The value of a JSON text; ValueError if it is not whole."""
    try:
        return json.loads(text)
    except RecursionError:
        return _read_deep(text)


def _read_deep(text: str):
    """As ``json.loads``, with a stack of its own in place of recursion."""
    space, number = json.decoder.WHITESPACE, json.scanner.NUMBER_RE
    words = {"t": ("true", True), "f": ("false", False), "n": ("null", None), "N": ("NaN", math.nan), "I": ("Infinity", math.inf)}
    stack: list = []  # open containers; of an object also the key that waits for its value
    at, size = space.match(text, 0).end(), len(text)
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            held = {} if c == "{" else []
            at = space.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                value, at = held, at + 1
            else:
                if c == "{":
                    key, at = _key(text, at)
                    stack.append((held, key))
                else:
                    stack.append((held, None))
                continue
        elif c == '"':
            value, at = json.decoder.scanstring(text, at + 1, True)
        elif c in words and text.startswith(words[c][0], at):
            value, at = words[c][1], at + len(words[c][0])
        elif text.startswith("-Infinity", at):
            value, at = -math.inf, at + 9
        elif m := number.match(text, at):
            whole, fraction, power = m.groups()
            value, at = (float(m.group()) if fraction or power else int(whole)), m.end()
        else:
            raise ValueError(f"no value at {at}")
        while True:  # the value is whole: hand it to what holds it
            at = space.match(text, at).end()
            if not stack:
                if at < size:
                    raise ValueError(f"more after the value at {at}")
                return value
            held, key = stack[-1]
            if isinstance(held, dict):
                held[key] = value
            else:
                held.append(value)
            c = text[at : at + 1]
            if c == ",":
                at = space.match(text, at + 1).end()
                if isinstance(held, dict):
                    key, at = _key(text, at)
                    stack[-1] = (held, key)
                break
            if c != ("}" if isinstance(held, dict) else "]"):
                raise ValueError(f"no end or comma at {at}")
            stack.pop()
            value, at = held, at + 1


def _key(text: str, at: int) -> tuple[str, int]:
    space = json.decoder.WHITESPACE
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = json.decoder.scanstring(text, at + 1, True)
    at = space.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return key, space.match(text, at + 1).end()


def _name(value) -> str | None:
    return value if isinstance(value, str) and value.strip() else None


#: What a value stands for: any value, the value of a container field, an element of one, an object of a kind.
_ANY, _HELD, _ELEMENT, _OBJECT = range(4)


def dewey_nodes(payload: str | None) -> list[tuple]:
    """All nodes of a payload, parents first: (label, kind or None, name, schema path, attributes as JSON)."""
    if payload is None:
        return []
    try:
        value = read_json(payload)
    except ValueError:
        return []
    out: list[tuple] = []
    work: list[tuple] = [(value, "0", "", _ANY, None, None, False)]
    while work:
        value, label, path, means, kind, name, inside = work.pop()
        below: list[tuple] = []
        if means == _ELEMENT:
            if isinstance(value, dict):
                means, name = _OBJECT, _name(value.get("name"))
            else:
                means = _HELD
        if means == _HELD:
            if isinstance(value, str):
                out.append((label, kind, _name(value), path, None))
            elif isinstance(value, list):
                below = [(v, f"{label}.{i}", path, _ELEMENT, kind, None, inside) for i, v in enumerate(value)]
            elif isinstance(value, dict):
                if "name" in value and not isinstance(value["name"], (dict, list)):
                    means, name = _OBJECT, _name(value["name"])
                else:  # a mapping of names to objects; a group of tools is no parent
                    for i, (k, v) in enumerate(value.items()):
                        mine = f"{label}.{i}"
                        if isinstance(v, dict):
                            below.append((v, mine, path, _OBJECT, kind, _name(v.get("name")) or _name(k), inside))
                        elif kind == "tool":
                            if isinstance(v, list):
                                below.append((v, mine, path, _HELD, kind, None, inside))
                        else:
                            out.append((mine, kind, _name(k), path, None if v is None else json.dumps({"value": v}, ensure_ascii=False) if not isinstance(v, list) else None))
                            if isinstance(v, list):
                                below.append((v, mine, path, _ANY, None, None, inside))
        if means == _ANY and isinstance(value, str) and not inside:  # a wrapper may be a JSON string
            if value.lstrip()[:1] in ("{", "["):
                try:
                    work.append((read_json(value), label, path, _ANY, None, None, False))
                except ValueError:
                    pass
            continue
        if means == _ANY and isinstance(value, list):
            below = [(v, f"{label}.{i}", path, _ANY, None, None, inside) for i, v in enumerate(value)]
        elif means in (_ANY, _OBJECT) and isinstance(value, dict):
            inside = inside or any(_field(k) for k in value)
            flat = {}
            for i, (k, v) in enumerate(value.items()):
                mine, field = f"{label}.{i}", _field(k)
                if field:
                    below.append((v, mine, f"{path}/{field}", _HELD, field, None, inside))
                elif isinstance(v, dict) or (isinstance(v, list) and any(isinstance(x, (dict, list)) for x in v)) or (isinstance(v, str) and not inside):
                    below.append((v, mine, f"{path}/{k}", _ANY, None, None, inside))
                if not field and not isinstance(v, dict) and k != "name":
                    scalars = [x for x in v if not isinstance(x, (dict, list))] if isinstance(v, list) else v
                    if scalars is not None and scalars != []:
                        flat[k] = scalars
            out.append((label, kind if means == _OBJECT else None, name, path, json.dumps(flat, sort_keys=True, ensure_ascii=False) if flat else None))
        work.extend(reversed(below))
    return out


def linked_nodes(payload: str | None) -> Iterator[tuple]:
    """(kind, parent names, name, label, parent label, parent kind, schema path, attributes, label of the node around).

    Parents come from truncating labels: the nearest label that is a node's is the node around, and
    what that passes on is the nearest named server, plugin or agent.
    """
    seen: dict[str, tuple[str | None, str | None, str]] = {}
    for label, kind, name, path, attributes in dewey_nodes(payload):
        up = label.rpartition(".")[0]
        while up and up not in seen:
            up = up.rpartition(".")[0]
        parent_label, parent_kind, names = seen[up] if up else (None, None, "")
        enclosing = kind in ENCLOSING and name is not None
        seen[label] = (label, kind, f"{names}/{name}" if names else name) if enclosing else (parent_label, parent_kind, names)
        yield kind, names, name, label, parent_label, parent_kind, path, attributes, up or None


def record_nodes(records: DataFrame, id_col: str = "record_id", payload_col: str = "payload", every: bool = True) -> DataFrame:
    """A row per node of every input row (see NODE_SCHEMA), or only per named server, plugin and tool.

    Narrow: repeated input rows give repeated rows here, which the callers' ``distinct`` removes
    after the payloads have been left behind.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (rid, *row)
                for rid, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                for row in linked_nodes(payload)
                if every or (row[0] in TABLES and row[2] is not None)
            ]
            cols = list(zip(*rows)) if rows else [[] for _ in _ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

    ship(records.sparkSession)
    given = records.select(F.col(id_col).cast("long").alias("record_id"), F.col(payload_col).cast("string").alias("payload"))
    return given.filter(F.col("payload").isNotNull()).mapInArrow(walk, NODE_SCHEMA)


def flatten_records(records: DataFrame, **cols: str) -> DataFrame:
    """A row per named server, plugin and tool of every input row."""
    return record_nodes(records, **cols, every=False)


def record_tables(records: DataFrame, **cols: str) -> dict[str, DataFrame]:
    """The flat tables by kind: distinct rows of servers, plugins and tools with their links."""
    nodes = flatten_records(records, **cols).drop("node_label")
    return {kind: nodes.filter(F.col("child") == kind).distinct() for kind in TABLES}


def path_table(nodes: DataFrame, schema_path: str) -> DataFrame:
    """One table of a corpus: the nodes of a schema path, with the label of the node around as foreign key."""
    return nodes.filter(F.col("schema_path") == schema_path).select("record_id", F.col("label").alias("node"), F.col("node_label").alias("holder"), "name", "attributes").distinct()


def path_summary(nodes: DataFrame) -> DataFrame:
    """(schema_path, n_nodes, n_records): the tables that the nodes make up."""
    once = nodes.select("record_id", "schema_path", "label").distinct()
    return once.groupBy("schema_path").agg(F.count("*").alias("n_nodes"), F.count_distinct("record_id").alias("n_records"))
