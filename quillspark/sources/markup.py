"""Markup as a node table: one row for each element, numbered so that subtrees are intervals.

Columns beside the keys: ``pre`` (place of the element's start, from 0), ``last`` (greatest ``pre`` in its subtree), ``parent`` and
``ancestors`` (their ``pre``, the root's first), ``depth``, ``name``, ``ord`` (place among the siblings of its name), ``nth`` (place among all
elements of its name), ``path`` (``/name#ord`` of all ancestors and the element), ``attributes`` (name and value, in order, repeated
ones too), ``text`` (what stands directly in it), ``issues``.

Broken markup still gives a tree: an end tag closes the nearest open element of its name and leaves those within it
``unclosed``; one that has none is a ``stray_close`` of the element around it; what is open at the end is ``unclosed``. A null or empty
text has no nodes; text outside of elements is dropped; several elements may stand at the top.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|</(?P<close>[A-Za-z_][^\s<>/]*)[^<>]*>|<(?P<open>[A-Za-z_][^\s<>/]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Fixed values of HTML: elements without content, and those whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset({"script", "style"})

NODE = T.StructType(
    [
        *[T.StructField(c, T.IntegerType()) for c in ("pre", "last", "parent")],
        T.StructField("ancestors", T.ArrayType(T.IntegerType())),
        T.StructField("depth", T.IntegerType()),
        T.StructField("name", T.StringType()),
        *[T.StructField(c, T.IntegerType()) for c in ("ord", "nth")],
        T.StructField("path", T.StringType()),
        T.StructField("attributes", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))),
        T.StructField("text", T.StringType()),
        T.StructField("issues", T.ArrayType(T.StringType())),
    ]
)


def tokens(text: str, html: bool) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): ``open``, ``empty``, ``close`` and ``text``, in order."""
    at = 0
    while at < len(text):
        m = TOKEN.search(text, at)
        begin = m.start() if m else len(text)
        if begin > at:
            yield "text", text[at:begin], ""
        if not m:
            return
        at = m.end()
        if m["data"]:
            yield "text", m["data"], ""
        elif m["close"]:
            yield "close", m["close"].lower() if html else m["close"], ""
        elif m["open"]:
            name, rest = (m["open"].lower() if html else m["open"]), m["rest"]
            empty = rest.endswith("/") or (html and name in VOID)
            yield "empty" if empty else "open", name, rest
            if html and name in RAW and not empty:
                end = re.compile(f"</{name}(?=[\\s>/])", re.I).search(text, at)
                stop = end.start() if end else len(text)
                if stop > at:
                    yield "text", text[at:stop], ""
                at = stop


def nodes_of(text: str, html: bool = True) -> list[dict]:
    """The nodes of one text, by a stack over its tokens."""
    nodes: list[dict] = []
    stack: list[dict] = []
    top, seen = {"same": {}}, {}
    for kind, what, rest in tokens(text, html):
        if kind == "text":
            if stack:
                stack[-1]["text"].append(what)
        elif kind == "close":
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d]["name"] == what), None)
            if depth is None:
                if stack:
                    stack[-1]["issues"].append("stray_close")
                continue
            for node in stack[depth + 1 :]:
                node["issues"].append("unclosed")
            for node in stack[depth:]:
                node["last"] = len(nodes) - 1
            del stack[depth:]
        else:
            around = stack[-1] if stack else top
            place = around["same"].get(what, 0)
            around["same"][what] = place + 1
            parent = stack[-1] if stack else None
            node = {
                "pre": len(nodes), "last": len(nodes), "parent": parent and parent["pre"], "ancestors": [*parent["ancestors"], parent["pre"]] if parent else [], "depth": len(stack), "name": what, "ord": place,
                "nth": seen.get(what, 0), "path": f"{parent['path'] if parent else ''}/{what}#{place}", "attributes": [{"name": a.lower() if html else a, "value": next((v for v in vs if v), "")} for a, *vs in ATTRIBUTE.findall(rest)],
                "text": [], "issues": [], "same": {},
            }
            seen[what] = node["nth"] + 1
            nodes.append(node)
            if kind == "open":
                stack.append(node)
    for node in stack:
        node["last"] = len(nodes) - 1
        node["issues"].append("unclosed")
    return nodes


def node_table(df: DataFrame, keys: list[str], text: str, html: bool = True, columns: list[str] | None = None) -> DataFrame:
    """The nodes of the texts of all rows, with all columns or those named; rows are parsed one by one, each by the task that reads it."""
    fields = [df.schema[k] for k in keys]
    kept = [f for f in NODE if columns is None or f.name in columns]
    names = [f.name for f in kept]

    def run(batches):
        import pyarrow as pa

        kinds = None
        for batch in batches:
            for k, body in enumerate(batch.column(len(keys)).to_pylist()):
                nodes = nodes_of(body or "", html)
                if not nodes:
                    continue
                columns = [pa.array([n[c] if c != "text" else "".join(n[c]) for n in nodes]) for c in names]
                if kinds is None:
                    of = {"ancestors": pa.list_(pa.int32()), "attributes": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), "issues": pa.list_(pa.string()), **dict.fromkeys(("name", "path", "text"), pa.string())}
                    kinds = [of.get(c, pa.int32()) for c in names]
                own = [batch.column(c).take(pa.array([k] * len(nodes))) for c in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, *[c.cast(kind) if c.type != kind else c for c, kind in zip(columns, kinds)]], [*keys, *names])

    return df.select(*keys, text).mapInArrow(run, T.StructType([*fields, *kept]))
