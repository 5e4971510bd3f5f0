"""Shredding document texts into the node table: one row per value occurrence.

Rows are numbered in pre-order, `pre` to `subtree_end`, so descendants are an
interval.  Aliases are expanded into occurrences with their own paths, within a
budget of max(10,000, 100 x characters) nodes.  Spans are byte offsets.
"""

from __future__ import annotations

import json as _json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import TAGS, number_text, ordered, resolve
from ..functions.yaml import Node, YamlError, byte_offsets, parse, position

_NUM = T.StructType([T.StructField("sgn", T.IntegerType()), T.StructField("places", T.LongType()), T.StructField("digits", T.StringType())])
_NODE = [
    ("doc_ix", "int"), ("pre", "int"), ("subtree_end", "int"), ("parent", "int"), ("depth", "int"), ("ord", "int"), ("n_children", "int"),
    ("key", "string"), ("pointer", "string"), ("kind", "string"), ("style", "string"), ("tag", "string"), ("anchor", "string"), ("alias", "string"),
    ("text", "string"), ("bool_val", "boolean"), ("num", _NUM), ("is_int", "boolean"), ("canon", "string"), ("json", "string"),
    ("span_start", "int"), ("span_end", "int"), ("error", "string"), ("error_at", "int"), ("error_line", "int"), ("error_column", "int"),
]
_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
NODE_COLUMNS = [n for n, _ in _NODE]


def schema(key_type: T.DataType, columns: tuple[str, ...] | None = None) -> T.StructType:
    simple = {"int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField("doc_key", key_type), *(T.StructField(n, simple.get(t, t)) for n, t in _NODE if columns is None or n in columns)])


def quote(text: str) -> str:
    return _json.dumps(text, ensure_ascii=False)


class _Shredder:
    def __init__(self, text: str, whole: bool = True):
        self.text, self.rows, self.whole = text, [], whole
        self.budget = max(10_000, 100 * len(text))
        self.byte = byte_offsets(text)

    def document(self, ix: int, root: Node | None) -> None:
        """Rows of one document; raises if it does not fit the JSON model."""
        if root is None:
            self.rows.append(dict.fromkeys(NODE_COLUMNS) | {"doc_ix": ix, "pre": 0, "subtree_end": 0, "parent": -1, "depth": 0, "ord": 0, "n_children": 0, "pointer": "", "kind": "empty", "canon": "null", "json": "null", "span_start": 0, "span_end": 0})
            return
        self.ix, self.count, self.anchors = ix, 0, {}
        self.mark(root)
        self.visit(root, -1, 0, 0, None, "", {}, None)

    def mark(self, root: Node) -> None:
        todo = [root]
        while todo:
            n = todo.pop()
            if n.anchor:
                self.anchors.setdefault(n.anchor, []).append(n)
            todo += n.items if n.kind == "seq" else [x for kv in n.items for x in kv]
        for v in self.anchors.values():
            v.sort(key=lambda n: n.start)

    def target(self, n: Node) -> Node:
        found = None
        for a in self.anchors.get(n.value, ()):
            if a.start <= n.start:
                found = a
        if found is None:
            raise YamlError(f"unknown anchor {n.value}", n.start)
        return found

    def visit(self, n: Node, parent: int, depth: int, place: int, key: str | None, pointer: str, above: dict, alias: str | None) -> dict:
        while n.kind == "alias":
            alias, n = n.value, self.target(n)
        if id(n) in above:
            raise YamlError("recursive alias", n.start)
        self.count += 1
        if self.count > self.budget:
            raise YamlError("too many alias occurrences", n.start)
        row = dict.fromkeys(NODE_COLUMNS) | {"doc_ix": self.ix, "pre": self.count - 1, "parent": parent, "depth": depth, "ord": place, "n_children": len(n.items), "key": key, "pointer": pointer, "style": n.style, "tag": n.tag, "anchor": n.anchor, "alias": alias, "span_start": self.byte(n.start), "span_end": self.byte(n.end)}
        self.rows.append(row)
        pre = self.count - 1
        if n.kind == "scalar":
            try:
                kind, v = resolve(n.value, n.style == "plain", n.tag)
            except ValueError as e:
                raise YamlError(str(e), n.start) from None
            row |= {"kind": kind, "text": n.value}
            if kind == "nonfinite":
                raise YamlError("number is not finite", n.start)
            if kind == "num":
                sgn, places, digits, is_int = v
                key3 = ordered(sgn, places, digits)
                row |= {"num": dict(zip(("sgn", "places", "digits"), key3)), "is_int": is_int}
                row["json"] = number_text(*v) if is_int else n.value.replace("_", "").lstrip("+") if n.value[:1].isdigit() or n.value[:1] == "-" else number_text(*v)
                row["canon"] = "0" if not sgn else f"{'-' if sgn < 0 else ''}{digits}e{places - len(digits)}"
            else:
                row["bool_val"] = v if kind == "bool" else None
                row["json"] = row["canon"] = "null" if kind == "null" else str(v).lower() if kind == "bool" else quote(n.value)
        else:
            if n.tag and TAGS.get(n.tag) != n.kind:
                raise YamlError(f"unsupported tag {n.tag}", n.start)
            row["kind"] = n.kind
            inside = above | {id(n): True}
            if n.kind == "seq":
                kids = [self.visit(x, pre, depth + 1, k, None, f"{pointer}/{k}", inside, None) for k, x in enumerate(n.items)]
                if self.whole:
                    row["json"], row["canon"] = ("[" + ",".join(c[f] for c in kids) + "]" for f in ("json", "canon"))
            else:
                seen, kids = set(), []
                for k, (name, x) in enumerate(n.items):
                    while name.kind == "alias":
                        name = self.target(name)
                    got = resolve(name.value, name.style == "plain", name.tag) if name.kind == "scalar" else ("", None)
                    if got[0] != "str":
                        raise YamlError("a key is not a string", name.start)
                    if name.value in seen:
                        raise YamlError(f"duplicate key {name.value!r}", name.start)
                    seen.add(name.value)
                    step = name.value.replace("~", "~0").replace("/", "~1")
                    kids.append((name.value, self.visit(x, pre, depth + 1, k, name.value, f"{pointer}/{step}", inside, None)))
                if not self.whole:
                    row["subtree_end"] = self.count - 1
                    return row
                row["json"] = "{" + ",".join(f"{quote(k)}:{c['json']}" for k, c in kids) + "}"
                row["canon"] = "{" + ",".join(f"{quote(k)}:{c['canon']}" for k, c in sorted(kids, key=lambda kc: kc[0])) + "}"
        row["subtree_end"] = self.count - 1
        return row


def shred_text(text: str | None, whole: bool = True) -> list[dict]:
    """Node rows of a stream, or one row that holds the error."""
    text = text or ""
    try:
        s = _Shredder(text, whole)
        for ix, root in enumerate(parse(text)):
            s.document(ix, root)
        return s.rows
    except (YamlError, RecursionError) as e:
        at = getattr(e, "at", 0)
        line, column = position(text, at)
        return [dict.fromkeys(NODE_COLUMNS) | {"error": str(e) or "nested too deeply", "error_line": line, "error_column": column, "error_at": len(text[:at].encode("utf-8", "surrogatepass"))}]


def shred(texts: DataFrame, key: str, text: str, mode: str = "FAILFAST", columns: tuple[str, ...] | None = None) -> DataFrame:
    """Node table of the documents in column `text`.

    FAILFAST raises on the first text that does not parse or fit the JSON model;
    PERMISSIVE keeps a row with `error` and `error_at` in its place; DROPMALFORMED
    leaves the text out.  No shuffle: every text is shredded where it is read.
    `columns` names the columns to make; without json and canon the text of inner
    values is not built.
    """
    out = schema(texts.schema[key].dataType, columns)
    made = [(n, t) for n, t in _NODE if columns is None or n in columns]
    whole = columns is None or bool({"json", "canon"} & set(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, at, rows = batch.slice(lo, 500), [], []
                for i, t in enumerate(part.column(1)):
                    got = shred_text(t.as_py(), whole)
                    if got and got[0]["error"] is not None:
                        if mode == "FAILFAST":
                            raise ValueError(f"document {part.column(0)[i]}: {got[0]['error']} at byte {got[0]['error_at']}")
                        if mode == "DROPMALFORMED":
                            continue
                    rows += got
                    at += [i] * len(got)
                num = pa.struct([("sgn", pa.int32()), ("places", pa.int64()), ("digits", pa.string())])
                cols = [pa.array([r[n] for r in rows], _ARROW.get(t, num)) for n, t in made]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *cols], ["doc_key", *(n for n, _ in made)])

    return texts.select(F.col(key).alias("doc_key"), F.col(text).alias("_text")).mapInArrow(run, out)


def errors(nodes: DataFrame) -> DataFrame:
    return nodes.where("error is not null").select("doc_key", "error", "error_at", "error_line", "error_column")
