"""Lexical tables of texts: events, tokens and directives.

Each table is made where a text is read, without a shuffle; spans are byte
offsets.  The modes are those of `shred`: FAILFAST raises, PERMISSIVE leaves one
row with `error`, DROPMALFORMED leaves no row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.yaml import Node, YamlError, byte_offsets, framed

EVENTS = "doc_ix int, ord int, event string, kind string, style string, tag string, anchor string, value string, span_start int, span_end int"
TOKENS = "ord int, kind string, text string, span_start int, span_end int"
DIRECTIVES = "doc_ix int, ord int, name string, params array<string>, span_start int, span_end int"

_MARKS = {"plain": ":", "single": "'", "double": '"', "literal": "|", "folded": ">"}
_ESCAPED = str.maketrans({"\\": "\\\\", "\n": "\\n", "\t": "\\t", "\r": "\\r", "\b": "\\b"})


def event_rows(text: str) -> list[tuple]:
    """Rows of EVENTS; kind is the start, end or leaf that the event is about."""
    docs, frames = framed(text)
    byte, out = byte_offsets(text), []

    def put(ix, event, kind, n: Node | None = None, value=None, at=None):
        at = at or ((n.start, n.end) if n else (0, 0))
        out.append((ix, len(out), event, kind, n.style if n else None, n.tag if n else None, n.anchor if n else None, value, byte(at[0]), byte(at[1])))

    put(None, "+STR", "stream")
    for ix, (root, frame) in enumerate(zip(docs, frames)):
        put(ix, "+DOC", "document", value="---" if frame["explicit"] else None)
        todo: list[tuple[str, Node]] = [("", root)] if root else []
        while todo:
            do, n = todo.pop()
            if do:
                put(ix, do, n.kind, None, at=(n.end, n.end))
            elif n.kind == "scalar":
                put(ix, "=VAL", "scalar", n, n.value)
            elif n.kind == "alias":
                put(ix, "=ALI", "alias", n, n.value)
            else:
                put(ix, "+MAP" if n.kind == "map" else "+SEQ", n.kind, n)
                todo.append(("-MAP" if n.kind == "map" else "-SEQ", n))
                todo += [("", x) for x in reversed(n.items if n.kind == "seq" else [x for kv in n.items for x in kv])]
        if not root:
            put(ix, "=VAL", "scalar", Node("scalar", "plain", 0, 0), "")
        put(ix, "-DOC", "document", value="..." if frame["ended"] else None)
    put(None, "-STR", "stream")
    return out


def event_line(row: tuple) -> str:
    """One event in the notation of the public YAML test suite."""
    _, _, event, _, style, tag, anchor, value, _, _ = row
    parts = [event]
    if event in ("+DOC", "-DOC") and value:
        parts.append(value)
    if style == "flow":
        parts.append("{}" if event == "+MAP" else "[]")
    if anchor and event != "=ALI":
        parts.append(f"&{anchor}")
    if tag:
        parts.append(f"<{tag}>")
    if event == "=VAL":
        parts.append(_MARKS[style] + value.translate(_ESCAPED))
    if event == "=ALI":
        parts.append(f"*{value}")
    return " ".join(parts)


def event_text(text: str) -> str:
    return "".join(event_line(r) + "\n" for r in event_rows(text))


_GAP = re.compile(r"(?P<bom>﻿)|(?P<newline>\r\n?|\n)|(?P<space>[ \t]+)|(?P<comment>#[^\r\n]*)|(?P<indicator>[-?:,\[\]{}])|(?P<other>.)", re.S)
_PROPERTY = {True: re.compile(r"[&!][^\s,\[\]{}]*"), False: re.compile(r"[&!]\S*")}


def token_rows(text: str) -> list[tuple]:
    """Rows of TOKENS: spans without gaps or overlaps, so their texts join to the source."""
    docs, frames = framed(text)
    leaves: list[tuple[int, int, str]] = []
    todo = [d for d in docs if d]
    while todo:
        n = todo.pop()
        if n.kind in ("scalar", "alias"):
            start = n.start
            while start < n.end and text[start] in "&! \t\r\n" and n.kind == "scalar":  # a key's span begins with its properties
                start = m.end() if (m := _PROPERTY[False].match(text, start, n.end)) else start + 1
            if start < n.end:
                leaves.append((start, n.end, n.kind if n.kind == "alias" else n.style))
        else:
            todo += n.items if n.kind == "seq" else [x for kv in n.items for x in kv]
    leaves += [(a, b, "directive") for f in frames for _, _, a, b in f["directives"]]
    leaves.sort()
    byte, out, at, flow = byte_offsets(text), [], 0, 0

    def put(kind: str, a: int, b: int) -> None:
        out.append((len(out), kind, text[a:b], byte(a), byte(b)))

    for a, b, kind in [*leaves, (len(text), len(text), "")]:
        while at < a:
            if text[at] in "&!" and (m := _PROPERTY[flow > 0].match(text, at, a)):
                put("anchor" if text[at] == "&" else "tag", at, m.end())
                at = m.end()
                continue
            if text[at : at + 3] in ("---", "...") and (at == 0 or text[at - 1] in "\r\n﻿"):
                put("start" if text[at] == "-" else "end", at, at + 3)
                at += 3
                continue
            m = _GAP.match(text, at, a)
            flow += (m[0] in "[{") - (m[0] in "]}") if m.lastgroup == "indicator" else 0
            put(m.lastgroup, at, m.end())
            at = m.end()
        if kind:
            put(kind, a, b)
            at = b
    return out


SYNTAX = "node int, parent int, depth int, kind string, text string, span_start int, span_end int"


def syntax_rows(text: str) -> list[tuple]:
    """Rows of SYNTAX in pre-order: stream, documents, directives, collections, entries, items, keys and values, scalars and aliases, and the tokens between them."""
    docs, frames = framed(text)
    byte, out = byte_offsets(text), []

    def put(kind: str, parent: int, depth: int, a: int, b: int, leaf: bool = False) -> int:
        out.append((len(out), parent, depth, kind, text[a:b] if leaf else None, byte(a), byte(b)))
        return len(out) - 1

    def visit(n: Node, parent: int, depth: int) -> None:
        if n.kind in ("scalar", "alias"):
            put(n.kind, parent, depth, n.start, n.end, True)
            return
        me = put(("flow_" if n.style == "flow" else "block_") + ("mapping" if n.kind == "map" else "sequence"), parent, depth, n.start, n.end)
        for item in n.items:
            if n.kind == "seq":
                visit(item, put("item", me, depth + 1, item.start, item.end), depth + 2)
                continue
            key, value = item
            at = put("entry", me, depth + 1, key.start if key.mark < 0 else key.mark, max(key.end, value.end))
            visit(key, put("key", at, depth + 2, key.start, key.end), depth + 3)
            visit(value, put("value", at, depth + 2, value.start, value.end), depth + 3)

    top = put("stream", -1, 0, 0, len(text))
    for root, frame in zip(docs, frames):
        own = [d[2:] for d in frame["directives"]]
        spans = own + ([(root.start, root.end)] if root else [])
        me = put("document", top, 1, min((a for a, _ in spans), default=0), max((b for _, b in spans), default=0))
        for a, b in own:
            put("directive", me, 2, a, b, True)
        if root:
            visit(root, me, 2)
    for _, kind, t, a, b in token_rows(text):
        if kind in ("comment", "anchor", "tag", "start", "end", "indicator"):
            out.append((len(out), top, 1, kind, t, a, b))
    return out


def directive_rows(text: str) -> list[tuple]:
    byte = byte_offsets(text)
    return [(ix, k, name, params, byte(a), byte(b)) for ix, f in enumerate(framed(text)[1]) for k, (name, params, a, b) in enumerate(f["directives"])]


def table(texts: DataFrame, key: str, text: str, columns: str, rows: Callable[[str], list[tuple]], mode: str = "FAILFAST") -> DataFrame:
    """(doc_key, columns, error): the rows of every text; null text is empty."""
    fields = T.StructType.fromDDL(columns)
    out = T.StructType([T.StructField("doc_key", texts.schema[key].dataType), *fields, T.StructField("error", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields] + [pa.string()]
    names = ["doc_key", *fields.names, "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
            at, got = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                try:
                    part = [(*r, None) for r in rows(t or "")]
                except (YamlError, RecursionError) as e:
                    if mode == "FAILFAST":
                        raise ValueError(f"document {batch.column(0)[i]}: {e}") from None
                    part = [(*[None] * len(fields), str(e) or "nested too deeply")] if mode == "PERMISSIVE" else []
                got += part
                at += [i] * len(part)
            cols = [pa.array([r[k] for r in got], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], names)

    return texts.select(F.col(key).alias("doc_key"), F.col(text).alias("_text")).mapInArrow(run, out)


def events(texts: DataFrame, key: str, text: str, mode: str = "FAILFAST") -> DataFrame:
    return table(texts, key, text, EVENTS, event_rows, mode)


def tokens(texts: DataFrame, key: str, text: str, mode: str = "FAILFAST") -> DataFrame:
    return table(texts, key, text, TOKENS, token_rows, mode)


def syntax(texts: DataFrame, key: str, text: str, mode: str = "FAILFAST") -> DataFrame:
    return table(texts, key, text, SYNTAX, syntax_rows, mode)


def directives(texts: DataFrame, key: str, text: str, mode: str = "FAILFAST") -> DataFrame:
    return table(texts, key, text, DIRECTIVES, directive_rows, mode)


def tokens_text(tokens: DataFrame) -> DataFrame:
    """(doc_key, text): each source again from its tokens."""
    got = tokens.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    return got.select("doc_key", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"))


def valid_source(text: Column) -> Column:
    """Whether every character is one that YAML 1.2.2 allows."""
    return ~text.rlike(r"[^\x09\x0A\x0D\x20-\x7E\x85\xA0-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]")
