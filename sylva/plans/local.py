"""JSONPath over one parsed document: a path never leaves its document, so texts are queried where they are read."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import TAGS, number, number_text, ordered, resolve
from ..functions.yaml import Node, YamlError, parse

COLUMNS = ("pointer", "kind", "text", "num", "json", "canon", "rank")
_NUM = T.StructType([T.StructField("sgn", T.IntegerType()), T.StructField("places", T.LongType()), T.StructField("digits", T.StringType())])
_TYPES = dict.fromkeys(("pointer", "kind", "text", "json", "canon"), T.StringType()) | {"num": _NUM, "rank": T.ArrayType(T.IntegerType())}


class Value:
    """A value of a document; aliases share the value of their anchor."""

    __slots__ = ("_canon", "_json", "count", "items", "keys", "kind", "node", "num", "text")

    def __init__(self, kind: str, node: Node | None, text: str | None = None, num: tuple | None = None):
        self.kind, self.node, self.text, self.num = kind, node, text, num
        self.items: list[Value] = []
        self.keys: list[str] | None = None
        self.count, self._json, self._canon = 1, None, None

    @property
    def json(self) -> str:
        if self._json is None:
            self._json = self._written(lambda v: v.json, False)
        return self._json

    @property
    def canon(self) -> str:
        """Equal for values of equal meaning: keys sorted, numbers normalised."""
        if self._canon is None:
            self._canon = self._written(lambda v: v.canon, True)
        return self._canon

    def _written(self, of, canonical: bool) -> str:
        from ..operators.shred import quote

        if self.kind == "map":
            pairs = zip(self.keys, self.items)
            return "{" + ",".join(f"{quote(k)}:{of(v)}" for k, v in (sorted(pairs, key=lambda kv: kv[0]) if canonical else pairs)) + "}"
        if self.kind == "seq":
            return "[" + ",".join(map(of, self.items)) + "]"
        if self.kind == "str":
            return quote(self.text)
        if self.kind == "num":
            sgn, places, digits, is_int = self.num
            if canonical:
                return "0" if not sgn else f"{'-' if sgn < 0 else ''}{digits}e{places - len(digits)}"
            return number_text(*self.num) if is_int or not (self.text[:1].isdigit() or self.text[:1] == "-") else self.text.replace("_", "").lstrip("+")
        return "null" if self.kind in ("null", "empty") else self.text.lower()


class Values:
    """The values of one document; raises YamlError where it does not fit the JSON model."""

    def __init__(self, text: str):
        self.budget = max(10_000, 100 * len(text))
        self.anchors: dict[str, Value | None] = {}

    def value(self, n: Node) -> Value:
        if n.kind == "alias":
            if n.value not in self.anchors:
                raise YamlError(f"unknown anchor {n.value}", n.start)
            got = self.anchors[n.value]
            if got is None:
                raise YamlError("recursive alias", n.start)
            return got
        if n.anchor:
            self.anchors[n.anchor] = None
        if n.kind == "scalar":
            try:
                kind, v = resolve(n.value, n.style == "plain", n.tag)
            except ValueError as e:
                raise YamlError(str(e), n.start) from None
            if kind == "nonfinite":
                raise YamlError("number is not finite", n.start)
            out = Value(kind, n, n.value, v if kind == "num" else None)
        else:
            if n.tag and TAGS.get(n.tag) != n.kind:
                raise YamlError(f"unsupported tag {n.tag}", n.start)
            out = Value(n.kind, n)
            if n.kind == "seq":
                out.items = [self.value(x) for x in n.items]
            else:
                out.keys, seen = [], set()
                for key, x in n.items:
                    k = self.value(key)
                    if k.kind != "str":
                        raise YamlError("a key is not a string", key.start)
                    if k.text in seen:
                        raise YamlError(f"duplicate key {k.text!r}", key.start)
                    seen.add(k.text)
                    out.keys.append(k.text)
                    out.items.append(self.value(x))
            out.count = 1 + sum(x.count for x in out.items)
            if out.count > self.budget:
                raise YamlError("too many alias occurrences", n.start)
        if n.anchor:
            self.anchors[n.anchor] = out
        return out


def documents(text: str) -> list[Value]:
    """The root values of a stream; an empty document is a value of kind `empty`."""
    if sys.getrecursionlimit() < 20_000:
        sys.setrecursionlimit(20_000)
    out = []
    for root in parse(text):
        out.append(Value("empty", None) if root is None else Values(text).value(root))
    return out


# -- evaluation; a match is (value, pointer)
def _step(pointer: str, v: Value, k: int) -> str:
    return f"{pointer}/{k}" if v.keys is None else f"{pointer}/{v.keys[k].replace('~', '~0').replace('/', '~1')}"


def _places(v: Value, sel: tuple, root: Value) -> list[int]:
    n = len(v.items)
    if sel[0] == "name":
        return [v.keys.index(sel[1])] if v.keys is not None and sel[1] in v.keys else []
    if sel[0] == "wild":
        return list(range(n))
    if sel[0] == "filter":
        return [k for k in range(n) if holds(sel[1], v.items[k], root)]
    if v.kind != "seq":
        return []
    if sel[0] == "index":
        k = sel[1] + n if sel[1] < 0 else sel[1]
        return [k] if 0 <= k < n else []
    a, b, step = sel[1:]
    return [] if step == 0 else list(range(n))[slice(a, b, step)]


def evaluate(path: list, root: Value, start: Value | None = None, place: str = "") -> list[tuple[Value, str]]:
    """Matches in the order of the nodelist, duplicates kept."""
    now = [(root if start is None else start, place)]
    for s in path:
        if s.descend:
            deep, todo = [], list(reversed(now))
            while todo:
                v, p = todo.pop()
                deep.append((v, p))
                todo += [(v.items[k], _step(p, v, k)) for k in range(len(v.items) - 1, -1, -1)]
            now = deep
        now = [(v.items[k], _step(p, v, k)) for v, p in now for sel in s.selectors for k in _places(v, sel, root)]
    return now


@lru_cache(maxsize=512)
def _pattern(p: str, whole: bool):
    """The compiled pattern, or None for a bad or refused one."""
    from .jsonpath import JsonPathError, java_pattern

    try:
        java_pattern(p)
        return regex.compile(f"(?:{p})" + (r"\Z" if whole else ""), regex.V0)
    except (JsonPathError, regex.error):
        return None


def _like(text: str | None, p: str | None, whole: bool) -> bool:
    got = None if text is None or p is None else _pattern(p, whole)
    return got is not None and (got.match(text) if whole else got.search(text)) is not None


def likes(text: pd.Series, pattern: pd.Series) -> pd.Series:
    return pd.Series([_like(t, p, False) for t, p in zip(text, pattern)], dtype=bool)


def matches(text: pd.Series, pattern: pd.Series) -> pd.Series:
    return pd.Series([_like(t, p, True) for t, p in zip(text, pattern)], dtype=bool)


def holds(e: tuple, v: Value, root: Value) -> bool:
    if e[0] == "or":
        return any(holds(x, v, root) for x in e[1])
    if e[0] == "and":
        return all(holds(x, v, root) for x in e[1])
    if e[0] == "not":
        return not holds(e[1], v, root)
    if e[0] == "exists":
        return bool(_found(e, v, root))
    if e[0] == "call":
        a, p = _operand(e[2][0], v, root), _operand(e[2][1], v, root)
        return a is not None and p is not None and a.kind == p.kind == "str" and _like(a.text, p.text, e[1] == "match")
    op, a, b = e[1], _operand(e[2], v, root), _operand(e[3], v, root)
    if op in ("==", "!="):
        return _same(a, b) == (op == "==")
    if op[0] == ">":
        a, b = b, a
    return _less(a, b) or len(op) == 2 and _same(a, b)


def _found(q: tuple, v: Value, root: Value) -> list[tuple[Value, str]]:
    return evaluate(q[2], root, v if q[1] == "@" else None)


def _same(a: Value | None, b: Value | None) -> bool:
    if a is None or b is None:
        return a is b
    return a is b or a.kind == b.kind and a.canon == b.canon


def _less(a: Value | None, b: Value | None) -> bool:
    if a is None or b is None or a.kind != b.kind:
        return False
    if a.kind == "num":
        return ordered(*a.num[:3]) < ordered(*b.num[:3])
    return a.kind == "str" and a.text < b.text


def _integer(n: int) -> Value:
    return Value("num", None, str(n), number(str(n)))


def _operand(x: tuple, v: Value, root: Value) -> Value | None:
    if x[0] == "lit":
        if x[1] == "num":
            return Value("num", None, x[2], number(x[2]) or (0, 0, "", True))
        return Value(x[1], None, x[2] if x[1] == "str" else str(x[2]).lower())
    if x[0] == "query":
        got = _found(x, v, root)
        return got[0][0] if got else None
    name, a = x[1], x[2][0]
    if name == "count":
        return _integer(len(_found(a, v, root)))
    if name == "value":
        got = _found(a, v, root)
        return got[0][0] if len(got) == 1 else None
    of = _operand(a, v, root)
    if of is None or of.kind not in ("str", "seq", "map"):
        return None
    return _integer(len(of.text) if of.kind == "str" else len(of.items))


def cells(v: Value, pointer: str, rank: int, columns: tuple[str, ...]) -> list:
    out = []
    for c in columns:
        if c == "num":
            out.append(dict(zip(("sgn", "places", "digits"), ordered(*v.num[:3]))) if v.kind == "num" else None)
        elif c == "text":
            out.append(v.text if v.node is not None and v.node.kind == "scalar" else None)
        else:
            out.append(pointer if c == "pointer" else [rank] if c == "rank" else getattr(v, c))
    return out


def query_texts(texts: DataFrame, key: str, text: str, path: list, columns: tuple[str, ...], mode: str) -> DataFrame:
    names = ("doc_ix", *columns, *(("error",) if mode == "PERMISSIVE" else ()))
    fields = [T.StructField(n, T.IntegerType() if n == "doc_ix" else T.StringType() if n == "error" else _TYPES[n]) for n in names]
    out = T.StructType([T.StructField("doc_key", texts.schema[key].dataType), *fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 2000) for b in batches for lo in range(0, b.num_rows, 2000)):
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                try:
                    got = [[ix, *cells(v, p, k, columns)] for ix, root in enumerate(documents(t or "")) for k, (v, p) in enumerate(evaluate(path, root))]
                except (YamlError, RecursionError) as e:
                    if mode == "FAILFAST":
                        raise ValueError(f"document {batch.column(0)[i]}: {e or 'nested too deeply'}") from None
                    got = [[None] * (1 + len(columns)) + [str(e) or "nested too deeply"]] if mode == "PERMISSIVE" else []
                rows += got
                at += [i] * len(got)
            filled = [r if len(r) == len(names) else [*r, None] for r in rows]
            cols = [pa.array([r[k] for r in filled], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], ["doc_key", *names])

    return texts.select(F.col(key).alias("doc_key"), F.col(text).alias("_text")).mapInArrow(run, out)
