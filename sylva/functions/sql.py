"""SQL functions and table functions: `register(spark)` makes them known to a session.

Scalar functions take a text and give null where it does not parse; `yaml_error`
tells why.  All run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..operators import edit, events
from ..operators.shred import NODE_COLUMNS, shred_text
from . import render, values
from .yaml import YamlError, parse

_BAD = (YamlError, *edit.FAILURES)


def _each(f: Callable, *columns: pd.Series) -> pd.Series:
    out = []
    for row in zip(*columns):
        try:
            out.append(None if any(x is None for x in row) else f(*row))
        except _BAD:
            out.append(None)
    return pd.Series(out, dtype=object)


def _root(text: str, field: str) -> str | None:
    rows = shred_text(text)
    if not rows or rows[0]["error"] is not None:
        return None
    return rows[0][field]


def _error(text: str) -> str | None:
    rows = shred_text(text)
    return rows[0]["error"] if rows else None


@F.pandas_udf(T.StringType())
def yaml_json(text: pd.Series) -> pd.Series:
    """The first document as compact JSON, aliases expanded, numbers exact."""
    return _each(lambda t: _root(t, "json"), text)


@F.pandas_udf(T.StringType())
def yaml_canonical(text: pd.Series) -> pd.Series:
    """Equal for documents of equal meaning: keys sorted, numbers normalised."""
    return _each(lambda t: _root(t, "canon"), text)


@F.pandas_udf(T.StringType())
def yaml_error(text: pd.Series) -> pd.Series:
    """Why a text is refused; null for a good one."""
    return _each(_error, text)


@F.pandas_udf(T.IntegerType())
def yaml_documents(text: pd.Series) -> pd.Series:
    return _each(lambda t: len(parse(t)), text)


@F.pandas_udf(T.StringType())
def yaml_get(text: pd.Series, pointer: pd.Series) -> pd.Series:
    """JSON of the value at a pointer."""
    return _each(edit.get, text, pointer)


@F.pandas_udf(T.BooleanType())
def yaml_test(text: pd.Series, pointer: pd.Series, value: pd.Series) -> pd.Series:
    return _each(edit.test, text, pointer, value)


@F.pandas_udf(T.StringType())
def yaml_patch(text: pd.Series, patch: pd.Series) -> pd.Series:
    """The text with all operations of a patch applied; null if one of them fails."""
    return _each(lambda t, p: edit.apply(t, edit.read_patch(p)), text, patch)


@F.pandas_udf(T.StringType())
def yaml_render(json: pd.Series) -> pd.Series:
    """Block YAML of a JSON value."""
    return _each(lambda t: render.block(values.from_json(t)), json)


@F.pandas_udf(T.StringType())
def yaml_flow(json: pd.Series) -> pd.Series:
    return _each(lambda t: render.flow(values.from_json(t)), json)


@F.pandas_udf(T.StringType())
def yaml_format(text: pd.Series) -> pd.Series:
    """All documents written anew in block style; tags stay, comments and aliases do not."""
    return _each(lambda t: render.stream(values.documents(t)), text)


@F.pandas_udf(T.StringType())
def yaml_merge(text: pd.Series) -> pd.Series:
    """The document with its merge keys applied, in block style."""
    return _each(lambda t: render.block(values.merged(values.one(t))), text)


@F.pandas_udf(T.StringType())
def yaml_append(text: pd.Series, json: pd.Series) -> pd.Series:
    return _each(lambda t, j: render.append_document(t, values.from_json(j)), text, json)


@F.pandas_udf(T.StringType())
def yaml_set(text: pd.Series, pointer: pd.Series, value: pd.Series) -> pd.Series:
    """A string set in the style of the scalar that is there."""
    return _each(edit.set_scalar, text, pointer, value)


@F.pandas_udf(T.StringType())
def yaml_set_directive(text: pd.Series, name: pd.Series, value: pd.Series) -> pd.Series:
    return _each(edit.set_directive, text, name, value)


@F.pandas_udf(T.StringType())
def yaml_remove_directive(text: pd.Series, name: pd.Series) -> pd.Series:
    return _each(edit.remove_directive, text, name)


@F.pandas_udf(T.StringType())
def yaml_event_text(text: pd.Series) -> pd.Series:
    return _each(events.event_text, text)


SCALARS = {f.__name__: f for f in (yaml_json, yaml_canonical, yaml_error, yaml_documents, yaml_get, yaml_test, yaml_patch, yaml_render, yaml_flow, yaml_format, yaml_merge, yaml_append, yaml_set, yaml_set_directive, yaml_remove_directive, yaml_event_text)}

_NODES = ["doc_ix", "pre", "subtree_end", "parent", "depth", "ord", "n_children", "key", "pointer", "kind", "style", "tag", "anchor", "alias", "text", "json", "canon", "span_start", "span_end", "error"]
_INTS = {"doc_ix", "pre", "subtree_end", "parent", "depth", "ord", "n_children", "span_start", "span_end"}
assert set(_NODES) <= set(NODE_COLUMNS)


@udtf(returnType=", ".join(f"{c} {'int' if c in _INTS else 'string'}" for c in _NODES))
class yaml_nodes:
    def eval(self, text: str):
        for r in shred_text(text):
            yield tuple(r[c] for c in _NODES)


def _rows(f: Callable, text: str) -> list[tuple]:
    try:
        return f(text or "")
    except _BAD:
        return []


@udtf(returnType=events.EVENTS)
class yaml_events:
    def eval(self, text: str):
        yield from _rows(events.event_rows, text)


@udtf(returnType=events.TOKENS)
class yaml_tokens:
    def eval(self, text: str):
        yield from _rows(events.token_rows, text)


@udtf(returnType=events.SYNTAX)
class yaml_cst:
    def eval(self, text: str):
        yield from _rows(events.syntax_rows, text)


TABLES = {"yaml_cst": yaml_cst, "yaml_nodes": yaml_nodes, "yaml_events": yaml_events, "yaml_tokens": yaml_tokens}


def register(spark: SparkSession) -> None:
    for name, f in SCALARS.items():
        spark.udf.register(name, f)
    for name, t in TABLES.items():
        spark.udtf.register(name, t)


def to_yaml(value: Column, style: str = "block") -> Column:
    """A struct, map or array column as YAML; null members are left out, a null value is null."""
    return (yaml_render if style == "block" else yaml_flow)(F.to_json(value))
