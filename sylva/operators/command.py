"""One command on one text: get, query, test and edits, with a structured answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.yaml import YamlError, parse, position
from ..plans import jsonpath, local
from . import edit
from .shred import quote

EDITS = ("add", "replace", "remove", "move", "copy", "rename-key", "set", "patch")
ANSWER = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("output", T.StringType()), T.StructField("pointers", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


def chosen(text: str, doc: int | None, n: int | None = None) -> int:
    """The chosen document; it must be named where there are several (n, if they are counted already)."""
    n = len(parse(text)) if n is None else n
    if n == 0:
        raise edit.EditError("no document")
    if doc is None and n > 1:
        raise edit.EditError(f"{n} documents: choose one with --doc")
    if doc is not None and not 0 <= doc < n:
        raise edit.EditError(f"no document {doc}")
    return doc or 0


def targets(root: local.Value, found: list[tuple[local.Value, str]], nested: bool = False) -> list[str]:
    """The entries that matches stand for: each once, by whatever alias it was reached, without entries below another one (unless nested), deeper and later ones first."""
    own: dict[tuple, str] = {}
    for _, p in found:
        steps, up = edit.tokens(p), root
        for t in steps[:-1]:
            up = up.items[int(t) if up.keys is None else up.keys.index(t)]
        own.setdefault((id(up), *steps[-1:]), p)
    return places(list(own.values()), nested)


def _place(pointer: str) -> tuple:
    steps = edit.tokens(pointer)
    return (-len(steps), [(-int(s), "") if s.isdigit() else (0, s) for s in steps])


def places(pointers: list[str], nested: bool = False) -> list[str]:
    once = set(pointers)
    kept = once if nested else {p for p in once if not any(edit.is_prefix(q, p) for q in _above(p) & once)}
    return sorted(kept, key=_place)


def _above(pointer: str) -> set[str]:
    steps = pointer.split("/")
    return {"/".join(steps[:k]) for k in range(1, len(steps))}


def apply_at(text: str, pointers: list[str], op: str, value: str | None, ix: int) -> str:
    """One operation at every place, all or nothing."""
    return edit.apply(text, [{"op": op, "path": p, "value": value} for p in pointers], ix)


def execute(text: str, command: str, pointer: str | None = None, query: str | None = None, value: str | None = None, ops: list[dict] | None = None, doc: int | None = None) -> tuple:
    """(ok, text, output, pointers, error): the text after the command, what it prints, and the matches it worked on."""
    try:
        found: list[tuple[int, local.Value, str]] = []
        roots: list[local.Value] = []
        if query is not None:
            roots = local.documents(text)
            path = jsonpath.parse(query)
            every = doc is None and command in ("query", "test", "get")
            for ix in range(len(roots)) if every else [chosen(text, doc, len(roots))]:
                found += [(ix, v, p) for v, p in local.evaluate(path, roots[ix])]
        at = [p for _, _, p in found] if query is not None else [pointer] if pointer is not None else []
        if command == "query":
            return True, text, "".join(f"{quote(p)}: {v.json}\n" for _, v, p in found), at, None
        if command == "get":
            if query is None:
                return True, text, edit.extract(text, pointer, chosen(text, doc)), at, None
            return True, text, edit.stream_of(text, [v.node for _, v, _ in found]), at, None
        if command == "test":
            if query is None:
                ok = edit.test(text, pointer, value, chosen(text, doc))
                return ok, text, None, at, None if ok else "not equal"
            want = local.documents(value)
            canon = want[0].canon if want else "null"
            ok = bool(found) and all(v.canon == canon for _, v, _ in found)
            return ok, text, None, at, None if ok else "not equal" if found else "no match"
        ix = chosen(text, doc, len(roots) if query is not None else None)
        if query is not None:
            if not found:
                return False, text, None, at, "no match"
            at = targets(roots[ix], [(v, p) for _, v, p in found], command == "rename-key")
            out = apply_at(text, at, command, value, ix)
        else:
            out = edit.apply(text, ops or [], ix)
        return True, out, out, at, None
    except YamlError as e:
        line, column = position(text, e.at)
        return False, text, None, [], f"{e} at {line}:{column}"
    except (*edit.FAILURES, jsonpath.JsonPathError) as e:
        return False, text, None, [], edit.message(e)


def executed(text: Column, **request) -> Column:
    """struct(ok, text, output, pointers, error) of one command on every text; null text is empty."""

    @F.udf(ANSWER, useArrow=True)
    def run(t):
        return execute(t or "", **request)

    return run(text)
