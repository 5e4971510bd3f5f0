"""Pointer edits and patches that leave every other character of a text as it is.

Each text is edited on its own, as a transaction: the edited text must parse and
every alias must keep its anchor, otherwise the original stays and the error is
returned.  A pointer names one member: a mapping with a key that is no string, or
with the named key twice, is an error.  Strings that replace strings keep the
quoting of their place, renamed keys their quoting and anchor; inserted lines end
as the text's first line does.
"""

from __future__ import annotations

import json as _json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.render import _SAFE, dedented, flow, line_break
from ..functions.scalars import resolve
from ..functions.yaml import Node, YamlError, framed, parse
from .events import token_rows
from .shred import _Shredder, quote


class EditError(ValueError):
    pass


#: What one document's edit may raise; it becomes that document's error row.
FAILURES = (EditError, YamlError, ValueError, LookupError, TypeError, AttributeError, RecursionError)


def tokens(pointer: str) -> list[str]:
    if pointer == "":
        return []
    if not pointer.startswith("/") or re.search(r"~(?![01])", pointer):
        raise EditError(f"bad pointer {pointer!r}")
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer[1:].split("/")]


def is_prefix(a: str, b: str) -> bool:
    """Whether pointer a names a place above b."""
    x, y = tokens(a), tokens(b)
    return len(x) < len(y) and y[: len(x)] == x


def key_text(key: str) -> str:
    return key if _SAFE.match(key) and resolve(key, True, None)[0] == "str" else quote(key)


def styled(text: str, style: str) -> str | None:
    """A string on one line in a scalar style, or None where that style cannot hold it."""
    if style == "double":
        return quote(text)
    if style == "single":
        return None if re.search(r"[\x00-\x1f\x7f-\x9f]", text) else "'" + text.replace("'", "''") + "'"
    return text if style == "plain" and _SAFE.match(text) and resolve(text, True, None)[0] == "str" else None


def _children(n: Node) -> list[Node]:
    return n.items if n.kind == "seq" else [x for kv in n.items for x in kv] if n.kind == "map" else []


def below(n: Node) -> list[Node]:
    """A node and all nodes in it, aliases not followed."""
    out, todo = [], [n]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += _children(x)
    return out


class Document:
    """One document of a text, with its nodes."""

    def __init__(self, text: str, ix: int = 0):
        self.text, self.ix = text, ix
        docs = parse(text)
        if ix >= len(docs):
            raise EditError(f"no document {ix}")
        self.root = docs[ix]
        self.anchors: dict[str, list[Node]] = {}
        if self.root:
            s = _Shredder(text)
            s.anchors = self.anchors
            s.mark(self.root)
            self._target = s.target

    def open(self, n: Node) -> Node:
        while n.kind == "alias":
            n = self._target(n)
        return n

    def keys(self, n: Node) -> list[str]:
        out = []
        for key, _ in n.items:
            k = self.open(key)
            if k.kind != "scalar" or resolve(k.value, k.style == "plain", k.tag)[0] != "str":
                raise EditError("a mapping on the way has a key that is no string")
            out.append(k.value)
        return out

    def child(self, n: Node, token: str) -> tuple[int, Node] | None:
        n = self.open(n)
        if n.kind == "map":
            at = [k for k, name in enumerate(self.keys(n)) if name == token]
            if len(at) > 1:
                raise EditError(f"key {token!r} is there more than once")
            return (at[0], n.items[at[0]][1]) if at else None
        if n.kind == "seq" and re.fullmatch("0|[1-9][0-9]*", token) and int(token) < len(n.items):
            return int(token), n.items[int(token)]
        return None

    def find(self, path: list[str]) -> Node:
        if self.root is None:
            raise EditError("the document is empty")
        n = self.root
        for t in path:
            got = self.child(n, t)
            if got is None:
                raise EditError(f"no match at {t!r}")
            n = got[1]
        return n

    def holder(self, path: list[str]) -> tuple[Node, int]:
        """The collection that holds the last token's entry, and the entry's place."""
        if not path:
            raise EditError("the root cannot be edited so")
        up = self.open(self.find(path[:-1]))
        got = self.child(up, path[-1])
        if got is None:
            raise EditError(f"no match at {path[-1]!r}")
        return up, got[0]

    def _row(self, n: Node) -> dict:
        s = _Shredder(self.text)
        s.ix, s.count, s.anchors = 0, 0, self.anchors
        return s.visit(n, -1, 0, 0, None, "", {}, None)

    def json(self, n: Node) -> str:
        return self._row(n)["json"]

    def canon(self, n: Node) -> str:
        return self._row(n)["canon"]

    def flow(self, n: Node, above: tuple = ()) -> str:
        """A value on one line, scalars spelt as they are where they stand on one line."""
        n = self.open(n)
        if id(n) in above:
            raise EditError("recursive alias")
        inside = (*above, id(n))
        tag = f"!<{n.tag}> " if n.tag and n.tag != "!" else "! " if n.tag else ""
        if n.kind == "seq":
            return tag + "[" + ", ".join(self.flow(x, inside) for x in n.items) + "]"
        if n.kind == "map":
            return tag + "{" + ", ".join(f"{'? ' if self.open(k).kind != 'scalar' else ''}{self.flow(k, inside)}: {self.flow(v, inside)}" for k, v in n.items) + "}"
        raw = self.text[self.bare(n) : n.end]
        if n.style in ("single", "double") and "\n" not in raw:
            return tag + raw
        if n.style == "plain" and "\n" not in raw and not re.search(r"[,\[\]{}]", raw):
            return tag + (raw or "null")
        return tag + quote(n.value)

    def bare(self, n: Node) -> int:
        """Where a scalar's own text begins, behind its tag and anchor."""
        at = n.start
        while at < n.end and self.text[at] in "&! \t" and n.style in ("plain", "single", "double"):
            m = re.compile(r"[&!]\S*[ \t\r\n]*|[ \t]+").match(self.text, at, n.end)
            at = m.end() if m else at + 1
        return at

    def value_text(self, n: Node) -> str:
        """One-line text of a value that stands for itself anywhere."""
        return self.flow(n)

    def outside_aliases(self, n: Node) -> bool:
        """Whether an alias outside a value needs an anchor inside it."""
        inside = {id(x) for x in below(n)}
        return any(x.kind == "alias" and id(x) not in inside and id(self._target(x)) in inside for x in below(self.root))

    # -- places of entries
    def entry_span(self, up: Node, k: int) -> tuple[int, int]:
        item = up.items[k]
        first, last = (item[0], item[1]) if up.kind == "map" else (item, item)
        start = first.start if first.mark < 0 else first.mark
        if up.kind == "map" and first.mark < 0:
            start = self.before_properties(start)
        if up.style == "block" and up.kind == "seq":
            start = self.text.rfind("-", 0, first.start + 1)
            line = self.text.rfind("\n", 0, first.start) + 1
            dash = re.compile(r"[ ]*(?:- +)*-(?=\s|\Z)")
            while not (m := dash.match(self.text, line)) or m.end() > first.start + 1:  # properties or a comment may lie between
                if line == 0:
                    break
                line = self.text.rfind("\n", 0, line - 1) + 1
            else:
                dashes = [x.start() for x in re.finditer("-", self.text[line : m.end()])]
                column = up.start - (self.text.rfind("\n", 0, up.start) + 1)
                start = line + next((d for d in dashes if d == column), dashes[-1])
        return start, max(last.end, first.end)

    def before_properties(self, at: int) -> int:
        """The start of the tag and anchor that stand right before a place on its line."""
        line = self.text.rfind("\n", 0, at) + 1
        while m := re.search(r"(?:^|(?<=[\s,\[{]))[&!][^\s,\[\]{}]*[ \t]+\Z", self.text[line:at]):
            at = line + m.start()
        return at


def sound(text: str, ix: int) -> bool:
    """Whether every alias of a document has its anchor."""
    d = Document(text, ix)
    try:
        for x in below(d.root) if d.root else []:
            if x.kind == "alias":
                d._target(x)
    except YamlError:
        return False
    return True


def fragment(value: str, taken: set[str] = frozenset()) -> str:
    """A value's text with anchors that clash with `taken` renamed (`_1`, `_2`, ...), and its aliases with them."""
    own = {a for n in parse(value) if n for a in (x.anchor for x in below(n)) if a}
    names, used = {}, set(taken) | own
    for a in sorted(own & set(taken)):
        k = next(i for i in range(1, len(used) + 2) if f"{a}_{i}" not in used)
        names[a] = f"{a}_{k}"
        used.add(names[a])
    if not names:
        return value
    return "".join(t[0] + names.get(t[1:], t[1:]) if kind in ("anchor", "alias") else t for _, kind, t, _, _ in token_rows(value))


def one_line(value: str, taken: set[str] = frozenset()) -> str:
    """A fragment's text, as one line."""
    docs = parse(value)
    if len(docs) > 1:
        raise EditError("a value is one document")
    if not docs or docs[0] is None:
        return "null"
    value = fragment(value, taken)
    n = parse(value)[0]
    d = Document(value)
    t = value[d.before_properties(n.start) : n.end]
    return t if "\n" not in t and not (n.kind != "scalar" and n.style == "block") and n.style not in ("literal", "folded") else d.flow(n)


def _string(n: Node) -> bool:
    return n.kind == "scalar" and resolve(n.value, n.style == "plain", n.tag)[0] == "str"


def replace(text: str, pointer: str, value: str, ix: int = 0) -> str:
    d = Document(text, ix)
    if d.root is None and not tokens(pointer):
        return text + ("" if not text or text.endswith("\n") else " ") + one_line(value)
    n, new = d.find(tokens(pointer)), one_line(value, set(d.anchors))
    given = (parse(value) or [None])[0]
    if given is not None and "\n" not in text[n.start : n.end] and _string(n) and _string(given) and not (given.anchor or given.tag):
        new = styled(given.value, n.style) or new
    if n.start == n.end:  # an empty value
        gap = "" if text[n.start - 1 : n.start] in (" ", "\n", "") else " "
        return text[: n.start] + gap + new + text[n.start :]
    start, end = d.bare(n) if n.kind == "scalar" else n.start, n.end
    if n.kind in ("map", "seq") and n.style == "block" and tokens(pointer):
        # a block collection starts on its own line: the new value goes behind the key or dash
        at = len(text[: n.start].rstrip(" \r\n"))
        if "\n" in text[at : n.start] and "#" not in text[text.rfind("\n", 0, at) + 1 : at]:
            return text[:at] + " " + new + text[end:]
    return text[:start] + new + text[end:]


def set_scalar(text: str, pointer: str, value: str, ix: int = 0) -> str:
    """The string at a pointer, in the style of the scalar that is there."""
    d = Document(text, ix)
    n = d.find(tokens(pointer))
    if n.kind != "scalar":
        raise EditError("only a scalar can be set")
    new = styled(value, n.style) or styled(value, "plain") or quote(value)
    at = d.bare(n)
    return text[:at] + (" " if n.start == n.end and text[at - 1 : at] not in (" ", "\n", "") else "") + new + text[n.end :]


def replace_text(text: str, pointer: str, source: str, ix: int = 0) -> str:
    """The source text of a value, put in its place as it is."""
    d = Document(text, ix)
    n = d.find(tokens(pointer))
    out = text[: d.bare(n) if n.kind == "scalar" else n.start] + source + text[n.end :]
    parse(out)
    return out


def remove(text: str, pointer: str, ix: int = 0, missing: bool = False) -> str:
    """Without an entry; a missing one is an error, or with `missing` no change."""
    d, path = Document(text, ix), tokens(pointer)
    if missing and (d.root is None or path and d.child(d.find(path[:-1]), path[-1]) is None):
        return text
    up, k = d.holder(path)
    item = up.items[k]
    if any(d.outside_aliases(x) for x in (item if up.kind == "map" else (item,))):
        raise EditError("an alias elsewhere needs an anchor in the value")
    if len(up.items) == 1:
        empty = "{}" if up.kind == "map" else "[]"
        first = d.entry_span(up, 0)[0] if up.style == "block" else up.start
        at = len(text[:first].rstrip(" \r\n"))
        if up.style == "block" and "\n" in text[at:first] and at and "#" not in text[text.rfind("\n", 0, at) + 1 : at]:
            return text[:at] + " " + empty + text[up.end :]
        return text[:first] + empty + text[up.end :]
    start, end = d.entry_span(up, k)
    if up.style == "flow":
        if k + 1 < len(up.items):
            return text[:start] + text[d.entry_span(up, k + 1)[0] :]
        return text[: d.entry_span(up, k - 1)[1]] + text[end:]
    line = text.rfind("\n", 0, start) + 1
    if text[line:start].strip(" "):  # the first entry of a compact collection
        return text[:start] + text[d.entry_span(up, k + 1)[0] :]
    stop = text.find("\n", end)
    if stop < 0:
        return text[: max(line - 1, 0)] + ("\n" if text.endswith("\n") else "")
    return text[:line] + text[stop + 1 :]


def add(text: str, pointer: str, value: str, ix: int = 0, comment: str | None = None, before: str | None = None) -> str:
    """An entry added, or an existing member replaced; `comment` lines go above a new block entry, `before` names the key it stands before."""
    path = tokens(pointer)
    if not path:
        return replace(text, pointer, value, ix)
    d = Document(text, ix)
    new, eol = one_line(value, set(d.anchors)), line_break(text)
    up = d.open(d.find(path[:-1]))
    if up.kind == "map":
        if d.child(up, path[-1]):
            return replace(text, pointer, value, ix)
        at = d.child(up, before) if before is not None else None
        entry, k = f"{key_text(path[-1])}: {new}", at[0] if at else len(up.items)
    elif up.kind == "seq":
        if path[-1] != "-" and not (re.fullmatch("0|[1-9][0-9]*", path[-1]) and int(path[-1]) <= len(up.items)):
            raise EditError(f"bad index {path[-1]!r}")
        k = len(up.items) if path[-1] == "-" else int(path[-1])
        entry = new if up.style == "flow" else f"- {new}"
    else:
        raise EditError("a scalar has no members")
    if up.style == "flow":
        if not up.items:
            return text[: up.start + 1] + entry + text[up.end - 1 :]
        own = lambda i: text[text.rfind("\n", 0, d.entry_span(up, i)[0]) + 1 : d.entry_span(up, i)[0]]
        # an entry that begins its line is followed by a line of its own
        lines = "\n" in text[up.start : up.end] and not own(min(k, len(up.items) - 1)).strip(" \t")
        gap = eol + own(min(k, len(up.items) - 1)) if lines else " "
        if k < len(up.items):
            at = d.entry_span(up, k)[0]
            return text[:at] + entry + "," + gap + text[at:]
        at = d.entry_span(up, k - 1)[1]
        comma = re.compile(r"(?:[ \t\r\n]|#[^\n]*)*,").match(text, at)
        if comma:  # a comma behind the last entry stays the last one's
            return text[: comma.end()] + gap + entry + "," + text[comma.end() :]
        return text[:at] + "," + gap + entry + text[at:]
    first = d.entry_span(up, 0)[0]
    pad = " " * (first - (text.rfind("\n", 0, first) + 1))
    notes = "".join(f"# {c}".rstrip() + eol + pad for c in comment.split("\n")) if comment is not None else ""
    if k < len(up.items):
        at = d.entry_span(up, k)[0]
        return text[:at] + notes + entry + eol + pad + text[at:]
    end = d.entry_span(up, k - 1)[1]
    stop = text.find("\n", end)
    if stop < 0:
        return text + eol + pad + notes + entry
    return text[: stop + 1] + pad + notes + entry + eol + text[stop + 1 :]


def add_in_order(text: str, pointer: str, value: str, order: list[str], ix: int = 0, comment: str | None = None) -> str:
    """A member added where a declared order of keys wants it: before the first later key that is there."""
    path, d = tokens(pointer), Document(text, ix)
    there = set(d.keys(d.open(d.find(path[:-1]))))
    later = order[order.index(path[-1]) + 1 :] if path[-1] in order else []
    return add(text, pointer, value, ix, comment, next((k for k in later if k in there), None))


def add_value(text: str, pointer: str, value: object, ix: int = 0) -> str:
    """A dynamic value added, in flow style."""
    return add(text, pointer, flow(value), ix)


def rename_key(text: str, pointer: str, name: str, ix: int = 0) -> str:
    """A key's own text changed; its quoting, tag and anchor stay."""
    d = Document(text, ix)
    up, k = d.holder(tokens(pointer))
    if up.kind != "map":
        raise EditError("only mapping keys have names")
    if name != tokens(pointer)[-1] and d.child(up, name):
        raise EditError(f"key {name!r} exists")
    key = up.items[k][0]
    if key.kind == "alias":
        raise EditError("a key that is an alias has no text of its own")
    at = d.bare(key)
    return text[:at] + (styled(name, key.style) or key_text(name)) + text[key.end :]


def get(text: str, pointer: str, ix: int = 0) -> str:
    d = Document(text, ix)
    return d.json(d.find(tokens(pointer)))


def extract(text: str, pointer: str, ix: int = 0) -> str:
    """The source of a value, its lines moved left to where it starts."""
    d = Document(text, ix)
    return source_of(text, d.open(d.find(tokens(pointer))))


def source_of(text: str, n: Node) -> str:
    """The source of a node, its lines moved left to where it starts."""
    line = text[text.rfind("\n", 0, n.start) + 1 : n.start]
    return dedented(text[n.start : n.end], len(line) if n.style in ("block",) else len(line) - len(line.lstrip(" ")))


def stream_of(text: str, nodes: list[Node | None]) -> str:
    """The sources of several values as a stream: a marker and the value, each; None is an empty document."""
    eol = line_break(text)
    parts = ["" if n is None else source_of(text, n) for n in nodes]
    return "".join("---" + eol + (got if got.endswith("\n") or not got else got + eol) for got in parts)


def test(text: str, pointer: str, value: str, ix: int = 0) -> bool:
    """Equal by meaning: style and mapping order do not matter."""
    d, v = Document(text, ix), Document(value if parse(value) else "null")
    return d.canon(d.find(tokens(pointer))) == (v.canon(v.root) if v.root else "null")


def copy(text: str, source: str, pointer: str, ix: int = 0) -> str:
    d = Document(text, ix)
    n = d.find(tokens(source))
    if any(x.anchor for x in below(n)):
        raise EditError("a value that holds an anchor cannot be copied")
    return add(text, pointer, d.value_text(n), ix)


def move(text: str, source: str, pointer: str, ix: int = 0) -> str:
    if is_prefix(source, pointer):
        raise EditError("a value cannot move into itself")
    if pointer == source:
        return text
    if not tokens(source):
        raise EditError("the root cannot move")
    d = Document(text, ix)
    n = d.find(tokens(source))
    if d.outside_aliases(n):
        raise EditError("an alias elsewhere needs an anchor in the value")
    name = f"&{n.anchor} " if n.anchor else ""
    return add(remove(text, source, ix), pointer, name + d.value_text(n), ix)


# -- directives
_DIRECTIVE = {"YAML": re.compile(r"[0-9]+\.[0-9]+\Z"), "TAG": re.compile(r"!(?:[0-9A-Za-z-]*!)? \S+\Z")}


def set_directive(text: str, name: str, value: str, ix: int = 0) -> str:
    """`YAML` (a version) or `TAG` (handle and prefix): replaced, or put before the document with its marker."""
    if name not in _DIRECTIVE or not _DIRECTIVE[name].match(value):
        raise EditError(f"bad directive {name} {value!r}")
    docs, frames = framed(text)
    if ix >= len(docs):
        raise EditError(f"no document {ix}")
    eol, new = line_break(text), f"%{name} {value}"
    for got, params, a, b in frames[ix]["directives"]:
        if got == name and (name == "YAML" or params[0] == value.split(" ")[0]):
            rest = re.search(r"[ \t]+#[^\n]*", text[a:b])
            return text[:a] + new + (rest[0] if rest else "\r" if text[a:b].endswith("\r") else "") + text[b:]
    if frames[ix]["directives"]:
        at = frames[ix]["directives"][0][2]
        return text[:at] + new + eol + text[at:]
    if ix:
        raise EditError("only the first document, or one that has directives, takes a new one")
    head = 1 if text.startswith("\ufeff") else 0
    return text[:head] + new + eol + ("" if frames[0]["explicit"] else "---" + eol) + text[head:]


def remove_directive(text: str, name: str, handle: str | None = None, ix: int = 0) -> str:
    """Without a directive; a missing one is no change."""
    docs, frames = framed(text)
    if ix >= len(docs):
        raise EditError(f"no document {ix}")
    for got, params, a, b in frames[ix]["directives"]:
        if got == name and (handle is None or params[:1] == [handle]):
            stop = text.find("\n", a)
            out = text[:a] + (text[stop + 1 :] if stop >= 0 else "")
            parse(out)
            return out
    return text


# -- queued edits
class Queue:
    """Edits of spans of one text, committed together: overlaps are refused, inserts at one place keep their order."""

    def __init__(self, text: str):
        self.text, self.edits = text, []

    def put(self, start: int, end: int, new: str) -> None:
        if not 0 <= start <= end <= len(self.text):
            raise EditError(f"no span {start}..{end}")
        for a, b, _ in self.edits:
            if a < end and start < b or start < end and a == b and start < a < end or a < b and start == end and a < start < b:
                raise EditError(f"span {start}..{end} overlaps {a}..{b}")
        self.edits.append((start, end, new))

    def commit(self) -> str:
        out, at = [], 0
        for a, b, new in sorted(self.edits, key=lambda e: (e[0], e[1])):  # stable: equal places as they were queued
            out += [self.text[at:a], new]
            at = b
        done = "".join(out) + self.text[at:]
        parse(done)
        return done


def apply(text: str, ops: list[dict], ix: int = 0) -> str:
    """All operations in order; any failure raises and nothing is changed."""
    whole, changed = None, False
    for o in ops:
        kind, path = o.get("op"), o.get("path")
        if path is None:
            raise EditError("an operation needs a path")
        if kind == "test":
            if not test(text, path, o["value"], ix):
                raise EditError(f"test failed at {path!r}")
            continue
        if whole is None:  # a text without "*" has no alias to lose
            whole = "*" in text and sound(text, ix)
        changed = True
        if kind in ("add", "replace"):
            text = (add if kind == "add" else replace)(text, path, o["value"], ix)
        elif kind == "remove":
            text = remove(text, path, ix)
        elif kind in ("move", "copy"):
            text = (move if kind == "move" else copy)(text, o["from"], path, ix)
        elif kind == "rename-key":
            text = rename_key(text, path, o["value"], ix)
        elif kind == "set":
            text = set_scalar(text, path, o["value"], ix)
        else:
            raise EditError(f"unknown operation {kind!r}")
        if whole and not sound(text, ix):
            raise EditError("an alias would lose its anchor")
    if changed and not whole:  # every operation reads what the one before it left; the last result is read here
        parse(text)
    return text


_MEMBERS = {"add": {"value"}, "replace": {"value"}, "test": {"value"}, "remove": set(), "move": {"from"}, "copy": {"from"}, "rename-key": {"value"}, "set": {"value"}}


def read_patch(patch: str) -> list[dict]:
    """Operations from a YAML or JSON sequence; values are kept as texts.  Every member stands once; those that an operation needs must be there."""
    d = Document(patch)
    if d.root is None or d.root.kind != "seq":
        raise EditError("a patch is a sequence")
    out = []
    for item in map(d.open, d.root.items):
        if item.kind != "map":
            raise EditError("an operation is a mapping")
        names = d.keys(item)
        if len(set(names)) < len(names):
            raise EditError("an operation has a member twice")
        o = {k: v for k, (_, v) in zip(names, item.items)}
        for k in ("op", "path", "from"):
            if k in o and not _string(d.open(o[k])):
                raise EditError(f"{k} is no string")
        kind = d.open(o["op"]).value if "op" in o else None
        if kind not in _MEMBERS:
            raise EditError(f"unknown operation {kind!r}")
        for k in {"path"} | _MEMBERS[kind]:
            if k not in o:
                raise EditError(f"{kind} needs {k}")
        for k in ("path", "from"):
            if k in o:
                tokens(d.open(o[k]).value)
        plain = kind in ("rename-key", "set")
        out.append({k: d.open(v).value if k != "value" or plain else d.value_text(v) for k, v in o.items() if k in ("op", "path", "from", "value")})
    return out


RESULT = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def message(e: BaseException) -> str:
    return str(e) or type(e).__name__


def edited(text: Column, ops: list[dict], ix: int = 0) -> Column:
    """struct(ok, text, error) of the same operations on every text; on error the text is unchanged.  Null text is an empty document."""
    spec = _json.dumps(ops)

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        todo, rows = _json.loads(spec), []
        for t in texts:
            try:
                rows.append((True, apply(t or "", todo, ix), None))
            except FAILURES as e:
                rows.append((False, t, message(e)))
        return pd.DataFrame(rows, columns=["ok", "text", "error"])

    return run(text)


def pointer_get(nodes: DataFrame, pointer: str) -> DataFrame:
    """A pointer's value in every document: one filter on the node table."""
    tokens(pointer)
    return nodes.where(F.col("pointer") == pointer).select("doc_key", "doc_ix", "pointer", "kind", "text", "json")
