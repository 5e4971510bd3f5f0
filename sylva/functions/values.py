"""Dynamic values: documents as Python objects, tags and duplicate-free mappings kept."""

from __future__ import annotations

import json
from decimal import Decimal

from .render import Pairs, Tagged
from .scalars import TAGS, resolve
from .yaml import Node, YamlError, parse

BUDGET = 100


class _Loader:
    def __init__(self, text: str):
        self.left = max(10_000, BUDGET * len(text))
        self.anchors: dict[str, Node] = {}

    def load(self, n: Node, above: tuple = ()) -> object:
        """Nodes are met in text order, so an alias finds the last anchor before it."""
        self.left -= 1
        if self.left < 0:
            raise YamlError("too many alias occurrences", n.start)
        if n.kind == "alias":
            got = self.anchors.get(n.value)
            if got is None:
                raise YamlError(f"unknown anchor {n.value}", n.start)
            if id(got) in above:
                raise YamlError("recursive alias", n.start)
            return self.load(got, above)
        if n.anchor:
            self.anchors[n.anchor] = n
        inside = (*above, id(n))
        local = n.tag is not None and n.tag not in TAGS and n.tag != "!"
        if n.kind == "scalar":
            out = self.scalar(n, None if local else n.tag)
        elif n.kind == "seq":
            out = [self.load(x, inside) for x in n.items]
        else:
            out = self.mapping([(self.load(k, inside), self.load(v, inside)) for k, v in n.items], n)
        return Tagged(n.tag, out) if local else out

    def scalar(self, n: Node, tag: str | None) -> object:
        try:
            kind, v = resolve(n.value, n.style == "plain", tag)
        except ValueError as e:
            raise YamlError(str(e), n.start) from None
        if kind == "num":
            sign, places, digits, is_int = v
            if is_int:
                return sign * int(digits + "0" * (places - len(digits))) if digits else 0
            return Decimal((int(sign < 0), tuple(map(int, digits)), places - len(digits))) if digits else Decimal("0.0")
        if kind == "nonfinite":
            return float(n.value.replace(".", "").lower())
        return v

    def mapping(self, items: list[tuple[object, object]], n: Node) -> object:
        seen = [json.dumps([type(k).__name__, str(k)]) for k, _ in items]
        if len(set(seen)) < len(seen):
            raise YamlError("duplicate key", n.start)
        if any(isinstance(k, (list, dict, Pairs, Tagged)) for k, _ in items) or len({k for k, _ in items}) < len(items):
            return Pairs(items)
        return dict(items)


def documents(text: str) -> list[object]:
    """All documents of a stream; an empty one is None."""
    return [None if root is None else _Loader(text).load(root) for root in parse(text)]


def one(text: str) -> object:
    got = documents(text)
    if len(got) > 1:
        raise YamlError("more than one document", 0)
    return got[0] if got else None


def from_json(text: str) -> object:
    return json.loads(text, parse_float=Decimal)


def merged(v: object, above: int = 0) -> object:
    """Merge keys applied at every level: explicit members win, then earlier sources; a source that is no mapping raises."""
    if isinstance(v, list):
        return [merged(x) for x in v]
    if isinstance(v, Tagged):
        return Tagged(v.tag, merged(v.value))
    if isinstance(v, Pairs):
        return Pairs([(merged(k), merged(x)) for k, x in v.items])
    if not isinstance(v, dict):
        return v
    out = {k: merged(x) for k, x in v.items() if k != "<<"}
    if "<<" in v:
        sources = merged(v["<<"])
        for s in sources if isinstance(sources, list) else [sources]:
            if not isinstance(s, dict):
                raise ValueError("a merge source is not a mapping")
            for k, x in s.items():
                out.setdefault(k, x)
    return out


class Mapping(dict):
    """An ordered mapping; equal if entries are equal in any order."""

    def insert(self, key: object, value: object) -> object:
        """The value that was there, or None; a key keeps its place."""
        old = self.get(key)
        self[key] = value
        return old

    def shift_remove(self, key: object) -> object:
        """Removes an entry; those after it keep their order."""
        return self.pop(key, None)

    def swap_remove(self, key: object) -> object:
        """Removes an entry and puts the last one in its place."""
        if key not in self:
            return None
        items, at = list(self.items()), list(self).index(key)
        out, last = self[key], items.pop()
        if at < len(items):
            items[at] = last
        self.clear()
        self.update(items)
        return out

    def retain(self, keep) -> None:
        for k in [k for k, v in self.items() if not keep(k, v)]:
            del self[k]

    def entry(self, key: object, default) -> object:
        """The value of a key, which is put there first where it is missing."""
        if key not in self:
            self[key] = default()
        return self[key]


_RANK = ("null", "bool", "number", "string", "sequence", "mapping", "tagged")


def _rank(v: object) -> int:
    kinds = ((type(None), 0), (bool, 1), ((int, float, Decimal), 2), (str, 3), (list, 4), ((dict, Pairs), 5), (Tagged, 6))
    return next(k for t, k in kinds if isinstance(v, t))


def compare(a: object, b: object) -> int | None:
    """-1, 0 or 1; None where there is no order (a number that is none).  Kinds go in the order of _RANK; mappings compare as lists of entries."""
    x, y = _rank(a), _rank(b)
    if x != y:
        return -1 if x < y else 1
    if x in (4, 5):
        m, n = ([list(p) for p in (v.items() if isinstance(v, dict) else v.items)] if x == 5 else v for v in (a, b))
        for p, q in zip(m, n):
            if (c := compare(p, q)) != 0:
                return c
        return (len(m) > len(n)) - (len(m) < len(n))
    if x == 6:
        return compare([a.tag, a.value], [b.tag, b.value])
    if x == 0:
        return 0
    return None if a != a or b != b else (a > b) - (a < b)
