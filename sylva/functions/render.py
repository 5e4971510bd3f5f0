"""Values as YAML text: block and flow style, the same text for the same value.

Values are None, bool, int, Decimal, float, str, list, dict, `Tagged` and
`Pairs` (a mapping whose keys may be collections).
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from decimal import Decimal

from .scalars import resolve

_SAFE = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*( [A-Za-z0-9_.-]+)*\Z")
_HIDDEN = re.compile("[\x7f-\x84\x86-\x9f\u2028\u2029\ud800-\udfff\ufeff\ufffe\uffff]")
_PLACES = re.compile(r"\r\n?|\n")


@dataclass(frozen=True)
class Tagged:
    tag: str
    value: object

    def written(self) -> str:
        t = self.tag.lstrip("!")
        return f"!{t}" if re.fullmatch(r"[\w.-]+", t) else f"!<{self.tag}>"


@dataclass
class Pairs:
    items: list[tuple[object, object]]


def quoted(text: str) -> str:
    """Double-quoted, on one line, printable."""
    return _HIDDEN.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(text, ensure_ascii=False))


def string(text: str) -> str:
    return text if _SAFE.match(text) and resolve(text, True, None)[0] == "str" else quoted(text)


def scalar(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (float, Decimal)):
        if math.isnan(v):
            return ".nan"
        if math.isinf(v):
            return ".inf" if v > 0 else "-.inf"
        t = str(v).lower().replace("e+", "e")
        return t if "." in t or "e" in t else t + ".0"
    return string(v)


def _pairs(v: object) -> list[tuple[object, object]]:
    return list(v.items()) if isinstance(v, dict) else v.items


def flow(v: object) -> str:
    if isinstance(v, Tagged):
        return f"{v.written()} {flow(v.value)}"
    if isinstance(v, list):
        return "[" + ", ".join(map(flow, v)) + "]"
    if isinstance(v, (dict, Pairs)):
        return "{" + ", ".join(f"{'? ' if isinstance(k, (list, dict, Pairs)) else ''}{flow(k)}: {flow(x)}" for k, x in _pairs(v)) + "}"
    return scalar(v)


def _literal(text: str, pad: str) -> str | None:
    """A literal block for a string of several lines, where one can hold it exactly."""
    lines = text.split("\n")
    if len(lines) < 2 or not text.strip("\n") or "\r" in text or "\x85" in text or lines[0][:1] in (" ", "\t", "") or any(x.strip() == "" and x for x in lines):
        return None
    if _HIDDEN.search(text) or re.search("[\0-\x08\x0b-\x1f]", text):
        return None
    body = text.rstrip("\n")
    ends = len(text) - len(body)
    head = "|" + ("-" if ends == 0 else "" if ends == 1 else "+")
    return head + "\n" + "\n".join(pad + x if x else "" for x in body.split("\n")) + "\n" * max(ends, 1)


def _put(v: object, pad: str, before: str) -> str:
    """A value after `before` (a key with its colon, a dash, or nothing), children at `pad`; ends in a line break."""
    space = " " if before else ""
    if isinstance(v, Tagged):
        return _put(v.value, pad, f"{before}{space}{v.written()}")
    if isinstance(v, (dict, Pairs, list)) and (v if isinstance(v, (dict, list)) else v.items):
        lines = []
        if isinstance(v, list):
            lines = [pad + _entry(x, pad) for x in v]
        else:
            for k, x in _pairs(v):
                if isinstance(k, (list, dict, Pairs)):
                    lines.append(pad + "? " + flow(k) + "\n" + pad + _put(x, pad + "  ", ":"))
                else:
                    lines.append(pad + _put(x, pad + "  ", flow(k) + ":"))
        return (before + "\n" if before else "") + "".join(lines)
    if isinstance(v, str) and (block := _literal(v, pad or "  ")):
        return before + space + block
    return before + space + flow(v) + "\n"


def _entry(v: object, pad: str) -> str:
    """A sequence's item: mappings and sequences start behind the dash."""
    inner = pad + "  "
    if isinstance(v, (dict, Pairs, list)) and (v if isinstance(v, (dict, list)) else v.items):
        return "- " + _put(v, inner, "")[len(inner) :]
    return _put(v, inner, "-")


def block(v: object) -> str:
    """One document in block style, two columns a level."""
    return _put(v, "", "")


def stream(values: list[object]) -> str:
    """Several documents; each but the first after a marker.  A block that keeps its line breaks needs none of its own."""
    return "".join(("---\n" if k else "") + block(v) for k, v in enumerate(values))


# -- text helpers
def line_break(text: str) -> str:
    """The first line break decides; without one, a line feed."""
    m = _PLACES.search(text)
    return m[0] if m else "\n"


def indented(text: str, by: int) -> str:
    return re.sub(r"(?m)^(?=[^\r\n])", " " * by, text)


def continued(text: str, by: int) -> str:
    """All lines but the first indented."""
    return re.sub(r"(?<=\n)(?=[^\r\n])", " " * by, text)


def dedented(text: str, by: int) -> str:
    return re.sub(rf"(?<=\n) {{0,{by}}}", "", text)


def append_document(text: str, value: object = Pairs([])) -> str:
    """A document (without a value an empty mapping) after the others, with a marker and a line break where these are missing."""
    eol = line_break(text)
    body = block(value).replace("\n", eol)
    if not text.strip():
        return text + body
    return text + ("" if text.endswith(("\n", "\r")) else eol) + "---" + eol + body


def renamed(name: str, rule: str) -> str:
    """A field or variant name under one of the usual rules; words are split at underscores and capitals."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^A-Z_\-]+", name)]
    if rule in ("lowercase", "UPPERCASE"):
        return "".join(words) if rule == "lowercase" else "".join(words).upper()
    if rule in ("snake_case", "kebab-case"):
        return ("_" if rule == "snake_case" else "-").join(words)
    if rule in ("SCREAMING_SNAKE_CASE", "SCREAMING-KEBAB-CASE"):
        return ("_" if "SNAKE" in rule else "-").join(words).upper()
    if rule in ("PascalCase", "camelCase"):
        out = "".join(w[:1].upper() + w[1:] for w in words)
        return out if rule == "PascalCase" else out[:1].lower() + out[1:]
    raise ValueError(f"unknown rule {rule!r}")
