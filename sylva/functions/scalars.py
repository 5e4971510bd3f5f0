"""YAML 1.2 core schema scalars with exact numbers."""

from __future__ import annotations

import re

_INT = re.compile(r"[-+]?(?:0|[1-9][0-9_]*)\Z")
_RADIX = re.compile(r"([-+]?)0(?:x([0-9a-fA-F_]+)|o([0-7_]+)|b([01_]+))\Z")
_FLOAT = re.compile(r"([-+]?)(?=\.?[0-9])([0-9][0-9_]*)?(?:\.([0-9_]*))?(?:[eE]([-+]?[0-9]+))?\Z")
_SPECIAL = re.compile(r"[-+]?\.(?:inf|Inf|INF)\Z|\.(?:nan|NaN|NAN)\Z")

# Fixed values of the core schema.
NULLS = frozenset(("", "~", "null", "Null", "NULL"))
BOOLS = {"true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}

TAGS = {"tag:yaml.org,2002:" + k: k for k in ("null", "bool", "int", "float", "str", "map", "seq")}


def number(text: str) -> tuple[int, int, str, bool] | None:
    """(sign, exponent, digits, is_int) with the value sign * 0.digits * 10^exponent; zero is (0, 0, "")."""
    if m := _RADIX.match(text):
        base = 16 if m[2] else 8 if m[3] else 2
        digits = (m[2] or m[3] or m[4]).replace("_", "")
        return _packed(m[1], str(int(digits, base)), 0, True) if digits else None
    if _INT.match(text):
        return _packed(text[0] if text[0] in "+-" else "", text.lstrip("+-").replace("_", ""), 0, True)
    m = _FLOAT.match(text)
    if not m or (m[3] is None and m[4] is None):
        return None
    whole, part = (m[2] or "").replace("_", ""), (m[3] or "").replace("_", "")
    if not whole and not part:
        return None
    return _packed(m[1], whole + part, int(m[4] or 0) - len(part), False)


def _packed(sign: str, digits: str, exponent: int, is_int: bool) -> tuple[int, int, str, bool]:
    d = digits.lstrip("0")
    if not d:
        return 0, 0, "", is_int
    places = len(d) + exponent
    return -1 if sign == "-" else 1, places, d.rstrip("0"), is_int


def number_text(sign: int, places: int, digits: str, is_int: bool) -> str:
    """Canonical text: integers written out, anything else as digits and exponent."""
    if not sign:
        return "0" if is_int else "0e0"
    s = "-" if sign < 0 else ""
    if is_int:
        return s + digits + "0" * (places - len(digits))
    return f"{s}{digits}e{places - len(digits)}"


_NINES = str.maketrans("0123456789", "9876543210")


def ordered(sign: int, places: int, digits: str) -> tuple[int, int, str]:
    """Key whose plain struct order is the numeric order."""
    return (sign, places, digits) if sign >= 0 else (sign, -places, digits.translate(_NINES) + "~")


def resolve(text: str, plain: bool, tag: str | None) -> tuple[str, object]:
    """(kind, value): kind null, bool, num, nonfinite or str.  An unusable tag raises ValueError."""
    if tag is not None and tag not in TAGS and tag != "!":
        raise ValueError(f"unsupported scalar tag {tag}")
    want = TAGS.get(tag) if tag else None
    if tag == "!" or want == "str" or (want is None and not plain):
        return "str", text
    if want in (None, "null") and text in NULLS:
        return "null", None
    if want in (None, "bool") and text in BOOLS:
        return "bool", BOOLS[text]
    if want in (None, "int", "float"):
        if want != "int" and _SPECIAL.match(text):
            return "nonfinite", text
        n = number(text)
        if n and not (want == "int" and not n[3]):
            return "num", n
    if want:
        raise ValueError(f"{text!r} does not fit its tag")
    return "str", text
