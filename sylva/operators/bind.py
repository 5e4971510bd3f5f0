"""Documents bound to a StructType, and written back without touching the rest of their text.

A field's metadata may hold {"yaml": {...}} with

- name: the key, where it differs from the field; alias: further keys, tried in order
- default: a JSON value for a missing key (without one: null if nullable, else an error)
- flatten: a struct whose fields stand in the same mapping
- rest: a map that takes the entries no other field claims
- enum: a struct of `variant` and one field for each variant with data, written `!variant data`
- skip: neither read (the default or null stands) nor written
- comment: lines above the entry where it is written anew
- newtype: a struct of one field that reads and writes as that field
- with: the name of a codec (`register_codec`) between document values and the field's

The schema's own rule for names is the `rename` argument.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import render, values
from ..functions.render import Tagged
from . import edit

_INTS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


#: Codecs by name: (from a document's value, to a document's value).
CODECS: dict[str, tuple[Callable, Callable]] = {}


def register_codec(name: str, read: Callable[[object], object], write: Callable[[object], object]) -> None:
    """A codec that fields name in `with`; it travels to the executors with each read and write."""
    CODECS[name] = (read, write)


def _use(codecs: dict) -> None:
    CODECS.update(codecs)


class BindError(ValueError):
    """A value that does not fit; the message begins with its pointer."""


def _step(pointer: str, key: object) -> str:
    return f"{pointer}/{str(key).replace('~', '~0').replace('/', '~1')}"


def _options(f: T.StructField) -> dict:
    return (f.metadata or {}).get("yaml", {})


def _fail(pointer: str, want: str, v: object):
    raise BindError(f"{pointer or '/'}: expected {want}, found {type(v).__name__}")


def bind(v: object, t: T.DataType, pointer: str = "", rename: str | None = None) -> object:
    """A dynamic value as the Python value of a Spark type; raises BindError."""
    if isinstance(t, T.StructType):
        if not isinstance(v, dict):
            _fail(pointer, "a mapping", v)
        return _struct(v, t, pointer, rename, set(v))
    if isinstance(t, T.ArrayType):
        if not isinstance(v, list):
            _fail(pointer, "a sequence", v)
        return [None if x is None and t.containsNull else bind(x, t.elementType, _step(pointer, k), rename) for k, x in enumerate(v)]
    if isinstance(t, T.MapType):
        if not isinstance(v, dict) or not all(isinstance(k, str) for k in v):
            _fail(pointer, "a mapping with string keys", v)
        return {k: None if x is None and t.valueContainsNull else bind(x, t.valueType, _step(pointer, k), rename) for k, x in v.items()}
    if isinstance(t, T.StringType):
        return v if isinstance(v, str) else _fail(pointer, "a string", v)
    if isinstance(t, T.BooleanType):
        return v if isinstance(v, bool) else _fail(pointer, "a boolean", v)
    if isinstance(v, bool) or not isinstance(v, (int, float, Decimal)):
        _fail(pointer, "a number", v)
    if type(t) in _INTS:
        if not isinstance(v, int):
            _fail(pointer, "an integer", v)
        if not -(1 << _INTS[type(t)] - 1) <= v < 1 << _INTS[type(t)] - 1:
            raise BindError(f"{pointer}: {v} does not fit {t.simpleString()}")
        return v
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return float(v)
    if isinstance(t, T.DecimalType):
        if isinstance(v, float) and not math.isfinite(v):
            _fail(pointer, "a finite number", v)
        d = Decimal(v)
        if d != 0 and (d.adjusted() >= t.precision - t.scale or -d.as_tuple().exponent > t.scale and d != d.quantize(Decimal(1).scaleb(-t.scale))):
            raise BindError(f"{pointer}: {v} does not fit {t.simpleString()}")
        return d
    raise BindError(f"{pointer}: no binding for {t.simpleString()}")


def _struct(v: dict, t: T.StructType, pointer: str, rename: str | None, free: set) -> dict:
    out, later = {}, None
    for f in t:
        o = _options(f)
        if o.get("rest"):
            if later:
                raise BindError(f"{pointer}: two fields take the rest")
            later = f
            continue
        if o.get("flatten"):
            out[f.name] = _struct(v, f.dataType, pointer, rename, free)
            continue
        if o.get("skip"):
            out[f.name] = o.get("default")
            continue
        names = [o.get("name") or (render.renamed(f.name, rename) if rename else f.name), *o.get("alias", [])]
        key = next((n for n in names if n in v), None)
        free -= {key}
        if key is None:
            if "default" in o:
                out[f.name] = bind(o["default"], f.dataType, _step(pointer, names[0]), rename) if o["default"] is not None else None
            elif f.nullable:
                out[f.name] = None
            else:
                raise BindError(f"{_step(pointer, names[0])}: missing")
        elif v[key] is None and f.nullable:
            out[f.name] = None
        else:
            x = v[key]
            if "with" in o:
                try:
                    x = CODECS[o["with"]][0](x)
                except (ValueError, TypeError, KeyError, ArithmeticError) as e:
                    raise BindError(f"{_step(pointer, key)}: {e}") from None
            if o.get("newtype"):
                out[f.name] = {f.dataType[0].name: bind(x, f.dataType[0].dataType, _step(pointer, key), rename)}
            else:
                out[f.name] = (_enum if o.get("enum") else bind)(x, f.dataType, _step(pointer, key), rename)
    if later:
        out[later.name] = bind({k: x for k, x in v.items() if k in free}, later.dataType, pointer, rename)
    return {f.name: out[f.name] for f in t}


def _enum(v: object, t: T.StructType, pointer: str, rename: str | None) -> dict:
    out = dict.fromkeys(t.names)
    if isinstance(v, Tagged):
        name = v.tag.lstrip("!")
        if name not in t.names or name == "variant":
            raise BindError(f"{pointer}: unknown variant {name!r}")
        return out | {"variant": name, name: bind(v.value, t[name].dataType, pointer, rename)}
    if not isinstance(v, str):
        _fail(pointer, "a variant", v)
    known = _options(t["variant"]).get("units")
    if known is not None and v not in known:
        raise BindError(f"{pointer}: unknown variant {v!r}")
    return out | {"variant": v}


def unbind(row: object, t: T.DataType, rename: str | None = None) -> object:
    """The inverse of bind: null members are left out."""
    if row is None:
        return None
    if isinstance(t, T.StructType):
        out: dict = {}
        for f in t:
            x, o = row[f.name], _options(f)
            if x is None or o.get("skip"):
                continue
            if o.get("newtype"):
                x, f = x[f.dataType[0].name], T.StructField(f.name, f.dataType[0].dataType, True, f.metadata)
            if "with" in o:
                out[o.get("name") or (render.renamed(f.name, rename) if rename else f.name)] = CODECS[o["with"]][1](unbind(x, f.dataType, rename))
            elif o.get("flatten") or o.get("rest"):
                out |= unbind(x, f.dataType, rename)
            elif o.get("enum"):
                name = x["variant"]
                out[o.get("name") or (render.renamed(f.name, rename) if rename else f.name)] = name if name not in f.dataType.names or x[name] is None else Tagged("!" + name, unbind(x[name], f.dataType[name].dataType, rename))
            else:
                out[o.get("name") or (render.renamed(f.name, rename) if rename else f.name)] = unbind(x, f.dataType, rename)
        return out
    if isinstance(t, T.ArrayType):
        return [unbind(x, t.elementType, rename) for x in row]
    if isinstance(t, T.MapType):
        return {k: unbind(x, t.valueType, rename) for k, x in (row.items() if isinstance(row, dict) else row)}
    if hasattr(row, "item"):
        row = row.item()
    return row


def read(text: Column, schema: T.StructType, rename: str | None = None, merge: bool = False) -> Column:
    """struct(ok, value, error): the one document of each text as `schema`; value is null on error.  Null text is empty."""
    out = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("value", _nullable(schema)), T.StructField("error", T.StringType())])
    spec, codecs = schema.json(), dict(CODECS)

    @F.udf(out, useArrow=True)
    def run(t):
        _use(codecs)
        try:
            v = values.one(t or "")
            return True, bind(values.merged(v) if merge else v, T.StructType.fromJson(json.loads(spec)), "", rename), None
        except edit.FAILURES as e:
            return False, None, edit.message(e)

    return run(text)


def _nullable(t: T.DataType) -> T.DataType:
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in t])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_nullable(t.elementType), True)
    return T.MapType(t.keyType, _nullable(t.valueType), True) if isinstance(t, T.MapType) else t


def layout(t: T.DataType, rename: str | None = None) -> dict:
    """Of a struct's own level: keys in declared order, and the comments of those that have one."""
    keys, notes, inner = [], {}, {}
    for f in t:
        o = _options(f)
        if o.get("rest") or o.get("skip"):
            continue
        if o.get("flatten"):
            sub = layout(f.dataType, rename)
            keys += sub["keys"]
            notes |= sub["notes"]
            inner |= sub["inner"]
            continue
        name = o.get("name") or (render.renamed(f.name, rename) if rename else f.name)
        keys.append(name)
        if "comment" in o:
            notes[name] = o["comment"]
        if isinstance(f.dataType, T.StructType) and not (o.get("enum") or o.get("newtype")):
            inner[name] = layout(f.dataType, rename)
    return {"keys": keys, "notes": notes, "inner": inner}


def overlay(text: str, new: object, prune: bool = False, ix: int = 0, plan: dict | None = None) -> str:
    """A text edited until its document equals `new` where `new` speaks.

    Equal values are not touched, so comments and styles stay; keys unknown to
    `new` stay unless `prune`; null members of `new` leave the text alone.  With a
    `plan` (see `layout`) new entries stand in declared order, with their comments.
    """
    if not text.strip():
        return render.block(new)
    docs = values.documents(text)
    return _overlay(text, docs[ix] if ix < len(docs) else None, new, "", prune, ix, plan)


def _same(a: object, b: object) -> bool:
    return type(a) is type(b) and a == b or isinstance(a, (int, float, Decimal)) and isinstance(b, (int, float, Decimal)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b


def _overlay(text: str, old: object, new: object, at: str, prune: bool, ix: int, plan: dict | None = None) -> str:
    if isinstance(old, dict) and isinstance(new, dict):
        for k, x in new.items():
            if k not in old and plan:
                text = edit.add_in_order(text, _step(at, k), render.flow(x), plan["keys"], ix, plan["notes"].get(k))
            elif k not in old:
                text = edit.add(text, _step(at, k), render.flow(x), ix)
            elif x is not None:
                text = _overlay(text, old[k], x, _step(at, k), prune, ix, (plan or {}).get("inner", {}).get(k))
        for k in [k for k in old if k not in new] if prune else []:
            text = edit.remove(text, _step(at, k), ix)
        return text
    if isinstance(old, list) and isinstance(new, list):
        for k, x in enumerate(new):
            text = _overlay(text, old[k], x, _step(at, k), prune, ix) if k < len(old) else edit.add(text, f"{at}/-", render.flow(x), ix)
        for k in range(len(old) - 1, len(new) - 1, -1):
            text = edit.remove(text, _step(at, k), ix)
        return text
    return text if _same(old, new) else edit.replace(text, at, render.flow(new), ix)


def write(text: Column, value: Column, schema: T.StructType, rename: str | None = None, prune: bool = False, ordered: bool = False) -> Column:
    """struct(ok, text, error): each text with the fields of its struct written into it; on error the text is unchanged.  ordered: new entries stand where the schema declares them."""
    spec, codecs = schema.json(), dict(CODECS)

    @F.udf(edit.RESULT, useArrow=True)
    def run(t, v):
        _use(codecs)
        try:
            own = T.StructType.fromJson(json.loads(spec))
            return True, t if v is None else overlay(t or "", unbind(v, own, rename), prune, 0, layout(own, rename) if ordered else None), None
        except edit.FAILURES as e:
            return False, t, edit.message(e)

    return run(text, value)


