"""RFC 9535 JSONPath compiled to DataFrame plans over the node table.

Every segment is one join on (document, parent) or, for descendants, on the
pre-order interval; `rank` carries the order of the nodelist and keeps
duplicates.  Leading names and indexes fuse into one filter on `pointer`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import number, ordered
from . import local


class JsonPathError(ValueError):
    pass


@dataclass
class Segment:
    descend: bool
    selectors: list[tuple]  # (name, s) (index, i) (wild,) (slice, a, b, c) (filter, expr)


_NAME = re.compile(r"[A-Za-z_\u0080-\ud7ff\ue000-\U0010ffff][0-9A-Za-z_\u0080-\ud7ff\ue000-\U0010ffff]*")
_INT = re.compile(r"-?(?:0|[1-9][0-9]*)")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
# Fixed: the function names of RFC 9535 with (argument kinds, result kind).
FUNCTIONS = {"length": ("v", "v"), "count": ("n", "v"), "value": ("n", "v"), "match": ("vv", "l"), "search": ("vv", "l")}
_DEPTH = 128


class _Reader:
    def __init__(self, text: str):
        self.s, self.i, self.depth = text, 0, 0

    def fail(self, what: str):
        raise JsonPathError(f"{what} at {self.i}")

    def ws(self) -> None:
        while self.s[self.i : self.i + 1] in (" ", "\t", "\n", "\r") and self.i < len(self.s):
            self.i += 1

    def eat(self, t: str) -> bool:
        if self.s.startswith(t, self.i):
            self.i += len(t)
            return True
        return False

    def need(self, t: str) -> None:
        if not self.eat(t):
            self.fail(f"expected {t}")

    def take(self, pattern: re.Pattern) -> str | None:
        m = pattern.match(self.s, self.i)
        if m:
            self.i = m.end()
            return m[0]
        return None

    def path(self) -> list[Segment]:
        out = []
        while True:
            at = self.i
            self.ws()
            if self.eat(".."):
                out.append(Segment(True, self.bracket() if self.s[self.i : self.i + 1] == "[" else [self.dotted()]))
            elif self.eat("."):
                out.append(Segment(False, [self.dotted()]))
            elif self.s[self.i : self.i + 1] == "[":
                out.append(Segment(False, self.bracket()))
            else:
                self.i = at
                return out

    def dotted(self) -> tuple:
        if self.eat("*"):
            return ("wild",)
        name = self.take(_NAME)
        return ("name", name) if name is not None else self.fail("expected a name")

    def bracket(self) -> list[tuple]:
        self.need("[")
        out = []
        while True:
            self.ws()
            out.append(self.selector())
            self.ws()
            if self.eat("]"):
                return out
            self.need(",")

    def selector(self) -> tuple:
        c = self.s[self.i : self.i + 1]
        if c in ("'", '"') and c:
            return ("name", self.string())
        if self.eat("*"):
            return ("wild",)
        if self.eat("?"):
            self.ws()
            return ("filter", self.logical())
        a = self.integer()
        at = self.i
        self.ws()
        if not self.eat(":"):
            self.i = at
            return ("index", a) if a is not None else self.fail("expected a selector")
        self.ws()
        b = self.integer()
        self.ws()
        step = None
        if self.eat(":"):
            self.ws()
            step = self.integer()
        return ("slice", a, b, 1 if step is None else step)

    def integer(self) -> int | None:
        t = self.take(_INT)
        if t is None:
            return None
        if t == "-0" or abs(int(t)) > 2**53 - 1:
            self.fail("bad integer")
        return int(t)

    def string(self) -> str:
        q = self.s[self.i]
        self.i += 1
        out = ""
        while True:
            c = self.s[self.i : self.i + 1]
            if not c or c < " ":
                self.fail("unterminated string")
            self.i += 1
            if c == q:
                return out
            if c != "\\":
                out += c
                continue
            e = self.s[self.i : self.i + 1]
            self.i += 1
            if e == "u":
                code = self.hex4()
                if 0xD800 <= code < 0xDC00:
                    self.need("\\u")
                    low = self.hex4()
                    if not 0xDC00 <= low < 0xE000:
                        self.fail("lone surrogate")
                    code = 0x10000 + ((code - 0xD800) << 10) + low - 0xDC00
                elif 0xDC00 <= code < 0xE000:
                    self.fail("lone surrogate")
                out += chr(code)
            elif e == q or e in tuple("bfnrt/\\"):
                out += {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}.get(e, e)
            else:
                self.fail("bad escape")

    def hex4(self) -> int:
        t = self.take(re.compile("[0-9A-Fa-f]{4}"))
        return int(t, 16) if t else self.fail("bad escape")

    # -- filters: ("or"|"and", [..]) ("not", e) ("exists", rel, path) ("cmp", op, a, b) ("call", name, args)
    def logical(self) -> tuple:
        self.depth += 1
        if self.depth > _DEPTH:
            self.fail("nested too deeply")
        parts = [self.conjunction()]
        while self.ws() or self.eat("||"):
            self.ws()
            parts.append(self.conjunction())
        self.depth -= 1
        return parts[0] if len(parts) == 1 else ("or", parts)

    def conjunction(self) -> tuple:
        parts = [self.basic()]
        while self.ws() or self.eat("&&"):
            self.ws()
            parts.append(self.basic())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def basic(self) -> tuple:
        if self.s[self.i : self.i + 1] == "!" and self.s[self.i + 1 : self.i + 2] != "=":
            self.i += 1
            self.ws()
            return ("not", self.basic_unit(False))
        return self.basic_unit(True)

    def basic_unit(self, compare: bool) -> tuple:
        if self.eat("("):
            self.ws()
            e = self.logical()
            self.ws()
            self.need(")")
            return e
        a = self.operand()
        at = self.i
        self.ws()
        op = next((o for o in ("==", "!=", "<=", ">=", "<", ">") if self.s.startswith(o, self.i)), None) if compare else None
        if op:
            self.i += len(op)
            self.ws()
            b = self.operand()
            for x in (a, b):
                if x[0] == "query" and not singular(x[2]):
                    self.fail("a comparison needs singular queries")
                if x[0] == "call" and FUNCTIONS[x[1]][1] == "l":
                    self.fail("a logical result cannot be compared")
            return ("cmp", op, a, b)
        self.i = at
        if a[0] == "query":
            return ("exists", a[1], a[2])
        if a[0] == "call" and FUNCTIONS[a[1]][1] == "l":
            return a
        self.fail("expected a comparison")

    def operand(self) -> tuple:
        c = self.s[self.i : self.i + 1]
        if c in ("@", "$") and c:
            self.i += 1
            return ("query", c, self.path())
        if c in ("'", '"') and c:
            return ("lit", "str", self.string())
        t = self.take(_NUMBER)
        if t is not None:
            return ("lit", "num", t)
        m = self.take(re.compile("[a-z][a-z_0-9]*"))
        if m in ("true", "false"):
            return ("lit", "bool", m == "true")
        if m == "null":
            return ("lit", "null", None)
        if m not in FUNCTIONS:
            self.fail("unknown function" if m else "expected an operand")
        self.need("(")
        args = []
        for k in FUNCTIONS[m][0]:
            self.ws()
            if args:
                self.need(",")
                self.ws()
            a = self.operand()
            if k == "n" and a[0] != "query" or k == "v" and (a[0] == "query" and not singular(a[2]) or a[0] == "call" and FUNCTIONS[a[1]][1] == "l"):
                self.fail(f"bad argument of {m}")
            args.append(a)
        self.ws()
        self.need(")")
        if m in ("match", "search") and args[1][0] == "lit" and args[1][1] == "str":
            java_pattern(args[1][2])
        return ("call", m, args)


def singular(path: list[Segment]) -> bool:
    return all(not s.descend and len(s.selectors) == 1 and s.selectors[0][0] in ("name", "index") for s in path)


def parse(text: str) -> list[Segment]:
    r = _Reader(text)
    r.need("$")
    out = r.path()
    if r.i != len(text):
        r.fail("unexpected text")
    return out


def java_pattern(p: str) -> str:
    """Pattern for Java's engine: lines end at U+000A only, classes are Unicode; look-around and back-references are refused."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", p):
        raise JsonPathError("pattern not supported")
    try:
        re.compile(re.sub(r"\\[pP]\{\w+\}", "x", p))
    except re.error as e:
        raise JsonPathError(f"bad pattern: {e}") from None
    return f"(?dU){p}"


_ID = ["doc_key", "doc_ix"]
_VALUE = ["kind", "text", "bool_val", "num", "canon", "n_children"]


def _children(nodes: DataFrame) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"c_{c}") for c in (*_ID, "pre", "subtree_end", "parent", "ord", "key", "n_children")])


class Plan:
    def __init__(self, nodes: DataFrame):
        self.nodes = nodes.where("kind is not null")
        self.kids = _children(self.nodes)

    def start(self) -> DataFrame:
        """The roots, each its own context; columns: document, ctx, pre, subtree_end, n_children, rank."""
        r = self.nodes.where("parent = -1")
        return r.select(*_ID, F.col("pre").alias("ctx"), "pre", "subtree_end", "n_children", F.array().cast("array<int>").alias("rank"))

    def step(self, cur: DataFrame, s: Segment) -> DataFrame:
        if s.descend:
            k = self.kids
            on = (cur["doc_key"].eqNullSafe(k["c_doc_key"])) & (cur["doc_ix"] == k["c_doc_ix"]) & (k["c_pre"] >= cur["pre"]) & (k["c_pre"] <= cur["subtree_end"])
            cur = cur.join(k, on).select(*[cur[c] for c in _ID], "ctx", F.col("c_pre").alias("pre"), F.col("c_subtree_end").alias("subtree_end"), F.col("c_n_children").alias("n_children"), F.concat("rank", F.array(F.col("c_pre"))).alias("rank"))
        out = None
        for n, sel in enumerate(s.selectors):
            got = self.select(cur, sel, n)
            out = got if out is None else out.unionByName(got)
        return out

    def select(self, cur: DataFrame, sel: tuple, n: int) -> DataFrame:
        k = self.kids
        on = (cur["doc_key"].eqNullSafe(k["c_doc_key"])) & (cur["doc_ix"] == k["c_doc_ix"]) & (cur["pre"] == k["c_parent"])
        order = F.col("c_ord")
        if sel[0] == "name":
            on &= k["c_key"] == F.lit(sel[1])
        elif sel[0] == "index":
            on &= k["c_key"].isNull() & (k["c_ord"] == (F.lit(sel[1]) if sel[1] >= 0 else cur["n_children"] + sel[1]))
        elif sel[0] == "slice":
            a, b, step = sel[1:]
            if step == 0:
                on &= F.lit(False)
            else:
                size = cur["n_children"]
                norm = lambda v: F.lit(v) if v >= 0 else size + v
                if step > 0:
                    lo = F.least(F.greatest(norm(0 if a is None else a), F.lit(0)), size)
                    hi = size if b is None else F.least(F.greatest(norm(b), F.lit(0)), size)
                    on &= k["c_key"].isNull() & (k["c_ord"] >= lo) & (k["c_ord"] < hi) & ((k["c_ord"] - lo) % step == 0)
                else:
                    hi = size - 1 if a is None else F.least(F.greatest(norm(a), F.lit(-1)), size - 1)
                    lo = F.lit(-1) if b is None else F.least(F.greatest(norm(b), F.lit(-1)), size - 1)
                    on &= k["c_key"].isNull() & (k["c_ord"] <= hi) & (k["c_ord"] > lo) & ((hi - k["c_ord"]) % -step == 0)
                    order = -F.col("c_ord")
        out = cur.join(k, on).select(*[cur[c] for c in _ID], "ctx", F.col("c_pre").alias("pre"), F.col("c_subtree_end").alias("subtree_end"), F.col("c_n_children").alias("n_children"), F.concat("rank", F.array(F.lit(n), order)).alias("rank"))
        return self.filter(out, sel[1]) if sel[0] == "filter" else out

    def run(self, cur: DataFrame, path: list[Segment]) -> DataFrame:
        for s in path:
            cur = self.step(cur, s)
        return cur

    # -- filters
    def filter(self, cur: DataFrame, expr: tuple) -> DataFrame:
        """Rows of cur whose node satisfies expr; every subquery adds columns by one join on the node."""
        self.n = getattr(self, "n", 0)
        base = cur.select(*_ID, "pre", "subtree_end", "n_children").dropDuplicates([*_ID, "pre"])
        state = {"df": base, "base": base}
        ok = self.logic(state, expr)
        good = state["df"].where(ok).select(F.col("doc_key").alias("_k"), F.col("doc_ix").alias("_x"), F.col("pre").alias("_p"))
        return cur.join(good, cur["doc_key"].eqNullSafe(good["_k"]) & (cur["doc_ix"] == good["_x"]) & (cur["pre"] == good["_p"]), "left_semi")

    def logic(self, state: dict, e: tuple) -> Column:
        if e[0] in ("or", "and"):
            parts = [self.logic(state, x) for x in e[1]]
            out = parts[0]
            for p in parts[1:]:
                out = out | p if e[0] == "or" else out & p
            return out
        if e[0] == "not":
            return ~self.logic(state, e[1])
        if e[0] == "exists":
            return F.coalesce(F.col(self.sub(state, e[1], e[2]) + ".n"), F.lit(0)) > 0
        if e[0] == "call":
            a, p = (self.value(state, x) for x in e[2])
            both = (a["kind"] == "str") & (p["kind"] == "str")
            if e[2][1][0] == "lit":
                pattern = F.lit(java_pattern(e[2][1][2]) if e[1] == "search" else "^(?:" + java_pattern(e[2][1][2]) + r")\z")
                return F.coalesce(F.when(both, F.regexp_like(a["text"], pattern)), F.lit(False))
            # a pattern from the data may be bad: that is false in its document and no error of the job
            like = F.pandas_udf(local.likes if e[1] == "search" else local.matches, "boolean")
            return F.coalesce(F.when(both, like(a["text"], p["text"])), F.lit(False))
        op, a, b = e[1], self.value(state, e[2]), self.value(state, e[3])
        same = F.when(a["kind"].isNull() | b["kind"].isNull(), a["kind"].isNull() & b["kind"].isNull()).otherwise((a["kind"] == b["kind"]) & (a["canon"] == b["canon"]))
        less = lambda x, y: F.coalesce(F.when((x["kind"] == "num") & (y["kind"] == "num"), x["num"] < y["num"]).when((x["kind"] == "str") & (y["kind"] == "str"), x["text"] < y["text"]), F.lit(False))
        return {"==": lambda: same, "!=": lambda: ~same, "<": lambda: less(a, b), ">": lambda: less(b, a), "<=": lambda: less(a, b) | same, ">=": lambda: less(b, a) | same}[op]()

    def sub(self, state: dict, rel: str, path: list[Segment]) -> str:
        """Name of a struct column: n matches, and the first one's value."""
        self.n += 1
        name, base = f"q{self.n}", state["base"]
        if rel == "@":
            cur = base.select(*_ID, F.col("pre").alias("ctx"), "pre", "subtree_end", "n_children", F.array().cast("array<int>").alias("rank"))
        else:
            cur = self.start()
        got = self.run(cur, path)
        v = self.nodes.select(F.col("doc_key").alias("v_key"), F.col("doc_ix").alias("v_ix"), F.col("pre").alias("v_pre"), *_VALUE[:-1], F.col("n_children").alias("size"))
        got = got.drop("n_children").join(v, got["doc_key"].eqNullSafe(v["v_key"]) & (got["doc_ix"] == v["v_ix"]) & (got["pre"] == v["v_pre"]))
        got = got.groupBy(*_ID, "ctx").agg(F.count("*").alias("n"), *[F.min_by(c, "rank").alias(c) for c in (*_VALUE[:-1], "size")])
        got = got.select(F.col("doc_key").alias("g_key"), F.col("doc_ix").alias("g_ix"), F.col("ctx").alias("g_ctx"), F.struct("n", *_VALUE[:-1], "size").alias(name))
        df = state["df"]
        on = df["doc_key"].eqNullSafe(got["g_key"]) & (df["doc_ix"] == got["g_ix"])
        if rel == "@":
            on &= df["pre"] == got["g_ctx"]
        state["df"] = df.join(got, on, "left").drop("g_key", "g_ix", "g_ctx")
        return name

    def value(self, state: dict, x: tuple) -> dict[str, Column]:
        none = F.lit(None)
        if x[0] == "lit":
            if x[1] == "num":
                sgn, places, digits, _ = number(x[2]) or (0, 0, "", True)
                k = ordered(sgn, places, digits)
                canon = "0" if not sgn else f"{'-' if sgn < 0 else ''}{digits}e{places - len(digits)}"
                return {"kind": F.lit("num"), "num": F.struct(F.lit(k[0]).alias("sgn"), F.lit(k[1]).cast("long").alias("places"), F.lit(k[2]).alias("digits")), "text": none.cast("string"), "canon": F.lit(canon)}
            from ..operators.shred import quote

            canon = quote(x[2]) if x[1] == "str" else "null" if x[1] == "null" else str(x[2]).lower()
            return {"kind": F.lit(x[1]), "text": F.lit(x[2] if x[1] == "str" else None).cast("string"), "canon": F.lit(canon), "num": none.cast("struct<sgn:int,places:bigint,digits:string>")}
        if x[0] == "query":
            c = self.sub(state, x[1], x[2])
            return {k: F.col(f"{c}.{k}") for k in ("kind", "text", "num", "canon")}
        name, args = x[1], x[2]
        if name == "value":
            c = self.sub(state, args[0][1], args[0][2])
            one = lambda k: F.when(F.col(f"{c}.n") == 1, F.col(f"{c}.{k}"))
            return {k: one(k) for k in ("kind", "text", "num", "canon")}
        if name == "count":
            n = F.coalesce(F.col(self.sub(state, args[0][1], args[0][2]) + ".n"), F.lit(0))
        elif args[0][0] == "query":
            c = self.sub(state, args[0][1], args[0][2])
            n = F.when(F.col(f"{c}.kind") == "str", F.char_length(F.col(f"{c}.text"))).when(F.col(f"{c}.kind").isin("seq", "map"), F.col(f"{c}.size"))
        else:
            v = self.value(state, args[0])
            n = F.when(v["kind"] == "str", F.char_length(v["text"]))
        # an integer as a number key
        t = n.cast("string")
        digits = F.regexp_replace(t, "0+$", "")
        zero = n == 0
        num = F.struct(F.when(zero, 0).otherwise(1).alias("sgn"), F.when(zero, 0).otherwise(F.length(t)).cast("long").alias("places"), F.when(zero, "").otherwise(digits).alias("digits"))
        canon = F.when(zero, F.lit("0")).otherwise(F.concat(digits, F.lit("e"), (F.length(t) - F.length(digits)).cast("string")))
        return {"kind": F.when(n.isNotNull(), F.lit("num")), "num": F.when(n.isNotNull(), num), "canon": F.when(n.isNotNull(), canon), "text": none.cast("string")}


def query_texts(texts: DataFrame, key: str, text: str, path: str, columns: tuple[str, ...] = local.COLUMNS, mode: str = "FAILFAST") -> DataFrame:
    """Matches of a JSONPath in the documents of column `text`, found where each text is read: no node table, join or shuffle.

    Columns as `query`, of which only those named are made; `rank` is the place in
    the nodelist.  The modes are those of `shred`; PERMISSIVE adds a column `error`.
    """
    return local.query_texts(texts, key, text, parse(path), columns, mode)


def query(nodes: DataFrame, path: str) -> DataFrame:
    """Matches of a JSONPath in every document: doc_key, doc_ix, pointer, kind, text, num, json, canon, rank, in no order.

    Sort by rank within a document for the order of the nodelist.
    """
    segments = parse(path)
    plan = Plan(nodes)
    lead = 0
    pointer = ""
    while lead < len(segments) and not segments[lead].descend and len(segments[lead].selectors) == 1 and segments[lead].selectors[0][0] == "name" and not segments[lead].selectors[0][1].isdigit():
        pointer += "/" + segments[lead].selectors[0][1].replace("~", "~0").replace("/", "~1")
        lead += 1
    cur = plan.start()
    if lead > 1 or lead == 1 and len(segments) == 1:
        # leading names are one filter, which reaches a stored node table
        at = plan.nodes.where((F.col("pointer") == pointer) & F.col("key").isNotNull() & (F.col("depth") == lead))
        cur = at.select(*_ID, F.lit(0).alias("ctx"), "pre", "subtree_end", "n_children", F.array().cast("array<int>").alias("rank"))
        segments = segments[lead:]
        if not segments:
            return at.select(*_ID, "pointer", "kind", "text", "num", "json", "canon", F.array().cast("array<int>").alias("rank"))
    got = plan.run(cur, segments)
    v = plan.nodes.select(F.col("doc_key").alias("v_key"), F.col("doc_ix").alias("v_ix"), F.col("pre").alias("v_pre"), "pointer", "kind", "text", "num", "json", "canon")
    return got.join(v, got["doc_key"].eqNullSafe(v["v_key"]) & (got["doc_ix"] == v["v_ix"]) & (got["pre"] == v["v_pre"])).select(*_ID, "pointer", "kind", "text", "num", "json", "canon", "rank")
