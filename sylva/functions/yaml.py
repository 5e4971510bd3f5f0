"""A YAML 1.2 parser for streams of documents, written for shredding: nodes with character spans."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field
from functools import lru_cache

DEPTH = 1024
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
#: What YAML 1.2.2 does not count as printable.
_UNPRINTABLE = re.compile("[^\\t\\n\\r\\x20-\\x7e\\x85\\xa0-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]")

#: Blanks, line breaks and comments; a comment starts the text or follows one of the former.
_GAPS = re.compile(r"(?:[ \t\r\n]+|(?<![^ \t\r\n])#[^\n]*)*")
#: The rest of a plain scalar on its line, outside and inside flow collections.
_PLAIN_BLOCK = re.compile(r"(?:[^\n#:]+|:(?![ \t\n\r]|\Z)|(?<![ \t])#)*")
_PLAIN_FLOW = re.compile(r"(?:[^\n#:,\[\]{}]+|:(?![ \t\n\r,\[\]{}]|\Z)|(?<![ \t])#)*")
_QUOTED = {"'": re.compile(r"[^'\n]+"), '"': re.compile(r'[^"\\\n]+')}
_VERSION = re.compile(r"[0-9]+\.[0-9]+\Z")
_HANDLE = re.compile(r"!(?:[0-9A-Za-z-]*!)?\Z")


_WORDS = r"[^\s#:&*!|>'\"%@`{}\[\],]*(?: [^\s#:&*!|>'\"%@`{}\[\],]+)*"


@lru_cache(maxsize=256)
def _entry_line(col: int) -> re.Pattern:
    """A whole line "key: words" that the next line does not continue."""
    return re.compile(rf"([A-Za-z_][A-Za-z0-9_-]*): ([A-Za-z0-9_./+]{_WORDS})\n(?= {{0,{col}}}[^\s#])")


class YamlError(ValueError):
    def __init__(self, message: str, at: int):
        super().__init__(message)
        self.at = at


@dataclass(slots=True)
class Node:
    kind: str  # map, seq, scalar, alias
    style: str  # block, flow, plain, single, double, literal, folded
    start: int
    end: int = 0
    value: str = ""
    tag: str | None = None
    anchor: str | None = None
    items: list = field(default_factory=list)  # seq: nodes; map: (key, value) pairs
    mark: int = -1  # of an explicit key: where its "?" stands


class Parser:
    def __init__(self, text: str):
        self.s, self.n, self.i = text, len(text), 0
        self.head = int(text.startswith("\ufeff"))  # a byte order mark takes no column
        self.tags = {"!": "!", "!!": "tag:yaml.org,2002:"}
        self.depth = 0
        #: of each document: directives as (name, parameters, start, end), whether --- and ... are written
        self.frames: list[dict] = []

    # -- places
    def peek(self, k: int = 0) -> str:
        j = self.i + k
        return self.s[j] if j < self.n else ""

    def column(self, at: int) -> int:
        line = self.s.rfind("\n", 0, at) + 1
        return at - (line or self.head)

    def blank_after(self, at: int) -> bool:
        return at >= self.n or self.s[at] in " \t\n\r"

    def marker(self, at: int) -> bool:
        return self.s[at : at + 3] in ("---", "...") and self.blank_after(at + 3) and (at == self.head or self.s[at - 1] == "\n")

    def fail(self, message: str, at: int | None = None):
        raise YamlError(message, self.i if at is None else at)

    def skip(self) -> bool:
        """Pass blanks, comments and line breaks; true if a line break was passed."""
        at = self.i
        self.i = _GAPS.match(self.s, at).end()
        return self.i > at and self.s.find("\n", at, self.i) >= 0

    def spaces(self, at: int) -> int:
        """Spaces that the line of `at` begins with: tabs do not indent."""
        start = j = self.s.rfind("\n", 0, at) + 1
        while j < at and self.s[j] == " ":
            j += 1
        return j - start

    def indent_ok(self) -> None:
        start = self.s.rfind("\n", 0, self.i) + 1
        if "\t" in self.s[start : self.i]:
            self.fail("tab in indentation")

    # -- stream
    def stream(self) -> list[Node | None]:
        docs: list[Node | None] = []
        self.i = self.head
        while True:
            directives = []
            self.tags = {"!": "!", "!!": "tag:yaml.org,2002:"}
            while True:
                self.skip()
                if self.peek() == "%" and self.column(self.i) == 0:
                    j = self.s.find("\n", self.i)
                    words = self.s[self.i : self.n if j < 0 else j].split()
                    params = next((words[:k] for k, w in enumerate(words) if w.startswith("#")), words)
                    if words[0] == "%YAML" and not (len(params) == 2 and _VERSION.match(params[1])):
                        self.fail("a YAML directive has one version")
                    if words[0] == "%TAG":
                        if len(params) != 3 or not _HANDLE.match(params[1]):
                            self.fail("a TAG directive has a handle and a prefix")
                        if any(d[0] == "TAG" and d[1][0] == params[1] for d in directives):
                            self.fail("two TAG directives for one handle")
                        self.tags[params[1]] = params[2]
                    if words[0] == "%YAML" and any(d[0] == "YAML" for d in directives):
                        self.fail("two YAML directives")
                    directives.append((params[0][1:], params[1:], self.i, self.n if j < 0 else j))
                    self.i = self.n if j < 0 else j
                elif self.marker(self.i) and self.s[self.i] == ".":
                    if directives:
                        self.fail("directives without a document")
                    if self.frames:
                        self.frames[-1]["ended"] = True
                    self.i += 3
                else:
                    break
            if self.i >= self.n:
                if directives:
                    self.fail("directives without a document")
                return docs
            explicit = self.marker(self.i)
            if explicit:
                self.i += 3
            elif directives:
                self.fail("expected ---")
            self.frames.append({"directives": directives, "explicit": explicit, "ended": False})
            docs.append(self.node(0, -1, bool(explicit)))
            self.skip()
            if self.i < self.n and not self.marker(self.i):
                self.fail("content after the document's end")

    # -- nodes
    def properties(self) -> tuple[str | None, str | None, int]:
        tag = anchor = None
        first = -1
        while self.peek() in ("&", "!"):
            at = self.i
            stop = at
            while stop < self.n and self.s[stop] not in " \t\n\r" and not (self.flow and self.s[stop] in ",[]{}"):
                stop += 1
            word = self.s[at:stop]
            if word[0] == "&":
                if anchor is not None or len(word) < 2:
                    self.fail("bad anchor")
                anchor = word[1:]
            else:
                if tag is not None:
                    self.fail("two tags")
                tag = self.tag(word)
            first = at if first < 0 else first
            self.i = stop
            while self.peek() and self.peek() in " \t":
                self.i += 1
        return tag, anchor, first

    def tag(self, word: str) -> str:
        if word.startswith("!<") and word.endswith(">"):
            return word[2:-1]
        k = word.find("!", 1)
        handle, rest = (word[: k + 1], word[k + 1 :]) if k > 0 else ("!", word[1:])
        if handle not in self.tags:
            self.fail("unknown tag handle")
        return self.tags[handle] + rest if rest or handle != "!" else "!"

    flow = 0

    def node(self, least: int, parent: int, inline: bool, seq_same: bool = False) -> Node | None:
        """The block node that starts here; None if there is none at column `least` or more.

        inline: content may start on the current line, but no block collection may;
        seq_same: a block sequence may stand at column parent.
        """
        self.depth += 1
        if self.depth > DEPTH:
            self.fail("nested too deeply")
        try:
            fresh = not inline
            compact = not inline
            if self.skip():
                fresh = compact = True
            floor = parent if seq_same and fresh and self.peek() == "-" and self.blank_after(self.i + 1) else least
            if self.i >= self.n or self.marker(self.i) or fresh and self.column(self.i) < floor:
                return None
            if fresh and inline and least > 0 and self.spaces(self.i) < floor:
                self.fail("tab in indentation")
            tag, anchor, first = self.properties()
            moved = False
            if first >= 0:
                at = self.i
                moved = self.skip()
                if moved:
                    floor = parent if seq_same and self.peek() == "-" and self.blank_after(self.i + 1) else least
                if self.i >= self.n or self.marker(self.i) or moved and self.column(self.i) < floor:
                    self.i = at if not moved else self.i
                    return Node("scalar", "plain", first, at, "", tag, anchor)
                compact = compact or moved
            c, start = self.peek(), self.i
            if c == "-" and self.blank_after(start + 1):
                if not compact or first >= 0 and not moved:
                    self.fail("block sequence not allowed here")
                out = self.block_seq(self.column(start))
            elif c in "|>" and c:
                out = self.block_scalar(parent)
            elif c == "?" and self.blank_after(start + 1):
                if not compact:
                    self.fail("block mapping not allowed here")
                out = self.block_map(self.column(start), None)
            else:
                key_props = (tag, anchor, first) if first >= 0 and not moved else None
                out = self.flow_node(least, True)
                if self.key_follows(start, out):
                    if not compact:
                        self.fail("nested mapping on one line")
                    if key_props:
                        out.tag, out.anchor, out.start = tag or out.tag, anchor or out.anchor, first
                        tag = anchor = None
                        first = -1
                    out = self.block_map(self.column(out.start), out)
            if out.kind == "alias" and (tag or anchor):
                self.fail("an alias takes no properties")
            out.tag, out.anchor = tag or out.tag, anchor or out.anchor
            return out
        finally:
            self.depth -= 1

    def key_follows(self, start: int, out: Node) -> bool:
        j = out.end
        while j < self.n and self.s[j] in " \t":
            j += 1
        if j < self.n and self.s[j] == ":" and self.blank_after(j + 1):
            if "\n" in self.s[start : out.end]:
                self.fail("a key spans lines")
            self.i = j
            return True
        return False

    def block_seq(self, col: int) -> Node:
        self.indent_ok_here(col)
        out = Node("seq", "block", self.i)
        while True:
            self.i += 1
            at = self.i
            item = self.entry(col)
            out.items.append(item or Node("scalar", "plain", at, at))
            out.end = max(at, item.end if item else at)
            keep = self.i
            self.skip()
            if self.i < self.n and self.column(self.i) == col and self.peek() == "-" and self.blank_after(self.i + 1) and not self.marker(self.i):
                continue
            if self.i < self.n and self.column(self.i) > col and not self.marker(self.i):
                self.fail("bad indentation in a sequence")
            self.i = keep
            return out

    def entry(self, col: int) -> Node | None:
        """A value after "-", "?" or ":" that may be a compact collection."""
        return self.node(col + 1, col, False)

    def indent_ok_here(self, col: int) -> None:
        start = self.s.rfind("\n", 0, self.i) + 1
        if "\t" in self.s[start : start + col]:
            self.fail("tab in indentation")

    def block_map(self, col: int, key: Node | None) -> Node:
        out = Node("map", "block", key.start if key else self.i)
        if key:
            self.indent_ok_here(col)
        line = _entry_line(col)
        while True:
            if key is None and (m := line.match(self.s, self.i)):
                out.items.append((Node("scalar", "plain", m.start(1), m.end(1), m[1]), Node("scalar", "plain", m.start(2), m.end(2), m[2])))
                out.end = self.i = m.end(2)
                if not self.next_key(col):
                    return out
                continue
            if key is None:
                if self.peek() == "?" and self.blank_after(self.i + 1):
                    mark = self.i
                    self.i += 1
                    at = self.i
                    key = self.entry(col) or Node("scalar", "plain", at, at)
                    key.mark = mark
                    keep = self.i
                    self.skip()
                    if not (self.i < self.n and self.column(self.i) == col and self.peek() == ":" and self.blank_after(self.i + 1)):
                        self.i = keep
                        out.items.append((key, Node("scalar", "plain", key.end, key.end)))
                        out.end, key = key.end, None
                        if self.next_key(col):
                            continue
                        return out
                    explicit = True
                elif self.peek() == ":" and self.blank_after(self.i + 1):
                    key, explicit = Node("scalar", "plain", self.i, self.i), True
                else:
                    start = self.i
                    tag, anchor, first = self.properties()
                    key = self.flow_node(col + 1, True) if not (self.peek() == ":" and self.blank_after(self.i + 1)) else Node("scalar", "plain", self.i, self.i)
                    key.tag, key.anchor, key.start = tag or key.tag, anchor or key.anchor, first if first >= 0 else key.start
                    if not self.key_follows(start, key):
                        self.fail("expected a key", start)
                    explicit = False
            else:
                explicit = False
            self.i += 1  # the colon
            at = self.i
            value = self.entry(col) if explicit else self.node(col + 1, col, True, True)
            value = value or Node("scalar", "plain", at, at)
            out.items.append((key, value))
            out.end, key = max(at, value.end), None
            if not self.next_key(col):
                return out

    def next_key(self, col: int) -> bool:
        keep = self.i
        line = self.skip()
        if self.i < self.n and not self.marker(self.i):
            c = self.column(self.i)
            if c == col and (line or self.s[keep - 1 : keep] == "\n") and not (self.peek() == "-" and self.blank_after(self.i + 1)):
                return True
            if c > col or not line and self.s[keep - 1 : keep] != "\n":
                self.fail("bad indentation in a mapping")
        self.i = keep
        return False

    def block_scalar(self, parent: int) -> Node:
        out = Node("scalar", "literal" if self.peek() == "|" else "folded", self.i)
        self.i += 1
        chomp, given = "", 0
        while self.peek() and self.peek() in "+-123456789":
            if self.peek() in "+-":
                if chomp:
                    self.fail("bad block scalar header")
                chomp = self.peek()
            else:
                if given:
                    self.fail("bad block scalar header")
                given = int(self.peek())
            self.i += 1
        j = self.s.find("\n", self.i)
        rest = self.s[self.i : self.n if j < 0 else j].rstrip("\r")
        if rest.strip(" \t") and not (rest[0] in " \t" and rest.lstrip(" \t").startswith("#")):
            self.fail("text after a block scalar header")
        self.i = self.n if j < 0 else j + 1
        level = max(parent, 0) + given if given and parent >= 0 else given if given else -1
        lines: list[str] = []
        end = self.i
        while self.i < self.n and not self.marker(self.i):
            j = self.s.find("\n", self.i)
            stop = self.n if j < 0 else j
            raw = self.s[self.i : stop].rstrip("\r")
            pad = len(raw) - len(raw.lstrip(" "))
            if raw.strip(" ") == "" and (level < 0 or pad <= level):
                lines.append("")
            else:
                if level < 0:
                    if pad <= parent:
                        break
                    level = pad
                if pad < level:
                    if raw.lstrip(" ").startswith("\t") and pad > parent:
                        self.fail("tab in a block scalar's indentation")
                    break
                lines.append(raw[level:])
            self.i = self.n if j < 0 else j + 1
            end = stop
        body = len(lines)
        while body and lines[body - 1] == "":
            body -= 1
        tail = len(lines) - body
        if out.style == "literal":
            text = "\n".join(lines[:body])
        else:
            text, prev, gap = "", None, 0
            for x in lines[:body]:
                if x == "":
                    gap += 1
                    continue
                if prev is None:
                    text = "\n" * gap + x
                elif x[0] in " \t" or prev[0] in " \t":
                    text += "\n" * (gap + 1) + x
                else:
                    text += ("\n" * gap if gap else " ") + x
                prev, gap = x, 0
        if chomp == "+":
            text += "\n" * (tail + (1 if body else 0))
        elif chomp == "" and body:
            text += "\n"
        out.value, out.end = text, end
        return out

    # -- flow nodes
    def flow_node(self, least: int, block: bool) -> Node:
        c, start = self.peek(), self.i
        if c == "*":
            stop = start + 1
            while stop < self.n and self.s[stop] not in " \t\n\r,[]{}":
                stop += 1
            if stop == start + 1:
                self.fail("empty alias")
            self.i = stop
            return Node("alias", "plain", start, stop, self.s[start + 1 : stop])
        if c == '"':
            return self.quoted(least, '"')
        if c == "'":
            return self.quoted(least, "'")
        if c in ("[", "{"):
            return self.flow_collection(least)
        if c in ",]}#&!|>%@`" or c in "-?:" and (self.blank_after(start + 1) or not block and self.s[start + 1] in ",[]{}"):
            self.fail(f"unexpected {c!r}")
        return self.plain(least, block)

    def fold(self, lines: list[str]) -> str:
        out, gap = lines[0], 0
        for x in lines[1:]:
            if x == "":
                gap += 1
            else:
                out += ("\n" * gap if gap else " ") + x
                gap = 0
        return out + "\n" * gap

    def plain(self, least: int, block: bool) -> Node:
        start, lines, end = self.i, [], self.i
        while True:
            j = (_PLAIN_BLOCK if block else _PLAIN_FLOW).match(self.s, self.i).end()
            if j == self.i and self.s[j : j + 1] == "#":  # as at the start of a following line's piece
                j = (_PLAIN_BLOCK if block else _PLAIN_FLOW).match(self.s, j + 1).end()
            piece = self.s[self.i : j].rstrip(" \t\r")
            lines.append(piece)
            end = self.i + len(piece)
            if j >= self.n or self.s[j] != "\n":
                break
            k, blanks = j, 0
            while k < self.n:  # next line that is not blank
                e = self.s.find("\n", k + 1)
                e = self.n if e < 0 else e
                if self.s[k + 1 : e].strip(" \t\r"):
                    break
                k = e
                blanks += 1
            if k >= self.n:
                break
            p = k + 1
            while self.s[p] in " \t":
                p += 1
            if p - k - 1 < least or self.s[p] == "#" or self.marker(k + 1) or not block and self.s[p] in ",[]{}" or self.s[p] == ":" and self.blank_after(p + 1):
                break
            if block:  # a line that holds a key is not part of the scalar
                e = self.s.find("\n", p)
                line = self.s[p : self.n if e < 0 else e]
                cut = line.find(": ")
                if (cut >= 0 or line.rstrip().endswith(":")) and " #" not in line[: cut if cut >= 0 else None]:
                    self.fail("a key inside a scalar of several lines", p)
            lines += [""] * blanks
            self.i = p
        self.i = end
        return Node("scalar", "plain", start, end, self.fold(lines))

    def quoted(self, least: int, q: str) -> Node:
        start, j, parts, line = self.i, self.i + 1, [], ""
        keep = 0  # characters of line that blanks after them may not remove
        while True:
            if j >= self.n:
                self.fail("unterminated quoted scalar", start)
            c = self.s[j]
            if c == q:
                if q == "'" and self.s[j + 1 : j + 2] == "'":
                    line += "'"
                    j += 2
                    continue
                break
            if c == "\\" and q == '"':
                e = self.s[j + 1 : j + 2]
                if e in ("\n", "\r"):
                    j = self.s.index("\n", j) + 1
                    while self.s[j : j + 1] and self.s[j] in " \t":
                        j += 1
                    keep = len(line)
                    continue
                if e in ("x", "u", "U"):
                    k = {"x": 2, "u": 4, "U": 8}[e]
                    try:
                        code = int(self.s[j + 2 : j + 2 + k], 16)
                        if len(self.s[j + 2 : j + 2 + k]) < k:
                            raise ValueError
                        j += 2 + k
                        if 0xD800 <= code < 0xDC00 and self.s[j : j + 2] == "\\u":
                            code = 0x10000 + ((code - 0xD800) << 10) + int(self.s[j + 2 : j + 6], 16) - 0xDC00
                            j += 6
                        line += chr(code)
                    except ValueError:
                        self.fail("bad escape", j)
                elif e and e in _ESCAPES:
                    line += _ESCAPES[e]
                    j += 2
                else:
                    self.fail("bad escape", j)
                keep = len(line)
                continue
            if c == "\n":
                parts.append(line[:keep] + line[keep:].rstrip(" \t\r"))
                j += 1
                if self.marker(j):
                    self.fail("unterminated quoted scalar", start)
                k = j
                while k < self.n and self.s[k] in " \t":
                    k += 1
                if k < self.n and self.s[k] != "\n" and k - j < least and not self.flow and self.s[k] != "\r":
                    self.fail("a quoted scalar is indented too little", k)
                j, line, keep = k, "", 0
                continue
            m = _QUOTED[q].match(self.s, j)
            line += m[0]
            j = m.end()
        parts.append(line)
        if len(parts) > 2:
            parts[1:-1] = [p.lstrip(" \t") if not p.strip(" \t") else p for p in parts[1:-1]]
        text = parts[0]
        gap = 0
        for k, x in enumerate(parts[1:], 1):
            if x == "" and k < len(parts) - 1:
                gap += 1
            else:
                text += ("\n" * gap if gap else " ") + x
                gap = 0
        self.i = j + 1
        return Node("scalar", "double" if q == '"' else "single", start, self.i, text)

    def flow_collection(self, least: int) -> Node:
        self.depth += 1
        if self.depth > DEPTH:
            self.fail("nested too deeply")
        self.flow += 1
        close = "]" if self.peek() == "[" else "}"
        out = Node("seq" if close == "]" else "map", "flow", self.i)
        self.i += 1
        ready = True
        while True:
            self.flow_skip(least)
            if self.i >= self.n:
                self.fail("unterminated flow collection", out.start)
            if self.peek() == close:
                self.i += 1
                break
            if self.peek() == ",":
                if ready:
                    self.fail("empty flow entry")
                self.i += 1
                ready = True
                continue
            if not ready:
                self.fail("expected , in a flow collection")
            ready = False
            pair, mark = self.peek() == "?" and self.blank_after(self.i + 1), self.i
            if pair:
                self.i += 1
                self.flow_skip(least)
            key = self.flow_value(least)
            key.mark = mark if pair else -1
            after = self.i
            self.flow_skip(least)
            quick = key.style in ("single", "double", "flow") or key.kind == "alias"
            if self.peek() == ":" and (quick and (pair or out.kind == "map" or self.i == after) or self.blank_after(self.i + 1) or self.s[self.i + 1] in ",[]{}"):
                if out.kind == "seq" and not pair and "\n" in self.s[key.start : self.i]:
                    self.fail("a key spans lines")
                self.i += 1
                self.flow_skip(least)
                value = self.flow_value(least)
            elif pair or out.kind == "map":
                self.i = after
                value = Node("scalar", "plain", after, after)
            else:
                self.i = after
                out.items.append(key)
                continue
            if out.kind == "map":
                out.items.append((key, value))
            else:
                out.items.append(Node("map", "flow", key.start, value.end, items=[(key, value)]))
        out.end = self.i
        self.flow -= 1
        self.depth -= 1
        return out

    def flow_skip(self, least: int) -> None:
        if self.skip():
            if self.i < self.n and (self.marker(self.i) or self.spaces(self.i) < least and self.peek() not in "]}"):
                self.fail("a flow collection is indented too little")

    def flow_value(self, least: int) -> Node:
        tag, anchor, first = self.properties()
        if first >= 0:
            self.flow_skip(least)
        c = self.peek()
        if c in (",", "]", "}", "") or c == ":" and (self.blank_after(self.i + 1) or self.s[self.i + 1] in ",[]{}"):
            return Node("scalar", "plain", first if first >= 0 else self.i, self.i, "", tag, anchor)
        out = self.flow_node(least, False)
        if out.kind == "alias" and (tag or anchor):
            self.fail("an alias takes no properties")
        out.tag, out.anchor = tag or out.tag, anchor or out.anchor
        return out


def position(text: str, at: int) -> tuple[int, int]:
    """Line and column, from 1, in characters; lines end at U+000A."""
    return text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at)


def byte_offsets(text: str):
    """A function from character offsets to byte offsets; one pass over a text that is not ASCII."""
    if text.isascii():
        return lambda at: at
    import numpy as np

    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    table = np.r_[0, np.cumsum(size)].tolist()
    return table.__getitem__


def parse(text: str) -> list[Node | None]:
    """Documents of a stream; an empty document is None.  Raises YamlError."""
    return framed(text)[0]


def framed(text: str) -> tuple[list[Node | None], list[dict]]:
    """Documents of a stream and their frames: directives and written markers."""
    if sys.getrecursionlimit() < 20_000:
        sys.setrecursionlimit(20_000)
    if m := _UNPRINTABLE.search(text):
        raise YamlError(f"character U+{ord(m[0]):04X} is not allowed", m.start())
    p = Parser(text)
    return p.stream(), p.frames
