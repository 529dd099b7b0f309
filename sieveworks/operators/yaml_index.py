"""An index of the mappings of YAML texts: where each stands, and its scalar values with their spans.

A small event parser over an indentation stack, for detectors that look for values in known places.
Aliases are not expanded, tags and anchors are passed over. Text that is no YAML, or nested deeper than
MAX_DEPTH, has no index.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MAX_DEPTH = 64
#: The longest key that may stand on a line without a question mark before it.
MAX_KEY = 1024

_DOUBLE = re.compile(r'"((?:[^"\\]++|\\.)*+)"', re.S)
_SINGLE = re.compile(r"'((?:[^']++|'')*+)'")
_COLON = re.compile(r"[ \t]*+:(?=[ \t\r\n]|\Z)")
_PLAIN_KEY = re.compile(r"((?:[^\s:#]++|:(?=[^\s])|[ \t]++(?![#:\s])|(?<=\S)#)++)[ \t]*+:(?=[ \t\r\n]|\Z)")
_PLAIN_LINE = re.compile(r"(?:[^\s:#]++|:(?=[^\s])|[ \t]++(?=[^#\s])|(?<=\S)#)++")
_FLOW_END = re.compile(r"[,\[\]{}]|:(?=[\s,\[\]{}]|\Z)|(?<=\s)#")
_HEADER = re.compile(r"([|>])([+-]?[1-9]?|[1-9][+-]?)[ \t]*+(?:(?<=[ \t])#[^\n]*+)?(?:\r?\n|\Z)")
_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|\r?\n[ \t]*|(.))", re.S)
# What escaped letters of double-quoted scalars stand for.
_NAMED = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}


@dataclass
class Mapping:
    """A mapping: its number, that of the mapping that it stands in (through sequences, too; -1 at the top),
    under which key, and its scalar values as (key, value, start, end)."""

    number: int
    parent: int
    key: str
    values: list[tuple[str, str, int, int]] = field(default_factory=list)


def _folded(text: str) -> str:
    """Line breaks within a plain or quoted scalar: one is a space, each further one a line feed."""
    if "\n" not in text:
        return text
    lines = text.replace("\r\n", "\n").split("\n")
    out, gap = [lines[0].rstrip(" \t")], 0
    for line in lines[1:-1]:
        if body := line.strip(" \t"):
            out += ["\n" * gap if gap else " ", body]
            gap = 0
        else:
            gap += 1
    return "".join(out) + ("\n" * gap if gap else " ") + lines[-1].lstrip(" \t")


def _folded_lines(lines: list[str]) -> str:
    """The lines of a folded block scalar: breaks between two that begin at the margin fold, others stay."""
    out, before, gap = [], "", 0
    for line in lines:
        if not line:
            gap += 1
            continue
        further = line[0] in " \t" or before[:1] in (" ", "\t")
        out += ["\n" * (gap + (further and bool(before))) or (" " if before else ""), line]
        before, gap = line, 0
    return "".join(out)


def _character(m: re.Match) -> str:
    if code := m[1] or m[2] or m[3]:
        return chr(int(code, 16))
    return _NAMED.get(m[4], m[4]) if m[4] else ""


def _double(body: str) -> str:
    """What a double-quoted scalar stands for. Escaped line breaks go, others fold, then escapes count."""
    body = re.sub(r"((?:^|[^\\])(?:\\\\)*)\\\r?\n[ \t]*", r"\1", body)
    return _ESCAPE.sub(_character, _folded(body))


class YamlIndex:
    """The mappings of all documents of a text; raises ValueError if it is no YAML."""

    def __init__(self, text: str):
        self.t, self.n, self.i = text, len(text), 1 if text.startswith("\ufeff") else 0
        self.mappings: list[Mapping] = []
        while True:
            self.skip()
            if self.i >= self.n:
                return
            if self.marker():
                self.i += 3
            elif self.t[self.i] == "%" and not self.column():
                self.i = self.line_end()
            else:
                self.node(-1, None, -1, "", 0, inline=False)
                self.skip()
                if self.i < self.n and not self.marker():
                    raise ValueError("content behind the end of a document")

    def column(self) -> int:
        return self.i - self.t.rfind("\n", 0, self.i) - 1

    def line_end(self) -> int:
        end = self.t.find("\n", self.i)
        return self.n if end < 0 else end

    def marker(self) -> bool:
        """Whether a line that parts documents begins here."""
        t, i = self.t, self.i
        return t[i : i + 3] in ("---", "...") and (not i or t[i - 1] == "\n") and t[i + 3 : i + 4] in ("", " ", "\t", "\r", "\n")

    def skip(self) -> bool:
        """Go on to the next token, over space and comments; whether that is on another line."""
        t, at = self.t, self.i
        while self.i < self.n:
            c = t[self.i]
            if c in " \t\r\n":
                self.i += 1
            elif c == "#" and (not self.i or t[self.i - 1] in " \t\r\n"):
                self.i = self.line_end()
            else:
                break
        return "\n" in t[at : self.i]

    def mark(self, c: str) -> bool:
        """Whether this indicator stands here, with space or nothing behind it."""
        return self.t[self.i : self.i + 1] == c and self.t[self.i + 1 : self.i + 2] in ("", " ", "\t", "\r", "\n")

    def properties(self) -> bool:
        """Pass over anchors and tags; whether that led to another line."""
        crossed = False
        while self.i < self.n and self.t[self.i] in "&!":
            self.i = re.compile(r"[^\s,\[\]{}]*+").match(self.t, self.i + 1).end()
            crossed |= self.skip()
        return crossed

    def key(self) -> tuple[str, int] | None:
        """The key that stands here with its colon, on one line, and where its colon ends."""
        c, most = self.t[self.i], min(self.n, self.i + MAX_KEY)
        if c in "\"'":
            m = (_DOUBLE if c == '"' else _SINGLE).match(self.t, self.i, most)
            colon = m and "\n" not in m[0] and _COLON.match(self.t, m.end())
            return (_double(m[1]) if c == '"' else m[1].replace("''", "'"), colon.end()) if colon else None
        m = None if c in "[{|>%@`*" else _PLAIN_KEY.match(self.t, self.i, most)
        return (m[1].rstrip(" \t"), m.end()) if m and m.end() < most + (most == self.n) else None

    def node(self, indent: int, into: int | None, owner: int, key: str, depth: int, inline: bool) -> None:
        """A block node, indented by more than `indent`. into: the mapping whose value under `key` it is;
        owner: the mapping that it stands in. inline: it goes on behind a key on the same line."""
        if self.properties():
            inline = False
            if self.i >= self.n or self.marker() or self.column() <= indent and not (into is not None and self.column() == indent and self.mark("-")):
                return
        if self.i >= self.n:
            return
        c = self.t[self.i]
        if not inline and self.mark("-"):
            self.sequence(owner, key, depth)
        elif not inline and (self.mark("?") or self.key()):
            self.mapping(owner, key, depth)
        elif c in "[{":
            self.flow(owner, key, depth)
        elif c == "*":
            self.i = re.compile(r"\S++").match(self.t, self.i).end()
        else:
            if inline and self.key():
                raise ValueError("a key behind a key")
            value, start, end = self.block_scalar(indent) if c in "|>" else self.quoted() if c in "\"'" else self.plain(indent)
            if into is not None:
                self.mappings[into].values.append((key, value, start, end))

    def deepen(self, depth: int) -> None:
        if depth >= MAX_DEPTH:
            raise ValueError("nested too deeply")

    def begin(self, parent: int, key: str) -> int:
        self.mappings.append(Mapping(len(self.mappings), parent, key))
        return len(self.mappings) - 1

    def mapping(self, owner: int, key: str, depth: int) -> None:
        self.deepen(depth)
        number, indent = self.begin(owner, key), self.column()
        while True:
            self.properties()
            name, inline = "", True
            if self.mark("?"):
                self.i += 1
                self.skip()
                self.node(indent, None, number, "", depth + 1, inline=False)
                self.skip()
                if self.i < self.n and self.column() == indent and self.mark(":"):
                    self.i += 1
                    inline = False
                else:
                    name = None
            elif found := self.key():
                name, self.i = found
            else:
                raise ValueError("no key")
            if name is not None:
                crossed = self.skip()
                if self.i < self.n and not self.marker():
                    if not crossed:
                        self.node(indent, number, number, name, depth + 1, inline)
                    elif self.column() > indent or self.column() == indent and self.mark("-"):
                        self.node(indent - self.mark("-"), number, number, name, depth + 1, inline=False)
            self.skip()
            if self.i >= self.n or self.marker() or self.column() < indent:
                return
            if self.column() > indent:
                raise ValueError("indented by too much")

    def sequence(self, owner: int, key: str, depth: int) -> None:
        self.deepen(depth)
        indent = self.column()
        while self.i < self.n and not self.marker() and self.column() == indent and self.mark("-"):
            self.i += 1
            crossed = self.skip()
            if self.i < self.n and not self.marker() and not (crossed and self.column() <= indent):
                self.node(indent, None, owner, key, depth + 1, inline=False)
                self.skip()

    def plain(self, indent: int) -> tuple[str, int, int]:
        start = end = self.i
        while m := _PLAIN_LINE.match(self.t, self.i):
            self.i = end = m.end()
            rest = self.t[self.i : self.line_end()].strip(" \t\r")
            if rest.startswith(":"):
                raise ValueError("a key inside a scalar")
            crossed = self.t.find("\n", self.i, self.i + 1 + len(self.t[self.i : self.line_end()]))
            # A comment ends it, and so does whatever is indented by less.
            if rest or crossed < 0:
                break
            self.i = crossed
            while self.i < self.n and self.t[self.i] in " \t\r\n":
                self.i += 1
            if self.i >= self.n or self.marker() or self.column() <= indent or self.t[self.i] == "#":
                break
        else:
            if end == start:
                raise ValueError("no scalar")
        self.i = max(self.i, end)
        return _folded(self.t[start:end]), start, end

    def quoted(self) -> tuple[str, int, int]:
        double = self.t[self.i] == '"'
        m = (_DOUBLE if double else _SINGLE).match(self.t, self.i)
        if not m:
            raise ValueError("a quote that is not closed")
        self.i = m.end()
        return (_double(m[1]) if double else _folded(m[1].replace("''", "'"))), m.start(1), m.end(1)

    def block_scalar(self, indent: int) -> tuple[str, int, int]:
        m = _HEADER.match(self.t, self.i)
        if not m:
            raise ValueError("no block scalar")
        digit = "".join(c for c in m[2] if c.isdigit())
        width = max(indent, 0) + int(digit) if digit else 0
        self.i, lines, start, end = m.end(), [], m.end(), m.end()
        while self.i < self.n and not self.marker():
            stop = self.line_end()
            line = self.t[self.i : stop].rstrip("\r")
            body = line.lstrip(" ")
            if body and not width:
                width = max(len(line) - len(body), indent + 1)
                start = self.i + width
            if body and len(line) - len(body) < width:
                break
            lines.append(line[width:] if width else "")
            end = self.i + len(line) if body else end
            self.i = min(stop + 1, self.n)
        kept = len(lines)
        while kept and not lines[kept - 1]:
            kept -= 1
        text = "\n".join(lines[:kept]) if m[1] == "|" else _folded_lines(lines[:kept])
        tail = "" if "-" in m[2] or not kept else "\n" * (len(lines) - kept + 1) if "+" in m[2] else "\n"
        return text + tail, min(start, end), end

    def flow(self, owner: int, key: str, depth: int) -> None:
        """A collection in brackets or braces."""
        self.deepen(depth)
        braces = self.t[self.i] == "{"
        number = self.begin(owner, key) if braces else -1
        self.i += 1
        while True:
            self.skip()
            if self.i >= self.n:
                raise ValueError("a bracket that is not closed")
            c = self.t[self.i]
            if c in "]}":
                if (c == "}") != braces:
                    raise ValueError("another bracket closes")
                self.i += 1
                return
            if c == ",":
                self.i += 1
                continue
            if self.mark("?"):
                self.i += 1
                self.skip()
            first = self.flow_node(number if braces else owner, "" if braces else key, depth)
            self.skip()
            if self.t[self.i : self.i + 1] != ":":
                continue
            # A pair; between brackets it is a mapping of its own.
            self.i += 1
            self.skip()
            name, inside = first[0] if first else "", number if braces else self.begin(owner, key)
            if self.t[self.i : self.i + 1] not in ("", ",", "]", "}"):
                value = self.flow_node(inside, name, depth)
                if value:
                    self.mappings[inside].values.append((name, *value))

    def flow_node(self, owner: int, key: str, depth: int) -> tuple[str, int, int] | None:
        """A node between brackets: a scalar, or None for a collection or an alias."""
        self.properties()
        c = self.t[self.i : self.i + 1]
        if c and c in "[{":
            self.flow(owner, key, depth + 1)
            return None
        if c and c in "\"'":
            return self.quoted()
        start, m = self.i, _FLOW_END.search(self.t, self.i)
        if not m or c and c in ",]}":
            if m:
                return None
            raise ValueError("a bracket that is not closed")
        text = self.t[start : m.start()].rstrip()
        if not text and m[0] != ":":
            raise ValueError("no scalar")
        self.i = m.start()
        return None if c == "*" else (_folded(text), start, start + len(text))


def yaml_mappings(text: str) -> list[Mapping]:
    """The mappings of a text; none if it is no YAML."""
    try:
        return YamlIndex(text).mappings
    except ValueError:
        return []
