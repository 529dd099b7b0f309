"""The predicate language of rule sets, compiled to a Column.

Operators: ! && || == != < <= > >= contains starts_with ends_with matches, and parentheses. Types are
checked when compiling. Text beyond 65,536 characters or lists beyond 256 items make the whole
expression false, wherever they are met in evaluation; so every operand carries null for "gave
up", and && and || pass it on in their order of evaluation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import to_java

# The fields that can be read, with their types, and the limits.
SOURCE_FIELDS = {"source.path": "string", "source.symlink": "string"}
FINDING_FIELDS = {
    "finding.rule_id": "string", "finding.description": "string", "finding.match": "string", "finding.secret": "string", "finding.line": "string",
    "finding.start_line": "number", "finding.end_line": "number", "finding.start_column": "number", "finding.end_column": "number", "finding.entropy": "number",
    "finding.randomness_score": "number", "finding.decode_depth": "number", "finding.is_decoded": "boolean", "finding.tags": "list", "finding.decode_path": "list",
    "finding.severity": "string", "finding.confidence": "string", "finding.rule_pack": "string", "finding.provider": "string",
}
MAX_TEXT, MAX_TOKENS, MAX_NESTING, MAX_LITERAL, MAX_REGEXES = 4096, 256, 16, 1024, 32
MAX_STRING, MAX_LIST = 65_536, 256
_TOKEN = re.compile(r"""\s*(?:(&&|\|\||==|!=|<=|>=|[!<>()])|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([A-Za-z_][\w.]*))""", re.S)
_TEXT_OPS = {"contains", "starts_with", "ends_with", "matches"}


class PredicateError(ValueError):
    """An expression that breaks the grammar, the typing or a limit."""


@dataclass
class _Value:
    column: Column
    type: str
    literal: object = None


def _tokens(text: str) -> list[tuple[str, object]]:
    if len(text.encode()) > MAX_TEXT:
        raise PredicateError("the expression is too long")
    out: list[tuple[str, object]] = []
    at = 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise PredicateError(f"unexpected text at {at}")
        at = m.end()
        op, number, double, single, word = m.groups()
        if op:
            out.append(("op", op))
        elif number is not None:
            out.append(("number", float(number)))
        elif word is not None:
            out.append(("op", word) if word in _TEXT_OPS else ("boolean", word == "true") if word in ("true", "false") else ("field", word))
        else:
            value = re.sub(r"\\(.)", lambda e: {"n": "\n", "r": "\r", "t": "\t"}.get(e[1], e[1]), double if double is not None else single, flags=re.S)
            if len(value.encode()) > MAX_LITERAL:
                raise PredicateError("a literal is too long")
            out.append(("string", value))
    if len(out) > MAX_TOKENS:
        raise PredicateError("too many tokens")
    return out


class _Parser:
    def __init__(self, text: str, scope: str, columns: dict[str, Column]):
        self.tokens, self.at, self.depth, self.regexes = _tokens(text), 0, 0, 0
        self.fields = SOURCE_FIELDS | (FINDING_FIELDS if scope == "finding" else {})
        self.columns = columns

    def peek(self) -> tuple[str, object]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *ops: str) -> str | None:
        if self.peek()[0] == "op" and self.peek()[1] in ops:
            self.at += 1
            return str(self.tokens[self.at - 1][1])
        return None

    def boolean(self, v: _Value) -> Column:
        if v.type != "boolean":
            raise PredicateError(f"a {v.type} where a boolean is needed")
        return v.column

    def either(self) -> _Value:
        left = self.both()
        while self.take("||"):
            a, b = self.boolean(left), self.boolean(self.both())
            left = _Value(F.when(a.isNull(), F.lit(None).cast("boolean")).when(a, F.lit(True)).otherwise(b), "boolean")
        return left

    def both(self) -> _Value:
        left = self.compare()
        while self.take("&&"):
            a, b = self.boolean(left), self.boolean(self.compare())
            left = _Value(F.when(a.isNull(), F.lit(None).cast("boolean")).when(a, b).otherwise(F.lit(False)), "boolean")
        return left

    def compare(self) -> _Value:
        left = self.unary()
        op = self.take("==", "!=", "<", "<=", ">", ">=", *_TEXT_OPS)
        if not op:
            return left
        right = self.unary()
        a, b = left.column, right.column
        if op in ("==", "!="):
            if left.type != right.type or left.type == "list":
                raise PredicateError(f"{left.type} {op} {right.type}")
            return _Value(a == b if op == "==" else a != b, "boolean")
        if op in ("<", "<=", ">", ">="):
            if (left.type, right.type) != ("number", "number"):
                raise PredicateError(f"{left.type} {op} {right.type}")
            return _Value({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], "boolean")
        if right.type != "string" or left.type not in (("string", "list") if op == "contains" else ("string",)):
            raise PredicateError(f"{left.type} {op} {right.type}")
        if op == "matches":
            self.regexes += 1
            if right.literal is None or self.regexes > MAX_REGEXES:
                raise PredicateError("matches needs a string literal" if right.literal is None else "too many regular expressions")
            try:
                return _Value(F.regexp_like(a, F.lit(to_java(str(right.literal)))), "boolean")
            except (ValueError, KeyError) as e:
                raise PredicateError(f"bad regular expression: {e}") from e
        if left.type == "list":
            return _Value(F.array_contains(a, b), "boolean")
        return _Value({"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[op](a, b), "boolean")

    def unary(self) -> _Value:
        if self.take("!"):
            return _Value(~self.boolean(self.unary()), "boolean")
        if self.take("("):
            self.depth += 1
            if self.depth > MAX_NESTING:
                raise PredicateError("parentheses nest too deeply")
            v = self.either()
            if not self.take(")"):
                raise PredicateError("a parenthesis is not closed")
            self.depth -= 1
            return v
        kind, value = self.peek()
        self.at += 1
        if kind in ("string", "number", "boolean"):
            return _Value(F.lit(value), kind, value)
        if kind == "field":
            if value not in self.fields:
                raise PredicateError(f"unknown field {value}")
            return self.field(str(value))
        raise PredicateError(f"unexpected {value!r}")

    def field(self, name: str) -> _Value:
        kind, c = self.fields[name], self.columns.get(name)
        short = name.split(".")[1]
        c = F.col({"path": "path", "symlink": "symlink_file"}.get(short, short)) if c is None else c
        if kind == "string":
            c = F.coalesce(c.cast("string"), F.lit(""))
            c = F.when(F.char_length(c) <= MAX_STRING, c)
        elif kind == "list":
            c = F.coalesce(c, F.array().cast("array<string>"))
            c = F.when(F.size(c) <= MAX_LIST, c)
        elif kind == "number":
            c = F.coalesce(c.cast("double"), F.lit(0.0))
        return _Value(c, kind)


def compile_predicate(text: str, scope: str = "finding", columns: dict[str, Column] | None = None) -> Column:
    """A boolean Column, never null. scope: "source" for prefilters, "finding" for filters. columns: other
    columns for some fields; by default source.path is path and finding.x is x."""
    p = _Parser(text, scope, columns or {})
    out = p.boolean(p.either())
    if p.peek()[0] != "end":
        raise PredicateError(f"unexpected {p.peek()[1]!r}")
    return F.coalesce(out, F.lit(False))
