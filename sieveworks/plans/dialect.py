"""Rewrites rule patterns from RE2's dialect to the one of Spark's Java engine.

What differs: $ is the end of text only, word boundaries and \\s are ASCII, case folding is that of
Unicode, POSIX classes stand in brackets, named groups are written (?P<n>), and a bare brace or a
bracket within a class is literal.
"""

from __future__ import annotations

import re
from functools import lru_cache

# The parts of the target dialect.
_WORD = "[0-9A-Za-z_]"
BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
NO_BOUNDARY = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
SPACE = r"\t\n\f\r "
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_FLAGS = re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])")
_REPEAT = re.compile(r"\{\d+(?:,\d*)?\}")


def _class(rx: str, at: int) -> tuple[str, int]:
    """A bracket class that begins at this place, rewritten, and where it ends."""
    i, out = at + 1, "["
    if rx[i : i + 1] == "^":
        out, i = out + "^", i + 1
    first = True
    while i < len(rx) and (rx[i] != "]" or first):
        first = False
        if posix := re.match(r"\[:(\^?)(\w+):\]", rx[i:]):
            body = POSIX[posix[2]]
            out += f"[^{body}]" if posix[1] else body
            i += posix.end()
        elif rx[i] == "\\" and i + 1 < len(rx):
            c = rx[i + 1]
            out += {"s": SPACE, "S": f"[^{SPACE}]", "z": "z"}.get(c, rx[i : i + 2])
            i += 2
        elif rx[i] == "[" or rx[i] == "]" or rx[i : i + 2] == "&&":
            out += "\\" + rx[i]
            i += 1
        else:
            out += rx[i]
            i += 1
    if i >= len(rx):
        raise ValueError(f"unclosed class in {rx!r}")
    return out + "]", i + 1


@lru_cache(maxsize=20_000)
def to_java(rx: str) -> str:
    """The pattern with the same meaning in the Java dialect."""
    out: list[str] = []
    multiline = [False]
    i = 0
    while i < len(rx):
        c = rx[i]
        if c == "\\" and i + 1 < len(rx):
            d = rx[i + 1]
            if d == "Q":
                end = rx.find("\\E", i)
                text = rx[i + 2 : end if end >= 0 else len(rx)]
                out.append(re.sub(r"([^\w\s])", r"\\\1", text))
                i = end + 2 if end >= 0 else len(rx)
                continue
            if d == "x" and rx[i + 2 : i + 3] != "{" or d in "pP":
                out.append(rx[i : i + 2])
            else:
                out.append({"b": BOUNDARY, "B": NO_BOUNDARY, "s": f"[{SPACE}]", "S": f"[^{SPACE}]", "z": r"\z", "C": "(?s:.)"}.get(d, rx[i : i + 2]))
            i += 2
            if d in "pPx" and rx[i : i + 1] == "{":
                end = rx.index("}", i) + 1
                out.append(rx[i:end])
                i = end
        elif c == "[":
            text, i = _class(rx, i)
            out.append(text)
        elif c == "(":
            if named := re.match(r"\(\?P?<([A-Za-z_]\w*)>", rx[i:]):
                out.append(f"(?<{re.sub(r'[^0-9A-Za-z]', 'x', named[1])}>")
                multiline.append(multiline[-1])
                i += named.end()
            elif flags := _FLAGS.match(rx, i):
                on, off = flags[1], flags[2] or ""
                now = ("m" in on or multiline[-1]) and "m" not in off
                java_on = "".join(f for f in on if f != "U") + ("u" if "i" in on else "")
                java_off = "".join(f for f in off if f != "U")
                out.append("(?" + java_on + (f"-{java_off}" if java_off else "") + flags[3])
                if flags[3] == ":":
                    multiline.append(now)
                else:
                    multiline[-1] = now
                i += flags.end() - flags.start()
            else:
                multiline.append(multiline[-1])
                out.append("(")
                i += 1
        elif c == ")":
            if len(multiline) > 1:
                multiline.pop()
            out.append(c)
            i += 1
        elif c == "$":
            out.append("$" if multiline[-1] else r"\z")
            i += 1
        elif c == "{" and not _REPEAT.match(rx, i):
            out.append(r"\{")
            i += 1
        elif c == "{":
            end = rx.index("}", i) + 1
            out.append(rx[i:end])
            i = end
        else:
            out.append(r"\}" if c == "}" else c)
            i += 1
    return "".join(out)


@lru_cache(maxsize=20_000)
def groups(rx: str) -> int:
    """The number of capture groups of a pattern."""
    n, i = 0, 0
    while i < len(rx):
        if rx[i] == "\\":
            i += 2
        elif rx[i] == "[":
            _, i = _class(rx, i)
        else:
            n += rx[i] == "(" and (rx[i + 1 : i + 2] != "?" or bool(re.match(r"\(\?P?<[A-Za-z_]", rx[i:])))
            i += 1
    return n


_ASCII = frozenset(range(128))
_LETTERS = frozenset(c for c in _ASCII if chr(c).isalpha())


def _held(node: object) -> frozenset[int]:
    """The ASCII characters that a match of this part of a parsed pattern can hold; more where in doubt."""
    out: frozenset[int] = frozenset()
    for op, arg in node:
        name = str(op)
        if name == "LITERAL":
            out |= {arg} & _ASCII
        elif name == "IN":
            if str(arg[0][0]) == "NEGATE":
                out |= _ASCII - _exactly(arg[1:])
            else:
                out |= _held(arg)
        elif name == "NOT_LITERAL":
            out |= _ASCII - {arg}
        elif name == "RANGE":
            out |= _ASCII & frozenset(range(arg[0], min(arg[1], 127) + 1))
        elif name == "CATEGORY" and not str(arg).startswith("CATEGORY_NOT"):
            kind = {"CATEGORY_DIGIT": r"\d", "CATEGORY_SPACE": r"\s", "CATEGORY_WORD": r"\w"}[str(arg)]
            out |= frozenset(c for c in _ASCII if re.match(kind, chr(c)))
        elif name == "BRANCH":
            out = out.union(*map(_held, arg[1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out |= _held(arg[2])
        elif name == "SUBPATTERN":
            out |= _held(arg[3])
        elif name != "AT":
            return _ASCII
    return out


def _exactly(items: list) -> frozenset[int]:
    """The characters that a class surely names; a category counts for none, since dialects differ in it."""
    return _held([(op, arg) for op, arg in items if str(op) in ("LITERAL", "RANGE")])


@lru_cache(maxsize=20_000)
def never_in_matches(rx: str) -> frozenset[int]:
    """ASCII characters that no match of the pattern can hold, so that none goes over them; none of them where
    the pattern is not understood."""
    # What the parser reads otherwise than RE2 does.
    if "[:" in rx or "{," in rx:
        return frozenset()
    try:
        held = _held(re._parser.parse(rx))
    except (re.error, OverflowError, RecursionError):
        return frozenset()
    return _ASCII - held - (_LETTERS if re.search(r"\(\?[A-Za-z]*i", rx) else frozenset())
