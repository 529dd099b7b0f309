"""Token shapes: credential formats as vendors publish them, and the rules that follow from them.

A shape is literal text with parts in braces: an alphabet and how many characters of it, as in
`ghp_{alnum:36}` or `xoxb-{digit:10-13}-{alnum:24-34}`. From a shape follow a pattern, the keyword that
gates it, an example, and the least entropy of what it matches.
"""

from __future__ import annotations

import hashlib
import math
import re

# The alphabets that shapes are written in.
ALPHABETS = {
    "digit": "0-9", "hex": "0-9a-f", "lower": "a-z0-9", "upper": "A-Z0-9", "letter": "A-Za-z", "alnum": "A-Za-z0-9", "word": "A-Za-z0-9_",
    "url": "A-Za-z0-9_-", "base32": "A-Z2-7", "base64": "A-Za-z0-9+/", "bech32": "AC-HJ-NP-Z02-9",
}
UUID = "{hex:8}-{hex:4}-{hex:4}-{hex:4}-{hex:12}"
#: The least entropy of a match, as a share of the most that a part of its length and alphabet can have.
ENTROPY_SHARE = 0.55

#: How a rule's validation entry with the form of a whole secret begins.
FORM = "offline:form:"

_PART = re.compile(r"\{(\w+):(\d+)(?:-(\d+))?\}")


def members(alphabet: str) -> str:
    """The characters of an alphabet."""
    rx = re.compile(f"[{ALPHABETS[alphabet]}]")
    return "".join(c for c in map(chr, range(33, 127)) if rx.match(c))


def parts(shape: str) -> list[tuple[str, str, int, int]]:
    """(literal, "", 0, 0) and ("", alphabet, least, most) for what the shape is made of."""
    shape, out, at = shape.replace("{uuid}", UUID), [], 0
    for m in _PART.finditer(shape):
        if m[2] and m[1] not in ALPHABETS:
            raise ValueError(f"unknown alphabet {m[1]} in {shape!r}")
        if m.start() > at:
            out.append((shape[at : m.start()], "", 0, 0))
        out.append(("", m[1], int(m[2]), int(m[3] or m[2])))
        at = m.end()
    if at < len(shape):
        out.append((shape[at:], "", 0, 0))
    return out


def _quoted(text: str) -> str:
    return re.sub(r"([^\w\s/@=:~-])", r"\\\1", text)


def pattern(shape: str) -> str:
    """The shape as a pattern without groups."""
    count = lambda a, b: f"{{{a}}}" if a == b else f"{{{a},{b}}}"
    return "".join(_quoted(text) if text else f"[{ALPHABETS[kind]}]{count(a, b)}" for text, kind, a, b in parts(shape))


def end_of(shape: str) -> str:
    """What must follow: nothing that could belong to the shape's last part."""
    kind = parts(shape)[-1][1]
    return f"(?:[^{ALPHABETS[kind]}]|$)" if kind else ""


def keyword(shape: str) -> str:
    """The longest literal, lower-cased; empty where there is none."""
    return max((text for text, *_ in parts(shape)), key=len, default="").lower()


def least_entropy(shape: str) -> float:
    drawn = [(len(members(kind)), a) for text, kind, a, _ in parts(shape) if kind]
    most = min(max((math.log2(k) for k, _ in drawn), default=0.0), math.log2(max(sum(a for _, a in drawn), 1)))
    return round(ENTROPY_SHARE * most, 1)


def example(shape: str, seed: str, short: int = 0) -> str:
    """A made-up string of this shape; with short, so many characters of its last part are left out."""
    out, rows = "", parts(shape)
    for n, (text, kind, least, _) in enumerate(rows):
        size = least - (short if n == len(rows) - 1 else 0)
        drawn = hashlib.shake_256(f"{seed}:{n}".encode()).digest(max(size, 0))
        out += text or "".join(members(kind)[x % len(members(kind))] for x in drawn)
    return out


def token_rule(id: str, description: str, shapes: list[str]) -> dict:
    """The rule, as in TOML, for tokens that their shapes alone tell from other text."""
    rows = [(s, pattern(s)) for s in shapes]
    ends = {end_of(s) for s in shapes}
    if len(ends) > 1:
        raise ValueError(f"the shapes of {id} end in different alphabets")
    start = r"\b" if all(re.match(r"\w", example(s, id)) for s in shapes) else ""
    body = "|".join(rx for _, rx in rows)
    return {
        "id": id, "description": description, "regex": f"{start}({body}){ends.pop()}", "secretGroup": 1, "keywords": sorted({keyword(s) for s in shapes}),
        "entropy": min(map(least_entropy, shapes)), "validation": [f"{FORM}^(?:{body})$"],
        "examples": [f'key = "{example(s, id)}"' for s in shapes],
        "negativeExamples": [f'key = "{example(s, id, 1)}"' for s in shapes if parts(s)[-1][1]],
    }


#: What may stand between a name and the value assigned to it.
ASSIGNS = r"""["'\x60]?[ \t]{0,4}(?::=|=>|=|:)[ \t]{0,4}["'\x60]?"""


def assigned_rule(id: str, description: str, names: list[str], shapes: list[str]) -> dict:
    """The rule, as in TOML, for keys without a mark of their own: a value of the shape that is assigned
    to something named after the vendor."""
    body, ends = "|".join(map(pattern, shapes)), {end_of(s) for s in shapes}
    if len(ends) > 1:
        raise ValueError(f"the shapes of {id} end in different alphabets")
    named = "|".join(map(_quoted, names))
    return {
        "id": id, "description": description, "regex": f"(?i:{named})[\\w.-]{{0,40}}{ASSIGNS}({body}){ends.pop()}", "secretGroup": 1,
        "keywords": [n.lower() for n in names], "entropy": min(map(least_entropy, shapes)), "validation": [f"{FORM}^(?:{body})$"],
        "examples": [f'{names[0]}_api_key = "{example(s, id)}"' for s in shapes],
        "negativeExamples": [f'other_api_key = "{example(s, id)}"' for s in shapes[:1]],
    }


__all__ = ["ALPHABETS", "FORM", "assigned_rule", "end_of", "example", "keyword", "least_entropy", "members", "parts", "pattern", "token_rule"]
