"""Structured detectors: secrets that stand in known places of JSON, YAML, npmrc and assignments.

A detector is a small function from a text to spans (start, end, secret). Spark finds the candidate
inputs by keyword, and Arrow batches carry only those to Python.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .yaml_index import yaml_mappings

MAX_DEPTH, MAX_LINE = 64, 64 << 10
Span = tuple[int, int, str]

_ASSIGN = re.compile(r"""(?i)(?:password|passwd)["']?\s{0,32}?[ \t]{0,32}[:=]{1,2}[ \t]{0,32}(?:"((?:[^"\\\n]|\\.){12,512})"|'((?:[^'\\\n]|\\.){12,512})'|([^\s"'#;,]{12,512}))""")
_PLACEHOLDER = re.compile(r"(?i)^(?:\$\{.*\}|\{\{.*\}\}|<.*>|%.*%|x+|\*+|(?:your|my|the|change|example|sample|dummy|test|placeholder|replace)[\W_].*|change ?me.*)$")
_JSON = re.compile(r'"((?:[^"\\]|\\.)*)"|([{}\[\],:])|(true|false|null|-?\d[\d.eE+-]*)|(\s+)|(.)', re.S)
_NPM = re.compile(r"(?im)^[ \t]*(?:(?://[^\n=]*:)?(?:_authToken|_auth|_password))[ \t]*=[ \t]*(\"?)([^\s\"#;]+)\1[ \t]*$")


def password_assignments(text: str) -> Iterator[Span]:
    """Values of 12 to 512 characters assigned to a name that ends in password or passwd."""
    for m in _ASSIGN.finditer(text):
        g = next(i for i in (1, 2, 3) if m[i] is not None)
        value = re.sub(r"\\(.)", r"\1", m[g]) if g < 3 else m[g]
        if not _PLACEHOLDER.match(value):
            yield m.start(g), m.end(g), value


def _unescaped(literal: str) -> str:
    """The value of a JSON string literal; escapes that JSON does not know stand for what follows."""
    try:
        return json.loads(f'"{literal}"', strict=False)
    except ValueError:
        return re.sub(r"\\(.)", r"\1", literal)


def json_strings(text: str) -> Iterator[tuple[tuple[str, ...], int, int, str]]:
    """(path, start, end, value) of each string property of the JSON texts that begin in this text, up to
    a nesting of 64. Text that is no JSON ends the walk."""
    stack: list[list] = []
    key: str | None = None
    expect_value = False
    begin = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if begin < 0:
        return
    for m in _JSON.finditer(text, begin):
        string, mark, literal, space, other = m.groups()
        if space is not None:
            continue
        if other is not None or len(stack) > MAX_DEPTH:
            return
        if string is not None:
            if stack and stack[-1][0] == "{" and not expect_value:
                key = string
                continue
            path = tuple(s[1] for s in stack if s[1] is not None) + ((key,) if stack and stack[-1][0] == "{" and key is not None else ())
            yield path, m.start(1), m.end(1), _unescaped(string)
            expect_value = False
        elif mark in "{[":
            stack.append([mark, key if stack and stack[-1][0] == "{" else None])
            key, expect_value = None, mark == "["
        elif mark in "}]":
            if not stack:
                return
            stack.pop()
            if not stack:
                return
            expect_value = stack[-1][0] == "["
        elif mark == ":":
            expect_value = True
        elif mark == ",":
            expect_value = bool(stack) and stack[-1][0] == "["
            key = None
        elif literal is not None:
            expect_value = False


def docker_auth(text: str) -> Iterator[Span]:
    for path, s, e, v in json_strings(text):
        if len(path) >= 3 and path[0] == "auths" and path[-1] in ("auth", "password", "identitytoken", "registrytoken") and len(v) >= 8:
            yield s, e, v


def codex_auth(text: str) -> Iterator[Span]:
    for path, s, e, v in json_strings(text):
        if path and path[-1] in ("OPENAI_API_KEY", "access_token", "refresh_token", "id_token") and (len(path) == 1 or path[0] == "tokens") and len(v) >= 16:
            yield s, e, v


def mcp_config(text: str) -> Iterator[Span]:
    for path, s, e, v in json_strings(text):
        named = len(path) >= 4 and path[0] in ("mcpServers", "servers") and path[2] in ("env", "headers")
        if named and re.search(r"(?i)token|key|secret|passw|auth", path[-1]) and len(v) >= 8 and not _PLACEHOLDER.match(v):
            yield s, e, v


def jwk(text: str) -> Iterator[Span]:
    """The private parameter of JSON web keys: d of RSA, EC and OKP keys, k of symmetric ones."""
    groups: dict[tuple[str, ...], dict[str, tuple[int, int, str]]] = {}
    for path, s, e, v in json_strings(text):
        groups.setdefault((*path[:-1], str(len(groups)) if path[-1:] == ("kty",) and "kty" in groups.get(path[:-1], {}) else ""), {})[path[-1] if path else ""] = (s, e, v)
    for g in groups.values():
        kind = g.get("kty", (0, 0, ""))[2]
        name = {"RSA": "d", "EC": "d", "OKP": "d", "oct": "k"}.get(kind)
        if name in g and len(g[name][2]) >= 16:
            yield g[name]


def gcp_service_account(text: str) -> Iterator[Span]:
    """Whole service-account objects, by their type and the fields that all of them have."""
    # The fields of a service-account key.
    needed = ("type", "project_id", "private_key_id", "private_key", "client_email", "client_id", "auth_uri", "token_uri", "auth_provider_x509_cert_url", "client_x509_cert_url")
    for m in re.finditer(r'"service_account"', text):
        start = text.rfind("{", max(0, m.start() - 4096), m.start())
        if start < 0:
            continue
        depth, quoted, i = 0, False, start
        while i < min(len(text), start + (16 << 10)):
            c = text[i]
            if quoted:
                i += c == "\\"
                quoted = c != '"'
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    break
            i += 1
        body = text[start : i + 1]
        if not depth and all(f'"{n}"' in body for n in needed):
            yield start, i + 1, body


#: Lines between an access key id and its secret key.
PAIR_LINES = 8
# The published forms of both.
_KEY_ID = re.compile(r"(?<![0-9A-Za-z])A[KS]IA[A-Z2-7]{16}(?![0-9A-Za-z])")
_SECRET_KEY = re.compile(r"(?<![0-9A-Za-z/+=])[0-9A-Za-z/+]{40}(?![0-9A-Za-z/+=])")


def aws_key_pair(text: str) -> Iterator[Span]:
    """Secret access keys that stand within a few lines of an access key id. What looks like a digest, all
    digits and letters of one case, is none."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    at = [bisect.bisect_left(breaks, m.start()) for m in _KEY_ID.finditer(text)]
    if not at:
        return
    for m in _SECRET_KEY.finditer(text):
        value = m[0]
        if not (re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value)):
            continue
        line = bisect.bisect_left(breaks, m.start())
        k = bisect.bisect_left(at, line - PAIR_LINES)
        if k < len(at) and at[k] <= line + PAIR_LINES:
            yield m.start(), m.end(), value


def _kubernetes_values(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(section, start, end, value) of the values under data and stringData of mappings whose kind is Secret,
    whole documents or items of lists, in block and flow form; aliases are not expanded."""
    mappings = yaml_mappings(text)
    secrets = {m.number for m in mappings if any(k == "kind" and v == "Secret" for k, v, _, _ in m.values)}
    for m in mappings:
        if m.parent in secrets and m.key in ("data", "stringData"):
            for _, value, start, end in m.values:
                if value.strip() and not _PLACEHOLDER.match(value):
                    yield m.key, start, end, value


def kubernetes_secret(text: str) -> Iterator[Span]:
    """Values of Kubernetes secrets as they stand there: under data in base64."""
    for _, start, end, value in _kubernetes_values(text):
        yield start, end, value


def kubernetes_secret_decoded(text: str) -> Iterator[Span]:
    """Values of Kubernetes secrets in plain text: those under data decoded. What is no base64 is no value of
    data; what is no text when decoded stays as it stands."""
    for section, start, end, value in _kubernetes_values(text):
        if section == "data":
            try:
                raw = base64.b64decode("".join(value.split()), validate=True)
            except ValueError:
                continue
            try:
                value = raw.decode()
            except UnicodeDecodeError:
                pass
        if value and not _PLACEHOLDER.match(value):
            yield start, end, value


def npmrc_auth(text: str) -> Iterator[Span]:
    for m in _NPM.finditer(text):
        if len(m[0]) <= MAX_LINE and not m[2].startswith("${"):
            yield m.start(2), m.end(2), m[2]


FUNCTIONS = {
    "password-assignment": password_assignments,
    "docker-auth": docker_auth,
    "codex-auth": codex_auth,
    "mcp-config": mcp_config,
    "jwk": jwk,
    "gcp-service-account": gcp_service_account,
    "kubernetes-secret": kubernetes_secret,
    "kubernetes-secret-decoded": kubernetes_secret_decoded,
    "npmrc-auth": npmrc_auth,
    "aws-key-pair": aws_key_pair,
}


def detector_spans(text: Column, detector: Column) -> Column:
    """An array of (at, start, end, match, secret) for each secret that a detector finds in a text, as spans() of
    match.py gives them for patterns; null without a detector. Only texts that have one go to Python."""

    @F.arrow_udf("array<struct<start:int,end:int,secret:string>>")
    def find(texts: pa.Array, detectors: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("secret", pa.string())]))
        out = []
        for t, d in zip(texts, detectors.to_pylist(), strict=True):
            out.append([{"start": s, "end": e, "secret": v} for s, e, v in FUNCTIONS[d](t.as_py() or "")] if d else None)
        return pa.array(out, kind)

    found = find(F.when(detector != "", text), detector)
    one = lambda s, i: F.struct(i.alias("at"), s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("match"), s["secret"].alias("secret"))
    return F.transform(found, one)


__all__ = ["FUNCTIONS", "detector_spans", "json_strings"]
