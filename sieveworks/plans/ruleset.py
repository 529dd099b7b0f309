"""Rule sets: their data model, TOML loading, layering, checks and identity."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from dataclasses import dataclass, field, fields, replace
from functools import cache
from pathlib import Path

from sieveworks.functions.text import version_at_least

from .dialect import groups, to_java
from .shapes import assigned_rule, token_rule

VERSION = "8.30.1"
MAX_RULES, MAX_EXTEND, MAX_BYTES = 10_000, 2, 10 << 20
DETECTORS = ("password-assignment", "kubernetes-secret-decoded", "codex-auth", "docker-auth", "gcp-service-account", "jwk", "mcp-config", "kubernetes-secret", "npmrc-auth", "aws-key-pair")


class RuleError(ValueError):
    """A rule set that cannot be used."""


@dataclass(frozen=True)
class Allowlist:
    """Conditions under which a finding is no finding: any of them, or with condition AND all."""

    description: str = ""
    condition: str = "OR"
    commits: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    regex_target: str = "secret"
    regexes: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()
    target_rules: tuple[str, ...] = ()


@dataclass(frozen=True)
class Required:
    """A rule that must have a finding near by: in so many lines, or in so many columns of the same line."""

    id: str
    within_lines: int | None = None
    within_columns: int | None = None


@dataclass(frozen=True)
class Rule:
    id: str
    description: str = ""
    regex: str = ""
    secret_group: int = 0
    entropy: float = 0.0
    path: str = ""
    keywords: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    allowlists: tuple[Allowlist, ...] = ()
    required: tuple[Required, ...] = ()
    skip_report: bool = False
    severity: str = ""
    confidence: str = ""
    rule_pack: str = ""
    provider: str = ""
    documentation_url: str = ""
    validation: tuple[str, ...] = ()
    examples: tuple[str, ...] = ()
    negative_examples: tuple[str, ...] = ()
    deprecated: bool = False
    randomness_threshold: float = 0.0
    detector: str = ""
    prefilter: str = ""
    filter: str = ""

    @property
    def java(self) -> str:
        return to_java(self.regex)

    @property
    def n_groups(self) -> int:
        return groups(self.regex) if self.regex else 0


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    allowlists: tuple[Allowlist, ...] = ()
    prefilter: str = ""
    filter: str = ""
    by_id: dict[str, Rule] = field(init=False, repr=False, compare=False, default_factory=dict)

    def __post_init__(self) -> None:
        if len(self.rules) > MAX_RULES:
            raise RuleError(f"more than {MAX_RULES} rules")
        for r in self.rules:
            if r.id in self.by_id:
                raise RuleError(f"two rules have the id {r.id}")
            self.by_id[r.id] = r

    def enable(self, ids: list[str]) -> RuleSet:
        """Only these rules, and the ones that they require."""
        if unknown := [i for i in ids if i not in self.by_id]:
            raise RuleError(f"unknown rules: {', '.join(sorted(unknown))}")
        wanted = set(ids) | {q.id for i in ids for q in self.by_id[i].required}
        return replace(self, rules=tuple(r for r in self.rules if r.id in wanted))

    def layer(self, other: RuleSet) -> RuleSet:
        """Both packs' rules; an id in both is an error."""
        return replace(self, rules=self.rules + other.rules, allowlists=self.allowlists + other.allowlists)

    def override(self, changes: list[Rule]) -> RuleSet:
        """Rules changed by others of the same id, new ones added, sorted by id: set scalars replace, lists add up."""
        out = dict(self.by_id)
        for r in changes:
            out[r.id] = merge(out[r.id], r) if r.id in out else r
        return replace(self, rules=tuple(out[i] for i in sorted(out)))

    @property
    def fingerprint(self) -> str:
        """Changes with anything that can change results: each value with its length, hashed."""
        h = hashlib.sha256()

        def put(x: object) -> None:
            if isinstance(x, tuple):
                put(len(x))
                for y in x:
                    put(y)
            elif hasattr(x, "__dataclass_fields__"):
                for f in fields(x):
                    if f.init:
                        put(getattr(x, f.name))
            else:
                b = str(x).encode()
                h.update(f"{len(b)}:".encode() + b + b";")

        put(self)
        return h.hexdigest()


def merge(base: Rule, change: Rule) -> Rule:
    new = {}
    for f in fields(Rule):
        a, b = getattr(base, f.name), getattr(change, f.name)
        new[f.name] = tuple(dict.fromkeys(a + b)) if isinstance(a, tuple) else (b or a)
    return Rule(**new)


def _get(d: dict, *names: str, default=None):
    for n in names:
        if n in d:
            return d[n]
    return default


def _allowlist(d: dict) -> Allowlist:
    condition = str(_get(d, "condition", default="OR")).upper()
    condition = {"&&": "AND", "||": "OR", "": "OR"}.get(condition, condition)
    target = str(_get(d, "regexTarget", default="secret") or "secret").lower()
    if condition not in ("AND", "OR") or target not in ("secret", "match", "line"):
        raise RuleError(f"allowlist with condition {condition} and target {target}")
    lists = {k: tuple(_get(d, n, default=[])) for k, n in (("commits", "commits"), ("paths", "paths"), ("regexes", "regexes"), ("stopwords", "stopwords"), ("target_rules", "targetRules"))}
    if not any(lists[k] for k in ("commits", "paths", "regexes", "stopwords")):
        raise RuleError("an allowlist without any check")
    return Allowlist(description=d.get("description", ""), condition=condition, regex_target=target, **lists)


def _allowlists(d: dict) -> tuple[Allowlist, ...]:
    given = [*([d["allowlist"]] if "allowlist" in d else []), *d.get("allowlists", [])]
    return tuple(_allowlist(a) for a in given)


def _rule(d: dict) -> Rule:
    required = tuple(Required(q["id"], q.get("withinLines"), q.get("withinColumns")) for q in d.get("required", []))
    simple = {
        "description": "description", "regex": "regex", "path": "path", "severity": "severity", "confidence": "confidence", "rule_pack": "rulePack",
        "provider": "provider", "documentation_url": "documentationUrl", "detector": "detector", "prefilter": "prefilter", "filter": "filter",
    }
    values = {k: d.get(n, "") for k, n in simple.items()}
    lists = {k: tuple(d.get(n, [])) for k, n in (("tags", "tags"), ("validation", "validation"), ("examples", "examples"), ("negative_examples", "negativeExamples"))}
    return Rule(
        id=d["id"], secret_group=int(d.get("secretGroup", 0)), entropy=float(d.get("entropy", 0)), keywords=tuple(k.lower() for k in d.get("keywords", [])),
        allowlists=_allowlists(d), required=required, skip_report=bool(d.get("skipReport", False)), deprecated=bool(d.get("deprecated", False)),
        randomness_threshold=float(d.get("randomnessThreshold", 0)), **values, **lists,
    )


def parse(text: str, base: str = ".", depth: int = 0) -> RuleSet:
    """A rule set from TOML, with what it extends. Beside rules it may hold tables of token shapes (tokens,
    assigned), which become rules ahead of the others."""
    d = tomllib.loads(text)
    if (least := d.get("minVersion")) and not version_at_least(VERSION, least):
        raise RuleError(f"the rule set needs version {least}")
    shaped = [token_rule(i, what, shapes) for i, (what, *shapes) in d.get("tokens", {}).items()]
    shaped += [assigned_rule(i, *row) for i, row in d.get("assigned", {}).items()]
    rules = [_rule(r) for r in (*shaped, *d.get("rules", []))]
    lists = _allowlists(d)
    extend = d.get("extend", {})
    out = RuleSet(tuple(rules), prefilter=d.get("prefilter", ""), filter=d.get("filter", ""))
    if extend:
        if depth >= MAX_EXTEND:
            raise RuleError("rule sets extend each other too deeply")
        if extend.get("useDefault") and extend.get("path"):
            raise RuleError("a rule set extends either the default or a path")
        if extend.get("useDefault") or extend.get("path"):
            inner = load(extend["path"], base, depth + 1) if extend.get("path") else default_rules()
            dropped = set(extend.get("disabledRules", []))
            kept = replace(inner, rules=tuple(r for r in inner.rules if r.id not in dropped))
            out = replace(kept.override(rules), prefilter=out.prefilter or inner.prefilter, filter=out.filter or inner.filter)
    targeted = [a for a in lists if a.target_rules]
    plain = tuple(a for a in lists if not a.target_rules)
    new = []
    for r in out.rules:
        own = tuple(a for a in targeted if r.id in a.target_rules)
        new.append(replace(r, allowlists=r.allowlists + own) if own else r)
    if missing := {i for a in targeted for i in a.target_rules} - set(out.by_id):
        raise RuleError(f"an allowlist targets unknown rules: {', '.join(sorted(missing))}")
    result = replace(out, rules=tuple(new), allowlists=out.allowlists + plain)
    if errors := [p for p in problems(result) if p[1] == "error"]:
        raise RuleError("; ".join(f"{i}: {what}" for i, _, what in errors))
    return result


#: The TOML names of the simple fields of a rule.
_NAMES = {
    "description": "description", "regex": "regex", "secret_group": "secretGroup", "entropy": "entropy", "path": "path", "keywords": "keywords", "tags": "tags", "skip_report": "skipReport",
    "severity": "severity", "confidence": "confidence", "rule_pack": "rulePack", "provider": "provider", "documentation_url": "documentationUrl", "validation": "validation", "examples": "examples",
    "negative_examples": "negativeExamples", "deprecated": "deprecated", "randomness_threshold": "randomnessThreshold", "detector": "detector", "prefilter": "prefilter", "filter": "filter",
}
_LIST_NAMES = {"description": "description", "condition": "condition", "commits": "commits", "paths": "paths", "regex_target": "regexTarget", "regexes": "regexes", "stopwords": "stopwords", "target_rules": "targetRules"}


def _toml(x: object) -> str:
    if isinstance(x, (bool, int, float)):
        return str(x).lower()
    if isinstance(x, tuple):
        return "[" + ", ".join(map(_toml, x)) + "]"
    # Basic strings of TOML escape as JSON does, but for the delete character.
    return json.dumps(x, ensure_ascii=False).replace("\x7f", "\\u007f")


def dump(rules: RuleSet) -> str:
    """The rule set as TOML that parse() reads back as the same; defaults are left out."""
    out: list[str] = []

    def table(header: str, x: object, names: dict[str, str], always: tuple[str, ...] = ()) -> None:
        given = {f.name: f.default for f in fields(x)}
        out.append(header)
        out.extend(f"{n} = {_toml(v)}" for k, n in names.items() if (v := getattr(x, k)) != given[k] or k in always)
        out.append("")

    out += [f"{k} = {_toml(getattr(rules, k))}" for k in ("prefilter", "filter") if getattr(rules, k)]
    for a in rules.allowlists:
        table("[[allowlists]]", a, _LIST_NAMES)
    for r in rules.rules:
        table("[[rules]]", r, {"id": "id", **_NAMES}, ("id",))
        for a in r.allowlists:
            table("[[rules.allowlists]]", a, _LIST_NAMES)
        for q in r.required:
            table("[[rules.required]]", q, {"id": "id", "within_lines": "withinLines", "within_columns": "withinColumns"}, ("id",))
    return "\n".join(out)


def load(path: str, base: str = ".", depth: int = 0) -> RuleSet:
    p = Path(base) / path
    data = p.read_bytes()
    if len(data) > MAX_BYTES:
        raise RuleError(f"{path} is larger than {MAX_BYTES} bytes")
    return parse(data.decode(), str(p.parent), depth)


@cache
def default_rules() -> RuleSet:
    """The pack that comes with this library, read once."""
    return parse((Path(__file__).parent.parent / "rules" / "default.toml").read_text())


def problems(rules: RuleSet) -> list[tuple[str, str, str]]:
    """(rule id, error or warning, what) for everything that is wrong with a rule set by itself."""
    from .predicates import PredicateError, compile_predicate

    out = []
    for r in rules.rules:
        say = lambda kind, what, r=r: out.append((r.id, kind, what))
        if not r.id.strip():
            say("error", "empty id")
        if not (r.regex or r.path or r.detector):
            say("error", "neither regex nor path nor detector")
        if r.detector and r.detector not in DETECTORS:
            say("error", f"unknown detector {r.detector}")
        try:
            if r.regex and r.secret_group > r.n_groups:
                say("error", f"secretGroup {r.secret_group} of {r.n_groups} groups")
            to_java(r.path)
            to_java(r.regex)
        except (ValueError, KeyError) as e:
            say("error", f"bad pattern: {e}")
        if r.regex and not r.keywords:
            say("warning", "no keywords: it runs on every input")
        if re.search(r"\.[*+](?!\?)", r.regex):
            say("warning", "unbounded wildcard")
        for q in r.required:
            if q.id == r.id:
                say("error", "requires itself")
            elif q.id not in rules.by_id:
                say("error", f"requires the unknown rule {q.id}")
        for source, scope in ((r.prefilter, "source"), (r.filter, "finding")):
            try:
                if source:
                    compile_predicate(source, scope)
            except PredicateError as e:
                say("error", f"bad predicate: {e}")
    return out
