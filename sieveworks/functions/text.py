"""Scoring and formatting functions on columns: JVM-side expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the finding format.
SECURITY_SEVERITY = {"critical": "8.0", "high": "7.0", "medium": "5.0", "low": "3.0", "info": "1.0"}
#: Prefix and version of stable fingerprints. To keep fingerprints made by another tool, pass its own.
FINGERPRINT_FORMAT = ("sieve:v1:", "sieve.finding.fingerprint.v1")


def _entropy_of(sizes: Column, n: Column) -> Column:
    """Shannon entropy in bits of shares sizes / n, which need not add up to one; 0 where n is 0. n is bound
    once, and a size is read once."""

    def bits(size: Column) -> Column:
        p = size / n
        return -p * F.log2(p)

    return F.when(n > 0, F.aggregate(F.transform(sizes, bits), F.lit(0.0), lambda a, b: a + b)).otherwise(F.lit(0.0))


def _once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn refers to it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def entropy(s: Column, per_byte_length: bool = True) -> Column:
    """Shannon entropy of the code points of s in bits. per_byte_length divides the counts by the
    UTF-8 length, as strict mode does; otherwise by the number of code points. Empty text has 0. The
    characters are sorted and their runs counted, so that long texts cost no more than sorting them."""

    def measured(t: Column) -> Column:
        n = (F.octet_length(t) if per_byte_length else F.char_length(t)).cast("double")
        runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(t, "")), ""), F.lit(r"(?s)(.)\1*+"), F.lit(0))
        return _once(n, lambda m: _entropy_of(F.transform(runs, lambda r: F.char_length(r).cast("double")), m))

    return _once(s, measured)


def byte_entropy(s: Column) -> Column:
    """Shannon entropy of the UTF-8 bytes of s in bits; bytes are sorted by their two hexadecimal digits."""

    def measured(t: Column) -> Column:
        codes = F.regexp_extract_all(F.hex(t.cast("binary")), F.lit(".."), F.lit(0))
        runs = F.regexp_extract_all(F.array_join(F.array_sort(codes), ""), F.lit(r"(..)\1*+"), F.lit(0))
        return _once(F.octet_length(t).cast("double"), lambda m: _entropy_of(F.transform(runs, lambda r: F.char_length(r) / 2.0), m))

    return _once(s, measured)


def sha256(s: Column) -> Column:
    return F.sha2(s, 256)


def normal_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def normal_lines(s: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(s, r"\r\n?", "\n")


def strict_fingerprint(commit: Column, path: Column, rule_id: Column, line: Column) -> Column:
    """commit:path:rule:line, without the commit where there is none."""
    head = F.when(F.coalesce(commit, F.lit("")) != "", F.concat(commit, F.lit(":"))).otherwise("")
    return F.concat(head, F.coalesce(path, F.lit("")), F.lit(":"), rule_id, F.lit(":"), line.cast("string"))


def stable_fingerprint(path: Column, rule_id: Column, evidence: Column, decode_path: Column, form: tuple[str, str] = FINGERPRINT_FORMAT, stored: Column | None = None) -> Column:
    """An identity that survives moves within a file: version, path, rule, evidence hash and decode path,
    parted by zero bytes and hashed, without position and commit. A valid stored one is kept."""
    fields = [F.lit(form[1]), normal_path(path), rule_id, evidence, F.array_join(decode_path, "\0")]
    new = F.concat(F.lit(form[0]), sha256(F.concat_ws("\0", *[F.coalesce(f, F.lit("")) for f in fields])))
    if stored is None:
        return new
    valid = F.startswith(stored, F.lit(form[0])) & F.regexp_like(F.substring(stored, len(form[0]) + 1, 1 << 20), F.lit("^[0-9a-fA-F]{64}$"))
    return F.when(F.coalesce(valid, F.lit(False)), stored).otherwise(new)


def evidence_hash(secret_sha256: Column, secret: Column, match_sha256: Column, match: Column) -> Column:
    """The first there is of the secret's stored hash, the secret, the match's stored hash, the match."""
    stored = lambda c: F.lower(F.nullif(c, F.lit("")))
    hashed = lambda c: F.when(F.coalesce(c, F.lit("")) != "", sha256(c))
    return F.coalesce(stored(secret_sha256), hashed(secret), stored(match_sha256), hashed(match), sha256(F.lit("")))


def security_severity(severity: Column) -> Column:
    levels = F.create_map(*[F.lit(x) for kv in SECURITY_SEVERITY.items() for x in kv])
    return F.coalesce(F.try_element_at(levels, F.lower(severity)), F.lit(SECURITY_SEVERITY["critical"]))


def or_default(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def csv_guard(c: Column) -> Column:
    """A cell that a spreadsheet would take for a formula, made text by a leading apostrophe."""
    return F.when(F.regexp_like(c, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), c)).otherwise(c)


def remote_https(url: Column) -> Column:
    """A Git remote as an https URL: scp-like and ssh forms rewritten, user and .git dropped."""
    u = F.regexp_replace(url, r"^(?:ssh://)?(?:[^@/]+@)([^:/]+)(?::\d+)?[:/](.+)$", "https://$1/$2")
    return F.regexp_replace(F.regexp_replace(u, r"^(https?://)[^@/]+@", "$1"), r"(?:\.git)?/?$", "")


def scm_link(platform: Column, remote: Column, commit: Column, path: Column, start: Column, end: Column) -> Column:
    """A web link to the lines of a finding; null without a remote, a commit or a known platform."""
    p, a, b = F.replace(path, F.lit(" "), F.lit("%20")), start.cast("string"), end.cast("string")
    several = end > start
    text = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    form = {
        "github": text(remote, "/blob/", commit, "/", p, "#L", a, F.when(several, text("-L", b)).otherwise("")),
        "gitlab": text(remote, "/blob/", commit, "/", p, "#L", a, F.when(several, text("-", b)).otherwise("")),
        "gitea": text(remote, "/src/commit/", commit, "/", p, "#L", a, F.when(several, text("-L", b)).otherwise("")),
        "bitbucket": text(remote, "/src/", commit, "/", p, "#lines-", a, F.when(several, text(":", b)).otherwise("")),
        "azuredevops": text(remote, "/commit/", commit, "?path=/", p, "&line=", a, "&lineEnd=", F.when(several, b).otherwise(a)),
    }
    out = F.lit(None).cast("string")
    for name, link in form.items():
        out = F.when(platform == name, link).otherwise(out)
    known = (F.coalesce(remote, F.lit("")) != "") & (F.coalesce(commit, F.lit("")) != "")
    return F.when(known, out)


def git_date(c: Column) -> Column:
    """An ISO date with an offset as UTC, ending in Z."""
    return F.date_format(F.to_utc_timestamp(F.to_timestamp(c), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def duration_text(seconds: float) -> str:
    """A duration for people: the largest fitting unit of ns, µs, ms and s, or h, m and s."""
    if seconds < 1:
        for unit, scale in (("ms", 1e3), ("µs", 1e6), ("ns", 1e9)):
            if seconds * scale >= 1 or unit == "ns":
                return f"{seconds * scale:.3g}{unit}"
    whole, rest = divmod(seconds, 60)
    if not whole:
        return f"{seconds:.3g}s"
    hours, minutes = divmod(int(whole), 60)
    return (f"{hours}h" if hours else "") + f"{minutes}m{rest:.3g}s"


def version_at_least(have: str, want: str) -> bool:
    """Whether dotted version numbers (a leading v and anything after - or + aside) reach a minimum."""
    numbers = lambda v: [int(x) if x.isdigit() else 0 for x in v.lstrip("vV").split("-")[0].split("+")[0].split(".")]
    a, b = numbers(have), numbers(want)
    n = max(len(a), len(b))
    return a + [0] * (n - len(a)) >= b + [0] * (n - len(b))
