"""Offline validation: whether a secret has the structure of what its rule looks for, without network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.plans.dialect import to_java
from sieveworks.plans.ruleset import RuleSet, default_rules
from sieveworks.plans.shapes import FORM

from .structure import STRUCTURE, structure_state

UNKNOWN, VALID, TEST, INVALID = "unknown", "structurally-valid", "test-credential", "invalid"
_TEST = r"(?i)(?:^(?:sk|rk)_test_|EXAMPLE$|^(?:AKIA)?(?:0{8,}|1234567890))"


def _base64url(part: Column) -> Column:
    raw = F.translate(part, "-_", "+/")
    padded = F.rpad(raw, F.char_length(raw) + F.pmod(-F.char_length(raw), F.lit(4)), F.lit("="))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def jwt_state(secret: Column) -> Column:
    """A web token is valid if header and payload are JSON and the header names an algorithm."""
    header, payload = (_base64url(F.split_part(secret, F.lit("."), F.lit(i))) for i in (1, 2))
    ok = F.get_json_object(header, "$.alg").isNotNull() & F.try_parse_json(payload).isNotNull()
    return F.when(F.coalesce(ok, F.lit(False)), VALID).otherwise(INVALID)


_ARMOR = r"(?s)^-----BEGIN ([A-Z ]*PRIVATE KEY(?: BLOCK)?)-----.+-----END \1-----$"


def forms(rules: RuleSet) -> dict[str, str]:
    """rule id -> the form of its whole secrets, for the rules that state one."""
    return {r.id: to_java(v.removeprefix(FORM)) for r in rules.rules for v in r.validation if v.startswith(FORM)}


def state_of(rule_id: Column, secret: Column, rules: RuleSet) -> Column:
    known = forms(rules) | {"private-key": _ARMOR}
    # One look-up for all rules; a case for each would be too large to compile.
    form = F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*map(F.lit, known.values()))), rule_id)
    shaped = F.when(~F.regexp_like(secret, form), INVALID).when(F.regexp_like(secret, F.lit(_TEST)), TEST).otherwise(VALID)
    return F.when(rule_id == "jwt", jwt_state(secret)).when(form.isNotNull(), shaped).otherwise(UNKNOWN)


def checks(rules: RuleSet) -> dict[str, str]:
    """rule id -> the structural check that it names, if any."""
    return {r.id: v.removeprefix(STRUCTURE) for r in rules.rules for v in r.validation if v.startswith(STRUCTURE)}


def validate(findings: DataFrame, rules: RuleSet | None = None, structure: bool = False) -> DataFrame:
    """findings with validation_state, by the forms that their rule set states (by default, the library's
    pack): unknown where there is no form to hold the secret against. With structure, rules that name a
    structural check go by that check, of secret and match, instead."""
    rules = rules or default_rules()
    state = state_of(F.col("rule_id"), F.col("secret"), rules)
    if structure and (named := checks(rules)):
        kind = F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*map(F.lit, named.values()))), F.col("rule_id"))
        state = F.coalesce(structure_state(kind, F.col("secret"), F.col("match")), state)
    return findings.withColumn("validation_state", state)


# What to do about a finding, by the first part of its rule id.
GUIDANCE = [
    ("aws", "aws", "Deactivate the key in IAM, then delete it and review its use."),
    ("github", "github", "Revoke the token in the developer settings and review the audit log."),
    ("gitlab", "gitlab", "Revoke the token in the access-token settings."),
    ("slack", "slack", "Rotate the token or the webhook in the app's settings."),
    ("stripe", "stripe", "Roll the key in the dashboard."),
    ("gcp", "google", "Delete the key and create one with restrictions."),
    ("npm", "npm", "Revoke the token and review published versions."),
    ("pypi", "pypi", "Revoke the token in the account settings."),
    ("private", "", "Replace the key pair wherever the public key is trusted."),
]


def analyze(findings: DataFrame) -> DataFrame:
    """A row for each finding with provider, risk and guidance."""
    table = findings.sparkSession.createDataFrame(GUIDANCE, "family string, provider_name string, guidance string")
    risk = F.when(F.col("validation_state").isin(TEST, INVALID), "low").when(F.col("validation_state") == VALID, "high").otherwise("medium")
    keyed = findings.withColumn("family", F.split_part("rule_id", F.lit("-"), F.lit(1)))
    joined = keyed.join(F.broadcast(table), "family", "left")
    return joined.select(
        "fingerprint", "rule_id", "path", "start_line", "validation_state", F.coalesce("provider_name", F.lit("")).alias("provider"), risk.alias("risk"),
        F.coalesce("guidance", F.lit("Rotate the secret and remove it from the source.")).alias("guidance"),
    )
