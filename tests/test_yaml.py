"""The YAML index by value, and the detectors that read it."""

import base64
import time

import pytest

from sieveworks.operators.detectors import FUNCTIONS
from sieveworks.operators.yaml_index import YamlIndex, yaml_mappings
from sieveworks.plans.ruleset import default_rules, parse
from sieveworks.plans.scan import ScanOptions, scan


def values(text):
    return [[(k, v) for k, v, _, _ in m.values] for m in YamlIndex(text).mappings]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a: b\nc: d e # x\nf: http://x:80/y#z\n", [[("a", "b"), ("c", "d e"), ("f", "http://x:80/y#z")]]),
        ("a:\n  b: 1\n  c:\n    d: 2\ne:\nf: 3\n", [[("f", "3")], [("b", "1")], [("d", "2")]]),
        ("- a: 1\n  b: 2\n-\n  c: 3\n- - d: 4\n- e\n", [[("a", "1"), ("b", "2")], [("c", "3")], [("d", "4")]]),
        ("a:\n- b: 1\n- c\nd: 2\n", [[("d", "2")], [("b", "1")]]),
        ("a: |\n  one\n   two\n\n  three\nb: |-\n  x\nc: |+\n  y\n\nd: |2\n    z\n", [[("a", "one\n two\n\nthree\n"), ("b", "x"), ("c", "y\n\n"), ("d", "  z\n")]]),
        ("a: >\n  one\n  two\n\n  three\n    four\n  five\nb: >-\n  x\n  y\n", [[("a", "one two\nthree\n  four\nfive\n"), ("b", "x y")]]),
        ("a: 'it''s'\nb: \"x\\ty\\u00e9\\x41\\\"\"\nc: \"one\n  two\n\n  three\"\nd: 'one\n  two'\ne: \"a\\\n   b\"\n", [[("a", "it's"), ("b", 'x\tyéA"'), ("c", "one two\nthree"), ("d", "one two"), ("e", "ab")]]),
        ("a: one\n  two\n\n  three\nb: c\n", [[("a", "one two\nthree"), ("b", "c")]]),
        ("{a: b, 'c': \"d\", e: [1, {f: g}, h: i], j:, \"k\":l}\n", [[("a", "b"), ("c", "d"), ("k", "l")], [("f", "g")], [("h", "i")]]),
        ("a: !!str &x b\nc: &y\n  d: e\nf: *x\ng: [*x, z]\n", [[("a", "b")], [("d", "e")]]),
        ("%YAML 1.2\n---\na: b\n...\n# c\n--- \nd: e\n", [[("a", "b")], [("d", "e")]]),
        ("a: b\r\nc:\r\n  d: e\r\n", [[("a", "b")], [("d", "e")]]),
        ("? k\n: v\n? m\nz: 1\n", [[("", "v"), ("z", "1")]]),
        ("plain text\n", []), ("", []), ("# only\n", []), ('{"a": {"b": [1, "x"]}}', [[], []]),
    ],
)
def test_forms(text, want):
    assert values(text) == want


@pytest.mark.parametrize("text", ["a: b: c\n", "a: [1, 2\n", "a: 'x\n", "a: b\n   c: d\n", "a: {b: c]\n", "a: b\n c\n d: e\n", "[" * 65 + "]" * 65, "- " * 70 + "x", "a: |x\n  y\n", "a: b\n- c\n"])
def test_no_yaml_has_no_index(text):
    with pytest.raises(ValueError):
        YamlIndex(text)
    assert yaml_mappings(text) == []


def test_spans_point_at_the_value():
    text = "é: x\nkind: Secret\nstringData:\n  a: \"quoted\"\n  b: |\n    block one\n    two\n  c: {d: 'in'}\n"
    for m in YamlIndex(text).mappings:
        for _, value, start, end in m.values:
            assert "".join(text[start:end].split()) == "".join(value.split())


@pytest.mark.parametrize("text", ["- " * 100_000, "[" * 100_000, "a:" + " " * 1_000_000 + "b", "'" * 1_000_000, 'a: "' + "\\" * 1_000_000, "a: b\n" * 100_000, "x " * 500_000, ":" * 1_000_000, "k: " + "y\n " * 300_000, "[" + "a, " * 300_000 + "]", "- a\n" * 100_000, "&a " * 300_000, "a: |\n" + " x\n" * 200_000])
def test_no_text_holds_up_the_parser(text):
    start = time.monotonic()
    yaml_mappings(text)
    assert time.monotonic() - start < 30


def secrets(text, name="kubernetes-secret-decoded"):
    return [v for _, _, v in FUNCTIONS[name](text)]


def test_kubernetes_secrets():
    encoded = base64.b64encode(b"some-password").decode()
    assert secrets(f"apiVersion: v1\ndata:\n  password: {encoded}\nstringData:\n  apiKey: some-api-key-value\nkind: Secret") == ["some-password", "some-api-key-value"]
    # Aliases are not expanded.
    assert secrets("kind: Secret\nshared: &credential some-password\nstringData:\n  password: *credential\n") == []
    # Only the items that are secrets count.
    assert secrets("kind: List\nitems:\n- kind: Secret\n  stringData:\n    password: some-password\n- kind: ConfigMap\n  data:\n    setting: no-secret\n") == ["some-password"]
    assert secrets("{kind: Secret, stringData: {a: in-braces-1}}\n---\nkind: Secret\nstringData:\n  a: |\n    in a block\n  b: >-\n    folded\n    text\n") == ["in-braces-1", "in a block\n", "folded text"]
    assert secrets("kind: ConfigMap\ndata:\n  a: c29tZQ==\n") == secrets("kind: ExternalSecret\nstringData:\n  a: b\n") == secrets("kind: Secret\ndata: {a: 'no base64!', b: ''}\n") == []
    assert secrets(f"kind: Secret\ndata: {{a: {encoded}}}", "kubernetes-secret") == [encoded]


def test_native_pack_runs_all_detectors(spark):
    files = {
        "auth.json": '{"tokens": {"access_token": "abcdefghijklmnop1234567890", "account": "x"}}',
        "key.json": '{"kty": "EC", "crv": "P-256", "x": "a", "d": "c2VjcmV0LWtleS1ieXRlcw-0123"}',
        "m.json": '{"mcpServers": {"one": {"command": "npx", "env": {"API_KEY": "mcp_a8F2kL9mQ4xT7vN1zR6pW3cY5uH0", "LEVEL": "debug"}}}}',
        "s.yaml": "kind: Secret\nstringData:\n  password: aB3-xY9-kL2-pQ7\n",
    }
    content = spark.createDataFrame(list(files.items()), "path string, text string")
    rules = default_rules().enable(["codex-credentials", "jwk-private-key", "mcp-server-credential", "kubernetes-secret"])
    got = {(r.path, r.rule_id, r.secret) for r in scan(content, rules, ScanOptions(mode="native")).collect()}
    assert got == {
        ("auth.json", "codex-credentials", "abcdefghijklmnop1234567890"), ("key.json", "jwk-private-key", "c2VjcmV0LWtleS1ieXRlcw-0123"),
        ("m.json", "mcp-server-credential", "mcp_a8F2kL9mQ4xT7vN1zR6pW3cY5uH0"), ("s.yaml", "kubernetes-secret", "aB3-xY9-kL2-pQ7"),
    }


def test_decoded_values_stand_where_they_are_written(spark):
    text = "# é\nkind: Secret\ndata:\n  a: c29tZS1wYXNzd29yZA==\n"
    rules = parse('[[rules]]\nid = "k"\ndetector = "kubernetes-secret-decoded"\nkeywords = ["secret"]')
    r = scan(spark.createDataFrame([("a.yml", text)], "path string, text string"), rules, ScanOptions(mode="native")).first()
    assert (r.secret, r.match, r.start_line, r.start_column, r.end_column) == ("some-password", "c29tZS1wYXNzd29yZA==", 4, 6, 26)
