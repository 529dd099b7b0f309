"""URL filters: rules are indexed by their rarest literal token, the tokens of a URL fetch the
candidate rules, and only those run their regular expressions.

All of it is DataFrame functions. Distinct URLs are cut into tokens, joined with the index on the
token, tested with the candidates' expressions, and reduced to the longest matching rule; verdicts
join back to the rows on the URL. Hot hosts and hot URLs are partially aggregated before a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import join_checked, materialize

_TOKEN = re.compile(r"[a-z0-9]+")
#: Up to the first "://", never further.
HEAD = r"^(?>(?s:.*?)://)"
INDEX_SCHEMA = "token string, rule string, action string, length int, regex string, named boolean"


@dataclass(frozen=True)
class Rule:
    """A rule by host suffix and path prefix, like "example.net/en/", or (with named=False) a pattern
    rule: a regular expression over the lower-cased URL with the whole tokens that it needs."""

    text: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    named: bool = True

    @staticmethod
    def prefix(text: str, action: str) -> Rule:
        host, slash, path = text.partition("/")
        literal = f"{host.lower()}"
        regex = rf"{HEAD}(?:[^/?#]*\.)?(?i:{re.escape(literal)}){re.escape(slash + path)}" if slash else rf"{HEAD}(?:[^/?#]*\.)?(?i:{re.escape(literal)})(?:[/?#]|$)"
        # The last token of the path may go on in the URL, so only tokens that something ends count.
        whole = _TOKEN.findall(host.lower()) + [t.lower() for t in re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]
        return Rule(text, action, regex, tuple(whole))

    @staticmethod
    def word(word: str, action: str) -> Rule:
        """Any host that has this token between dots and hyphens."""
        token = word.lower()
        regex = rf"{HEAD}(?:[^/?#]*[^a-zA-Z0-9/?#])?(?i:{token})(?:[^a-zA-Z0-9][^/?#]*)?(?:[/?#]|$)"
        return Rule(f"*{token}*", action, regex, (token,), named=False)


#: Words of hosts that are blocked where no listed rule speaks.
SPAM_WORDS = ("spam", "adult", "porn", "xxx", "casino", "betting", "pills", "viagra", "escort", "warez", "torrent", "phishing", "malware")


def index_rules(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules, each under the one of its tokens that the fewest rules have (ties: the longest, then
    the first by name); rules without a whole token stand under the empty token, which every URL has."""
    times: dict[str, int] = {}
    for r in rules:
        for t in set(r.tokens):
            times[t] = times.get(t, 0) + 1
    rows = [(min(r.tokens, key=lambda t: (times[t], -len(t), t), default=""), r.text, r.action, len(r.text), r.regex, r.named) for r in rules]
    return spark.createDataFrame(rows, INDEX_SCHEMA)


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """A row (page_id, host, path, rule, verdict, pattern) for each row of pages(page_id, url, ...).

    host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the
    end; both empty for a null url or one without ://. The longest listed rule that matches gives rule and
    verdict (ties: block before allow, then by name); without one, rule is null and the longest pattern
    rule gives the verdict and stands in pattern; without that, the verdict is the default. Repeated rows
    give repeated results, further columns are ignored, an empty table gives no rows."""
    spark = pages.sparkSession
    index = index_rules(spark, rules)
    # One row for each distinct URL, so that a hot one is tested once.
    urls = pages.select(F.col("url").cast("string").alias("url")).where("url is not null").distinct()
    ascii_lower = F.translate("url", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.split(ascii_lower, "[^a-z0-9]+")))
    fetched = join_checked(urls.select("url", F.explode(tokens).alias("token")), index, "token", "inner", 512)
    hits = fetched.where(F.regexp_like("url", F.col("regex")))
    best = F.max(F.struct("named", "length", (F.col("action") == "block").alias("strict"), "rule", "action"))
    found = materialize(hits.groupBy("url").agg(best.alias("best")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = join_checked(rows, found, "url", "left", 256)
    url = F.coalesce("url", F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return rows.select(
        "page_id",
        host.alias("host"),
        path.alias("path"),
        F.when(F.col("best.named"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
        F.when(~F.col("best.named"), F.col("best.rule")).alias("pattern"),
    )
