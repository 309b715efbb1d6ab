"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression over host and path, with the literal tokens that every
match must hold. It is filed under the one of them that the fewest URLs have; a URL's
tokens fetch the rules filed under them, and only those run their expressions. Tokens and
verdicts are worked out once for each distinct URL. Built-in functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path. Of the rules that match, one of the
    highest ``rank`` wins, then the longest name, then the first by name. Without
    literals a rule is tried on every URL.
    """

    name: str
    action: str
    pattern: str
    literals: tuple[str, ...] = field(default=())
    rank: int = 0


def tokens_of(text: str) -> tuple[str, ...]:
    return tuple(t for t in re.split("[^0-9a-z]+", text.lower()) if t)


def site_rule(action: str, name: str) -> Rule:
    """A rule for a host with its subdomains, and the paths that start with its path."""
    host, slash, path = name.partition("/")
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    # The path's last part may go on in a URL, so it is no whole token unless closed.
    whole = path if not path or path.endswith("/") else path.rpartition("/")[0]
    return Rule(name, action, pattern, tokens_of(f"{host}/{whole}"), rank=1)


def host_words(action: str, *words: str) -> Rule:
    """A rule for hosts that hold ``words`` in a row, joined by a hyphen or a dot."""
    joined = "[.-]".join(map(re.escape, words))
    return Rule("-".join(words), action, rf"^(?:[^/]*[.-])?{joined}[.-]", words)


SITE_RULES = (
    site_rule("allow", "com/"),
    site_rule("block", "example.com/en/"),
    site_rule("allow", "www.example.com/en/"),
    site_rule("block", "net/es/"),
    site_rule("block", "net/fr/"),
)
#: Hosts whose names advertise what no page of theirs should be kept for.
PATTERN_RULES = (
    host_words("block", "casino"),
    host_words("block", "poker"),
    host_words("block", "cheap", "pills"),
    host_words("block", "spam"),
    host_words("block", "free", "bets"),
    host_words("block", "free", "money"),
    host_words("block", "adult"),
    host_words("block", "ads"),
    host_words("block", "xxx"),
    host_words("block", "warez"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + PATTERN_RULES, default: str = "allow"
) -> DataFrame:
    """``pages`` (with ``url``) and ``url_filter``: host, path, the winning rule with its
    rank (null if none matches) and the verdict, its action or ``default``.

    Null and malformed URLs match only rules without literals. Every row comes back with
    all its columns, repeated ones too; one named ``url_filter`` is replaced.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.where("url IS NOT NULL").groupBy("url").agg(F.lit(1).alias("one"))
    text = F.concat(host, path)
    # Every URL has the empty token, which fetches the rules without literals.
    tokens = F.array_distinct(
        F.concat(
            F.array(F.lit("")),
            F.split(F.translate(text, UPPER, LOWER), "[^0-9a-z]+"),
        )
    )
    tokens = urls.select("url", text.alias("text"), F.explode(tokens).alias("token"))
    listed = spark.createDataFrame(
        [(r.name, r.action, r.pattern, list(r.literals) or [""], r.rank) for r in rules],
        "rule string, action string, pattern string, literals array<string>, rank int",
    )
    literals = listed.select("rule", "rank", F.explode("literals").alias("token"))
    seen = (
        tokens.join(literals.select("token").distinct(), "token")
        .groupBy("token")
        .agg(F.count("*").alias("urls"))
    )
    filed = (
        literals.join(seen, "token", "left")
        .groupBy("rule", "rank")
        .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)), "token"))["token"].alias("token"))
        .join(listed.drop("literals"), ["rule", "rank"])
    )
    best = F.struct(
        (-F.col("rank")).alias("order"), (-F.length("rule")).alias("size"), "rule", "action", "rank"
    )
    matched = (
        tokens.join(filed, "token")
        .where(F.rlike("text", F.col("pattern")))
        .groupBy("url")
        .agg(F.min(best).alias("best"))
    )
    row = F.struct(*[F.col(c) for c in pages.columns])
    df = pages.select(row.alias("_row"), F.col("url").alias("_url"))
    df = df.join(matched, F.col("_url") == F.col("url"), "left")
    host, path = host_and_path(F.col("_url"))
    result = F.struct(
        host.alias("host"),
        path.alias("path"),
        F.col("best.rule").alias("rule"),
        F.col("best.rank").alias("rank"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
    columns = [F.col("_row")[c].alias(c) for c in pages.columns if c != "url_filter"]
    return df.select(*columns, result.alias("url_filter"))
