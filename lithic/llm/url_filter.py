"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that any URL it matches must hold. Each
rule is filed under the one of its tokens that the fewest URLs hold; the tokens of a URL fetch
candidate rules, and only those run. A rule without any token is a candidate for every URL.
Among the host rules that match, the longest gives the verdict; a URL that none fits gets
``block`` when a pattern rule matches it and ``allow`` otherwise.

A host rule fits its host and all subdomains when the path starts with the rule's path. The last
run of a path that doesn't end in a separator is only a prefix of a token, so it isn't indexed.

Only DataFrame functions are used. URLs are exploded into tokens and met with the index by an
equi-join that Spark broadcasts or shuffles by the index's size; the one shuffle is the sum a
URL, with partial sums first. Defined cases: a null url, or one without ``://``, has an empty
host and path; repeated rows come back as often as they went in; an empty table gives no rows;
columns other than the two named are ignored; equally long rules go by the longer host, then by
text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EVERY = ""  # the index entry of rules without a token


class Rule(NamedTuple):
    """``name`` host/path for host rules, free for patterns; ``on``: address or url."""

    verdict: str
    name: str
    pattern: str
    tokens: tuple[str, ...]
    on: str


def host_rule(verdict: str, rule: str) -> Rule:
    host, slash, path = rule.partition("/")
    whole = re.sub(r"[A-Za-z0-9]+$", "", slash + path)
    tokens = re.findall(r"[a-z0-9]+", host.lower()) + re.findall(r"[a-z0-9]+", whole.lower())
    return Rule(verdict, rule, rf"^(?:[^/]*\.)?{_quoted(host.lower())}{_quoted(slash + path)}", tuple(dict.fromkeys(tokens)), "address")


def pattern_rule(name: str, pattern: str, *tokens: str) -> Rule:
    """``tokens``: runs of a-z0-9 that stand whole in every URL the pattern matches."""
    return Rule("block", name, pattern, tokens, "url")


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


#: Gambling, adult, pharmacy, tracker, log-in and session addresses, each by whole tokens.
PATTERNS = (
    *(pattern_rule(word, rf"(?:^|[^a-z0-9]){word}(?:[^a-z0-9]|$)", word) for word in ("casino", "poker", "porn", "xxx", "viagra", "cialis", "doubleclick", "adserver", "adclick")),
    pattern_rule("login", r"/wp-login\.php(?:[?#]|$)", "wp", "login", "php"),
    pattern_rule("cgi", r"/cgi-bin/", "cgi", "bin"),
    pattern_rule("session", r"[?&;](?:php)?sessionid=", "sessionid"),
    pattern_rule("feed", r"/feed/(?:rss|atom)\.xml(?:[?#]|$)", "feed", "xml"),
)


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.split(F.translate(url, UPPER, LOWER), "[^a-z0-9]+"))


def rule_index(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rules, each with the token that the fewest of ``urls`` hold."""
    spark = urls.sparkSession
    listed = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rule_no int, verdict string, name string, pattern string, tokens array<string>, on string")
    # Only tokens of rules are counted, and they are picked before the rows are spread.
    wanted = F.lit(sorted({t for r in rules for t in r.tokens}) or [EVERY])
    held = urls.select(F.explode(F.array_intersect(tokens_of(F.col("url")), wanted)).alias("token")).groupBy("token").agg(F.count("*").alias("urls"))
    spread = listed.select("*", F.explode_outer("tokens").alias("token")).join(held, "token", "left")
    rarest = F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), F.coalesce("token", F.lit(EVERY)).alias("token"))).alias("rarest")
    chosen = spread.groupBy("rule_no", "verdict", "name", "pattern", "on").agg(rarest)
    return chosen.select(F.col("rarest.token").alias("token"), "verdict", "name", "pattern", "on")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], patterns: Sequence[Rule] = PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, pattern, verdict of every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    index = rule_index(rows, [*rules, *patterns])
    url = F.coalesce("url", F.lit(""))
    # Position 0 is the entry for rules without a token; it also counts the rows.
    spread = rows.select("page_id", "url", F.posexplode(F.concat(F.array(F.lit(EVERY)), F.array_remove(tokens_of(url), EVERY))).alias("at", "token"))
    met = spread.join(index, "token", "left")
    target = F.when(F.col("on") == "address", F.concat(host_of(F.col("url")), path_of(F.col("url")))).otherwise(F.translate("url", UPPER, LOWER))
    fits = F.coalesce(F.regexp_like(target, F.col("pattern")), F.lit(False))
    order = F.struct(F.length("name"), F.length(F.substring_index("name", "/", 1)), "name")
    by_host = fits & (F.col("on") == "address")
    # A token may fetch several rules; the row is counted at its first entry and first rule only.
    rules_of_every = sum(not r.tokens for r in (*rules, *patterns))
    weight = F.when(F.col("at") == 0, 1).otherwise(0)
    summed = met.groupBy("page_id", "url").agg(
        F.sum(weight).alias("times"),
        F.max_by(F.when(by_host, F.struct("name", "verdict")), F.when(by_host, order)).alias("best"),
        F.min(F.when(fits & (F.col("on") == "url"), F.col("name"))).alias("pattern"),
    )
    repeats = F.explode(F.array_repeat(F.lit(0), (F.col("times") / max(1, rules_of_every)).cast("int"))).alias("again")
    whole = summed.select("page_id", "url", "best", "pattern", repeats)
    verdict = F.coalesce("best.verdict", F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))
    return whole.select("page_id", host_of(F.coalesce("url", F.lit(""))).alias("host"), path_of(F.coalesce("url", F.lit(""))).alias("path"), F.col("best.name").alias("rule"), "pattern", verdict.alias("verdict"))
