"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over `host + path` (site rules) or over the whole URL, with the literal tokens (runs of
a-z and 0-9, in lower case, cut as URLs are) that every URL it matches must hold. The token that fewest URLs of the
input hold becomes the rule's index key; a URL's tokens fetch candidate rules by a join, and only those run their
regular expressions. A rule without literal tokens is a candidate for every URL. What a URL's candidates say is gathered
before the one shuffle of the pages, which brings the tokens of a URL together.

Edge cases: a null URL, or one without `://`, has an empty host and path and matches no site rule; repeated rows are all
kept; an empty table gives no rows; without rules every URL is allowed; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, UPPER, ascii_lower

#: Rule tables up to this many rows are broadcast; larger ones join by shuffle.
BROADCAST_RULES = 10_000


@dataclass(frozen=True)
class UrlRule:
    """on: 'site' (host + path) or 'url'. Of a URL's site rules the longest wins, and any site rule outranks url rules."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    on: str = "url"


def literal(text: str) -> str:
    """A pattern for the text itself, in Java's and RE2's syntax."""
    return re.sub(r"([\\.+*?()\[\]{}^$|])", r"\\\1", text)


def literal_tokens(text: str, open_end: bool) -> tuple[str, ...]:
    """The tokens of a literal text; of one that may go on, without a token at its end."""
    found = re.split("[^a-z0-9]+", "".join(LOWER[UPPER.index(c)] if c in UPPER else c for c in text))
    return tuple(dict.fromkeys(x for x in (found[:-1] if open_end else found) if x))


def site_rule(action: str, host: str, path: str) -> UrlRule:
    """Fits host (in lower case) and all its subdomains, if the path starts with `path`."""
    end = literal(path) if path else "(?:/|$)"
    return UrlRule(host + path, action, rf"^(?:[^/]*\.)?{literal(host)}{end}", literal_tokens(host + path, bool(path)), "site")


def word_rule(name: str, phrase: str) -> UrlRule:
    """Blocks URLs that hold the phrase's tokens next to each other, with anything else around them."""
    tokens = literal_tokens(phrase, False)
    body = r"[^a-z0-9]+".join(tokens)
    return UrlRule(name, "block", rf"(?:^|[^a-z0-9]){body}(?:[^a-z0-9]|$)", tokens)


SITE_RULES = (
    site_rule("allow", "org", "/"),
    site_rule("block", "example.org", "/es/"),
    site_rule("block", "example.org", "/en/1"),
    site_rule("allow", "com", "/fr/"),
    site_rule("block", "com", "/de/"),
)
PATTERN_RULES = (
    word_rule("cheap-pills", "cheap pills"),
    word_rule("spam-farm", "spam farm"),
    word_rule("online-casino", "online casino"),
    word_rule("free-download", "free download"),
    word_rule("payday-loans", "payday loans"),
    word_rule("xxx", "xxx"),
    word_rule("wp-login", "wp login php"),
    word_rule("cgi-bin", "cgi bin"),
    word_rule("replica-watches", "replica watches"),
    word_rule("link-exchange", "link exchange"),
)
RULES = SITE_RULES + PATTERN_RULES


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(url), "[^a-z0-9]+"), lambda x: x != ""))


def rule_table(spark: SparkSession, rules: Sequence[UrlRule]) -> DataFrame:
    """number, rule, action, pattern, site, tokens; number tells rules of one name apart."""
    rows = [(n, r.name, r.action, r.pattern, r.on == "site", list(r.tokens)) for n, r in enumerate(rules)]
    return spark.createDataFrame(rows, "number int, rule string, action string, pattern string, site boolean, tokens array<string>")


def index_rules(urls: DataFrame, rules: Sequence[UrlRule] = RULES) -> DataFrame:
    """rule, action, pattern, site, key: the rule's token that fewest URLs hold (ties: the first in order), null for a rule without tokens."""
    table = rule_table(urls.sparkSession, rules)
    sized = F.broadcast if len(rules) <= BROADCAST_RULES else lambda x: x
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    counts = urls.select(F.explode(tokens_of(F.col("url"))).alias("token")).join(sized(wanted), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    scored = table.select("number", F.explode("tokens").alias("token")).join(sized(counts), "token", "left").groupBy("number").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("rarest"))
    return table.join(scored, "number", "left").select("rule", "action", "pattern", "site", F.col("rarest.token").alias("key"))


def judge(pages: DataFrame, rules: Sequence[UrlRule] = RULES) -> DataFrame:
    """page_id, url, host, path, rule (the winning site rule), blocked_by (a matching url rule, if no site rule fits), verdict."""
    urls = pages.select("page_id", "url")
    index = index_rules(urls, rules).withColumn("key", F.coalesce("key", F.lit("")))
    sized = F.broadcast if len(rules) <= BROADCAST_RULES else lambda x: x
    # the token '' stands for the URL itself: it fetches rules without tokens, and is there for every row
    keyed = urls.select("page_id", "url", F.explode(F.concat(F.array(F.lit("")), tokens_of(F.coalesce("url", F.lit(""))))).alias("token"))
    candidates = keyed.join(sized(index), F.col("token") == F.col("key"), "left")
    site = F.concat(host_of(F.col("url")), path_of(F.col("url")))
    fits = F.col("key").isNotNull() & F.rlike(F.when(F.col("site"), site).otherwise(ascii_lower(F.coalesce("url", F.lit("")))), F.col("pattern"))
    judged = candidates.select("page_id", "url", (F.col("token") == "").alias("row"), "rule", "action", "site", "key", F.when(F.col("key").isNotNull(), fits).otherwise(False).alias("fits"))
    # rows of the table are counted on their '' token, of which a rule without tokens makes one per rule
    free = sum(not r.tokens for r in rules)
    ranked = judged.groupBy("page_id", "url").agg(
        F.max(F.when(F.col("fits") & F.col("site"), F.struct(F.length("rule"), "rule", "action"))).alias("base"),
        F.min(F.when(F.col("fits") & ~F.col("site") & (F.col("action") == "block"), F.col("rule"))).alias("pattern"),
        (F.count_if("row") / max(1, free)).cast("int").alias("copies"),
    )
    rows = ranked.select("page_id", "url", "base", F.when(F.col("base").isNull(), F.col("pattern")).alias("blocked_by"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    verdict = F.coalesce("base.action", F.when(F.col("blocked_by").isNotNull(), "block"), F.lit("allow"))
    return rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("base.rule").alias("rule"), "blocked_by", verdict.alias("verdict"))
