"""URL filters: pattern rules indexed by their rarest literal token. DataFrame functions only.

A rule is a regular expression over `host + path` or over the whole url, with the literal tokens (runs of letters and
digits) that every url it matches must hold as whole tokens. Each rule is filed under the one of them that is rarest among
the tokens of the urls at hand; the tokens of a url fetch the rules filed under them, and only those run their regular
expression. Rules without such a token are filed under the empty token, which every url has, so none is lost.

Host rules `(host, path)` decide first: the host and its subdomains, a path that starts with the rule's, the longest
rule wins (then the greater text). A url that none fits is judged by the method's patterns (`PATTERNS`: blocked if any
matches), else allowed.

The verdict depends on the url alone, so distinct urls are judged once and joined back; only urls, never pages, are
shuffled, and rules are broadcast if there are at most `BROADCAST_RULES`, else joined by a shuffle.

Nulls and edge cases: a null url or one without `://` has an empty host and path, no rule and is judged by the patterns
(a null by none: allowed); repeated rows each get their verdict; a null page_id passes; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 50_000
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """`over`: "key" (host + path) or "url". `tokens`: whole lower-case tokens that each match holds."""

    name: str
    verdict: str
    pattern: str
    over: str
    tokens: tuple[str, ...]
    weight: int


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Tokens: the host's, and those of the path but for a last one that may go on in the url."""
    closed = re.findall(TOKEN + "(?=[^a-z0-9])", path) if path.isascii() and path == path.lower() else []
    return Rule(host + path, verdict, rf"^(?:[^/?#]*\.)?{_quoted(host)}{_quoted(path)}", "key", tuple(re.findall(TOKEN, host.lower()) + closed), len(host + path))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", text)


def pattern_rule(name: str, pattern: str, *tokens: str) -> Rule:
    return Rule(name, "block", pattern, "url", tokens, 0)


RULES = (host_rule("allow", "org", "/"), host_rule("block", "example.org", "/es/"), host_rule("block", "example.org", "/en/1"), host_rule("allow", "com", "/fr/"), host_rule("block", "com", "/de/"))
PATTERNS = (
    pattern_rule("tracked feed", r"[?&]utm_source=feed(?:[^a-z0-9]|$)", "utm", "source", "feed"),
    pattern_rule("paged with referrer", r"[?&]page=[0-9]+&ref=", "page", "ref"),
    pattern_rule("mobile host", r"^https?://m\.", "m"),
    pattern_rule("copied", r"/(?:mirror|proxy)/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The url's tokens and the empty one, under which rules without a token are filed."""
    lower = F.translate(url, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_append(F.array_distinct(F.regexp_extract_all(lower, F.lit(f"({TOKEN})"), F.lit(1))), F.lit(""))


def _few(table: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Marked for broadcast if there are at most BROADCAST_RULES; more are joined by a shuffle."""
    return F.broadcast(table) if len(rules) <= BROADCAST_RULES else table


def index(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row per rule with `token`, the rarest of its own among `urls(url, tokens)`; empty if it has none."""
    spark = urls.sparkSession
    table = spark.createDataFrame([(i, r.name, r.verdict, r.pattern, r.over, list(r.tokens), r.weight) for i, r in enumerate(rules)], "rule_id int, name string, verdict string, pattern string, over string, tokens array<string>, weight int")
    own = table.select("rule_id", F.explode("tokens").alias("token"))
    seen = urls.select(F.explode("tokens").alias("token")).join(_few(own.select("token").distinct(), rules), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = own.join(seen, "token", "left").groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    return table.drop("tokens").join(rarest, "rule_id", "left").withColumn("token", F.coalesce("token", F.lit("")))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, patterns: tuple[Rule, ...] = PATTERNS) -> DataFrame:
    """One row per row of `pages(page_id, url)`: page_id, url, host, path, rule, verdict, pattern (the method's, if one decided)."""
    host, path = parts(F.col("url"))
    urls = pages.select("url").where("url is not null").groupBy("url").agg(F.lit(1).alias("one")).select("url", F.concat(host, path).alias("key"), tokens(F.col("url")).alias("tokens"))
    filed = index(urls, (*rules, *patterns))
    candidates = urls.select("url", "key", F.explode("tokens").alias("token")).join(_few(filed, (*rules, *patterns)), "token")
    hits = candidates.where("CASE WHEN over = 'key' THEN key RLIKE pattern ELSE url RLIKE pattern END")
    ruled = F.col("over") == "key"
    best = hits.groupBy("url").agg(
        F.max_by(F.when(ruled, F.struct("name", "verdict")), F.when(ruled, F.struct("weight", "name"))).alias("r"),
        F.min(F.when(~ruled, F.col("name"))).alias("p"),
    )
    host, path = parts(pages["url"])
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path")).join(best, "url", "left")
    return out.select("page_id", "url", "host", "path", F.col("r.name").alias("rule"), F.coalesce("r.verdict", F.when(F.col("p").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.when(F.col("r").isNull(), F.col("p")).alias("pattern"))


def _sql() -> str:
    q = lambda s: s.replace("'", "''")
    fits = lambda r: f"regexp_matches(coalesce({r.over}, ''), '{q(r.pattern)}')"
    ordered = sorted(RULES, key=lambda r: (-r.weight, [-ord(c) for c in r.name]))
    pick = lambda what: " ".join(f"WHEN {fits(r)} THEN '{getattr(r, what)}'" for r in ordered)
    other = " OR ".join(fits(r) for r in PATTERNS)
    return rf"""
WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
k AS (SELECT *, host || path AS key FROM p)
SELECT page_id, host, path, CASE {pick("name")} END AS rule, CASE {pick("verdict")} WHEN {other} THEN 'block' ELSE 'allow' END AS verdict FROM k
"""


SQL = _sql()
