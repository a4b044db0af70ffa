"""Operator 2: URL filter with rules indexed by their rarest literal token.

Method. A rule is a regular expression over host + path, with the literal tokens that
every match must contain. The frequency of all rule tokens is counted over the whole
URL column, and each rule is indexed under its rarest token. The tokens of a URL fetch
candidate rules from the index, only those run their expression, and the longest
matching rule wins.

Scale. Up to `INLINE_RULES` rules (a checked bound) the index is a literal map and a URL
is judged in place, without a shuffle. Larger rule sets are joined by token and the
best match is aggregated by row. Both give the same rows.

Edge cases. Null URLs and URLs without "://" have an empty host and path, match no rule
and are allowed. Rows are judged one by one, so repeated or null page_ids are kept.
Of equally long matching rules the smaller text wins. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table

INLINE_RULES = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """name is what is returned and whose length ranks the rule; tokens are whole literal tokens of every match."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = False


def prefix_rule(verdict: str, name: str) -> Rule:
    """A host with its subdomains and a path prefix, written host/path."""
    host, slash, path = name.partition("/")
    literal = host + slash + path
    pattern = r"^([^/]*\.)?" + re.escape(literal)
    tokens = re.findall(r"[A-Za-z0-9]+", literal)
    if not literal.endswith("/") and tokens and re.search(r"[A-Za-z0-9]$", literal):
        tokens = tokens[:-1]  # the last one may go on in the URL
    return Rule(name, verdict, pattern, tuple(tokens), True)


def host_words(verdict: str, *words: str) -> Rule:
    """These words next to each other, joined by hyphens or dots, somewhere in the host."""
    return Rule("host:" + "-".join(words), verdict, r"^([^/]*[.-])?" + "[.-]".join(map(re.escape, words)) + r"([.-][^/]*)?(/|$)", words)


#: The listed prefix rules.
LISTED = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Words of unwanted hosts.
UNWANTED_HOSTS = (
    ("casino",),
    ("pills",),
    ("free", "bets"),
    ("spam",),
    ("ads",),
    ("porn",),
    ("xxx",),
    ("viagra",),
    ("poker",),
    ("payday", "loans"),
)
RULES = tuple(prefix_rule(v, n) for v, n in LISTED) + tuple(host_words("block", *w) for w in UNWANTED_HOSTS)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(site: Column) -> Column:
    return F.array_distinct(F.split(site, "[^A-Za-z0-9]+"))


def index(sites: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rules with the token each is filed under: its rarest in sites(site), then the smallest."""
    spark = sites.sparkSession
    for r in rules:
        if not r.tokens:
            raise ValueError(f"rule {r.name} has no literal token")
    listed = spark.createDataFrame([(r.name, r.verdict, r.pattern, r.listed, list(r.tokens)) for r in rules], "rule string, verdict string, pattern string, listed boolean, tokens array<string>")
    words = listed.select(F.explode("tokens").alias("token")).distinct()
    # counted before they meet the rules, so that a token of most URLs is one row of each task
    seen = sites.select(F.explode(_tokens(F.col("site"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).join(words, "token")
    filed = listed.select("*", F.explode("tokens").alias("token")).join(seen, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token"))
    return filed.groupBy("rule", "verdict", "pattern", "listed").agg(rarest.alias("token"))


def _rank(listed: Column, rule: Column, verdict: Column) -> Column:
    """The smallest wins: listed rules, then long ones, then the smaller text."""
    return F.struct((~listed).alias("unlisted"), (-F.length(rule)).alias("size"), rule.alias("rule"), verdict.alias("verdict"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", inline: int = INLINE_RULES) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, matched: one row per page.

    rule is the winning listed rule or null; matched is the winning rule of any kind.
    A listed rule that fits always beats the method's own patterns.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    sites = parts.withColumn("site", F.concat("host", "path"))
    filed = index(sites, rules)
    if len(rules) <= inline:
        by_token: dict[str, list] = {}
        for r in filed.collect():
            by_token.setdefault(r.token, []).append({"rule": r.rule, "verdict": r.verdict, "pattern": r.pattern, "listed": r.listed})
        kind = "map<string,array<struct<rule:string,verdict:string,pattern:string,listed:boolean>>>"
        filed_under = F.from_json(F.lit(json.dumps(by_token, sort_keys=True)), kind)
        fetched = F.flatten(F.transform(_tokens(F.col("site")), lambda t: F.coalesce(F.element_at(filed_under, t), F.array().cast(kind[len("map<string,") : -1]))))
        fits = F.filter(fetched, lambda c: F.rlike(F.col("site"), c["pattern"]))
        best = F.array_min(F.transform(fits, lambda c: _rank(c["listed"], c["rule"], c["verdict"])))
        judged = sites.withColumn("best", best)
    else:
        ws = Workspace(pages.sparkSession, "url-filter")
        rows = ws.write(sites.withColumn("row", F.monotonically_increasing_id()), "sites")
        hits = rows.select("row", "site", F.explode(_tokens(F.col("site"))).alias("token")).join(filed, "token").filter(F.rlike("site", F.col("pattern")))
        best = hits.groupBy("row").agg(F.min(_rank(F.col("listed"), F.col("rule"), F.col("verdict"))).alias("best"))
        judged = rows.join(best, "row", "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(~F.col("best.unlisted"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.col("best.rule").alias("matched"),
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("matched")


QUERIES = {"op2_url_filters": op2_url_filters}

_FITS = "\n".join(
    f"    WHEN (host = '{n.partition('/')[0]}' OR ends_with(host, '.{n.partition('/')[0]}')) AND starts_with(path, '/{n.partition('/')[2]}') THEN '{n}'"
    for _, n in sorted(LISTED, key=lambda r: (-len(r[1]), r[1]))
)
_HOSTS = "|".join("[.-]".join(w) for w in UNWANTED_HOSTS)

ORACLE = {
    "op2_url_filters": rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (SELECT *, CASE
{_FITS}
    END AS rule FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({", ".join(f"'{n}'" for v, n in LISTED if v == "block")}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN regexp_matches(host, '(^|[.-])({_HOSTS})([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
}
