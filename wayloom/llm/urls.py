"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame functions only.

Every rule carries the literal tokens (runs of letters and digits, of the host or of the path) that any url it fits
must hold. Token frequencies over all urls pick the rarest token of each rule; the tokens of a url fetch the rules
filed under them by an equi-join, and only these candidates run their regular expression. Urls are first reduced to
distinct (host, path) pairs, so one very common url is judged once.

Two kinds of rules: *prefix rules* (host and path, fitting the host and its subdomains, path by prefix; the longest
fitting one decides) and *patterns* (a regular expression over host and path; an allow pattern beats a block pattern).
Where no prefix rule fits, the patterns decide, and where none fits the url is allowed.

Defined results: a null url or one without ``://`` has an empty host and path and is allowed; repeated rows get equal
results; an empty table gives an empty result. A rule without a literal token is refused, since nothing could fetch it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import UPPER, keep_table, lower_ascii

TOKEN = r"[0-9A-Za-z\x80-￿]+"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    prefix: bool


def prefix_rule(verdict: str, text: str) -> Rule:
    """Rule ``host/path``; a path token counts as literal only if the rule also shows where it ends."""
    host, _, path = text.partition("/")
    literal = [f"h:{t}" for t in re.findall(r"[0-9a-z]+", host)]
    literal += [f"p:{m[1]}" for m in re.finditer(r"(?<=[^0-9A-Za-z])([0-9A-Za-z]+)(?=[^0-9A-Za-z])", f"/{path}")]
    plain = re.sub(r"([^0-9A-Za-z/])", r"\\\1", text)
    return Rule(text, verdict, rf"^([^/]*\.)?{plain}", tuple(literal), True)


def host_word(verdict: str, word: str) -> Rule:
    """Pattern: ``word`` stands between dots or hyphens in the host."""
    plain = re.sub(r"([^0-9A-Za-z])", r"\\\1", word)
    literal = tuple(f"h:{t}" for t in re.findall(r"[0-9a-z]+", word))
    return Rule(word, verdict, rf"^([^/]*[.-])?{plain}([.-][^/]*)?(/|$)", literal, False)


PREFIX_RULES = (
    prefix_rule("block", "com/en/"),
    prefix_rule("allow", "example.com/en/7"),
    prefix_rule("allow", "net/de/"),
    prefix_rule("block", "example.net/de/8"),
    prefix_rule("block", "org/es/"),
)
PATTERNS = tuple(host_word("block", w) for w in ("casino", "adult", "free-bets", "cheap-pills", "spam-farm"))
RULES = PREFIX_RULES + PATTERNS


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    def kind(text: Column, mark: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.concat(F.lit(mark), t))

    return F.array_distinct(F.concat(kind(host, "h:"), kind(path, "p:")))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of ``pages``: id_col, host, path, rule, verdict."""
    spark = pages.sparkSession
    if any(not r.tokens for r in rules):
        raise ValueError("a rule has no literal token")
    split = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    distinct = keep_table(split.select("host", "path").distinct())
    tokens = distinct.select("host", "path", F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
    frequency = tokens.groupBy("token").agg(F.count("*").alias("df"))
    known = spark.createDataFrame(
        [(i, r.name, r.verdict, r.regex, r.prefix, list(r.tokens)) for i, r in enumerate(rules)],
        "rule_id int, rule string, says string, regex string, prefix boolean, literals array<string>",
    )
    filed = (
        known.select("rule_id", F.explode("literals").alias("token"))
        .join(frequency, "token", "left")
        .groupBy("rule_id")
        .agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), F.col("token"))).alias("token"))
        .join(known.drop("literals"), "rule_id")
    )
    fits = tokens.join(filed, "token").filter(F.expr("regexp_like(concat(host, path), regex)"))
    best = fits.groupBy("host", "path").agg(
        F.max(F.when(F.col("prefix"), F.struct(F.length("rule").alias("long"), F.col("rule"), F.col("says")))).alias("longest"),
        F.max(~F.col("prefix") & (F.col("says") == "block")).alias("blocked"),
        F.max(~F.col("prefix") & (F.col("says") == "allow")).alias("allowed"),
    )
    other = F.when(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False)), "block").otherwise("allow")
    return split.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("longest.rule").alias("rule"), F.coalesce("longest.says", other).alias("verdict")
    )


def _oracle() -> str:
    lower = f"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}')"
    prefixes = ", ".join(f"('{r.name}', '{r.verdict}', '{r.regex}')" for r in PREFIX_RULES)
    blocks = " OR ".join(f"regexp_matches(p.host || p.path, '{r.regex}')" for r in PATTERNS)
    return f"""
WITH p AS (SELECT page_id, {lower} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule, says, regex) AS (VALUES {prefixes}),
f AS (SELECT page_id, host, path, max(struct_pack(long := length(rule), rule := rule, says := says)) AS best
  FROM (SELECT DISTINCT page_id, host, path FROM p) JOIN r ON regexp_matches(host || path, regex) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, best.rule AS rule,
  coalesce(best.says, CASE WHEN {blocks} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f ON p.page_id = f.page_id AND p.host = f.host AND p.path = f.path
"""


ORACLE = _oracle()
