"""URL filters: rules indexed by their rarest literal token, in DataFrame functions only.

A rule is a host and a path prefix, or a pattern of literals, `*` (anything) and `^` (a separator or an end). Each is
turned into a regular expression and filed under one token (a run of letters and digits) that every matching URL must
hold whole: the rule's rarest over all URLs. A URL's tokens fetch their rules from the index in a hash join, and only
fetched rules run their expression, as the join's own condition. Rules without such a token are tried on every URL.
Pages meet no other page: the aggregate that picks a page's rule has its rows in one task already, so one row per
page is shuffled, however many pages a host has.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.llm.common import lower_ascii, written

#: Rules of hosts and paths: (verdict, host, path prefix).
HOST_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Patterns for URLs that no host rule fits; an allowing pattern goes before a blocking one.
PATTERNS = (
    ("block", "/ads/"), ("block", "/adserver^"), ("block", "/banner*.gif^"), ("block", "/cgi-bin/"), ("block", "/wp-admin/"),
    ("block", "/wp-login.php^"), ("block", "^phpsessid="), ("block", "*casino-bonus*"), ("block", "://tracker.*"), ("allow", "/ads/policy^"),
)
DEFAULT_VERDICT = "allow"
#: Rules that are broadcast; a longer list is joined by a shuffle of tokens.
BROADCAST_RULES = 200_000
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """expression is searched in host + path for host rules (names set), in the lower-cased URL for patterns."""

    name: str
    verdict: str
    is_host: bool
    expression: str
    tokens: tuple[str, ...]


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains and paths that start with `path`; a token cut off by the path's end is no token."""
    host = host.lower()
    whole = re.sub(r"[A-Za-z0-9]+$", "", path)
    tokens = tuple(sorted(set(re.findall(TOKEN, host) + re.findall(TOKEN, whole.lower()))))
    return Rule(host + path, verdict, True, rf"^(?:[^/]*\.)?{_quoted(host)}{_quoted(path)}", tokens)


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """A token counts if a literal other than a letter or digit, or a separator, stands on both sides of it."""
    pattern = pattern.lower()
    parts = [r".*" if c == "*" else r"(?:[^a-z0-9_.%-]|^|$)" if c == "^" else _quoted(c) for c in pattern]
    inner = re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", pattern)
    return Rule(pattern, verdict, False, "(?s)" + "".join(parts), tuple(sorted(set(inner))))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [pattern_rule(*r) for r in PATTERNS]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null or a URL without `://`."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lower_ascii(F.coalesce(url, F.lit(""))), F.lit(TOKEN), F.lit(0)))


def rule_index(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rank, name, verdict, is_host, expression, token: the higher rank wins; the token is null where a rule has none.

    Host rules rank above patterns and by length, then blocking before allowing at the same length; allowing patterns
    rank above blocking ones. Rules whose rarest token no URL has are left out.
    """
    spark = pages.sparkSession
    listed = spark.createDataFrame(
        [(r.name, r.verdict, r.is_host, r.expression, list(r.tokens)) for r in dict.fromkeys(rules)],
        "name string, verdict string, is_host boolean, expression string, tokens array<string>")
    order = [F.col("is_host"), F.when(F.col("is_host"), F.length("name")), F.when(F.col("is_host"), F.col("verdict") == "block").otherwise(F.col("verdict") == "allow"), "name", "expression"]
    ranked = written(listed.orderBy(*order).withColumn("rank", F.monotonically_increasing_id()))
    each = ranked.select("rank", F.explode("tokens").alias("token"))
    vocabulary = each.select("token").distinct()
    near = F.broadcast(vocabulary) if len(rules) <= BROADCAST_RULES else vocabulary
    counts = pages.select(F.explode(tokens_of(F.col("url"))).alias("token")).join(near, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counted = each.join(counts, "token", "left").select("rank", "token", F.coalesce("n", F.lit(0)).alias("n"))
    rarest = counted.groupBy("rank").agg(F.min(F.struct("n", "token")).alias("x"))
    found = ranked.join(rarest, "rank", "left").filter("x is null or x.n > 0")
    return written(found.select("rank", "name", "verdict", "is_host", "expression", F.col("x.token").alias("token")))


def judge_urls(pages: DataFrame, rules: Sequence[Rule] | None = None, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern of every row of `pages`.

    `rule` names the host rule that decided, `pattern` the pattern that did; with neither the verdict is `default`.
    Null URLs and those without `://` have an empty host and path and fit no host rule. Repeated rows come back as often
    as they are there.
    """
    rules = list(default_rules() if rules is None else rules)
    index = rule_index(pages, rules)
    spark: SparkSession = pages.sparkSession
    wide = len(rules) > BROADCAST_RULES
    host, path = host_and_path(F.col("url"))
    # The empty token stands in every URL once: it fetches the rules without a token and a mark that keeps the page.
    every = F.concat(tokens_of(F.col("url")), F.array(F.lit("")))
    each = pages.select("page_id", "url", host.alias("host"), path.alias("path"), F.explode(every).alias("token"))
    mark = spark.createDataFrame([(None, False, None, "")], "rank long, is_host boolean, expression string, token string")
    filed = index.select("rank", "is_host", "expression", F.coalesce("token", F.lit("")).alias("filed")).union(mark)
    target = F.when(F.col("is_host"), F.concat("host", "path")).otherwise(lower_ascii(F.coalesce("url", F.lit(""))))
    fits = (F.col("token") == F.col("filed")) & (F.col("rank").isNull() | F.call_function("rlike", target, F.col("expression")))
    best = each.join(filed if wide else F.broadcast(filed), fits).groupBy("page_id", "url", "host", "path").agg(
        F.max("rank").alias("rank"), F.sum(F.col("rank").isNull().cast("int")).alias("copies"))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    named = index.select("rank", "name", "is_host", F.col("verdict").alias("given"))
    return best.join(named if wide else F.broadcast(named), "rank", "left").select(
        "page_id", "host", "path", F.when(F.col("is_host"), F.col("name")).alias("rule"),
        F.coalesce("given", F.lit(default)).alias("verdict"), F.when(~F.col("is_host"), F.col("name")).alias("pattern"))
