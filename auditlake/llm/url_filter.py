"""URL rules indexed by their rarest literal token, in DataFrame functions only.

A rule has a regular expression over host + path and the literal tokens that every URL it
fits must hold. It is indexed by the token that is rarest among the table's URLs. A URL's
tokens fetch candidate rules, and only those expressions are run on it.

A rule list is a table (rule, pattern, verdict, listed, tokens), such as ``rule_table`` makes of
a few rules in code; lists of up to ``BROADCAST_RULES`` rows are broadcast, longer ones meet the
URLs' tokens by a shuffle.

Listed rules (host and path prefix) win over pattern rules, longer ones over shorter ones;
a URL that nothing fits is allowed.

Defined results: a null URL, or one without ``://``, has empty host and path and is
allowed, as no listed rule fits it; repeated rows come back as often as they occur; an
empty table gives no rows; columns other than page_id and url are ignored. Of rules of
equal length the greater text wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rule lists up to this many entries are broadcast; longer ones are joined by a shuffle.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class UrlRule:
    """verdict for URLs whose host + path matches pattern; listed rules outrank the others."""

    text: str
    pattern: str
    verdict: str
    listed: bool
    tokens: tuple[str, ...] = field(default=())


def listed(verdict: str, text: str) -> UrlRule:
    """A rule like example.org/es/: the host, its subdomains, and paths that start so."""
    host, slash, path = text.partition("/")
    quoted = re.escape(host.lower() + slash + path)
    whole = re.split(r"[^a-z0-9]+", host.lower()) + re.split(r"[^a-z0-9]+", path.lower())[:-1]
    return UrlRule(text, rf"(?s)^(?:[^/]*\.)?{quoted}", verdict, True, tuple(dict.fromkeys(t for t in whole if t)))


def token_rule(verdict: str, token: str) -> UrlRule:
    """A pattern rule: a word of the host."""
    return UrlRule(token, rf"(?s)^(?:[^/]*[^a-z0-9/])?{token}(?:[^a-z0-9]|$)[^/]*", verdict, False, (token,))


#: The verdict where no listed rule fits: hosts that carry such a word are blocked.
HOST_WORDS = tuple(token_rule("block", t) for t in ("adult", "casino", "poker", "porn", "sex", "spam", "viagra", "warez", "xxx"))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// with A-Z in lower case, path up to ? or #."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens() -> Column:
    """The distinct tokens of host and path, and the empty token that every URL has."""
    found = F.split(F.lower(F.concat(F.col("host"), F.col("path"))), "[^a-z0-9]+")
    return F.array_union(F.array(F.lit("")), found)


def rule_table(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    """(rule, pattern, verdict, listed, tokens) of rules written in code; a long list should be read from a file."""
    fields = [F.struct(*[F.lit(v).alias(n) for n, v in (("rule", r.text), ("pattern", r.pattern), ("verdict", r.verdict), ("listed", r.listed))], F.array(*[F.lit(t) for t in r.tokens or ("",)]).alias("tokens")) for r in rules]
    return spark.range(1).select(F.inline(F.array(*fields)))


def rule_index(rules: DataFrame, urls: DataFrame, broadcast: bool) -> DataFrame:
    """(token, rule, pattern, verdict, listed): each rule under its rarest token among urls' tokens."""
    each = rules.select("rule", "pattern", "verdict", "listed", F.explode("tokens").alias("token"))
    wanted = each.select("token").distinct()
    wanted = F.broadcast(wanted) if broadcast else wanted
    seen = urls.select(F.explode(_tokens()).alias("token")).join(wanted, "token", "left_semi")
    counts = seen.groupBy("token").agg(F.count("*").alias("n"))
    ranked = each.join(counts, "token", "left").withColumn(
        "place", F.row_number().over(W.partitionBy("listed", "rule", "verdict").orderBy(F.coalesce("n", F.lit(0)), "token"))
    )
    return ranked.where("place = 1").select("token", "rule", "pattern", "verdict", "listed")


def judge(pages: DataFrame, rules: list[UrlRule] | DataFrame, defaults: tuple[UrlRule, ...] = HOST_WORDS) -> DataFrame:
    """page_id, url, host, path, rule (of the list, else null), verdict, fallback (the pattern rule, else null).

    rules: rules in code, or a table of them with the columns of rule_table().
    """
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    spark = pages.sparkSession
    every = rule_table(spark, [*rules, *defaults]) if isinstance(rules, list) else rules.select("rule", "pattern", "verdict", "listed", "tokens").unionByName(rule_table(spark, list(defaults)))
    small = (len(rules) if isinstance(rules, list) else rules.count()) + len(defaults) <= BROADCAST_RULES
    index = rule_index(every, urls, small)
    index = F.broadcast(index) if small else index
    candidates = urls.withColumn("token", F.explode(_tokens())).join(index, "token", "left")
    fits = F.rlike(F.concat("host", "path"), F.col("pattern"))
    best = F.max(F.when(fits, F.struct("listed", F.length("rule").alias("length"), "rule", "verdict")))
    found = candidates.groupBy("page_id", "url", "host", "path").agg(best.alias("best"), F.count_if(F.col("token") == "").alias("copies"))
    name = F.col("best.rule")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "page_id", "url", "host", "path",
        F.when(F.col("best.listed"), name).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.when(~F.col("best.listed"), name).alias("fallback"),
    )
