"""URL filters: pattern rules, each found through the rarest of its literal tokens.

A rule is a regular expression over host and path, with the literal tokens that every
matching URL must have as whole tokens. How often tokens occur is counted over all URLs; the
rule is indexed by its rarest token. The tokens of a URL fetch candidate rules, and only
those are run.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no rule.
Equal URLs get equal results; repeated rows and null ids are kept. Of fitting rules of equal
weight the greater name counts. A very long URL is read whole. A rule without a literal token is
refused. Other columns are kept, but for ``host``, ``path``, ``rule`` and ``verdict``, which the
results replace. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.store import stored
from topicloom.scale import lookup_join

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile(r"[A-Za-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``name`` is null for rules of which only the verdict is reported.

    Of the rules that match a URL the one with the greatest ``weight`` counts.
    """

    action: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    name: str | None = None


def host_rule(action: str, rule: str) -> Rule:
    """A rule ``host/path``: fits the host and its subdomains, and paths that begin so."""
    host, slash, path = rule.partition("/")
    # A token at the end of the rule may go on in the URL, so it is no whole token.
    whole = [m.group() for m in _TOKEN.finditer(rule) if m.end() < len(rule)]
    if not whole:
        raise ValueError(f"rule {rule!r} has no whole token")
    quoted = re.sub(r"([^A-Za-z0-9/])", r"\\\1", host + slash + path)
    return Rule(action, rf"^(?:[^/]*\.)?{quoted}", tuple(dict.fromkeys(whole)),
                1_000_000 + len(rule), rule)


def word_rule(action: str, word: str, where: str = "host") -> Rule:
    """A rule that fits a whole token in the host, or in the path."""
    before = r"^(?:[^/]*[^A-Za-z0-9/])?" if where == "host" else r"^[^/]*/(?:.*[^A-Za-z0-9])?"
    return Rule(action, rf"{before}{word}(?:[^A-Za-z0-9]|$)", (word,), len(word))


#: Hosts with such words are blocked unless a named rule says otherwise.
BLOCKED_WORDS = (
    "ads", "adserver", "bet", "bets", "betting", "casino", "escort", "gambling", "jackpot",
    "malware", "pills", "phishing", "poker", "porn", "slots", "spam", "torrent", "track",
    "tracker", "viagra", "warez", "xxx",
)


def default_rules() -> list[Rule]:
    return [word_rule("block", word) for word in BLOCKED_WORDS]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty without ``://``."""
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(after, "^[^?#]*", 0)


def _tokens(place: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(place, F.lit("[A-Za-z0-9]+"), F.lit(0)))


def rule_index(spark: SparkSession, rules: Sequence[Rule], counts: DataFrame) -> DataFrame:
    """(token, rule, action, pattern, weight): every rule under its rarest token.

    ``counts`` has (token, n) of the URLs; a token that is missing there is the rarest.
    """
    rows = [(i, r.name, r.action, r.pattern, r.weight, list(r.tokens))
            for i, r in enumerate(rules)]
    table = spark.createDataFrame(
        rows, "id int, rule string, action string, pattern string, weight int, "
              "tokens array<string>"
    )
    each = table.select("*", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rank = F.struct(F.coalesce("n", F.lit(0)), F.col("token"))
    return each.groupBy("id", "rule", "action", "pattern", "weight").agg(
        F.min_by("token", rank).alias("token")
    ).drop("id")


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow"
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``.

    ``rule`` is the name of the rule that counts, null if it has none or no rule fits.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    parted = pages.select("*", host.alias("_host"), path.alias("_path"))
    places = stored(parted.select("_host", "_path").distinct(), "url-places").withColumn(
        "_place", F.concat("_host", "_path"))
    tokens = places.select("_host", "_path", "_place", F.explode(_tokens(F.col("_place"))).alias(
        "token"))
    wanted = sorted({t for r in rules for t in r.tokens})
    counts = tokens.where(F.col("token").isin(wanted)).groupBy("token").agg(
        F.count("*").alias("n"))
    index = stored(rule_index(spark, rules, counts), "url-rules")
    candidates = lookup_join(tokens, index, "token")
    fitting = candidates.where(F.expr("_place rlike pattern"))
    best = fitting.groupBy("_host", "_path").agg(
        F.max(F.struct("weight", "rule", "action")).alias("_best"))
    # Many pages may share one place, all without an address for one: nothing is dealt by it
    # unless the places with a rule are too many to be sent.
    judged = lookup_join(parted, stored(best, "url-verdicts"), ["_host", "_path"], "left")
    results = ("host", "path", "rule", "verdict")
    return judged.select(
        *(c for c in pages.columns if c not in results), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.action", F.lit(default)).alias("verdict"),
    )
