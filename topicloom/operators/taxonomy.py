"""Map category paths to topics with include and exclude prefixes."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark import Row
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.categories import strip_top_prefix
from topicloom.scale import (
    BROADCAST_ROWS,
    explode_once,
    fits_broadcast,
    lookup_join,
    with_row_key,
    written_lookup,
)


class PrefixMap:
    """Rules as a dictionary of prefixes: a path costs one look-up per distinct length."""

    def __init__(self, rules: list[Row], segment_aware: bool = False) -> None:
        self.names = [rule.name for rule in rules]
        self.segment_aware = segment_aware
        self.rules_of: dict[str, list[tuple[int, bool]]] = defaultdict(list)
        for number, rule in enumerate(rules):
            for prefixes, included in ((rule.includes, True), (rule.excludes, False)):
                for prefix in prefixes or ():
                    if prefix is not None:
                        self.rules_of[prefix].append((number, included))
        self.lengths = sorted({len(prefix) for prefix in self.rules_of})

    def topics(self, category: str | None) -> list[str]:
        """Topics of the rules with an included prefix of the category and no excluded one."""
        if category is None:
            return []
        path = category.removeprefix("Top/")
        wanted, refused = set(), set()
        for length in self.lengths:
            if length > len(path):
                break
            if self.segment_aware and length < len(path) and path[length] != "/":
                continue
            for rule, included in self.rules_of.get(path[:length], ()):
                (wanted if included else refused).add(rule)
        return [self.names[rule] for rule in sorted(wanted - refused)]


def _topic_rows(pages: DataFrame) -> DataFrame:
    named = {"categories": F.array("topic"), "origCategories": F.col("categories")}
    return pages.withColumns(named).drop("topic", "category", "_row")


def map_to_topics(
    pages: DataFrame,
    rules: DataFrame,
    segment_aware: bool = False,
    dedupe: bool = False,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per (page, category, matching rule) with the topic as only category.

    A page with two categories that match one rule appears twice, unless ``dedupe``.
    Other columns are carried along.
    The rules are measured and sent as a dictionary of prefixes, whether there are six or a
    hundred thousand: no join, no shuffle, and of a page only its categories are looked at.
    Rules beyond the bound go through ``map_to_topics_by_prefix``.
    """
    known = rules.select("name", "includes", "excludes")
    if not fits_broadcast(known, max_broadcast_rows):
        return map_to_topics_by_prefix(pages, rules, segment_aware, dedupe)
    shared = pages.sparkSession.sparkContext.broadcast(PrefixMap(known.collect(), segment_aware))

    @F.arrow_udf("array<string>")
    def topics_of(lists: pa.Array) -> pa.Array:
        import pyarrow as pa

        prefixes, known = shared.value, {}
        out = []
        for categories in lists.to_pylist():
            found = []
            for category in categories or ():
                if category not in known:
                    known[category] = prefixes.topics(category)
                found += known[category]
            out.append(found)
        return pa.array(out, pa.list_(pa.string()))

    topics = topics_of("categories")
    if dedupe:
        topics = F.array_distinct(topics)
    return _topic_rows(explode_once(pages.withColumn("_topics", topics), F.col("_topics"),
                                    "topic").drop("_topics"))


def category_topics(
    categories: DataFrame, rules: DataFrame, segment_aware: bool = False
) -> DataFrame:
    """(category, rule, topic) for distinct categories, by equality instead of comparison.

    Every category is cut at each length that some rule prefix has, and the cuts are
    joined with the prefixes, so no category meets a rule it cannot match.
    """
    numbered = rules.select(F.monotonically_increasing_id().alias("rule"), "name", "includes",
                            "excludes")
    tagged = F.concat(
        F.transform("includes", lambda p: F.struct(p.alias("prefix"), F.lit(1).alias("inc"))),
        F.transform("excludes", lambda p: F.struct(p.alias("prefix"), F.lit(0).alias("inc"))),
    )
    prefixes = numbered.select(
        "rule", F.col("name").alias("topic"), F.explode(tagged).alias("p")
    ).select("rule", "topic", "p.prefix", "p.inc")
    # At most one row per prefix length, and a path is rarely longer than a few hundred.
    lengths = sorted(
        row.n for row in prefixes.select(F.length("prefix").alias("n")).distinct().collect()
    )
    path = strip_top_prefix(F.col("category"))
    fitting = F.filter(
        F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path)
    )
    cuts = categories.select(
        "category", path.alias("path"), F.explode(fitting).alias("n")
    ).select("category", "path", F.expr("substring(path, 1, n)").alias("prefix"))
    hits = lookup_join(cuts, prefixes, "prefix")
    if segment_aware:
        hits = hits.where(
            "length(path) = length(prefix) or substring(path, length(prefix) + 1, 1) = '/'"
        )
    return (
        hits.groupBy("category", "rule", "topic")
        .agg(F.min("inc").alias("least"))
        .where("least = 1")
        .select("category", "rule", "topic")
    )


def map_to_topics_by_prefix(
    pages: DataFrame,
    rules: DataFrame,
    segment_aware: bool = False,
    dedupe: bool = False,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``map_to_topics`` for taxonomies of any size.

    The rules meet the distinct categories only. Pages then join on the category: by
    broadcast when the mapping is small, salted when it is not, because a third of all
    pages may share one category.
    """
    distinct = pages.select(F.explode("categories").alias("category")).distinct()
    mapping = written_lookup(category_topics(distinct, rules, segment_aware).drop("rule"))
    keyed = with_row_key(pages) if dedupe else pages
    exploded = keyed.withColumn("category", F.explode("categories"))
    joined = lookup_join(exploded, mapping, "category", max_broadcast_rows=max_broadcast_rows)
    return _topic_rows(joined.dropDuplicates(["_row", "topic"]) if dedupe else joined)
