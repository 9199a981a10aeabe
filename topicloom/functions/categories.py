"""Category paths and the rules that map them to topics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_categories(categories: Column) -> Column:
    """Split at pipes; empty entries at the end vanish, others stay."""
    kept = F.regexp_replace(categories, r"\|+$", "")
    only_pipes = (kept == "") & (categories != "")
    return F.when(only_pipes, F.array().cast("array<string>")).otherwise(F.split(kept, r"\|"))


def strip_top_prefix(category: Column) -> Column:
    """Remove one leading ``Top/``."""
    return F.regexp_replace(category, "^Top/", "")


def has_prefix(path: Column, prefix: Column, segment_aware: bool = False) -> Column:
    """Plain string prefix, or a prefix that ends where a path segment ends."""
    if segment_aware:
        return (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))
    return F.startswith(path, prefix)


def rule_match(
    category: Column, includes: Column, excludes: Column, segment_aware: bool = False
) -> Column:
    """True when the category has an included prefix and no excluded one."""
    path = strip_top_prefix(category)

    def found(prefixes: Column) -> Column:
        return F.exists(prefixes, lambda prefix: has_prefix(path, prefix, segment_aware))

    return found(includes) & ~found(excludes)
