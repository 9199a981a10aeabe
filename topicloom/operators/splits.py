"""Train, test and validation splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bucket bounds and the names of the parts between them.
BOUNDS = (0.0, 0.1, 0.2, 1.0)
NAMES = ("valid", "test", "train")


def hash_number(key: Column) -> Column:
    """A stable number from 0 to 2**32 - 1 for a key."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")


def split_dataset(
    df: DataFrame,
    key: str = "uri",
    bounds: Sequence[float] = BOUNDS,
    names: Sequence[str] = NAMES,
) -> DataFrame:
    """Add ``split``. All rows of one page get the same part, in every run.

    The parts depend on the key alone, so there is no shuffle and no leak between parts
    when a page appears under several topics. Rows without a key have no part (null),
    because nothing could tell whether they leak.
    """
    number = hash_number(F.col(key))
    part = F.when(number.isNotNull(), F.lit(names[-1]))
    for name, upper in reversed(list(zip(names[:-1], bounds[1:-1]))):
        part = F.when(number < round(upper * (1 << 32)), F.lit(name)).otherwise(part)
    return df.withColumn("split", part)


def random_split(df: DataFrame, shares: Mapping[str, float], seed: int) -> DataFrame:
    """Add ``split``, drawn for each row: a part as often as its share says.

    Rows of one page may land in different parts; ``split_dataset`` keeps them together.
    """
    draw, total = F.col("_draw") * sum(shares.values()), 0.0
    part = F.lit(list(shares)[-1])
    limits = []
    for name, share in shares.items():
        total += share
        limits.append((name, total))
    for name, limit in reversed(limits[:-1]):
        part = F.when(draw < limit, F.lit(name)).otherwise(part)
    return df.withColumn("_draw", F.rand(seed)).withColumn("split", part).drop("_draw")


def split_report(df: DataFrame, key: str = "uri", names: Sequence[str] = NAMES) -> DataFrame:
    """(part, other, rows, shared): rows of ``part``, and keys it has in common with ``other``.

    In the row where both are the same part, ``shared`` is the number of its keys. All
    parts are compared in one grouping by key.
    """
    per_key = df.groupBy(key).agg(
        *[F.count_if(F.col("split") == name).alias(name) for name in names]
    )
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    compared = [
        F.struct(
            F.lit(a).alias("part"),
            F.lit(b).alias("other"),
            F.coalesce(F.sum(a), F.lit(0)).alias("rows"),
            F.count_if((F.col(a) > 0) & (F.col(b) > 0)).alias("shared"),
        )
        for a, b in pairs
    ]
    return per_key.agg(F.array(*compared).alias("r")).select(F.explode("r").alias("r")).select("r.*")
