"""Ways to stay whole and balanced on large or skewed data.

* ``bounded_rows``, ``bounded_arrow`` - bring a table to the driver only if it is provably small;
* ``lookup_join`` - broadcast a side that is measured to be small, salt the join if not;
* ``frequent_join`` - broadcast the frequent keys of a large lookup, join the others;
* ``keyed_join`` - broadcast or plain join on a unique key;
* ``written_lookup`` - a computed lookup as files, so that measuring it does not compute it;
* ``dense_index`` - consecutive numbers in a global order without a one-task window;
* ``explode_once``, ``filter_once`` - do not compute a costly column twice.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark import Row
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.session import scratch_path, shared_folder

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 << 20
ONE_TASK_ROWS = 1_000_000
LEAST_SALTS = 32
_SALTED_KINDS = {"inner", "left", "leftouter", "leftsemi", "semi", "leftanti", "anti"}


def bounded_rows(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> list[Row] | None:
    """All rows of ``df`` when there are at most ``max_rows``, else ``None``."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def bounded_arrow(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> pa.Table | None:
    """``bounded_rows`` as an Arrow table."""
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows else None


def fits_broadcast(
    lookup: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether a table has at most so many rows and, written as JSON, so many bytes."""
    width = F.length(F.to_json(F.struct("*")))
    size = lookup.limit(max_rows + 1).agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")
    ).first()
    return size.rows <= max_rows and size.bytes <= max_bytes


def written_lookup(lookup: DataFrame) -> DataFrame:
    """A lookup that is computed once: its rows written to the shared folder.

    ``lookup_join`` measures the files and joins the files.
    """
    path = scratch_path(lookup.sparkSession, "lookup")
    lookup.write.parquet(path)
    return lookup.sparkSession.read.schema(lookup.schema).parquet(path)


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    max_broadcast_rows: int = BROADCAST_ROWS,
    known_rows: int | None = None,
    salts: int | None = None,
) -> DataFrame:
    """Join a large, possibly skewed table with a lookup table.

    The lookup is broadcast when its size is within the bound, else the join is salted.
    ``known_rows`` is an upper bound of its rows that the caller already has: beyond the
    bound nothing is measured.
    """
    small = known_rows is None or known_rows <= max_broadcast_rows
    if small and fits_broadcast(lookup, max_broadcast_rows):
        return facts.join(F.broadcast(lookup), [on] if isinstance(on, str) else list(on), how)
    return salted_join(facts, lookup, on, how, salts)


def frequent_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str,
    count: str,
    max_broadcast_rows: int = BROADCAST_ROWS,
    max_broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join with a lookup of any size whose ``count`` tells how many facts each key has.

    The most frequent keys are broadcast, as many as are within the bounds. Only facts of
    the other keys move; none of them is hot. Both tables are read several times.
    """
    width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in lookup.columns])))
    sizes = lookup.groupBy(F.col(count).alias("_count")).agg(
        F.count("*").alias("rows"), F.sum(width).alias("bytes"))
    above = Window.orderBy(F.desc("_count"))
    summed = sizes.select("_count", F.sum("rows").over(above).alias("rows"),
                          F.sum("bytes").over(above).alias("bytes"))
    fits = (F.col("rows") <= max_broadcast_rows) & (F.col("bytes") <= max_broadcast_bytes)
    found = summed.agg(F.min(F.when(fits, F.col("_count"))).alias("least"),
                       F.min("_count").alias("smallest")).first()
    if found.least is None:
        return salted_join(facts, lookup, on)
    often = F.broadcast(lookup.where(F.col(count) >= found.least))
    joined = facts.join(often, on)
    if found.least == found.smallest:
        return joined
    seldom = facts.join(often.select(on), on, "left_anti").join(
        lookup.where(F.col(count) < found.least), on)
    return joined.unionByName(seldom)


def keyed_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str,
    how: str = "inner",
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join on a key that is unique in both tables: no key is hot, so none needs salts."""
    small = fits_broadcast(lookup, max_broadcast_rows)
    return facts.join(F.broadcast(lookup) if small else lookup, on, how)


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """Join with a lookup of any size; hot keys of ``facts`` spread over ``salts`` tasks.

    The lookup is copied once per salt, so the number of salts follows the cores of the
    cluster slowly; adaptive execution cuts partitions that are still too large. The salt
    is a hash of the row and its input partition: stable under task retries, and it splits
    a hot key whether its rows come from one partition or from many. Kinds of join that
    keep lookup rows without a partner would keep one per copy and are refused.
    """
    if how.replace("_", "").lower() not in _SALTED_KINDS:
        raise ValueError(f"a {how} join cannot be salted")
    keys = [on] if isinstance(on, str) else list(on)
    if salts is None:
        salts = max(LEAST_SALTS, facts.sparkSession.sparkContext.defaultParallelism // 32)
    parts = [F.col(f"`{f.name}`") for f in facts.schema if "map" not in f.dataType.simpleString()]
    mixed = F.xxhash64(F.spark_partition_id(), *parts)
    salted_facts = facts.withColumn("_salt", F.pmod(mixed, F.lit(salts)).cast("int"))
    salted_lookup = lookup.withColumn(
        "_salt", F.explode(F.array(*[F.lit(n) for n in range(salts)]))
    )
    return salted_facts.join(salted_lookup, [*keys, "_salt"], how).drop("_salt")


def dense_index(
    df: DataFrame,
    order_by: Sequence[str | Column],
    name: str = "idx",
    start: int = 0,
    known_rows: int | None = None,
) -> DataFrame:
    """Number the rows ``start, start + 1, ...`` in the order of ``order_by``.

    With a known small bound this is one ordered window. Otherwise the rows are range
    partitioned, sorted and checkpointed once; the number is then the offset of the
    partition plus the place within it. Only one count per partition is broadcast. Rows
    that are equal in ``order_by`` are cut further by their input partition, so that many
    equal rows do not end up in one task.
    """
    if known_rows is not None and known_rows <= ONE_TASK_ROWS:
        window = Window.orderBy(*order_by)
        return df.withColumn(name, (F.row_number().over(window) + (start - 1)).cast("long"))
    shared_folder(df.sparkSession)
    ordered = (
        df.withColumn("_tie", F.spark_partition_id())
        .repartitionByRange(*order_by, "_tie")
        .sortWithinPartitions(*order_by, "_tie")
        .drop("_tie")
        .checkpoint()
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_place", 33).cast("int"))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("_part")
        .agg(F.count("*").alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    )
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + place + F.lit(start)).cast("long"))
        .drop("_place", "_part", "_before")
    )


def with_row_key(df: DataFrame, name: str = "_row") -> DataFrame:
    """Give every row a key that later joins can rely on.

    The keys are written with the rows, so a lost executor cannot renumber them.
    """
    shared_folder(df.sparkSession)
    return df.withColumn(name, F.monotonically_increasing_id()).checkpoint()


def explode_once(df: DataFrame, values: Column, name: str, place: str | None = None) -> DataFrame:
    """One row per element of a computed array, as column ``name``, with its ``place``.

    A plain explode makes the optimizer add a filter for empty arrays below the column
    that computes them, which computes every array twice. The outer form has no such
    filter; its rows for empty arrays are dropped here. Arrays hold no null.
    """
    if place is not None:
        exploded = df.select("*", F.posexplode_outer(values).alias(place, name))
    else:
        exploded = df.withColumn(name, F.explode_outer(values))
    return exploded.where(F.col(name).isNotNull())


def filter_once(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on computed columns that are also output.

    A plain filter would be moved below those columns, with a copy of everything they
    are computed from. A filter on the output of an explode stays where it is.
    """
    kept = F.explode_outer(F.when(condition, F.array(F.lit(True))))
    return df.withColumn("_kept", kept).where("_kept").drop("_kept")
