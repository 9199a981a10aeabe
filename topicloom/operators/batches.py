"""Fixed-size batches of consecutive rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.scale import dense_index


def fixed_batches(
    df: DataFrame,
    size: int,
    order_by: Sequence[str | Column],
    columns: Sequence[str],
    known_rows: int | None = None,
) -> DataFrame:
    """(batch, <column>...): every column as an array of ``size`` consecutive values.

    The last batch may be shorter. Batches are numbered from 0.
    """
    numbered = dense_index(df, order_by, "_n", known_rows=known_rows)
    batch = F.floor(F.col("_n") / size).cast("long").alias("batch")
    rows = F.array_sort(F.collect_list(F.struct("_n", *columns)))
    grouped = numbered.groupBy(batch).agg(rows.alias("_rows"))

    def values(name: str) -> Column:
        return F.transform("_rows", lambda row: row[name]).alias(name)

    return grouped.select("batch", *[values(name) for name in columns])
