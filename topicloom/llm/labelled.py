"""A bounded sample of labelled rows to fit a classifier on.

Defined cases: rows without a key are not learned from; of several labels of a key the largest
counts, of several texts the first in order; a null text counts as empty and long ones are taken
whole. Empty tables give an empty sample. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def fold(key: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of a key's text; 0 for a null key."""
    return F.pmod(F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)),
                  F.lit(folds)).cast("int")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, allowed: Column,
    most_rows: int,
) -> DataFrame:
    """(key, text, label) of about ``most_rows`` labelled documents at most.

    Rows are chosen by a hash of the key, so the same rows give the same sample. Of several
    labels of a key the largest counts, of several texts the first in order; null labels
    and others than 0 and 1 count as none.
    """
    known = labels.select(F.col(key), F.col(label).cast("int").alias("label")).where(
        F.col(key).isNotNull() & F.col("label").isin(0, 1) & allowed
    )
    known = known.groupBy(key).agg(F.max("label").alias("label"))
    rows = known.count()
    share = min(_STEPS, _STEPS * most_rows // max(rows, 1))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(_STEPS)) < share)
    # One row per key, however many rows a key has: the bound is one of rows.
    found = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return found.join(F.broadcast(chosen), key).groupBy(key, "label").agg(
        F.min("text").alias("text")
    ).select(key, "text", "label")
