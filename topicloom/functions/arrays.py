"""Padding, truncation, one-hot and parsing of arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where ``use`` names the value several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _zeros(length: Column | int) -> Column:
    return F.array_repeat(F.lit(0), length)


def drop_zero_ids(ids: Column) -> Column:
    """Drop the id of unknown words."""
    return F.filter(ids, lambda i: i != 0)


def truncate(ids: Column, length: int) -> Column:
    """The first ``length`` ids."""
    return F.slice(ids, 1, length)


def pad_post(ids: Column, length: int) -> Column:
    """Zeros on the right up to ``length``; longer arrays stay as they are."""
    return F.concat(ids, _zeros(F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def fit_post(ids: Column, length: int) -> Column:
    """Pad on the right or truncate to exactly ``length``."""
    return F.slice(F.concat(ids, _zeros(length)), 1, length)


def pad_pre(ids: Column, length: int) -> Column:
    """Zeros on the left; of longer arrays the last ``length`` ids remain."""
    return F.slice(F.concat(_zeros(length), ids), -length, length)


def one_hot(index: Column, size: int | Column) -> Column:
    """Array of ``size`` zeros with a one at the 0-based ``index``."""
    if isinstance(size, int):
        size = F.lit(size)
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(places, lambda i: (i == index).cast("int"))


def dense_label(label: Column) -> Column:
    """One-hot array of a sparse label, a struct (idx, size); all zeros where ``idx`` is null."""
    return one_hot(F.coalesce(label["idx"], F.lit(-1)), label["size"])


def parse_floats(parts: Column, tolerant: bool = False) -> Column:
    """Cast strings to floats. A bad number fails the job, or is null when tolerant."""
    if tolerant:
        return F.transform(parts, lambda part: part.try_cast("float"))
    return F.transform(parts, lambda part: part.cast("float"))
