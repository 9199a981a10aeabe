"""Intermediate tables in the shared folder.

Rows are kept as they are, repeated ones and nulls too; an empty table stays one. What is left at
the end of a session goes with ``topicloom.session.clear_scratch``.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import topicloom
from topicloom.session import scratch_path
from topicloom.sources.materialize import Place

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors, as ``--py-files`` would; once per session."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(topicloom.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="topicloom-code-")) / "topicloom.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))


class Scratch:
    """Intermediate tables in the shared folder that go when they have been read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.places: list[Place] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``stored``, until ``clear``."""
        path = scratch_path(self.spark, name)
        self.places.append(Place(self.spark, path))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete the tables; what was made from them must have been written."""
        for place in self.places:
            place.remove()
        self.places.clear()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    What follows reads files instead of computing again, on whichever executors are left.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
