"""Topic counts, class weights and class numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.scale import dense_index, lookup_join

def category_counts(pages: DataFrame) -> DataFrame:
    """(category, count) over the category arrays of all rows."""
    return (
        pages.select(F.explode("categories").alias("category"))
        .groupBy("category")
        .agg(F.count("*").alias("count"))
    )


def class_weights(counts: DataFrame) -> DataFrame:
    """(category, count, weight): the largest count divided by the own count."""
    largest = counts.agg(F.max("count")).scalar()
    return counts.withColumn("weight", largest.cast("double") / F.col("count"))


def label_index(counts: DataFrame) -> DataFrame:
    """(label, idx): 0-based class numbers, frequent labels first, ties by name."""
    numbered = dense_index(counts, [F.desc("count"), F.asc("category")])
    return numbered.select(F.col("category").alias("label"), F.col("idx").cast("int").alias("idx"))


def label_list(labels: DataFrame) -> list[str]:
    """Labels in class order, for a model, which has a coefficient for each of them."""
    return [row.label for row in labels.orderBy("idx").collect()]


def sparse_labels(
    rows: DataFrame, labels: DataFrame, column: str, out: str = "label"
) -> DataFrame:
    """Replace ``column`` by ``out``, a struct of its class number and the number of classes.

    The class number joins from the label table, whatever its size; it is null for a value
    that is no label. A row has two numbers instead of an array as long as the table.
    """
    numbered = labels.select(F.col("label").alias(column), F.col("idx").alias("_idx"))
    size = labels.agg(F.count("*").cast("int")).scalar()
    joined = lookup_join(rows, numbered, column, "left")
    return joined.withColumn(out, F.struct(F.col("_idx").alias("idx"), size.alias("size"))).drop(
        "_idx", *([] if out == column else [column]))


def known_labels_only(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """Weights of labels that have a class number."""
    return lookup_join(weights, labels.select("label"), "label", "left_semi")


def weights_by_index(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """(idx, weight) from (label, weight); weights of unknown labels are dropped."""
    return lookup_join(weights, labels, "label").select("idx", "weight")
