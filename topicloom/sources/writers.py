"""Writers for the outputs of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.arrays import dense_label


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_topic_csv(topics: DataFrame, path: str) -> None:
    """(topic, link) as CSV over the old output; values with commas are quoted."""
    topics.select("topic", "link").write.mode("overwrite").csv(path, escape='"')


def write_features(features: DataFrame, path: str, mode: str = "error") -> None:
    """Features as JSON, one folder per split, written in one pass.

    A reader that wants one split reads only its folder. Sparse labels become the one-hot
    arrays ``category`` in the files only.
    """
    if "label" in features.columns:
        features = features.withColumn("category", dense_label(F.col("label"))).drop("label")
    features.write.mode(mode).partitionBy("split").json(path)


def single_file(df: DataFrame, single: bool = True) -> DataFrame:
    """One partition, and so one file, if the caller says so.

    Rows carry their number, so nothing depends on the file they end up in.
    """
    return df.coalesce(1) if single else df


def write_dictionaries(
    path: str,
    vocabulary: DataFrame,
    matrix: DataFrame,
    labels: DataFrame,
    weights: DataFrame,
    mode: str = "error",
    single: bool = True,
) -> None:
    """Write vocabulary, embedding matrix, labels and class weights below ``path``.

    Labels and vocabulary are one file each, unless ``single`` is false. ``weights`` has
    one row per label and is written as one map.
    """
    matrix.select("id", "vector").write.mode(mode).json(f"{path}/embeddings")
    single_file(labels.select("label", "idx"), single).write.mode(mode).csv(f"{path}/labels")
    single_file(vocabulary.select("word", "id"), single).write.mode(mode).json(f"{path}/vocabulary")
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "weight"))))
    one_map = weights.agg(F.lit("classWeights").alias("name"), pairs.alias("weights"))
    one_map.coalesce(1).write.mode(mode).json(f"{path}/class-weights")
