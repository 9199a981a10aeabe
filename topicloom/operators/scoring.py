"""Scores to labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_pairs(scores: Column, labels: Column) -> Column:
    """(score, idx, label) structs by position; the shorter side decides the length."""
    length = F.least(F.size(scores), F.size(labels))
    zipped = F.zip_with(scores, labels, lambda s, n: F.struct(s.alias("score"), n.alias("label")))
    pairs = F.transform(
        zipped,
        lambda pair, i: F.struct(
            pair["score"].alias("score"), i.alias("idx"), pair["label"].alias("label")
        ),
    )
    return F.slice(pairs, 1, length)


def label_scores(df: DataFrame, key: str, scores: str, labels: list[str]) -> DataFrame:
    """(key, idx, label, score): one row per score that has a label."""
    names = F.array(*[F.lit(label) for label in labels])
    return df.select(key, F.inline(label_pairs(F.col(scores), names))).select(
        key, "idx", "label", "score"
    )


def top_labels(scores: Column, labels: Column, n: int = 2) -> Column:
    """The labels of the ``n`` best scores; of equal scores the higher index comes first."""
    ranked = F.reverse(F.array_sort(label_pairs(scores, labels)))
    return F.transform(F.slice(ranked, 1, n), lambda pair: pair["label"])
