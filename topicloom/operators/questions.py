"""Questions and answers about images as sequence features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.arrays import pad_pre
from topicloom.operators.labels import sparse_labels
from topicloom.operators.sequences import token_ids
from topicloom.operators.vocabulary import answer_index, first_seen_index
from topicloom.scale import lookup_join, written_lookup

# Fixed value: default number of ids per question.
QUESTION_LENGTH = 45

# Fixed value: characters between the words of a question; "," and "." belong to words.
_SEPARATORS = "[;? ']+"


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns where present."""
    return df.drop(*names)


def question_tokens(question: Column, lower: bool = True) -> Column:
    """Words of a question, with the empty pieces at its ends.

    ``lower=True`` is the form the word index is built from, ``lower=False`` the form
    questions are encoded with.
    """
    words = F.split(question, _SEPARATORS)
    return F.transform(words, F.lower) if lower else words


def question_features(
    questions: DataFrame,
    order_key: str,
    length: int = QUESTION_LENGTH,
    as_written: bool = True,
) -> DataFrame:
    """(order_key, ids, answer): left-padded word ids, and answers as (idx, size).

    Words are numbered in the order they first appear. By default questions
    are encoded as written, so capitalised words are unknown (0); with ``as_written=False``
    they are encoded in lower case, and empty pieces are dropped.
    """
    lowered = questions.withColumn("tokens", question_tokens(F.col("question")))
    index = first_seen_index(lowered, order_key)
    answers = written_lookup(answer_index(questions)).withColumnRenamed("answer", "label")
    if as_written:
        worded = questions.withColumn("tokens", question_tokens(F.col("question"), lower=False))
    else:
        worded = lowered.withColumn("tokens", F.filter("tokens", lambda w: w != ""))
    slim = worded.select(order_key, "answer", "tokens")
    numbered = sparse_labels(slim, answers, "answer", "answer")
    return token_ids(numbered, index).select(
        order_key, pad_pre(F.col("ids"), length).alias("ids"), "answer")


def read_image_list(spark: SparkSession, root: str) -> DataFrame:
    """(image_filename, path, bytes) of the files below ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(
            F.regexp_extract("path", "([^/]+)$", 1).alias("image_filename"),
            "path",
            F.col("length").alias("bytes"),
        )
    )


def questions_with_images(questions: DataFrame, images: DataFrame) -> DataFrame:
    """Questions with the path of their image; many questions may share one image."""
    return lookup_join(questions, images, "image_filename")
