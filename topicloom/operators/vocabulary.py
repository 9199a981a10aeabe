"""Word counts, vocabularies and word numbers."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import clean_tokens
from topicloom.scale import dense_index, explode_once

# Fixed value: default number of words in a vocabulary.
VOCABULARY_SIZE = 20_000


def word_counts(tokenised: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(word, count) over all token arrays; frequent words collapse before the shuffle."""
    return (
        explode_once(tokenised.select(tokens), F.col(tokens), "word")
        .groupBy("word")
        .agg(F.count("*").alias("count"))
    )


def build_vocabulary(
    tokenised: DataFrame, size: int = VOCABULARY_SIZE, tokens: str = "tokens"
) -> DataFrame:
    """The ``size`` most frequent words with their counts; ties go by the word."""
    return word_counts(tokenised, tokens).orderBy(F.desc("count"), F.asc("word")).limit(size)


def dense_word_ids(counted: DataFrame, known_rows: int | None = None) -> DataFrame:
    """Give (word, count) rows the ids 1, 2, ...; the most frequent word comes first."""
    return dense_index(
        counted, [F.desc("count"), F.asc("word")], "id", start=1, known_rows=known_rows
    ).withColumn("id", F.col("id").cast("int"))


def tokens_and_vocab(
    pages: DataFrame, size: int = VOCABULARY_SIZE
) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, token rows): one token row per page and category.

    The vocabulary is counted over the pages, before categories are exploded. Pages that
    have ``tokens`` already are not tokenised again.
    """
    tokenised = pages
    if "tokens" not in pages.columns:
        tokenised = pages.withColumn("tokens", clean_tokens(F.col("text")))
    rows = tokenised.withColumn("category", F.explode("categories")).drop(
        "categories", "origCategories"
    )
    return build_vocabulary(tokenised, size), rows


def first_seen_index(df: DataFrame, order_key: str, tokens: str = "tokens") -> DataFrame:
    """(word, id): ids 1, 2, ... in the order words first appear.

    Rows follow ``order_key``, words follow their place in the row; only the first place
    of a word in a row matters, so repeats are dropped within the row. The first place
    of each word is found before the shuffle: frequent words cost one row per task.
    """
    unique = df.select(order_key, F.array_distinct(tokens).alias("words"))
    places = explode_once(unique, F.col("words"), "word", "pos").where("word <> ''")
    first = places.groupBy("word").agg(F.min(F.struct(F.col(order_key).alias("row"), "pos")).alias("first"))
    numbered = dense_index(first, ["first"], "id", start=1)
    return numbered.select("word", F.col("id").cast("int").alias("id"))


def answer_index(df: DataFrame, column: str = "answer") -> DataFrame:
    """(answer, idx): 0-based number of each distinct answer, in the order of answers."""
    distinct = df.select(F.col(column).alias("answer")).where("answer is not null").distinct()
    return dense_index(distinct, ["answer"], "idx").withColumn("idx", F.col("idx").cast("int"))


def word_vectorizer(words: DataFrame, tokens: str, out: str) -> CountVectorizerModel:
    """Count vectorizer for the given words (at most a vocabulary's size of them).

    Fitted on one row per word, because handing the words over from Python one by one is
    slow. Its ``vocabulary`` tells the place of each word.
    """
    listed = words.select("word").toArrow()
    one_per_row = words.sparkSession.createDataFrame(listed).select(F.array("word").alias(tokens))
    counter = CountVectorizer(
        inputCol=tokens, outputCol=out, vocabSize=max(listed.num_rows, 1), minDF=1.0, minTF=1.0
    )
    return counter.fit(one_per_row)


def common_words(vocabulary: DataFrame, vectors: DataFrame) -> DataFrame:
    """Distinct words that are in both tables."""
    return vocabulary.select("word").intersect(vectors.select("word"))
