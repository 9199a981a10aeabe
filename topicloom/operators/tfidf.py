"""Term weights: frequency in the text against the number of texts with the term."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.arrays import computed_once
from topicloom.operators.vocabulary import word_vectorizer
from topicloom.scale import frequent_join, lookup_join, written_lookup
from topicloom.session import scratch_path


def fit_tf_idf(
    tokenised: DataFrame, vocabulary: DataFrame, tokens: str = "tokens", out: str = "tfidf"
) -> PipelineModel:
    """Fit ``tf * ln((N + 1) / (df + 1))`` over the words of a vocabulary.

    The fitted stages turn a row's tokens into a sparse vector without a shuffle, so the
    vocabulary has to fit the driver; ``tf_idf`` has no such bound.
    """
    counter = word_vectorizer(vocabulary, tokens, "_tf")
    idf = IDF(inputCol="_tf", outputCol=out).fit(counter.transform(tokenised))
    return PipelineModel([counter, idf])


def word_runs(tokens: Column) -> Column:
    """(word, tf) of each distinct word of an array, which is sorted once; null is no word."""

    def counted(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - 1)
        heads = F.filter(places, lambda i: F.get(words, i).isNotNull() & ~F.get(
            words, i).eqNullSafe(F.get(words, i - 1)))
        return computed_once(heads, lambda first: F.transform(first, lambda i, n: F.struct(
            F.get(words, i).alias("word"),
            (F.coalesce(F.get(first, n + 1), F.size(words)) - i).cast("long").alias("tf"))))

    return F.when(F.size(tokens) > 0, computed_once(F.sort_array(tokens), counted))


def term_counts(tokenised: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, word, tf) rows, written once; rows with equal keys are one text.

    Words are counted within their row, so a text does not move. Only what the rows of a
    repeated or null key have in common is counted again, by key and word.
    """
    spark = tokenised.sparkSession
    kind = tokenised.schema[key].dataType
    rows = tokenised.select(F.col(key).alias("_key"), word_runs(F.col(tokens)).alias("_runs"))
    path = scratch_path(spark, "term-counts")
    rows.write.parquet(path)
    written = spark.read.schema(rows.schema).parquet(path)
    keys = written.select("_key")
    several = written_lookup(
        keys.where("_key is not null").groupBy("_key").count().where("count > 1").select("_key"))
    lost, repeated = not keys.where("_key is null").isEmpty(), not several.isEmpty()
    once, parts = written.where("_key is not null"), []
    if repeated:
        parts.append(lookup_join(once, several, "_key", "left_semi"))
        once = lookup_join(once, several, "_key", "left_anti")
    if lost:
        parts.append(written.where("_key is null"))
    counts = once.select("_key", F.inline("_runs"))
    for part in parts:
        runs = part.select("_key", F.inline("_runs"))
        # Written, because the counts are read several times.
        counts = counts.unionByName(written_lookup(
            runs.groupBy("_key", "word").agg(F.sum("tf").alias("tf"))))
    return counts.select(F.col("_key").cast(kind).alias(key), "word", "tf")


def tf_idf(
    tokenised: DataFrame, key: str, tokens: str = "tokens", vocabulary: DataFrame | None = None
) -> DataFrame:
    """(key, word, tf, tfidf): one row per text and word in it.

    All words count, or those of ``vocabulary`` if it is given. Words are counted within
    their text, see ``term_counts``; the counts are written once, for the number of texts with
    a word and for the result. The weights of words in many texts are sent to the counts;
    only the counts of rare words move, if there are too many words to send them all.
    """
    counts = term_counts(tokenised, key, tokens)
    texts = tokenised.select(key).count()
    weight = F.log(F.lit(texts + 1.0) / (F.count("*") + 1))
    weights = counts.groupBy("word").agg(weight.alias("idf"), F.count("*").alias("texts"))
    if vocabulary is not None:
        weights = lookup_join(weights, vocabulary.select("word").distinct(), "word", "left_semi")
    return frequent_join(counts, written_lookup(weights), "word", "texts").select(
        key, "word", "tf", (F.col("tf") * F.col("idf")).alias("tfidf")
    )
