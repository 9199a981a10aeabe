"""Language identification from character trigrams.

Every text is counted whole. A language is scored by the smoothed log-probabilities of
its trigrams (multinomial naive Bayes). The model is a table, one row per trigram: it is made
by aggregation, written once, and joined with the trigrams of the texts. No part of it passes
through the driver, however many trigrams a large script brings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.labels import category_counts, class_weights
from topicloom.scale import (
    BROADCAST_ROWS,
    explode_once,
    filter_once,
    fits_broadcast,
    keyed_join,
    salted_join,
    with_row_key,
    written_lookup,
)

ENGLISH = "en"
# Fixed value: least probability of a language that counts as detected.
LEAST_PROBABILITY = 0.5

# All overlapping groups of three characters; a group does not start inside a character.
_TRIGRAM = r"(?s)(?=([^\x{DC00}-\x{DFFF}]..))"


def trigrams(text: Column) -> Column:
    """Overlapping character trigrams of the whole lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TRIGRAM), F.lit(1))


@dataclass(frozen=True)
class LanguageModel:
    """``grams`` has (gram, logs): its log-probability in each of the ``languages``, in order."""

    languages: list[str]
    grams: DataFrame

    @property
    def version(self) -> int:
        """A number that follows from the rows of the model."""
        row = F.xxhash64("gram", F.transform("logs", lambda x: F.round(x, 6)))
        return self.grams.agg(F.coalesce(F.bit_xor(row), F.lit(0))).first()[0]

    def scores(
        self, texts: DataFrame, key: str, text: str, max_broadcast_rows: int = BROADCAST_ROWS
    ) -> DataFrame:
        """(key, probabilities) of the texts with a trigram of the model; keys are unique.

        The model is sent to the texts if it is measured to be small. Else the trigrams of
        each text are counted and meet it in a salted join.
        """
        found = explode_once(texts.select(key, text), trigrams(F.col(text)), "gram")
        if fits_broadcast(self.grams, max_broadcast_rows):
            joined = found.join(F.broadcast(self.grams), "gram").withColumn("n", F.lit(1))
        else:
            counted = found.groupBy(key, "gram").agg(F.count("*").alias("n"))
            joined = salted_join(counted, self.grams, "gram")
        places = range(len(self.languages))
        sums = joined.groupBy(key).agg(
            *(F.sum(F.col("n") * F.col("logs")[i]).alias(f"_{i}") for i in places))
        best = F.array_max("_sums")
        shares = F.transform("_sums", lambda s: F.exp(s - best))
        total = F.aggregate("_shares", F.lit(0.0), lambda a, x: a + x)
        return (
            sums.select(key, F.array(*(f"_{i}" for i in places)).alias("_sums"))
            .select(key, shares.alias("_shares"))
            .select(key, F.transform("_shares", lambda x: x / total).alias("probabilities"))
        )

    def probabilities(
        self, df: DataFrame, text: str = "text", max_broadcast_rows: int = BROADCAST_ROWS
    ) -> DataFrame:
        """Add ``language`` (most likely, ties by name) and ``languageProbabilities``.

        Both are null for a text without any trigram of the profile. Rows are written once,
        under a key, and their scores joined back to them.
        """
        keyed = with_row_key(df)
        scored = written_lookup(self.scores(keyed, "_row", text, max_broadcast_rows))
        names = F.array(*[F.lit(name) for name in self.languages])
        likely = F.col("languageProbabilities")
        best = F.array_position(likely, F.array_max(likely)).cast("int")
        return (
            keyed_join(keyed, scored.withColumnRenamed("probabilities", "languageProbabilities"),
                       "_row", "left")
            .withColumn("language", F.when(likely.isNotNull(), F.element_at(names, best)))
            .drop("_row")
        )

    def keep(
        self, df: DataFrame, language: str = ENGLISH, text: str = "text",
        max_broadcast_rows: int = BROADCAST_ROWS,
    ) -> DataFrame:
        """Rows whose text is in ``language`` with probability of at least one half."""
        place = self.languages.index(language)
        keyed = with_row_key(df)
        scored = self.scores(keyed, "_row", text, max_broadcast_rows)
        kept = scored.where(F.col("probabilities")[place] >= LEAST_PROBABILITY).select("_row")
        return keyed_join(keyed, written_lookup(kept), "_row", "left_semi").drop("_row")

    def save(self, path: str) -> None:
        spark = self.grams.sparkSession
        self.grams.write.mode("overwrite").parquet(f"{path}/grams")
        rows = list(enumerate(self.languages))
        spark.createDataFrame(rows, "idx int, language string").write.mode("overwrite").parquet(
            f"{path}/languages"
        )

    @staticmethod
    def load(spark: SparkSession, path: str) -> LanguageModel:
        rows = spark.read.parquet(f"{path}/languages").orderBy("idx").collect()
        return LanguageModel([row.language for row in rows], spark.read.parquet(f"{path}/grams"))


def fit_language_model(
    labelled: DataFrame, text: str = "text", language: str = "lang", size: int | None = None
) -> LanguageModel:
    """Train on texts with a known language.

    Languages weigh the same however many texts they have. All trigrams make up the
    profile, or the ``size`` most frequent ones. Only one row per language reaches the
    driver.
    """
    known = labelled.select(F.col(language).alias("language"), F.col(text).alias("text")).where(
        "language is not null and text is not null"
    )
    texts = category_counts(known.select(F.array("language").alias("categories")))
    weight_of = {row.category: row.weight for row in class_weights(texts).collect()}
    if not weight_of:
        raise ValueError("no text has a language")
    languages = sorted(weight_of)

    found = explode_once(known, trigrams(F.col("text")), "gram")
    by_language = found.groupBy("gram", "language").agg(F.count("*").alias("n"))
    # One row per trigram: how often each language has it.
    of_language = F.map_from_entries(F.collect_list(F.struct("language", "n")))
    counts = by_language.groupBy("gram").agg(F.sum("n").alias("count"), of_language.alias("by"))
    if size is not None:
        counts = counts.orderBy(F.desc("count"), F.asc("gram")).limit(size)
    counts = written_lookup(counts.select("gram", F.array(*(
        F.coalesce(F.try_element_at("by", F.lit(name)), F.lit(0)) * F.lit(weight_of[name])
        for name in languages)).alias("weighted")))
    sums = counts.agg(F.count("*").alias("grams"), *(
        F.coalesce(F.sum(F.col("weighted")[i]), F.lit(0.0)).alias(f"s{i}")
        for i in range(len(languages)))).first()
    totals = [sums[f"s{i}"] + sums.grams for i in range(len(languages))]
    logs = F.array(*(F.log(F.col("weighted")[i] + 1) - F.log(F.lit(float(total)))
                     for i, total in enumerate(totals)))
    return LanguageModel(languages, written_lookup(counts.select("gram", logs.alias("logs"))))


def english_only(pages: DataFrame, model: LanguageModel) -> DataFrame:
    """Pages with English text."""
    return model.keep(pages, ENGLISH)
