"""The batch jobs: crawled pages to topic pages, topic pages to features, features to a model.

Each part is a ``Step``, so a job that was cut short goes on where it stopped, and a changed
input or parameter makes just the parts that depend on it run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.text import clean_tokens
from topicloom.operators.classifier import (
    TopicModel,
    evaluate_classifier,
    fit_classifier,
    labelled_vectors,
)
from topicloom.operators.embeddings import embedding_matrix, vector_dim, vocab_embeddings
from topicloom.operators.labels import category_counts, class_weights, label_index, label_list, weights_by_index
from topicloom.operators.language import LanguageModel, english_only
from topicloom.operators.pages import extract_pages
from topicloom.operators.sequences import SEQUENCE_LENGTH, sequence_features
from topicloom.operators.splits import split_dataset
from topicloom.operators.taxonomy import map_to_topics
from topicloom.operators.vocabulary import VOCABULARY_SIZE, build_vocabulary
from topicloom.sources.materialize import Step
from topicloom.sources.readers import (
    load_rules,
    load_word_vectors,
    read_class_weights,
    read_json_lines,
    read_label_table,
    read_pages,
    read_vocabulary,
)
from topicloom.sources.writers import write_dictionaries, write_features, write_parquet


def process_pages(
    spark: SparkSession,
    raw_input: str | list[str],
    text_output: str,
    rules_path: str,
    clean_output: str,
    language_model: LanguageModel,
    segment_aware: bool = False,
    dedupe: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Crawled pages to English text, then to one row per page and topic.

    Neither step shuffles: rows go from input file to output file in one task. Gzipped
    crawls are one task per file, unless ``partitions`` spreads their rows first.
    """

    def extract() -> None:
        pages = extract_pages(read_pages(spark, raw_input, partitions))
        write_parquet(english_only(pages, language_model), text_output)

    def classify() -> None:
        rules = load_rules(spark, rules_path)
        pages = spark.read.parquet(text_output)
        write_parquet(map_to_topics(pages, rules, segment_aware, dedupe), clean_output)

    crawl = [raw_input] if isinstance(raw_input, str) else raw_input
    Step(spark, [text_output], later=[clean_output], inputs=crawl,
         parameters={"languages": language_model.languages,
                     "model": language_model.version}).run(extract)
    Step(spark, [clean_output], inputs=[text_output, rules_path],
         parameters={"segment_aware": segment_aware, "dedupe": dedupe}).run(classify)
    return spark.read.parquet(clean_output)


def build_features(
    spark: SparkSession,
    clean_path: str,
    vectors_path: str | list[str],
    output_path: str,
    vocabulary_size: int = VOCABULARY_SIZE,
    sequence_length: int = SEQUENCE_LENGTH,
    partitions: int | None = None,
) -> DataFrame:
    """Topic pages to padded sequences with one-hot topics, split by page.

    The token table is written once and read by every later step. The dictionaries are
    written as a group before the features and read back, so that features and
    dictionaries always carry the same numbers: a step that runs clears what later steps
    made from its former output.
    """
    tokens_path = f"{output_path}/tokens"
    features_path = f"{output_path}/features"
    parts = ["embeddings", "labels", "vocabulary", "class-weights"]
    dictionary_paths = [f"{output_path}/{part}" for part in parts]

    def tokenise() -> None:
        pages = spark.read.parquet(clean_path)
        rows = pages.withColumn("tokens", clean_tokens(F.col("text"))).drop("text")
        write_parquet(rows, tokens_path)

    def dictionaries() -> None:
        rows = spark.read.parquet(tokens_path)
        vectors = load_word_vectors(spark, vectors_path, partitions=partitions, with_line=True)
        vocabulary = build_vocabulary(rows, vocabulary_size)
        # The embedded vocabulary is used twice and is small: keep one copy on disk.
        embedded_path = f"{output_path}/embedded"
        write_parquet(
            vocab_embeddings(vocabulary, vectors, known_words=vocabulary_size),
            embedded_path,
            mode="overwrite",
        )
        embedded = spark.read.parquet(embedded_path)
        counts = category_counts(rows)
        write_dictionaries(
            output_path,
            embedded,
            embedding_matrix(embedded, vector_dim(vectors)),
            label_index(counts),
            class_weights(counts),
        )

    def features() -> None:
        rows = spark.read.parquet(tokens_path).withColumn("category", F.explode("categories"))
        vocabulary = read_vocabulary(spark, f"{output_path}/vocabulary")
        labels = read_label_table(spark, f"{output_path}/labels")
        made = sequence_features(rows, vocabulary, labels, sequence_length)
        write_features(split_dataset(made), features_path)

    later = [*dictionary_paths, features_path]
    vectors = [vectors_path] if isinstance(vectors_path, str) else vectors_path
    Step(spark, [tokens_path], later=later, inputs=[clean_path]).run(tokenise)
    Step(spark, dictionary_paths, later=[features_path], inputs=[tokens_path, *vectors],
         parameters={"vocabulary_size": vocabulary_size}).run(dictionaries)
    Step(spark, [features_path], inputs=[tokens_path, *dictionary_paths],
         parameters={"sequence_length": sequence_length}).run(features)
    return read_features(spark, output_path)


def read_features(spark: SparkSession, output_path: str, split: str | None = None) -> DataFrame:
    """Features written by ``build_features``; one split reads one folder."""
    schema = (
        "uri string, origUri string, paddedWords array<int>, category array<int>, split string"
    )
    features = read_json_lines(spark, f"{output_path}/features", schema)
    return features.where(F.col("split") == split) if split else features


def train_topics(
    spark: SparkSession,
    output_path: str,
    model_path: str,
    max_iter: int = 50,
    sequence_length: int = SEQUENCE_LENGTH,
) -> tuple[TopicModel, dict[str, float], DataFrame]:
    """Train on the written features, weigh classes, evaluate, save the model."""
    vocabulary = read_vocabulary(spark, f"{output_path}/vocabulary")
    numbered = read_label_table(spark, f"{output_path}/labels")
    labels = label_list(numbered)
    matrix = read_json_lines(spark, f"{output_path}/embeddings", "id int, vector array<float>")
    dim = vector_dim(matrix)
    weights = weights_by_index(
        read_class_weights(spark, f"{output_path}/class-weights"), numbered
    )
    training = labelled_vectors(read_features(spark, output_path, "train"), matrix, dim, weights)
    validation = labelled_vectors(read_features(spark, output_path, "valid"), matrix, dim, weights)
    classifier = fit_classifier(training, max_iter)
    metrics, confusion = evaluate_classifier(classifier, validation)
    model = TopicModel(vocabulary, matrix, labels, classifier, dim, sequence_length)
    model.save(model_path)
    return model, metrics, confusion
