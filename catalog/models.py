"""Training, evaluation, prediction and the prediction stream.

The fitted coefficients are not stated in SQL, but numbers that only the best ones have: in
how many components of each class the gradient of the loss is nearly zero, and what weight
the model gives each class. Predictions are told by how many scores are those that plain SQL
computes from the written coefficients.
"""

from __future__ import annotations

import dataclasses
import hashlib
import inspect

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.inputs import TOPIC_PAGES_SQL, joined, table, topic_tokens, word_vectors
from catalog.pages import _LABEL_SQL, SPLIT_SQL
from catalog.registry import query
from topicloom.functions.html import html_to_text
from topicloom.operators import classifier, embeddings, labels, sequences, splits, vocabulary
from topicloom.scale import with_row_key, written_lookup
from topicloom.session import scratch_path, shared_folder
from topicloom.sources.materialize import Place, Step
from topicloom.streaming.models import PublishedModels
from topicloom.streaming.predict import read_page_stream
from topicloom.streaming.predict import stream_predict as start_stream

ITERATIONS = 100
TOLERANCE = 1e-8
#: Greatest gradient of the mean loss that counts as none.
NEARLY_ZERO = 1e-3
#: Tables that the model is made from.
LEARNED_FROM = ("documents", "conversations", "embeddings")


def _training_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Words, matrix, numbered labels, weights and labelled page vectors of the documents."""
    pages = topic_tokens(spark, sf_dir)
    counted, rows = vocabulary.tokens_and_vocab(pages)
    vectors = word_vectors(spark, sf_dir)
    dim = embeddings.vector_dim(vectors)
    embedded = scratch_path(spark, "embedded")
    embeddings.vocab_embeddings(
        written_lookup(counted), vectors, known_words=vocabulary.VOCABULARY_SIZE
    ).write.parquet(embedded)
    words = spark.read.parquet(embedded)
    matrix = embeddings.embedding_matrix(words, dim)
    counts = labels.category_counts(pages)
    numbered = written_lookup(labels.label_index(counts))
    weights = labels.weights_by_index(
        labels.class_weights(counts).withColumnRenamed("category", "label"), numbered
    )
    made = sequences.sequence_features(rows, words, numbered)
    pooled = scratch_path(spark, "pooled")
    parts = splits.split_dataset(made)
    classifier.labelled_vectors(parts, matrix, dim, weights, keep=["split"]).write.parquet(pooled)
    return words, matrix, numbered, weights, spark.read.parquet(pooled)


def _model_folder(spark: SparkSession, sf_dir: str) -> str:
    """The folder for what is learned from the tables as they are now.

    Its name follows from the files that are learned from (path, size, modification time),
    the settings and the code of the classifier.
    """
    files = [Place(spark, f"{sf_dir}/{name}.parquet").files() for name in LEARNED_FROM]
    learned = (sf_dir, files, ITERATIONS, TOLERANCE, inspect.getsource(classifier))
    name = hashlib.sha256(repr(learned).encode()).hexdigest()[:16]
    return f"{shared_folder(spark)}/topic-model-{name}"


def _train(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Train, save model, coefficients and validation rows, and report on each class."""
    words, matrix, numbered, weights, labelled = _training_rows(spark, sf_dir)
    training = labelled.where("split = 'train'")
    fitted = classifier.fit_classifier(training, ITERATIONS, tol=TOLERANCE)
    dim = fitted.numFeatures
    names = labels.label_list(numbered)
    classifier.TopicModel(words, matrix, names, fitted, dim).save(f"{folder}/model")
    labelled.where("split = 'valid'").write.mode("overwrite").parquet(f"{folder}/validation")
    classifier.coefficient_rows(fitted).write.mode("overwrite").parquet(f"{folder}/coefficients")
    rows = training.groupBy(F.col("label").cast("int").alias("idx")).agg(
        F.count("*").alias("rows"))
    slopes = classifier.loss_gradient(fitted, training).groupBy("idx").agg(
        F.count_if(F.abs("gradient") < NEARLY_ZERO).alias("at_optimum"),
        F.round(F.max("mass") / F.max("expected"), 2).alias("mass"))
    return numbered.join(rows, "idx").join(weights, "idx").join(slopes, "idx").select(
        "label", "idx", "rows", "weight", "at_optimum", "mass")


def _trained(spark: SparkSession, sf_dir: str) -> tuple[classifier.TopicModel, DataFrame]:
    """The saved model of these very tables and its validation rows; trains if there is none."""
    folder = _model_folder(spark, sf_dir)
    Step(spark, [f"{folder}/validation"]).run(lambda: _train(spark, sf_dir, folder))
    model = classifier.TopicModel.load(spark, f"{folder}/model")
    return model, spark.read.parquet(f"{folder}/validation")


@query(f"""{_LABEL_SQL}, parts AS (SELECT topic, {SPLIT_SQL} AS split FROM topic_pages)
  SELECT label, idx, count(*) FILTER (split = 'train') AS rows,
    max(count(*)) OVER ()::DOUBLE / count(*) AS weight,
    (SELECT 1 + max(len(embedding)) FROM embeddings)::BIGINT AS at_optimum, 1::DOUBLE AS mass
  FROM parts JOIN label_index ON label = topic GROUP BY label, idx""")
def fit_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows and weight of each class, and how the fitted model stands to them.

    ``at_optimum``: coefficients with nearly no gradient; ``mass``: weight that the model gives
    the class in the training rows, by the weight of its rows.
    """
    return _train(spark, sf_dir, _model_folder(spark, sf_dir))


@query(f"""{_LABEL_SQL}, parts AS (SELECT topic, {SPLIT_SQL} AS split FROM topic_pages)
  , weighted AS (SELECT topic, max(count(*)) OVER ()::DOUBLE / count(*) AS weight
                 FROM topic_pages GROUP BY topic)
  SELECT idx AS label, count(*)::BIGINT AS rows, round(sum(weight), 6) AS weight,
    true AS consistent
  FROM parts JOIN label_index ON label = parts.topic JOIN weighted w ON w.topic = parts.topic
  WHERE split = 'valid' GROUP BY idx""")
def evaluate_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and weight of each true class; accuracy and loss against those of plain SQL scores."""
    model, validation = _trained(spark, sf_dir)
    metrics, confusion = classifier.evaluate_classifier(model.classifier, validation)
    right = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("rows")).otherwise(0))
    share = confusion.agg(right / F.sum("rows")).scalar()
    keyed = with_row_key(validation, "key")
    scores = _sql_scores(spark, sf_dir, keyed.select("key", vector_to_array("features").alias("x")))
    likely = F.greatest(F.element_at("scores", F.col("label").cast("int") + 1),
                        F.lit(classifier.LEAST_LIKELY))
    by_sql = keyed.join(scores, "key").agg(
        (F.sum(-F.log(likely) * F.col("weight")) / F.sum("weight")).alias("loss"))
    consistent = (F.abs(share - metrics["accuracy"]) < 1e-9) & (
        F.abs(by_sql.scalar() - metrics["weighted_loss"]) < 1e-6)
    weights = validation.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.round(F.sum("weight"), 6).alias("weight"))
    sums = confusion.groupBy("label").agg(F.sum("rows").alias("rows"))
    return sums.join(weights, "label").withColumn("consistent", consistent)


def _sql_scores(spark: SparkSession, sf_dir: str, vectors: DataFrame) -> DataFrame:
    """(key, scores) of the vectors (key, x), by the written coefficients in plain SQL."""
    folder = _model_folder(spark, sf_dir)
    spark.read.parquet(f"{folder}/coefficients").createOrReplaceTempView("model_coefficients")
    vectors.createOrReplaceTempView("page_vectors")
    return spark.sql(classifier.SCORES_SQL.format(
        coefficients="model_coefficients", vectors="page_vectors"))


def _shown(spark: SparkSession, sf_dir: str, vectors: DataFrame, key: str) -> DataFrame:
    """The scored rows: number of scores, how many of them plain SQL has too, the best topics.

    The vectors are written once, for the model and for SQL.
    """
    model, _ = _trained(spark, sf_dir)
    vectors = written_lookup(vectors.select(key, "features"))
    scored = model.score(vectors)
    by_sql = _sql_scores(spark, sf_dir, vectors.select(
        F.col(key).alias("key"), vector_to_array("features").alias("x")))
    best = F.array_max("predictions")
    first = F.element_at("predictions", F.array_position(
        "labels", F.element_at("max2", 1)).cast("int"))
    close = F.zip_with("predictions", "scores", lambda a, b: (F.abs(a - b) < 1e-5).cast("int"))
    return scored.join(by_sql.withColumnRenamed("key", key), key).select(
        key,
        F.size("predictions").alias("n_scores"),
        joined(F.array_sort("labels")).alias("labels"),
        F.aggregate(close, F.lit(0), lambda a, x: a + x).alias("n_equal"),
        (first == best).alias("best_first"),
    )


def _shown_sql(key: str, source: str) -> str:
    return f"""WITH {TOPIC_PAGES_SQL}, names AS (
    SELECT count(*)::INTEGER AS n, string_agg(topic, ',' ORDER BY topic) AS labels
    FROM (SELECT DISTINCT topic FROM topic_pages))
  SELECT {key}, n AS n_scores, labels, n AS n_equal, true AS best_first
  FROM {source}, names"""


@query(_shown_sql("doc_id", "documents"))
def predict_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _trained(spark, sf_dir)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _shown(spark, sf_dir, model.vectors(documents), "doc_id")


@query(_shown_sql("page_id", "pages"))
def predict_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _trained(spark, sf_dir)
    pages = table(spark, sf_dir, "pages").select(
        "page_id", html_to_text(F.col("html")).alias("text"))
    return _shown(spark, sf_dir, model.vectors(pages), "page_id")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END AS version, 1::BIGINT AS rows,
    page_id % 2 = 0 AS as_first FROM pages""")
def stream_published_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages scored by a stream while a second model is published, with the version used.

    The second model is the first with its labels the other way round, so its best topics differ.
    """
    model, _ = _trained(spark, sf_dir)
    models = PublishedModels(spark, scratch_path(spark, "published"))
    pages, folder = table(spark, sf_dir, "pages"), scratch_path(spark, "arriving")
    output, progress = scratch_path(spark, "predicted"), scratch_path(spark, "predicted-progress")
    reverse = dataclasses.replace(model, labels=model.labels[::-1])
    for half, published in enumerate((model, reverse)):
        models.publish(published)
        pages.where(F.col("page_id") % 2 == half).write.mode("append").parquet(folder)
        stream = read_page_stream(spark, folder, pages.schema, "parquet")
        start_stream(stream, models, output, progress, available_now=True).awaitTermination()
    first = model.predict_pages(pages).select("page_id", F.col("max2").alias("by_first"))
    streamed = spark.read.parquet(output)
    return streamed.join(first, "page_id").groupBy(
        "page_id", F.col("modelVersion").alias("version")).agg(
        F.count("*").alias("rows"),
        F.bool_and(F.col("max2") == F.col("by_first")).alias("as_first"))


@query("SELECT page_id, 1::BIGINT AS rows, true AS as_batch FROM pages")
def stream_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the stream wrote per page, and whether they equal those of the batch."""
    model, _ = _trained(spark, sf_dir)
    pages = table(spark, sf_dir, "pages")
    stream = read_page_stream(spark, f"{sf_dir}/pages.parquet", pages.schema, "parquet")
    output = scratch_path(spark, "predicted")
    started = start_stream(
        stream, model, output, scratch_path(spark, "predicted-progress"), available_now=True
    )
    started.awaitTermination()
    batch = model.predict_pages(pages).select(
        "page_id", F.col("max2").alias("in_batch"))
    streamed = spark.read.parquet(output).select("page_id", "max2")
    return streamed.join(batch, "page_id").groupBy("page_id").agg(
        F.count("*").alias("rows"), F.bool_and(F.col("max2") == F.col("in_batch")).alias("as_batch")
    )
