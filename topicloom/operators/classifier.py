"""Topic classifier: training, evaluation and prediction on Spark MLlib."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.html import html_to_text
from topicloom.functions.text import clean_tokens
from topicloom.operators.embeddings import mean_vectors
from topicloom.operators.scoring import top_labels
from topicloom.operators.sequences import SEQUENCE_LENGTH, encode
from topicloom.scale import lookup_join

#: Weight of the squared coefficients in the loss.
REG_PARAM = 1e-4
# Fixed value: least probability that enters the logarithmic loss.
LEAST_LIKELY = 1e-15


def page_vectors(
    features: DataFrame, matrix: DataFrame, dim: int, ids: str = "paddedWords"
) -> DataFrame:
    """Add ``features``, the mean vector of the known words of each row."""
    pooled = mean_vectors(features, matrix, dim, ids, "_mean")
    return pooled.withColumn("features", array_to_vector("_mean")).drop("_mean")


@dataclass(frozen=True)
class TopicModel:
    """Vocabulary, embedding matrix, labels and weights of a trained classifier."""

    vocabulary: DataFrame
    matrix: DataFrame
    labels: list[str]
    classifier: LogisticRegressionModel
    dim: int
    length: int = SEQUENCE_LENGTH

    def vectors(self, df: DataFrame, text: str = "text") -> DataFrame:
        tokenised = df.withColumn("_tokens", clean_tokens(F.col(text)))
        encoded = encode(
            tokenised, self.vocabulary, self.length, tokens="_tokens", out="_ids"
        ).drop("_tokens")
        return page_vectors(encoded, self.matrix, self.dim, "_ids").drop("_ids")

    def score(self, with_features: DataFrame) -> DataFrame:
        """Add ``predictions``, ``labels`` and ``max2`` to rows that have ``features``."""
        names = F.array(*[F.lit(label) for label in self.labels])
        scored = self.classifier.transform(with_features)
        return (
            scored.withColumn("predictions", vector_to_array("probability", "float32"))
            .withColumn("labels", names)
            .withColumn("max2", top_labels(F.col("predictions"), F.col("labels")))
            .drop("features", "rawPrediction", "probability", "prediction")
        )

    def predict_texts(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """Scores and the two best topics for every text; no row, no result."""
        return self.score(self.vectors(texts, text))

    def predict_pages(self, pages: DataFrame, page: str = "html") -> DataFrame:
        """``predict_texts`` on the visible text of HTML pages."""
        with_text = pages.withColumn("_text", html_to_text(F.col(page))).drop(page)
        return self.predict_texts(with_text, "_text").drop("_text")

    def save(self, path: str) -> None:
        spark = self.vocabulary.sparkSession
        self.vocabulary.select("word", "id").write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.matrix.select("id", "vector").write.mode("overwrite").parquet(f"{path}/matrix")
        spark.createDataFrame(
            list(enumerate(self.labels)), "idx int, label string"
        ).write.mode("overwrite").parquet(f"{path}/labels")
        spark.createDataFrame([(self.dim, self.length)], "dim int, length int").write.mode(
            "overwrite"
        ).parquet(f"{path}/shape")
        self.classifier.write().overwrite().save(f"{path}/classifier")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TopicModel:
        shape = spark.read.parquet(f"{path}/shape").first()
        labels = spark.read.parquet(f"{path}/labels").orderBy("idx").collect()
        return TopicModel(
            spark.read.parquet(f"{path}/vocabulary"),
            spark.read.parquet(f"{path}/matrix"),
            [row.label for row in labels],
            LogisticRegressionModel.load(f"{path}/classifier"),
            shape.dim,
            shape.length,
        )


def labelled_vectors(
    features: DataFrame,
    matrix: DataFrame,
    dim: int,
    weights: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(features, label, weight) from feature rows with a ``label`` (idx, size), or ``category``.

    ``category`` is the label as a one-hot array. ``weights`` has (idx, weight); classes without a weight count once. ``keep`` names
    further columns to carry along.
    """
    sparse = "label" in features.columns
    idx = F.col("label.idx") if sparse else F.array_position("category", F.lit(1)) - 1
    slim = features.select(*keep, "paddedWords", idx.cast("int").alias("idx")).where("idx >= 0")
    pooled = page_vectors(slim, matrix, dim)
    if weights is None:
        weighted = pooled.withColumn("weight", F.lit(1.0))
    else:
        weighted = lookup_join(pooled, weights, "idx", "left").withColumn(
            "weight", F.coalesce("weight", F.lit(1.0))
        )
    return weighted.select(
        *keep, "features", F.col("idx").cast("double").alias("label"), "weight"
    )


def fit_classifier(
    training: DataFrame, max_iter: int = 50, reg_param: float = REG_PARAM, tol: float = 1e-6
) -> LogisticRegressionModel:
    """Weighted multinomial logistic regression; ``training`` is (features, label, weight)."""
    return LogisticRegression(
        family="multinomial", weightCol="weight", maxIter=max_iter, regParam=reg_param, tol=tol
    ).fit(training)


def coefficient_rows(model: LogisticRegressionModel) -> DataFrame:
    """(idx, intercept, coefficients): one row per class."""
    spark = SparkSession.active()
    rows = [
        (k, float(b), [float(x) for x in row])
        for k, (b, row) in enumerate(zip(model.interceptVector.toArray(),
                                         model.coefficientMatrix.toArray()))
    ]
    return spark.createDataFrame(rows, "idx int, intercept double, coefficients array<double>")


def loss_gradient(
    model: LogisticRegressionModel, training: DataFrame, reg_param: float = REG_PARAM
) -> DataFrame:
    """(idx, component, gradient, mass, expected): how far the coefficients are from the optimum.

    The gradient of the weighted mean loss with its penalty, by class and component;
    component 0 is the intercept. ``mass`` is the weight the model gives the class in all
    rows, ``expected`` the weight of the rows that have it; at the optimum they are equal.
    One aggregation over the rows.
    """
    scored = model.transform(training).select(
        "weight", F.col("label").cast("int").alias("label"),
        F.concat(F.array(F.lit(1.0)), vector_to_array("features")).alias("x"),
        vector_to_array("probability").alias("p"),
    )
    by_class = scored.select("weight", "x", "label", F.posexplode("p").alias("idx", "p"))
    parts = by_class.select(
        "idx", "weight", "p", (F.col("idx") == F.col("label")).cast("double").alias("y"),
        F.posexplode("x").alias("component", "x"),
    )
    weight, x = F.col("weight"), F.col("x")
    sums = parts.groupBy("idx", "component").agg(
        F.sum(weight).alias("total"), F.sum(weight * weight).alias("total_squares"),
        F.sum(weight * x).alias("sum"),
        F.sum(weight * x * x).alias("squares"),
        F.sum(weight * (F.col("p") - F.col("y")) * x).alias("slope"),
        F.sum(weight * F.col("p")).alias("mass"), F.sum(weight * F.col("y")).alias("expected"),
    )
    # The penalty is on the coefficients of features of unit variance.
    mean = F.col("sum") / F.col("total")
    spread = F.col("squares") - mean * F.col("sum")
    variance = spread / (F.col("total") - F.col("total_squares") / F.col("total"))
    value = F.coalesce(F.try_element_at("coefficients", F.nullif("component", F.lit(0))), F.lit(0.0))
    gradient = F.col("slope") / F.col("total") + F.lit(reg_param) * variance * value
    return sums.join(F.broadcast(coefficient_rows(model)), "idx").select(
        "idx", "component", gradient.alias("gradient"), "mass", "expected")


#: Class scores of written vectors (key, x) by written coefficients, in plain SQL.
SCORES_SQL = """WITH raw AS (
  SELECT key, c.idx, c.intercept + aggregate(zip_with(x, c.coefficients, (a, b) -> a * b), 0D,
    (s, v) -> s + v) AS z
  FROM (SELECT key, x, explode((SELECT collect_list(struct(idx, intercept, coefficients))
                                FROM {coefficients})) AS c FROM {vectors})),
tops AS (SELECT key, max(z) AS top, array_agg(struct(idx, z)) AS zs FROM raw GROUP BY key)
SELECT key, transform(array_sort(zs), e -> exp(e.z - top) /
  aggregate(zs, 0D, (s, e2) -> s + exp(e2.z - top))) AS scores FROM tops"""


def evaluate_classifier(
    model: LogisticRegressionModel, validation: DataFrame
) -> tuple[dict[str, float], DataFrame]:
    """({accuracy, weighted_loss}, confusion): confusion counts are (label, predicted, rows).

    The rows are scored once; all three results come from sums per pair of classes.
    """
    place = F.col("label").cast("int")
    likely = F.element_at(vector_to_array("probability"), place + 1)
    loss = -F.log(F.greatest(likely, F.lit(LEAST_LIKELY)))
    sums = (
        model.transform(validation)
        .groupBy(place.alias("label"), F.col("prediction").cast("int").alias("predicted"))
        .agg(
            F.count("*").alias("rows"),
            F.sum("weight").alias("weight"),
            F.sum(F.col("weight") * loss).alias("loss"),
        )
    )
    # One row per pair of classes.
    found = sums.collect()
    rows = sum(row["rows"] for row in found)
    weight = sum(row.weight for row in found)
    right = sum(row["rows"] for row in found if row.label == row.predicted)
    metrics = {
        "accuracy": right / rows if rows else 0.0,
        "weighted_loss": sum(row.loss for row in found) / weight if weight else 0.0,
    }
    counts = [(row.label, row.predicted, row["rows"]) for row in found]
    confusion = validation.sparkSession.createDataFrame(
        counts, "label int, predicted int, rows long"
    )
    return metrics, confusion
