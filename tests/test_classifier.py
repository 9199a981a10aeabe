"""The gradient of the fitted loss, and class scores in plain SQL."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from topicloom.operators import classifier


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 4)) * [1, 2, 0.5, 3]
    label = (x @ draw.normal(size=(4, 3)) + draw.gumbel(size=(300, 3))).argmax(axis=1)
    weight = draw.uniform(0.5, 2, size=300)
    made = [(n, v.tolist(), float(k), float(w)) for n, (v, k, w) in enumerate(zip(x, label, weight))]
    frame = spark.createDataFrame(made, "key long, x array<double>, label double, weight double")
    return frame.withColumn("features", array_to_vector("x")), x, label, weight


def numpy_gradient(model, x, label, weight, reg):
    full = np.c_[np.ones(len(x)), x]
    beta = np.c_[model.interceptVector.toArray(), model.coefficientMatrix.toArray()]
    z = full @ beta.T
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    y = np.eye(3)[label]
    mean = (weight[:, None] * x).sum(axis=0) / weight.sum()
    total = weight.sum() - (weight ** 2).sum() / weight.sum()
    variance = (weight[:, None] * (x - mean) ** 2).sum(axis=0) / total
    penalty = reg * beta * np.r_[0, variance]
    return ((weight[:, None] * (p - y)).T @ full) / weight.sum() + penalty, p


def test_gradient_like_numpy_and_nearly_zero_at_the_optimum(rows):
    frame, x, label, weight = rows
    for max_iter, nearly_zero in ((2, False), (200, True)):
        model = classifier.fit_classifier(frame, max_iter, reg_param=0.01, tol=1e-12)
        found = classifier.loss_gradient(model, frame, 0.01).collect()
        wanted, p = numpy_gradient(model, x, label, weight, 0.01)
        assert len(found) == 15
        for row in found:
            assert row.gradient == pytest.approx(wanted[row.idx, row.component], abs=1e-9)
            assert row.mass == pytest.approx((weight * p[:, row.idx]).sum())
            assert row.expected == pytest.approx(weight[label == row.idx].sum())
        assert (max(abs(r.gradient) for r in found) < 1e-5) is nearly_zero


def test_scores_in_sql_like_the_model(spark, rows):
    frame, *_ = rows
    model = classifier.fit_classifier(frame, 20)
    classifier.coefficient_rows(model).createOrReplaceTempView("test_coefficients")
    frame.select("key", "x").createOrReplaceTempView("test_vectors")
    by_sql = spark.sql(classifier.SCORES_SQL.format(
        coefficients="test_coefficients", vectors="test_vectors"))
    scored = model.transform(frame).select("key", vector_to_array("probability").alias("p"))
    both = by_sql.join(scored, "key").collect()
    assert len(both) == 300
    for row in both:
        assert row.scores == pytest.approx(row.p, abs=1e-9)
    assert frame.where(F.size("x") != 4).count() == 0
