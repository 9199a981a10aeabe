"""Counts, weights, splits, ranked scores, questions and batches."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topicloom.functions.arrays import dense_label
from topicloom.operators import batches, labels, questions, scoring, splits

COUNTS = {"sport": 2, "health": 5, "technology": 1}


def counted(spark):
    rows = [([name],) for name, n in COUNTS.items() for _ in range(n)]
    return labels.category_counts(spark.createDataFrame(rows, "categories array<string>"))


def test_class_weights(spark):
    weights = {r.category: r.weight for r in labels.class_weights(counted(spark)).collect()}
    assert weights == {"sport": 2.5, "health": 1.0, "technology": 5.0}


def test_label_index_ties_by_name(spark):
    rows = spark.createDataFrame([("sport", 1), ("news", 1), ("health", 1), ("food", 3)],
                                 "category string, count long")
    numbered = labels.label_index(rows)
    assert labels.label_list(numbered) == ["food", "health", "news", "sport"]


def test_weights_by_index(spark):
    # Values of a published weight file.
    weights = spark.createDataFrame(
        [("bikes", 27.924082140634724), ("fashion", 8.422297297297296),
         ("health", 3.32227733767676), ("property", 3.5400757336699273), ("music", 2.2)],
        "label string, weight double",
    )
    names = spark.createDataFrame(
        [("bikes", 0), ("fashion", 1), ("health", 2), ("property", 3), ("cars", 4)],
        "label string, idx int",
    )
    assert dict(map(tuple, labels.weights_by_index(weights, names).collect())) == {
        0: 27.924082140634724, 1: 8.422297297297296, 2: 3.32227733767676, 3: 3.5400757336699273}
    known = {r.label for r in labels.known_labels_only(weights, names).collect()}
    assert known == {"bikes", "fashion", "health", "property"}


def test_hash_split_sizes_and_no_leak(spark):
    pages = spark.range(10_000).select(F.concat(F.lit("http://"), "id").alias("uri"))
    twice = splits.split_dataset(pages.unionByName(pages))
    report = {(r.part, r.other): (r["rows"], r["shared"])
              for r in splits.split_report(twice).collect()}
    assert abs(report["train", "train"][0] - 16_000) <= 1_600
    assert abs(report["test", "test"][0] - 2_000) <= 200
    assert abs(report["valid", "valid"][0] - 2_000) <= 200
    assert sum(report[n, n][0] for n in splits.NAMES) == 20_000
    for pair in [("valid", "test"), ("valid", "train"), ("test", "train")]:
        assert report[pair][1] == 0
    again = splits.split_dataset(pages.repartition(3)).where("split = 'test'").count()
    assert again * 2 == report["test", "test"][0]


def test_small_parts_and_rows_without_a_key(spark):
    pages = spark.range(20_000).select(F.concat(F.lit("http://"), "id").alias("uri"))
    cut = splits.split_dataset(pages, bounds=(0.0, 0.004, 0.008, 1.0))
    sizes = {row.split: row["count"] for row in cut.groupBy("split").count().collect()}
    assert abs(sizes["valid"] - 80) <= 36 and abs(sizes["test"] - 80) <= 36
    none = spark.createDataFrame([(None,)], "uri string")
    assert splits.split_dataset(none).first().split is None


def test_split_report_finds_a_leak(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test")],
                                 "uri string, split string")
    shared = {(r.part, r.other): r.shared for r in splits.split_report(rows).collect()}
    assert shared["test", "train"] == 1
    assert shared["valid", "test"] == 0


def test_random_split(spark):
    shares = {"valid": 0.1, "test": 0.1, "train": 0.8}
    drawn = splits.random_split(spark.range(10_000), shares, seed=5)
    sizes = {row.split: row["count"] for row in drawn.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 10_000
    assert abs(sizes["train"] - 8_000) <= 800
    assert abs(sizes["test"] - 1_000) <= 100 and abs(sizes["valid"] - 1_000) <= 100


LABELS = ("entertainment news finance education medical sport gardening technology music cars "
          "science food fashion photography health bikes property parents home travel").split()


def best(spark, scores, names):
    df = spark.createDataFrame([(scores,)], "s array<float>")
    listed = F.array(*map(F.lit, names))
    return df.select(scoring.top_labels(F.col("s"), listed)).first()[0]


def test_top_labels(spark):
    scores = [0.0] * 20
    scores[12], scores[11] = 0.9, 0.05
    assert best(spark, scores, LABELS) == ["fashion", "food"]
    assert best(spark, [0.5, 0.5, 0.0], ["a", "b", "c"]) == ["b", "a"]
    assert best(spark, [0.1, 0.2, 0.9], ["a", "b"]) == ["b", "a"]
    assert best(spark, [0.3], ["a", "b"]) == ["a"]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(scores=st.lists(st.sampled_from([0.0, 0.25, 0.5, -1.0]), min_size=1, max_size=6))
def test_top_labels_like_a_stable_sort_reversed(spark, scores):
    names = list("abcd")
    ranked = sorted(zip(scores, names), key=lambda pair: pair[0])[::-1]
    assert best(spark, scores, names) == [name for _, name in ranked[:2]]


def test_label_scores(spark):
    df = spark.createDataFrame([(7, [0.5, 0.25, 0.25])], "id int, s array<double>")
    rows = scoring.label_scores(df, "id", "s", ["a", "b"]).collect()
    assert sorted(rows) == [(7, 0, "a", 0.5), (7, 1, "b", 0.25)]


def test_fixed_batches(spark):
    df = spark.createDataFrame([(n, n * 10) for n in range(8, 0, -1)], "n int, y int")
    for known in (None, 8):
        made = batches.fixed_batches(df, 3, ["n"], ["n", "y"], known).orderBy("batch").collect()
        assert made == [(0, [1, 2, 3], [10, 20, 30]), (1, [4, 5, 6], [40, 50, 60]),
                        (2, [7, 8], [70, 80])]


def test_question_features(spark):
    asked = [
        (1, "Are there any big things?", "no"),
        (2, "is the thing; big, or any?", "yes"),
        (3, "are there", "no"),
    ]
    df = spark.createDataFrame(asked, "n int, question string, answer string")
    dense = dense_label(F.col("answer"))
    made = questions.question_features(df, "n", length=8).withColumn("answer", dense).orderBy(
        "n").collect()
    # are 1, there 2, any 3, big 4, things 5, is 6, the 7, thing 8, "big," 9, or 10
    assert made == [
        (1, [0, 0, 0, 2, 3, 4, 5, 0], [1, 0]),
        (2, [0, 6, 7, 8, 9, 10, 3, 0], [0, 1]),
        (3, [0, 0, 0, 0, 0, 0, 1, 2], [1, 0]),
    ]
    lowered = questions.question_features(df, "n", 6, as_written=False).orderBy("n").first()
    assert lowered == (1, [0, 1, 2, 3, 4, 5], (0, 2))


def test_images_and_columns(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"123")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.png").write_bytes(b"1")
    images = questions.read_image_list(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "a.png"), (2, "a.png"), (3, "b.png"), (4, "c.png")],
                               "n int, image_filename string")
    found = questions.questions_with_images(df, images).collect()
    assert sorted((r.n, r.image_filename, r.bytes) for r in found) == [
        (1, "a.png", 3), (2, "a.png", 3), (3, "b.png", 1)]
    assert questions.drop_columns(df, "program", "n").columns == ["image_filename"]


@pytest.mark.parametrize("lower", [True, False])
def test_question_tokens(spark, lower):
    df = spark.createDataFrame([("Are it's, big?",)], "q string")
    found = df.select(questions.question_tokens(F.col("q"), lower)).first()[0]
    assert found == (["are", "it", "s,", "big", ""] if lower else ["Are", "it", "s,", "big", ""])
