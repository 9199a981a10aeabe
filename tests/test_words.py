"""Vocabulary, word numbers, sequences, word vectors and term weights."""

import math
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topicloom import schemas
from topicloom.functions import arrays
from topicloom.operators import embeddings, sequences, tfidf, vocabulary

PAGES = [
    ("uri1", "o1", ["sport"], "the quick brow fox dives over the lazy dog", []),
    ("uri3", "o3", ["health"], "the fox is healthy", []),
]
WORDS = [("quick", 1), ("fox", 2), ("brown", 3), ("dog", 4), ("the", 5), ("over", 6), ("lazy", 7)]


def test_tokens_and_vocab(spark):
    pages = spark.createDataFrame(PAGES, schemas.TOPIC_PAGE)
    words, rows = vocabulary.tokens_and_vocab(pages, 50)
    found = [r.word for r in words.collect()]
    assert found[:2] == ["the", "fox"]
    assert set(found) == {"lazy", "is", "dives", "brow", "dog", "over", "healthy", "quick", "fox",
                          "the"}
    assert rows.columns == ["uri", "origUri", "text", "tokens", "category"]
    assert sorted((r.uri, r.category) for r in rows.collect()) == [
        ("uri1", "sport"), ("uri3", "health")]


def test_vocabulary_ties_go_by_word(spark):
    df = spark.createDataFrame([(["b", "a", "c", "c"],), ([],), (None,)], "tokens array<string>")
    assert vocabulary.build_vocabulary(df, 2).collect() == [("c", 2), ("a", 1)]
    ids = vocabulary.dense_word_ids(vocabulary.word_counts(df)).collect()
    assert sorted((r.id, r.word) for r in ids) == [(1, "c"), (2, "a"), (3, "b")]


def test_first_seen_and_answers(spark):
    df = spark.createDataFrame(
        [(2, ["x", "a"], "no"), (1, ["b", "", "a", "b"], "yes"), (3, ["c"], None)],
        "n int, tokens array<string>, answer string",
    )
    # Small whole numbers are packed; negative ones and other types are not.
    for key in (F.col("n"), F.col("n") - 5, F.col("n").cast("string")):
        found = vocabulary.first_seen_index(df.withColumn("n", key), "n").collect()
        assert sorted((r.id, r.word) for r in found) == [(1, "b"), (2, "a"), (3, "x"), (4, "c")]
    assert sorted(vocabulary.answer_index(df).collect()) == [("no", 0), ("yes", 1)]


def test_sequence_features(spark):
    rows = spark.createDataFrame(
        [
            ("uri1", "o", "sport", "t", "the quick brow fox dives over the lazy dog".split()),
            ("uri2", "o", "news", "t", "the dog notices the quick fox and wags his tail".split()),
            ("uri3", "o", "health", "t", "the fox is healthy".split()),
            ("uri4", "o", "health", None, ["nothing", "known"]),
        ],
        "uri string, origUri string, category string, text string, tokens array<string>",
    )
    words = spark.createDataFrame(WORDS, schemas.VOCABULARY)
    names = spark.createDataFrame([("news", 0), ("sport", 1), ("health", 2)], "label string, idx int")
    sparse = sequences.sequence_features(rows, words, names, 6)
    assert {(r.uri, r.label.idx, r.label.size) for r in sparse.collect()} == {
        ("uri1", 1, 3), ("uri2", 0, 3), ("uri3", 2, 3), ("uri4", 2, 3)}
    made = sparse.withColumn("label", arrays.dense_label(F.col("label")))
    assert sorted(made.collect()) == [
        ("uri1", "o", [5, 1, 2, 6, 5, 7], [0, 1, 0]),
        ("uri2", "o", [5, 4, 5, 1, 2, 0], [1, 0, 0]),
        ("uri3", "o", [5, 2, 0, 0, 0, 0], [0, 0, 1]),
        ("uri4", "o", [0, 0, 0, 0, 0, 0], [0, 0, 1]),
    ]


def test_a_million_labels_stay_a_table(spark):
    rows = spark.createDataFrame(
        [("u", "o", "label 999999", ["fox"]), ("v", "o", "none", ["fox"]), ("w", "o", None, [])],
        "uri string, origUri string, category string, tokens array<string>")
    words = spark.createDataFrame([("fox", 1)], schemas.VOCABULARY)
    few, many = (
        spark.range(n).select(F.concat(F.lit("label "), "id").alias("label"),
                              F.col("id").cast("int").alias("idx")) for n in (5, 1_000_000))
    few, many = (sequences.sequence_features(rows, words, n, 4) for n in (few, many))
    assert {(r.uri, r.label.idx, r.label.size) for r in many.collect()} == {
        ("u", 999_999, 1_000_000), ("v", None, 1_000_000), ("w", None, 1_000_000)}
    # No label is part of the plan, so it does not grow with them.
    sizes = [len(df._jdf.queryExecution().optimizedPlan().toString()) for df in (few, many)]
    assert abs(sizes[0] - sizes[1]) < 3000
    dense = few.select(arrays.dense_label(F.col("label")).alias("d")).collect()
    assert all(r.d == [0] * 5 for r in dense)


def test_serving_form(spark):
    words = spark.createDataFrame([("fox", 1), ("lazy", 2), ("dog", 3)], schemas.VOCABULARY)
    df = spark.createDataFrame([(["fox", "dog", "lazy"],), (["x", "fox"],)], "tokens array<string>")
    whole = sequences.encode(df, words, 9, oov="zero", truncate=False)
    assert [r.paddedWords for r in whole.collect()] == [[1, 3, 2] + [0] * 6, [0, 1] + [0] * 7]
    short = sequences.encode(df, words, 1, oov="zero", truncate=False)
    assert [r.paddedWords for r in short.collect()] == [[1, 3, 2], [0, 1]]
    with pytest.raises(ValueError, match="oov"):
        sequences.encode(df, words, oov="other")


texts = st.lists(st.one_of(st.none(), st.lists(st.sampled_from("abcdé"), max_size=6)), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(lists=texts, length=st.integers(1, 7))
def test_encoders_agree_with_brute_force(spark, lists, length):
    known = {"a": 3, "b": 1, "é": 7}
    words = spark.createDataFrame(list(known.items()), schemas.VOCABULARY)
    df = spark.createDataFrame(list(enumerate(lists)), "n int, tokens array<string>").repartition(3)
    expected = [
        (n, None if tokens is None else [known.get(t, 0) for t in tokens])
        for n, tokens in enumerate(lists)
    ]
    sent = sequences.token_ids(df, words).select("n", "ids").collect()
    assert sorted(map(tuple, sent)) == expected
    joined = sequences.token_ids(df, words, max_broadcast_rows=2).select("n", "ids").collect()
    assert sorted(map(tuple, joined)) == expected
    padded = sequences.encode(df.where("tokens is not null"), words, length).collect()
    for row in padded:
        ids = [known[t] for t in row.tokens if t in known][:length]
        assert row.paddedWords == ids + [0] * (length - len(ids))


def test_embedding_matrix(spark):
    words = spark.createDataFrame([("the", 2), ("cat", 1), ("no-embeddings", 3)],
                                  "word string, count long")
    vectors = spark.createDataFrame(
        [("the", [1.0, 2.0, 3.0]), ("cat", [3.0, 2.0, 1.0]), ("no-vocab", [4.0, 5.0, 6.0])],
        "word string, vector array<float>",
    )
    for known in (None, 3):
        embedded = embeddings.vocab_embeddings(words, vectors, known)
        assert sorted((r.word, r.id) for r in embedded.collect()) == [("cat", 2), ("the", 1)]
        matrix = embeddings.embedding_matrix(embedded, embeddings.vector_dim(vectors))
        assert matrix.collect() == [
            (0, [0.0, 0.0, 0.0]), (1, [1.0, 2.0, 3.0]), (2, [3.0, 2.0, 1.0])]
    assert sorted(vocabulary.common_words(words, vectors).collect()) == [("cat",), ("the",)]


def test_first_vector_of_a_word_counts(spark):
    words = spark.createDataFrame([("a", 2), ("b", 1)], "word string, count long")
    vectors = spark.createDataFrame(
        [("a", [9.0], 1), ("a", [1.0], 2), ("b", [5.0], 3)],
        "word string, vector array<float>, line int",
    )
    kept = embeddings.vocab_embeddings(words, vectors, 2).collect()
    assert sorted((r.id, r.word, r.vector) for r in kept) == [(1, "a", [9.0]), (2, "b", [5.0])]
    plain = embeddings.vocab_embeddings(words, vectors.drop("line"), 2).collect()
    assert sorted((r.id, r.vector) for r in plain) == [(1, [1.0]), (2, [5.0])]


def test_uneven_vectors_are_refused(spark):
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])],
                                    "word string, vector array<float>")
    assert embeddings.vector_dim_check(vectors).first() == (2, 1, 2)
    with pytest.raises(ValueError, match="dimensions 1 to 2"):
        embeddings.vector_dim(vectors)


def test_mean_vectors_both_ways(spark):
    matrix = spark.createDataFrame(
        [(0, [0.0, 0.0]), (1, [1.0, 2.0]), (2, [3.0, -2.0])], "id int, vector array<float>")
    df = spark.createDataFrame(
        [(1, [1, 2, 0, 0]), (2, [0, 0]), (3, []), (4, [2, 2, 1])], "n int, ids array<int>")
    expected = {1: [2.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [7 / 3, -2 / 3]}
    for bound in (100, 2):
        means = embeddings.mean_vectors(df, matrix, 2, max_floats=bound).collect()
        assert len(means) == 4
        for row in means:
            assert row.meanVector == pytest.approx(expected[row.n])


def test_sparse_ids_need_no_large_matrix(spark):
    far = 2_000_000_000
    matrix = spark.createDataFrame([(1, [1.0]), (far, [3.0])], "id int, vector array<float>")
    df = spark.createDataFrame([([1, far, 7],), (None,)], "ids array<int>")
    means = [r.meanVector for r in embeddings.mean_vectors(df, matrix, 1).collect()]
    assert means == [[2.0], [0.0]]


def test_tf_idf_vectors(spark):
    df = spark.createDataFrame([(["a", "a", "b"],), (["a"],)], "tokens array<string>")
    model = tfidf.fit_tf_idf(df, vocabulary.build_vocabulary(df))
    rows = model.transform(df).select(F.unwrap_udt("tfidf").alias("v")).collect()
    assert sorted(rows[0].v["values"]) == pytest.approx([0.0, math.log(3 / 2)])


def test_tf_idf(spark):
    lists = {1: ["a", "a", "b"], 2: ["a"], 3: []}
    df = spark.createDataFrame(list(lists.items()), "n int, tokens array<string>")
    expected = {(1, "a"): 2 * math.log(4 / 3), (1, "b"): math.log(4 / 2), (2, "a"): math.log(4 / 3)}
    found = {(r.n, r.word): r.tfidf for r in tfidf.tf_idf(df, "n").collect()}
    assert found == pytest.approx(expected)
    top = vocabulary.build_vocabulary(df, 1)
    one = tfidf.tf_idf(df, "n", vocabulary=top).select("word").distinct().collect()
    assert one == [("a",)]


def test_word_vectorizer_knows_every_word(spark):
    words = spark.createDataFrame([(w,) for w in "xyz"], "word string")
    counter = vocabulary.word_vectorizer(words, "tokens", "counts")
    assert sorted(counter.vocabulary) == ["x", "y", "z"]
    df = spark.createDataFrame([(["z", "z", "q"],)], "tokens array<string>")
    counts = counter.transform(df).select(F.unwrap_udt("counts").alias("c")).first().c
    assert [counter.vocabulary[i] for i in counts["indices"]] == ["z"]
    assert counts["values"] == [2.0]


def test_tf_idf_of_repeated_and_null_keys(spark):
    rows = [(1, ["a", "b", "a"]), (1, ["a", None]), (None, ["b"]), (None, ["b", "c"]), (2, []),
            (3, None), (4, ["d", "a"])]
    df = spark.createDataFrame(rows, "n int, tokens array<string>")
    counts = tfidf.term_counts(df, "n").collect()
    assert sorted(counts, key=str) == sorted([
        (1, "a", 3), (1, "b", 1), (None, "b", 2), (None, "c", 1), (4, "a", 1), (4, "d", 1)], key=str)
    found = {(r.n, r.word): r.tfidf for r in tfidf.tf_idf(df, "n").collect()}
    assert found[1, "a"] == pytest.approx(3 * math.log(8 / 3))
    assert found[None, "c"] == pytest.approx(math.log(8 / 2)) and len(found) == 6


def test_term_counts_stay_in_their_row(spark):
    df = spark.range(50).select("id", F.split(F.concat_ws(" ", F.lit("x y x"), "id"), " ").alias("t"))
    counts = tfidf.term_counts(df, "id", "t")
    assert "Aggregate" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert counts.where("word = 'x' and tf = 2").count() == 50 and counts.count() == 150


def _peak_mb(work):
    """MB that a function allocates at most, in NumPy and Arrow."""
    before, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        work()
        return (tracemalloc.get_traced_memory()[1] + pool.max_memory()) / 1e6
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(before)


def test_look_ups_need_little_memory_besides_their_batch():
    # A whole Arrow batch of padded rows: 10 million ids of which most are padding.
    ids = np.zeros((10_000, 1_000), dtype=np.int32)
    ids[:, :3] = np.arange(30_000).reshape(-1, 3) % 7
    lists = pa.ListArray.from_arrays(np.arange(10_001, dtype=np.int32) * 1_000, ids.ravel())
    vectors = np.arange(10, dtype=np.float32).reshape(5, 2)
    average = embeddings.averager(SimpleNamespace(value=(np.arange(1, 6), vectors)), 2)
    assert _peak_mb(lambda: average(lists)) < 100
    means = average(lists).to_pylist()
    for row in (0, 1, 4_321, 9_999):
        known = [vectors[i - 1] for i in ids[row] if 1 <= i <= 5]
        assert means[row] == pytest.approx(np.mean(known, axis=0))

    words = pa.array(["a", "b", "c", "d"] * 1_250_000)
    lists = pa.ListArray.from_arrays(pa.array([0, 3, 3, len(words)], pa.int32()), words)
    look_up = sequences.word_finder(SimpleNamespace(value=(
        pa.array(["a", "c"]), pa.array([1, 2], pa.int32()))))
    assert _peak_mb(lambda: look_up(lists)) < 60
    found = look_up(lists)
    assert found.offsets.to_pylist() == [0, 3, 3, len(words)]
    assert found.values.to_numpy().tolist() == [1, 0, 2, 0] * 1_250_000


def test_look_ups_in_pieces_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "GATHERED_IDS", 2)
    monkeypatch.setattr(sequences, "LOOKED_UP_WORDS", 2)
    df = spark.createDataFrame(
        [(1, ["a", "b", "x", "a", "c"]), (2, []), (3, None), (4, ["b"]), (5, ["x", "c"])],
        "n int, tokens array<string>").coalesce(1)
    known = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4)], "word string, id int")
    matrix = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [4.0]), (4, [6.0])],
                                   "id int, vector array<float>")
    encoded = sequences.token_ids(df, known)
    assert [r.ids for r in encoded.orderBy("n").collect()] == [
        [1, 2, 0, 1, 4], [], None, [2], [0, 4]]
    means = embeddings.mean_vectors(encoded, matrix, 1).orderBy("n").collect()
    assert [r.meanVector for r in means] == [[3.0], [0.0], [0.0], [4.0], [6.0]]
