"""The jobs end to end, and the stream against the batch."""

import dataclasses
import json

import pytest

from catalog import models
from topicloom.functions.html import html_to_text
from topicloom.operators import embeddings, sequences
from topicloom.operators.language import fit_language_model
from topicloom.operators.splits import split_report
from topicloom.operators.classifier import TopicModel
from topicloom.plans import jobs
from topicloom.streaming.models import PublishedModels
from topicloom.streaming.predict import read_page_stream, stream_predict
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SPORT = "ball goal team match league"
FOOD = "bread cheese soup salad dinner"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Crawl file, rules and word vectors: English sport and food pages, some French ones."""
    root = tmp_path_factory.mktemp("world")
    english = "the page is about this and that with the other things for you"
    french = "la page est pour les autres avec des choses et nous"
    with open(root / "pages.jl", "w") as out:
        for n in range(120):
            topic, words = (("Sports/X", SPORT), ("Recreation/Food", FOOD))[n % 2]
            body = french if n % 10 == 9 else english
            page = {"orig_domain": f"s{n}.com", "domain": f"http://s{n}.com/", "text":
                    f"<html><title>{words}</title><p>{body}</p><p>{words} fooBar</p></html>",
                    "categories": f"Top/{topic}|Top/World"}
            out.write(json.dumps(page) + "\n")
        out.write(json.dumps({"domain": "http://none", "text": None}) + "\n")
    with open(root / "rules.jl", "w") as out:
        out.write('{"name":"sport","filters":{"includes":["Sports"]}}\n')
        out.write('{"name":"food","filters":{"includes":["Recreation/Food"],"excludes":["X"]}}\n')
    with open(root / "vectors.txt", "w") as out:
        for n, word in enumerate(f"{SPORT} {FOOD} the page unknownword".split()):
            out.write(f"{word} {1.0 if word in SPORT else -1.0} {n / 10} 0.5\n")
    rows = [(english, "en"), (french, "fr"), ("the cat and the dog", "en"), ("le chat noir", "fr")]
    model = fit_language_model(spark.createDataFrame(rows, "text string, lang string"))
    clean = jobs.process_pages(spark, f"{root}/pages.jl", f"{root}/text", f"{root}/rules.jl",
                               f"{root}/clean", model)
    features = jobs.build_features(spark, f"{root}/clean", f"{root}/vectors.txt", f"{root}/out",
                                   vocabulary_size=50, sequence_length=30)
    return root, clean, features, model


def test_process_pages(world):
    _, clean, _, _ = world
    assert clean.count() == 108
    row = clean.where("uri = 'http://s0.com/'").first()
    assert row.categories == ["sport"]
    assert row.origCategories == ["Top/Sports/X", "Top/World"]
    assert row.text.startswith("ball goal team match league the page")


def test_build_features(spark, world):
    root, _, features, _ = world
    assert features.count() == 108
    words = {r.word: r.id for r in spark.read.json(f"{root}/out/vocabulary").collect()}
    assert sorted(words.values()) == list(range(1, len(words) + 1))
    assert "unknownword" not in words and words["the"] == 1
    matrix = {r.id: r.vector for r in spark.read.json(f"{root}/out/embeddings").collect()}
    assert sorted(matrix) == list(range(len(words) + 1))
    assert matrix[0] == [0.0, 0.0, 0.0]
    assert matrix[words["ball"]][0] == 1.0 and matrix[words["soup"]][0] == -1.0
    row = features.where("uri = 'http://s0.com/'").first()
    assert len(row.paddedWords) == 30
    assert row.paddedWords[:5] == [words[w] for w in SPORT.split()]
    assert row.category in ([1, 0], [0, 1])
    assert all(r.shared == 0 for r in split_report(features).collect() if r.part != r.other)


def test_jobs_go_on_where_they_stopped(spark, world):
    root, _, features, model = world
    before = sorted(features.collect())
    stamp = (root / "out" / "vocabulary" / "_SUCCESS").stat().st_mtime_ns
    jobs.build_features(spark, f"{root}/clean", f"{root}/vectors.txt", f"{root}/out", 50, 30)
    assert (root / "out" / "vocabulary" / "_SUCCESS").stat().st_mtime_ns == stamp
    (root / "out" / "labels" / "_SUCCESS").unlink()
    again = jobs.build_features(spark, f"{root}/clean", f"{root}/vectors.txt", f"{root}/out", 50, 30)
    assert (root / "out" / "vocabulary" / "_SUCCESS").stat().st_mtime_ns != stamp
    assert sorted(again.collect()) == before


def test_train_predict_and_stream(spark, world, monkeypatch):
    root = world[0]
    model, metrics, confusion = jobs.train_topics(spark, f"{root}/out", f"{root}/model", 20, 30)
    assert metrics["accuracy"] == 1.0
    assert metrics["weighted_loss"] < 0.5
    assert all(r.label == r.predicted for r in confusion.collect())

    texts = spark.createDataFrame([(1, "match team league"), (2, "soup and bread")],
                                  "n int, text string")
    found = {r.n: r for r in model.predict_texts(texts).collect()}
    assert found[1].max2[0] == "sport" and found[2].max2[0] == "food"
    assert sorted(found[1].labels) == ["food", "sport"]
    assert sum(found[1].predictions) == pytest.approx(1.0, abs=1e-5)
    assert model.predict_texts(texts.where("n > 5")).collect() == []

    loaded = TopicModel.load(spark, f"{root}/model")
    assert {r.n: r.max2 for r in loaded.predict_texts(texts).collect()} == {
        n: r.max2 for n, r in found.items()}

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    batch = model.predict_pages(pages).select("page_id", "predictions", "max2").collect()
    stream = read_page_stream(spark, f"{SF}/pages.parquet", pages.schema, "parquet")
    for _ in range(2):  # the second run finds no new file
        stream_predict(stream, model, f"{root}/scored", f"{root}/progress",
                       available_now=True).awaitTermination()
    scored = spark.read.parquet(f"{root}/scored").select("page_id", "predictions", "max2").collect()
    assert sorted(scored) == sorted(batch)
    # A model beyond every bound is joined instead of sent; the stream must not notice.
    monkeypatch.setattr(sequences, "bounded_arrow", lambda *args: None)
    monkeypatch.setattr(embeddings, "bounded_arrow", lambda *args: None)
    for _ in range(2):
        stream_predict(stream, model, f"{root}/scored-large", f"{root}/progress-large",
                       available_now=True).awaitTermination()
    large = spark.read.parquet(f"{root}/scored-large").select("page_id", "max2").collect()
    assert sorted(large) == sorted((r.page_id, r.max2) for r in batch)
    monkeypatch.undo()
    texts_of_pages = pages.select("page_id", html_to_text(F.col("html")).alias("text"))
    same = model.predict_texts(texts_of_pages).select("page_id", "predictions", "max2").collect()
    assert sorted(same) == sorted(batch)


def test_saved_models_follow_the_tables(spark, tmp_path, monkeypatch):
    source = "/root/testdata/sf0.001"
    for name in models.LEARNED_FROM:
        spark.read.parquet(f"{source}/{name}.parquet").coalesce(1).write.parquet(
            f"{tmp_path}/{name}.parquet")
    trained = []

    def train(session, sf_dir, folder):
        trained.append(session.read.parquet(f"{sf_dir}/documents.parquet").count())
        session.range(trained[-1]).write.parquet(f"{folder}/validation")

    monkeypatch.setattr(models, "_train", train)
    monkeypatch.setattr(models.classifier.TopicModel, "load", staticmethod(lambda *_: None))
    n = spark.read.parquet(f"{source}/documents.parquet").count()
    assert models._trained(spark, str(tmp_path))[1].count() == n
    assert models._trained(spark, str(tmp_path))[1].count() == n and trained == [n]
    more = spark.read.parquet(f"{source}/documents.parquet").limit(10)
    more.write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert models._trained(spark, str(tmp_path))[1].count() == n + 10
    assert trained == [n, n + 10]


def test_changed_rules_and_sizes_run_the_later_steps_only(spark, world, tmp_path):
    root, _, _, language = world
    rules = tmp_path / "rules.jl"
    rules.write_text('{"name":"sport","filters":{"includes":["Sports"]}}\n')

    def job(size, length):
        jobs.process_pages(spark, f"{root}/pages.jl", f"{tmp_path}/text", str(rules),
                           f"{tmp_path}/clean", language)
        jobs.build_features(spark, f"{tmp_path}/clean", f"{root}/vectors.txt", f"{tmp_path}/out",
                            vocabulary_size=size, sequence_length=length)
        made = ("text", "clean", "out/tokens", "out/vocabulary", "out/features")
        return [(tmp_path / name / "_SUCCESS").stat().st_mtime_ns for name in made]

    def changed(before, after):
        return [a != b for a, b in zip(before, after)]

    first = job(50, 30)
    again = job(50, 30)
    assert changed(first, again) == [False] * 5
    longer = job(50, 31)
    assert changed(again, longer) == [False, False, False, False, True]
    smaller = job(40, 31)
    assert changed(longer, smaller) == [False, False, False, True, True]
    rules.write_text('{"name":"food","filters":{"includes":["Recreation/Food"]}}\n')
    assert changed(smaller, job(40, 31)) == [False, True, True, True, True]


def test_stream_takes_up_published_models(spark, world, tmp_path):
    root = world[0]
    trained, _, _ = jobs.train_topics(spark, f"{root}/out", f"{tmp_path}/model", 20, 30)
    other = dataclasses.replace(trained, labels=trained.labels[::-1])
    models_ = PublishedModels(spark, f"{tmp_path}/published")
    with pytest.raises(ValueError, match="no model"):
        models_.latest()
    assert models_.publish(trained) == 1
    schema = "html string, n int"
    texts = [(f"<p>{SPORT}</p>", 1), (f"<p>{FOOD}</p>", 2)]

    def arrive(number):
        spark.createDataFrame(texts, schema).withColumn("n", F.col("n") + 10 * number).coalesce(
            1).write.mode("append").json(f"{tmp_path}/in")

    arrive(0)
    stream = read_page_stream(spark, f"{tmp_path}/in", schema)
    running = stream_predict(stream, models_, f"{tmp_path}/out", f"{tmp_path}/progress",
                             interval="0 seconds")
    running.processAllAvailable()
    # Published while the stream runs: the next batch has it.
    assert PublishedModels(spark, f"{tmp_path}/published").publish(other) == 2
    arrive(1)
    running.processAllAvailable()
    running.stop()
    found = {r.n: (r.modelVersion, r.max2[0])
             for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {1: (1, "sport"), 2: (1, "food"), 11: (2, "food"), 12: (2, "sport")}
