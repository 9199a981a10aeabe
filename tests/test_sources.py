"""Readers, writers and the guard."""

import gzip

import pytest

from topicloom import schemas
from topicloom.session import scratch_path
from topicloom.sources.materialize import Step
from topicloom.sources import readers, writers


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix == ".gz":
        path.write_bytes(gzip.compress(content.encode()))
    else:
        path.write_text(content)
    return str(path)


def test_read_seeds(spark, tmp_path):
    path = put(tmp_path / "seeds.tsv",
               "\"domain\"\t\"cat_labels_en\"\n\"www.shop.com\"\t\"blerg\"\n'a\tb'\tc\n")
    assert readers.read_seeds(spark, path).collect() == [
        ('"domain"', '"cat_labels_en"'), ('"www.shop.com"', '"blerg"'), ("a\tb", "c")]


def test_read_pages_gzipped(spark, tmp_path):
    line = '{"text":"<p>é</p>","domain":"http://a","categories":"x|y","orig_domain":"a"}\n'
    path = put(tmp_path / "pages.jl.gz", line * 3 + '{"domain": "only"}\n')
    pages = readers.read_pages(spark, path, partitions=2)
    assert sorted(pages.collect(), key=str) == sorted(
        [("a", "http://a", "x|y", "<p>é</p>")] * 3 + [(None, "only", None, None)], key=str)


def test_load_rules(spark, tmp_path):
    path = put(tmp_path / "rules.jl",
               '{"name":"science","filters":{"includes":["Science","Science"],"excludes":["S/T"]}}\n'
               '{"name": "bikes","filters": {"includes": [ "Sports/Cycling"] }}\n'
               '{"name": "none","filters": {}}\n')
    assert sorted(readers.load_rules(spark, path).collect()) == [
        ("bikes", ["Sports/Cycling"], []), ("none", [], []), ("science", ["Science"], ["S/T"])]


def test_load_word_vectors(spark, tmp_path):
    path = put(tmp_path / "v.txt.gz", "the 1 2.5 -3e-2\ncat 0 0 1\nlone\n")
    found = readers.load_word_vectors(spark, path).collect()
    assert [(r.word, [round(x, 6) for x in r.vector]) for r in found] == [
        ("the", [1.0, 2.5, -0.03]), ("cat", [0.0, 0.0, 1.0]), ("lone", [])]
    bad = put(tmp_path / "bad.txt", "the 1 x\n")
    assert readers.load_word_vectors(spark, bad, tolerant=True).first().vector == [1.0, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.load_word_vectors(spark, bad).collect()


def test_directory_xml_to_csv(spark, tmp_path):
    path = put(tmp_path / "content.rdf.u8.gz", """<?xml version="1.0"?><RDF>
      <Topic id="Top/Arts"><catid>1</catid></Topic>
      <ExternalPage about="http://a.com/?x=1&amp;y=2"><Title>A</Title>
        <topic>Top/Arts &amp; Crafts, X</topic></ExternalPage>
      <ExternalPage about="http://b.com/"><priority>1</priority></ExternalPage>
      <ExternalPage><topic>Top/No/Link</topic></ExternalPage></RDF>""")
    topics = readers.read_directory_xml(spark, path)
    assert topics.collect() == [("Top/Arts & Crafts, X", "http://a.com/?x=1&y=2")]
    out = f"{tmp_path}/topics"
    writers.write_topic_csv(topics, out)
    writers.write_topic_csv(topics, out)
    back = spark.read.schema("topic string, link string").csv(out, escape='"')
    assert back.collect() == topics.collect()


def test_lines_and_json_over_globs(spark, tmp_path):
    put(tmp_path / "part-1.jl", '{"a": 1}\n  {"b": 2}\n')
    put(tmp_path / "part-2.jl.gz", '{"c": 3}\n\n{"d": 4}\n')
    put(tmp_path / ".hidden.jl", "no\n")
    schema = "a int, b int, c int, d int"
    rows = readers.read_json_lines(spark, f"{tmp_path}/part*", schema).collect()
    assert len(rows) == 4
    lines = sorted(r.value for r in readers.read_text_lines(spark, str(tmp_path)).collect())
    assert lines == ['{"a": 1}', '{"b": 2}', '{"c": 3}', '{"d": 4}']
    assert readers.read_text_lines(spark, f"{tmp_path}/part*", keep_blank=True).count() == 5


def test_vocabulary_last_line_counts(spark, tmp_path):
    path = put(tmp_path / "v.jl", '{"word":"bid","id":1}\n{"word":"dsl","id":17346}\n'
                                  '{"word":"bid","id":17340}\n')
    found = dict(map(tuple, readers.read_vocabulary(spark, path).collect()))
    assert found == {"bid": 17340, "dsl": 17346}


def test_class_weights_file(spark, tmp_path):
    path = put(tmp_path / "w.jl", '{"name":"classWeights","weights":{"bikes":27.9,"music":1.0}}\n')
    assert sorted(readers.read_class_weights(spark, path).collect()) == [
        ("bikes", 27.9), ("music", 1.0)]


def test_dictionaries_round_trip(spark, tmp_path):
    words = spark.createDataFrame([("a", 1), ("b", 2)], schemas.VOCABULARY)
    matrix = spark.createDataFrame([(n, [float(n)]) for n in range(3)],
                                   "id int, vector array<float>")
    names = spark.createDataFrame([("x, y", 1), ("z", 0)], "label string, idx int")
    weights = spark.createDataFrame([("x, y", 2.0), ("z", 1.0)], "category string, weight double")
    writers.write_dictionaries(str(tmp_path / "d"), words, matrix, names, weights)
    assert readers.read_labels(spark, f"{tmp_path}/d/labels") == ["z", "x, y"]
    assert sorted(readers.read_vocabulary(spark, f"{tmp_path}/d/vocabulary").collect()) == [
        ("a", 1), ("b", 2)]
    assert sorted(readers.read_class_weights(spark, f"{tmp_path}/d/class-weights").collect()) == [
        ("x, y", 2.0), ("z", 1.0)]


def test_features_one_folder_per_split(spark, tmp_path):
    rows = spark.createDataFrame([("u", [1, 0], [1], "train"), ("v", [2, 0], [1], "test")],
                                 "uri string, paddedWords array<int>, category array<int>, split string")
    writers.write_features(rows, f"{tmp_path}/f")
    assert (tmp_path / "f" / "split=train").is_dir()
    train = readers.read_json_lines(spark, f"{tmp_path}/f/split=train", schemas.FEATURE).collect()
    assert [(r.uri, r.paddedWords) for r in train] == [("u", [1, 0])]


def test_files_whose_line_number_counts(spark, tmp_path):
    labels = put(tmp_path / "labels.txt", "b\na\nc, d\n")
    assert sorted(readers.read_label_lines(spark, labels).collect()) == [
        ("a", 1), ("b", 0), ("c, d", 2)]
    matrix = put(tmp_path / "matrix.jl", '{"vector": [0, 0]}\n{"vector": [2, 1]}\n')
    assert sorted(map(tuple, readers.read_matrix_lines(spark, matrix).collect())) == [
        (0, [0.0, 0.0]), (1, [2.0, 1.0])]


def test_single_file_on_request(spark):
    df = spark.range(100, numPartitions=4)
    assert writers.single_file(df).rdd.getNumPartitions() == 1
    assert writers.single_file(df, False).rdd.getNumPartitions() == 4


def test_materialize(spark, tmp_path):
    calls = []
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"

    def run():
        calls.append(1)
        spark.range(3).write.parquet(one)
        spark.range(3).write.parquet(two)

    assert Step(spark, []).run(run) is False
    assert Step(spark, [one, two]).run(run) is True
    assert Step(spark, [one, two]).run(run) is False
    (tmp_path / "two" / "_SUCCESS").unlink()
    assert Step(spark, [one, two]).run(run) is True
    assert len(calls) == 2
    file = put(tmp_path / "file.txt", "x")
    assert Step(spark, [file, one]).run(run) is False
    assert Step(spark, [one, two], later=[file]).run(run) is False
    (tmp_path / "one" / "_SUCCESS").unlink()
    assert Step(spark, [one, two], later=[file]).run(run) is True
    assert not (tmp_path / "file.txt").exists()


def test_tables_are_spread_on_request(spark, tmp_path):
    writers.write_parquet(spark.range(100, numPartitions=1), f"{tmp_path}/t")
    assert readers.read_parquet(spark, f"{tmp_path}/t").rdd.getNumPartitions() == 1
    spread = readers.read_parquet(spark, f"{tmp_path}/t", partitions=3)
    assert spread.rdd.getNumPartitions() == 3 and spread.count() == 100


def test_scratch_needs_the_shared_folder(spark, monkeypatch):
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert configured in first
