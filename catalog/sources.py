"""Readers and writers: the given tables are written in each format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.features import FEATURES_SQL, topic_features
from catalog.inputs import (
    CRAWLED_SQL,
    DOCUMENT_VOCABULARY_SQL,
    TOPIC_PAGES_SQL,
    components,
    crawled,
    document_vocabulary,
    joined,
    table,
    topic_pages,
)
from catalog.pages import SPLIT_SQL
from catalog.registry import query
from topicloom.operators import embeddings, labels, splits
from topicloom.session import scratch_path
from topicloom import schemas
from topicloom.sources import gzip_lines, readers, writers
from topicloom.sources.materialize import Step


@query(f"WITH {CRAWLED_SQL} SELECT orig_domain AS domain, categories FROM crawled")
def read_seed_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "seeds")
    crawled(spark, sf_dir).select("orig_domain", "categories").write.csv(
        path, sep="\t", quote="'", escape="'"
    )
    return readers.read_seeds(spark, path)


@query(f"WITH {CRAWLED_SQL} SELECT orig_domain, domain, categories, text FROM crawled")
def read_pages_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "pages")
    crawled(spark, sf_dir).write.json(path, compression="gzip")
    return readers.read_pages(spark, path)


_BROKEN = "page_id % 7 = 3"


@query(f"""SELECT 'page' AS part, url AS name, html AS content, 1::BIGINT AS n FROM pages
    WHERE NOT {_BROKEN}
  UNION ALL SELECT 'malformed', 'line', '{{"domain": "' || url || '", "text":', 1 FROM pages
    WHERE {_BROKEN}
  UNION ALL SELECT 'all', 'lines', NULL, count(*) FROM pages""")
def read_pages_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good pages and quarantined lines of JSON files of which every seventh line is cut."""
    path = scratch_path(spark, "checked")
    whole = F.to_json(F.struct(F.col("url").alias("domain"), F.col("html").alias("text")))
    cut = F.concat(F.lit('{"domain": "'), "url", F.lit('", "text":'))
    table(spark, sf_dir, "pages").select(
        F.when(F.expr(_BROKEN), cut).otherwise(whole).alias("value")
    ).repartition(3).write.text(path, compression="gzip")
    pages, malformed = readers.read_pages_checked(spark, path, scratch_path(spark, "quarantine"))
    # A line is told by its file, piece and number: no two are the same.
    placed = malformed.groupBy("file", "block_start", "line", "record").agg(F.count("*").alias("n"))
    lines = pages.select(F.lit(1)).union(malformed.select(F.lit(1)))
    return readers.concat_sources([
        pages.select(F.lit("page").alias("part"), F.col("domain").alias("name"),
                     F.col("text").alias("content"), F.lit(1).cast("long").alias("n")),
        placed.select(F.lit("malformed").alias("part"), F.lit("line").alias("name"),
                      F.col("record").alias("content"), "n"),
        lines.agg(F.count("*").alias("n")).select(
            F.lit("all").alias("part"), F.lit("lines").alias("name"),
            F.lit(None).cast("string").alias("content"), "n"),
    ])


@query(f"WITH {CRAWLED_SQL} SELECT orig_domain, domain, categories, text FROM crawled")
def read_gzip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages from gzipped files of several members, several tasks per file."""
    path = scratch_path(spark, "members")
    lines = crawled(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    gzip_lines.write_gzip_members(lines, path, rows_per_member=20)
    read = gzip_lines.read_gzip_lines(spark, path, range_bytes=16 << 10)
    return read.select(F.from_json("value", schemas.CRAWLED_PAGE).alias("p")).select("p.*")


@query("""SELECT (row_number() OVER (ORDER BY doc_id) - 1)::INTEGER AS idx,
    lang || ' ' || source || ' ' || doc_id AS label FROM documents""")
def read_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label per line; the line number is the class."""
    path = scratch_path(spark, "label-lines")
    label = F.concat_ws(" ", "lang", "source", "doc_id")
    table(spark, sf_dir, "documents").orderBy("doc_id").select(label.alias("value")).write.text(path)
    return readers.read_label_lines(spark, path).select("idx", "label")


@query("""SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS id,
    unnest(range(len(embedding)))::INTEGER AS pos, unnest(embedding)::DOUBLE AS value
  FROM embeddings""")
def read_matrix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector per line; the line number is the word id."""
    path = scratch_path(spark, "matrix-lines")
    table(spark, sf_dir, "embeddings").orderBy("vec_id").select(
        F.col("embedding").alias("vector")).write.json(path)
    return components(readers.read_matrix_lines(spark, path), "id")


@query("""SELECT source AS name, source || ',' || min(lang) || '/' || source AS includes,
    CASE WHEN min(lang) = max(lang) THEN '' ELSE max(lang) || '/' || source END AS excludes
  FROM documents GROUP BY source""")
def load_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "rules")
    first = F.concat_ws("/", F.min("lang"), "source")
    last = F.concat_ws("/", F.max("lang"), "source")
    filters = F.struct(
        F.array("source", first, "source").alias("includes"),
        F.when(F.min("lang") != F.max("lang"), F.array(last, last)).alias("excludes"),
    )
    table(spark, sf_dir, "documents").groupBy("source").agg(filters.alias("filters")).select(
        F.col("source").alias("name"), "filters"
    ).write.json(path)
    return readers.load_rules(spark, path).select(
        "name", joined("includes").alias("includes"), joined("excludes").alias("excludes")
    )


@query("SELECT page_id, url, html FROM pages")
def read_write_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "parquet")
    writers.write_parquet(table(spark, sf_dir, "pages"), path)
    return spark.read.parquet(path)


@query("""SELECT 'w' || vec_id AS word, (unnest(range(len(embedding))))::INTEGER AS pos,
  unnest(embedding)::DOUBLE AS value FROM embeddings""")
def load_word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "vectors")
    word = F.concat(F.lit("w"), F.col("vec_id"))
    table(spark, sf_dir, "embeddings").select(
        F.concat_ws(" ", word, joined("embedding", " ")).alias("value")
    ).write.text(path, compression="gzip")
    return components(readers.load_word_vectors(spark, path), "word")


def _directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory entries of which some have no topic."""
    topic = F.when(~F.endswith("orig_domain", F.lit(".net")),
                   F.concat(F.lit("Top/Arts & Crafts, "), "orig_domain"))
    return crawled(spark, sf_dir).select(F.col("domain").alias("_about"), topic.alias("topic"))


_DIRECTORY_SQL = f"""WITH {CRAWLED_SQL}
  SELECT 'Top/Arts & Crafts, ' || orig_domain AS topic, domain AS link FROM crawled
  WHERE NOT ends_with(orig_domain, '.net')"""


@query(_DIRECTORY_SQL)
def read_directory_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "directory")
    _directory(spark, sf_dir).write.format("xml").options(
        rowTag="ExternalPage", rootTag="RDF", compression="gzip"
    ).save(path)
    return readers.read_directory_xml(spark, path)


@query(_DIRECTORY_SQL)
def write_topic_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "topics")
    topics = _directory(spark, sf_dir).where("topic is not null")
    writers.write_topic_csv(topics.withColumnRenamed("_about", "link"), path)
    return spark.read.schema("topic string, link string").csv(path, escape='"')


@query(f"{FEATURES_SQL} SELECT uri, padded_words, category, {SPLIT_SQL} AS split FROM features")
def write_feature_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "features")
    writers.write_features(splits.split_dataset(topic_features(spark, sf_dir)), path)
    schema = "uri string, paddedWords array<int>, category array<int>, split string"
    return readers.read_json_lines(spark, path, schema).select(
        "uri", joined("paddedWords").alias("padded_words"), joined("category").alias("category"),
        "split",
    )


@query(f"""WITH {TOPIC_PAGES_SQL}, {DOCUMENT_VOCABULARY_SQL}, counts AS (
    SELECT topic, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, topic) - 1 AS idx
    FROM topic_pages GROUP BY topic)
  SELECT 'embedding' AS kind, id || ':' || pos AS name, value FROM (
    SELECT vec_id + 1 AS id, unnest(range(len(embedding))) AS pos,
      unnest(embedding)::DOUBLE AS value FROM embeddings
    UNION ALL SELECT 0, unnest(range((SELECT max(len(embedding)) FROM embeddings))), 0)
  UNION ALL SELECT 'label', topic, idx FROM counts
  UNION ALL SELECT 'weight', topic, (SELECT max(count) FROM counts)::DOUBLE / count FROM counts
  UNION ALL SELECT 'word', word, id FROM vocabulary""")
def write_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "dictionaries")
    counts = labels.category_counts(topic_pages(spark, sf_dir))
    vectors = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") + 1).cast("int").alias("id"), F.col("embedding").alias("vector")
    )
    writers.write_dictionaries(
        path,
        document_vocabulary(spark, sf_dir),
        embeddings.embedding_matrix(vectors, embeddings.vector_dim(vectors)),
        labels.label_index(counts),
        labels.class_weights(counts),
    )

    def shown(df: DataFrame, kind: str, name: str, value: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"),
                         F.expr(value).cast("double").alias("value"))

    matrix = readers.read_json_lines(
        spark, f"{path}/embeddings", "id int, vector array<float>"
    )
    components = matrix.select("id", F.posexplode("vector").alias("pos", "value")).select(
        F.concat_ws(":", "id", "pos").alias("name"), "value")
    numbered = spark.read.schema("label string, idx int").csv(f"{path}/labels")
    weights = readers.read_class_weights(spark, f"{path}/class-weights")
    words = readers.read_vocabulary(spark, f"{path}/vocabulary")
    return readers.concat_sources([
        shown(components, "embedding", "name", "value"),
        shown(numbered, "label", "label", "idx"),
        shown(weights, "weight", "label", "weight"),
        shown(words, "word", "word", "id"),
    ])


@query("SELECT conv_id, turn, role, text FROM conversations")
def read_jsonl_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "conversations")
    table(spark, sf_dir, "conversations").write.json(path, compression="gzip")
    schema = "conv_id bigint, turn bigint, role string, text string"
    return readers.read_json_lines(spark, f"{path}/part*", schema)


@query(r"""SELECT value, count(*) AS n FROM (
    SELECT regexp_replace(unnest(string_split_regex(text, '\r\n|\r|\n')),
                          '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS value FROM documents)
  WHERE value <> '' GROUP BY value""")
def read_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    return readers.read_text_lines(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query(f"WITH {DOCUMENT_VOCABULARY_SQL} SELECT word, id FROM vocabulary")
def read_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "vocabulary")
    document_vocabulary(spark, sf_dir).select("word", "id").write.json(path)
    return readers.read_vocabulary(spark, path)


@query("""SELECT run, ran, (SELECT count(*) FROM pages) AS rows
  FROM (VALUES (1, 1), (2, 0)) t(run, ran)""")
def materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "guarded")

    def write() -> None:
        writers.write_parquet(table(spark, sf_dir, "pages"), path)

    ran = [(run, int(Step(spark, [path]).run(write))) for run in (1, 2)]
    rows = spark.read.parquet(path).agg(F.count("*").alias("rows"))
    runs = F.array(*[F.struct(F.lit(n).alias("run"), F.lit(r).alias("ran")) for n, r in ran])
    return rows.select(F.inline(runs), "rows")


@query(f"""WITH {DOCUMENT_VOCABULARY_SQL} SELECT word, id, 1::BIGINT AS files FROM vocabulary""")
def single_file_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "single")
    writers.single_file(document_vocabulary(spark, sf_dir).select("word", "id")).write.json(path)
    words = spark.read.schema("word string, id int").json(path)
    files = words.select(F.col("_metadata.file_path").alias("f")).distinct().count()
    return words.withColumn("files", F.lit(files).cast("long"))


@query("""SELECT text, count(*) AS n FROM (
    SELECT text FROM documents UNION ALL SELECT text FROM conversations
    UNION ALL SELECT text FROM benchmark) GROUP BY text""")
def concat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["documents", "conversations", "benchmark"]
    texts = [table(spark, sf_dir, name).select("text") for name in names]
    return readers.concat_sources(texts).groupBy("text").agg(F.count("*").alias("n"))
