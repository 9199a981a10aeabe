"""Vocabularies, word numbers, word vectors and term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.inputs import (
    DOCUMENT_TOKENS_SQL,
    DOCUMENT_VOCABULARY_SQL,
    TOPIC_PAGES_SQL,
    WORD_VECTORS_SQL,
    components,
    document_tokens,
    document_vocabulary,
    encoded_sql,
    joined,
    table,
    tokens_sql,
    topic_pages,
    vocabulary_sql,
    word_vectors,
)
from catalog.registry import query
from topicloom.operators import embeddings, tfidf, vocabulary
from topicloom.operators.sequences import token_ids as encode_tokens

TOP = 500


@query(f"WITH {DOCUMENT_VOCABULARY_SQL} SELECT word, count FROM counted")
def build_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.build_vocabulary(document_tokens(spark, sf_dir))


@query(f"""WITH {DOCUMENT_TOKENS_SQL},
  {vocabulary_sql("SELECT tokens FROM document_tokens", TOP)} SELECT word, count FROM counted""")
def vocab_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.build_vocabulary(document_tokens(spark, sf_dir), TOP)


@query(f"""WITH {DOCUMENT_TOKENS_SQL}
  SELECT word, count(*) AS count,
         (row_number() OVER (ORDER BY count(*) DESC, word))::INTEGER AS id
  FROM (SELECT unnest(tokens) AS word FROM document_tokens) GROUP BY word""")
def dense_word_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.dense_word_ids(vocabulary.word_counts(document_tokens(spark, sf_dir)))


@query(f"""WITH {TOPIC_PAGES_SQL},
  topic_tokens AS (SELECT uri, orig_uri, topic, {tokens_sql("text")} AS tokens FROM topic_pages),
  {vocabulary_sql("SELECT tokens FROM topic_tokens")}
  SELECT 'word' AS kind, word AS name, '' AS category, count AS n, '' AS tokens FROM counted
  UNION ALL SELECT 'row', uri, topic, len(tokens), array_to_string(tokens, ' ')
  FROM topic_tokens""")
def tokens_and_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, rows = vocabulary.tokens_and_vocab(topic_pages(spark, sf_dir))
    shown_words = words.select(F.lit("word").alias("kind"), F.col("word").alias("name"),
                               F.lit("").alias("category"), F.col("count").alias("n"),
                               F.lit("").alias("tokens"))
    shown_rows = rows.select(F.lit("row").alias("kind"), F.col("uri").alias("name"), "category",
                             F.size("tokens").cast("long").alias("n"),
                             joined("tokens", " ").alias("tokens"))
    return shown_words.unionByName(shown_rows)


@query("""WITH answers AS (SELECT DISTINCT source AS answer FROM documents)
  SELECT answer, (row_number() OVER (ORDER BY answer) - 1)::INTEGER AS idx FROM answers""")
def answer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.answer_index(table(spark, sf_dir, "documents"), "source")


@query(f"""WITH {DOCUMENT_TOKENS_SQL}, places AS (
    SELECT doc_id, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS pos
    FROM document_tokens),
  first AS (SELECT word, min((doc_id, pos)) AS place FROM places GROUP BY word)
  SELECT word, (row_number() OVER (ORDER BY place))::INTEGER AS id FROM first""")
def first_seen_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.first_seen_index(document_tokens(spark, sf_dir), "doc_id")


@query(f"""WITH {DOCUMENT_VOCABULARY_SQL}, {WORD_VECTORS_SQL}
  SELECT word FROM vocabulary INTERSECT SELECT word FROM word_vectors""")
def common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.common_words(
        document_vocabulary(spark, sf_dir), word_vectors(spark, sf_dir)
    )


_EMBEDDED_SQL = f"""WITH {DOCUMENT_VOCABULARY_SQL}, {WORD_VECTORS_SQL},
  embedded AS (
    SELECT v.word, (row_number() OVER (ORDER BY v.count DESC, v.word))::INTEGER AS id, w.vector
    FROM vocabulary v JOIN word_vectors w USING (word))"""

_COMPONENTS_SQL = """SELECT {key}, (unnest(range(len({vector}))))::INTEGER AS pos,
  unnest({vector})::DOUBLE AS value FROM {source}"""


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = document_vocabulary(spark, sf_dir)
    return embeddings.vocab_embeddings(
        words, word_vectors(spark, sf_dir), known_words=vocabulary.VOCABULARY_SIZE
    )


@query(f"""{_EMBEDDED_SQL} SELECT word, id, pos, value FROM (
    {_COMPONENTS_SQL.format(key="word, id", vector="vector", source="embedded")})""")
def vocab_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedded(spark, sf_dir).select(
        "word", "id", F.posexplode("vector").alias("pos", "value")
    ).withColumn("value", F.col("value").cast("double"))


@query(f"""{_EMBEDDED_SQL}, matrix AS (
    SELECT id, vector FROM embedded
    UNION ALL SELECT 0, list_resize([]::FLOAT[], (SELECT max(len(vector)) FROM embedded), 0::FLOAT))
  {_COMPONENTS_SQL.format(key="id", vector="vector", source="matrix")}""")
def embedding_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = word_vectors(spark, sf_dir)
    matrix = embeddings.embedding_matrix(_embedded(spark, sf_dir), embeddings.vector_dim(vectors))
    return components(matrix, "id")


def _numbered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") + 1).cast("int").alias("id"), F.col("embedding").alias("vector")
    )


@query(_COMPONENTS_SQL.format(key="id", vector="vector", source="""(
    SELECT (vec_id + 1)::INTEGER AS id, embedding AS vector FROM embeddings ORDER BY id)"""))
def sort_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(embeddings.sort_matrix(_numbered_vectors(spark, sf_dir)), "id")


@query(_COMPONENTS_SQL.format(key="id", vector="vector", source="""(
    SELECT (vec_id + 1)::INTEGER AS id, embedding AS vector FROM embeddings UNION ALL
    SELECT 0, list_resize([]::FLOAT[], (SELECT max(len(embedding)) FROM embeddings), 0::FLOAT))"""))
def prepend_zero_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _numbered_vectors(spark, sf_dir)
    dim = embeddings.vector_dim(vectors)
    return components(embeddings.prepend_zero_vector(vectors, dim), "id")


@query("""SELECT count(*) AS vectors, min(len(embedding))::INTEGER AS min_dim,
  max(len(embedding))::INTEGER AS max_dim FROM embeddings""")
def vector_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vector"))
    return embeddings.vector_dim_check(vectors)


@query(f"""WITH {DOCUMENT_VOCABULARY_SQL}, {encoded_sql("document_tokens", "doc_id")}
  SELECT doc_id, array_to_string(ids, ',') AS ids FROM encoded""")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_tokens(document_tokens(spark, sf_dir), document_vocabulary(spark, sf_dir))
    return encoded.select("doc_id", joined("ids").alias("ids"))


@query(f"""WITH {DOCUMENT_TOKENS_SQL}, total AS (SELECT count(*) AS n FROM documents),
  tf AS (SELECT doc_id, word, count(*) AS tf
         FROM (SELECT doc_id, unnest(tokens) AS word FROM document_tokens)
         GROUP BY doc_id, word),
  df AS (SELECT word, count(*) AS df FROM tf GROUP BY word)
  SELECT doc_id, word, tf, round(tf * ln((n + 1.0::DOUBLE) / (df + 1)), 6) AS tfidf
  FROM tf JOIN df USING (word), total""")
def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = tfidf.tf_idf(document_tokens(spark, sf_dir), "doc_id")
    return weighted.withColumn("tfidf", F.round("tfidf", 6))
