"""The pipeline's inputs derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.text import clean_tokens
from topicloom.functions.urls import host_of
from topicloom.operators.taxonomy import map_to_topics
from topicloom.operators.vocabulary import VOCABULARY_SIZE, build_vocabulary, dense_word_ids
from topicloom.session import scratch_path
from topicloom.sources.readers import read_parquet

# Topic rules over the category paths built below: an excluded prefix, a prefix that also
# matches longer names (src1 and src10 to src19), two prefixes, a rule without a match.
RULES = [
    ("english", ["en"], ["en/src1"]),
    ("early", ["en/src1", "en/src2", "Source/src1"], ["en/src19"]),
    ("romance", ["fr/", "es/"], []),
    ("german", ["de"], []),
    ("web", ["Web/"], ["Web/www", "Web/m"]),
    ("nothing", ["Nowhere"], []),
]


TEXT_TABLES = {"documents", "pages", "conversations"}


#: Session setting: number of partitions that text tables are spread over, unset for none.
SPREAD = "spark.topicloom.spread"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spread = spark.conf.get(SPREAD, None) if name in TEXT_TABLES else None
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", int(spread) if spread else None)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RULES, "name string, includes array<string>, excludes array<string>"
    )


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages from ``pages``: language segment, top-level domain and site as categories."""
    host = host_of(F.col("url"))
    segment = F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)", 1)
    tld = F.regexp_extract(host, "([a-z]+)$", 1)
    site = F.regexp_extract(host, r"^([^.]+)", 1)
    categories = F.concat(
        F.lit("Top/"), segment, F.lit("/"), tld, F.lit("|Top/Web/"), site,
        F.when(tld == "org", "||").otherwise(""),
    )
    return table(spark, sf_dir, "pages").select(
        host.alias("orig_domain"),
        F.col("url").alias("domain"),
        categories.alias("categories"),
        F.col("html").alias("text"),
    )


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned pages from ``documents``: language and source as categories."""
    path = F.concat(F.lit("Top/"), F.col("lang"), F.lit("/"), F.col("source"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("uri"),
        F.col("source").alias("origUri"),
        F.array(path, F.concat(F.lit("Top/Source/"), F.col("source"))).alias("categories"),
        "text",
        F.array().cast("array<string>").alias("origCategories"),
    )


def topic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_to_topics(document_pages(spark, sf_dir), rules(spark))


def topic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic pages as tokens, written once for the steps that read them."""
    path = scratch_path(spark, "tokens")
    pages = document_pages(spark, sf_dir).withColumn("tokens", clean_tokens(F.col("text")))
    map_to_topics(pages.drop("text"), rules(spark)).write.parquet(path)
    return spark.read.parquet(path)


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", clean_tokens(F.col("text")).alias("tokens")
    )


def document_vocabulary(spark: SparkSession, sf_dir: str, size: int = VOCABULARY_SIZE) -> DataFrame:
    """(word, count, id) of all documents."""
    counted = build_vocabulary(document_tokens(spark, sf_dir), size)
    return dense_word_ids(counted, known_rows=size)


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors for conversation words: the word of rank r has the vector ``vec_id`` r.

    Some of these words are not in the documents, and most document words have none. Like
    a vector file, the table is written before it is used.
    """
    spoken = table(spark, sf_dir, "conversations").select(
        clean_tokens(F.col("text")).alias("tokens")
    )
    ranked = dense_word_ids(build_vocabulary(spoken), known_rows=VOCABULARY_SIZE)
    vectors = table(spark, sf_dir, "embeddings")
    path = scratch_path(spark, "vectors")
    ranked.join(vectors, ranked.id == vectors.vec_id).select(
        "word", F.col("embedding").alias("vector")
    ).write.parquet(path)
    return spark.read.parquet(path)


def joined(values: str | Column, separator: str = ",") -> Column:
    """An array as text, so that both engines show it the same way."""
    values = F.col(values) if isinstance(values, str) else values
    return F.array_join(values.cast("array<string>"), separator)


def components(df: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(key, pos, value): one row per vector component."""
    return df.select(key, F.posexplode(vector).alias("pos", "value")).select(
        key, "pos", F.col("value").cast("double").alias("value")
    )


# SQL for the same inputs.


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


RULES_SQL = "rules(rule, name, includes, excludes) AS (VALUES " + ", ".join(
    f"({i}, '{name}', {_list(inc)}, {_list(exc)})" for i, (name, inc, exc) in enumerate(RULES)
) + ")"

CRAWLED_SQL = r"""crawled AS (
  SELECT host AS orig_domain, url AS domain, html AS text,
         'Top/' || regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1) || '/' || tld
         || '|Top/Web/' || regexp_extract(host, '^([^.]+)', 1)
         || CASE WHEN tld = 'org' THEN '||' ELSE '' END AS categories
  FROM (SELECT *, regexp_extract(host, '([a-z]+)$', 1) AS tld
        FROM (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages)))"""

DOCUMENT_PAGES_SQL = """document_pages AS (
  SELECT doc_id::VARCHAR AS uri, source AS orig_uri, text,
         ['Top/' || lang || '/' || source, 'Top/Source/' || source] AS categories
  FROM documents)"""


def match_sql(category: str, rule: str = "r") -> str:
    path = rf"regexp_replace({category}, '^Top/', '')"
    return (
        f"len(list_filter({rule}.includes, lambda p: starts_with({path}, p))) > 0 "
        f"AND len(list_filter({rule}.excludes, lambda p: starts_with({path}, p))) = 0"
    )


TOPIC_PAGES_SQL = f"""{RULES_SQL}, {DOCUMENT_PAGES_SQL},
exploded AS (SELECT uri, orig_uri, text, categories, unnest(categories) AS category
             FROM document_pages),
topic_pages AS (SELECT uri, orig_uri, r.name AS topic, text, categories AS orig_categories
                FROM exploded, rules r WHERE {match_sql("category")})"""


def tokens_sql(text: str) -> str:
    return rf"""list_filter(string_split(trim(lower(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace({text}, '\.net|\.com|www\.|\.org|\.gov|\.co\.uk|\.uk', ' ', 'g'),
      '[^a-zA-Z]+', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'),
      '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'))), ' '), lambda x: x <> '')"""


def visible_sql(page: str) -> str:
    hidden = r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>"
    inline = r"</?(b|i|a|em|strong|span|u|small|code)(\s[^>]*)?>"
    text = f"regexp_replace({page}, '{hidden}', '', 'g')"
    text = f"regexp_replace({text}, '{inline}', '', 'g')"
    text = f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"
    for name, char in [("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " "),
                       ("lt", "<"), ("gt", ">"), ("amp", "&")]:
        text = f"regexp_replace({text}, '&{name};?', '{char}', 'g')"
    return rf"trim(regexp_replace({text}, '[ \t\n\f\r]+', ' ', 'g'))"


def vocabulary_sql(source: str, size: int = VOCABULARY_SIZE, prefix: str = "") -> str:
    """CTEs ``counted`` (word, count) and ``vocabulary`` (word, count, id).

    ``source`` selects one column ``tokens``.
    """
    return f"""{prefix}counted AS (
  SELECT word, count(*) AS count FROM (SELECT unnest(tokens) AS word FROM ({source}))
  GROUP BY word ORDER BY count DESC, word LIMIT {size}),
{prefix}vocabulary AS (
  SELECT word, count, (row_number() OVER (ORDER BY count DESC, word))::INTEGER AS id
  FROM {prefix}counted)"""


DOCUMENT_TOKENS_SQL = f"""document_tokens AS (
  SELECT doc_id, lang, {tokens_sql("text")} AS tokens FROM documents)"""

DOCUMENT_VOCABULARY_SQL = (
    f"{DOCUMENT_TOKENS_SQL}, {vocabulary_sql('SELECT tokens FROM document_tokens')}"
)

WORD_VECTORS_SQL = (
    vocabulary_sql(f"SELECT {tokens_sql('text')} AS tokens FROM conversations", prefix="spoken_")
    + """,
word_vectors AS (SELECT v.word, e.embedding AS vector
                 FROM spoken_vocabulary v JOIN embeddings e ON v.id = e.vec_id)"""
)


def encoded_sql(rows: str, key: str, vocabulary: str = "vocabulary", keep_zero: bool = True) -> str:
    """CTE ``encoded`` (key, ids): ids as a list in token order; ``rows`` has (key, tokens)."""
    if keep_zero:
        ids = "list(coalesce(v.id, 0) ORDER BY p.pos) FILTER (p.pos IS NOT NULL)"
    else:
        ids = "list(v.id ORDER BY p.pos) FILTER (v.id IS NOT NULL)"
    return f"""places AS (
  SELECT {key}, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS pos FROM {rows}),
encoded AS (
  SELECT r.{key}, coalesce({ids}, []) AS ids
  FROM {rows} r LEFT JOIN places p ON r.{key} = p.{key}
  LEFT JOIN {vocabulary} v ON p.word = v.word GROUP BY r.{key})"""
