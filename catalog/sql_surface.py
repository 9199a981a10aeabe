"""Queries written in SQL alone, over temp views and the library's SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.inputs import (
    CRAWLED_SQL,
    DOCUMENT_PAGES_SQL,
    RULES_SQL,
    crawled,
    document_pages,
    match_sql,
    rules,
    tokens_sql,
    visible_sql,
)
from catalog.registry import query
from topicloom.functions.html import html_to_text
from topicloom.functions.sql import PAGES_VIEW, RULES_VIEW, register_sql
from topicloom.functions.text import clean_tokens
from topicloom.operators.taxonomy import map_to_topics

# Pages and documents as one table: both have an address, a category list and a text.
_TEXTS = f"""
  SELECT domain AS uri, split_categories(categories) AS categories, visible_text(text) AS text
  FROM crawled_pages
  UNION ALL SELECT uri, categories, text FROM document_pages"""

_TOPIC_TEXTS = """
  SELECT t.uri, t.topic, t.category, size(p.tokens) AS n_tokens,
    array_join(fit_post(transform(p.tokens, w -> length(w)), 8), ' ') AS lengths
  FROM page_topics() t JOIN (
    SELECT uri, clean_tokens(text) AS tokens FROM all_texts) p ON t.uri = p.uri"""


def _views(spark: SparkSession, sf_dir: str) -> None:
    crawled(spark, sf_dir).createOrReplaceTempView("crawled_pages")
    document_pages(spark, sf_dir).createOrReplaceTempView("document_pages")
    rules(spark).createOrReplaceTempView(RULES_VIEW)
    register_sql(spark, tables=False)
    spark.sql(_TEXTS).createOrReplaceTempView("all_texts")
    spark.sql("SELECT uri, categories FROM all_texts").createOrReplaceTempView(PAGES_VIEW)
    register_sql(spark)


_LENGTHS = "array_to_string((list_transform(tokens, lambda w: len(w)) || [0, 0, 0, 0, 0, 0, 0, 0])[1:8], ' ')"

_TOPIC_TEXTS_SQL = f"""WITH {RULES_SQL}, {DOCUMENT_PAGES_SQL}, {CRAWLED_SQL}, texts AS (
    SELECT domain AS uri, string_split(regexp_replace(categories, '\\|+$', ''), '|') AS categories,
      {visible_sql("text")} AS text FROM crawled
    UNION ALL SELECT uri, categories, text FROM document_pages),
  exploded AS (SELECT uri, unnest(categories) AS category FROM texts),
  tokenised AS (SELECT uri, {tokens_sql("text")} AS tokens FROM texts)
  SELECT e.uri, r.name AS topic, e.category, len(tokens)::INTEGER AS n_tokens,
    {_LENGTHS} AS lengths
  FROM exploded e JOIN rules r ON {match_sql("category")} JOIN tokenised t ON t.uri = e.uri"""


@query(_TOPIC_TEXTS_SQL)
def sql_topic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics and words of all pages and documents, by SQL alone."""
    _views(spark, sf_dir)
    return spark.sql(_TOPIC_TEXTS)


@query(f"""WITH {RULES_SQL}, {DOCUMENT_PAGES_SQL}, {CRAWLED_SQL}, texts AS (
    SELECT string_split(regexp_replace(categories, '\\|+$', ''), '|') AS categories,
      {visible_sql("text")} AS text FROM crawled
    UNION ALL SELECT categories, text FROM document_pages),
  topics AS (
    SELECT r.name AS topic, len({tokens_sql("text")}) AS n
    FROM (SELECT text, unnest(categories) AS category FROM texts)
    JOIN rules r ON {match_sql("category")})
  SELECT topic, count(*) AS rows, sum(n)::BIGINT AS tokens, true AS as_columns
  FROM topics GROUP BY topic""")
def sql_equals_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and words of each topic by SQL, and whether the Column form has the same."""
    _views(spark, sf_dir)
    by_sql = spark.sql("""SELECT t.topic, count(*) AS rows, sum(size(clean_tokens(p.text))) AS tokens
      FROM (SELECT text, explode(categories) AS category FROM all_texts) p
      JOIN category_topics() t ON t.category = p.category GROUP BY t.topic""")
    pages = crawled(spark, sf_dir).select(
        F.split(F.regexp_replace("categories", r"\|+$", ""), r"\|").alias("categories"),
        html_to_text(F.col("text")).alias("text"))
    both = pages.unionByName(document_pages(spark, sf_dir).select("categories", "text"))
    mapped = map_to_topics(both.withColumn("uri", F.lit("")), rules(spark))
    by_columns = mapped.groupBy(F.element_at("categories", 1).alias("topic")).agg(
        F.count("*").alias("rows_c"), F.sum(F.size(clean_tokens(F.col("text")))).alias("tokens_c"))
    same = (F.col("rows") == F.col("rows_c")) & (F.col("tokens") == F.col("tokens_c"))
    return by_sql.join(by_columns, "topic", "full").select(
        "topic", "rows", "tokens", F.coalesce(same, F.lit(False)).alias("as_columns"))
