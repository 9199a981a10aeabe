"""Text, array and URL functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.inputs import (
    CRAWLED_SQL,
    DOCUMENT_TOKENS_SQL,
    DOCUMENT_VOCABULARY_SQL,
    components,
    crawled,
    document_tokens,
    document_vocabulary,
    encoded_sql,
    joined,
    table,
    tokens_sql,
)
from catalog.registry import query
from topicloom.functions import arrays, categories, text, urls
from topicloom.operators.labels import category_counts, label_index
from topicloom.operators.questions import question_tokens
from topicloom.operators.sequences import drop_oov as drop_unknown
from topicloom.operators.sequences import token_ids
from topicloom.scale import lookup_join

SHORT = 300


@query(r"""SELECT page_id, regexp_replace(url, '\.net|\.com|www\.|\.org|\.gov|\.co\.uk|\.uk', ' ',
  'g') AS text FROM pages""")
def remove_site_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.remove_site_markers(F.col("url")).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '[^a-zA-Z]', ' ', 'g') AS text FROM documents")
def letters_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", text.letters_only(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, array_to_string(words, ' ') AS words, len(words)::INTEGER AS n FROM (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')
  AS words FROM documents)""")
def split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(
        "doc_id", text.split_words(F.col("text")).alias("words")
    )
    return words.select("doc_id", joined("words", " ").alias("words"), F.size("words").alias("n"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(
  regexp_replace(html, '[^a-zA-Z]+', ' ', 'g'),
  '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')) AS words FROM pages""")
def split_camel_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.split_words(text.letters_only(F.col("html")))
    return table(spark, sf_dir, "pages").select(
        "page_id", joined(text.split_camel_case(words), " ").alias("words")
    )


@query("""SELECT doc_id, trim(lower(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'))) AS words
  FROM documents""")
def lowercase(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.split_words(text.letters_only(F.col("text")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", joined(text.lowercase(words), " ").alias("words")
    )


@query(f"""SELECT page_id, array_to_string(tokens, ' ') AS tokens, len(tokens)::INTEGER AS n
  FROM (SELECT page_id, {tokens_sql("url || ' ' || html")} AS tokens FROM pages)""")
def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat_ws(" ", "url", "html")
    tokens = table(spark, sf_dir, "pages").select(
        "page_id", text.clean_tokens(whole).alias("tokens")
    )
    return tokens.select("page_id", joined("tokens", " ").alias("tokens"),
                         F.size("tokens").alias("n"))


# The English stop words and the single letters.
_STOP_LIST = """
    'i', 'me', 'my', 'myself', 'we', 'our', 'ours', 'ourselves', 'yo', 'your', 'yours',
    'yourself', 'yourselves', 'he', 'him', 'his', 'himself', 'she', 'her', 'hers',
    'herself', 'it', 'its', 'itself', 'they', 'them', 'their', 'theirs', 'themselves',
    'what', 'which', 'who', 'whom', 'this', 'that', 'these', 'those', 'am', 'is', 'are',
    'was', 'were', 'be', 'been', 'being', 'have', 'has', 'had', 'having', 'do', 'does',
    'did', 'doing', 'a', 'an', 'the', 'and', 'but', 'if', 'or', 'because', 'as', 'until',
    'while', 'of', 'at', 'by', 'for', 'with', 'about', 'against', 'between', 'into',
    'through', 'during', 'before', 'after', 'above', 'below', 'to', 'from', 'up', 'down',
    'in', 'out', 'on', 'off', 'over', 'under', 'again', 'further', 'then', 'once', 'here',
    'there', 'when', 'where', 'why', 'how', 'all', 'any', 'both', 'each', 'few', 'more',
    'most', 'other', 'some', 'such', 'no', 'nor', 'not', 'only', 'own', 'same', 'so',
    'than', 'too', 'very', 's', 't', 'can', 'will', 'just', 'don', 'should', 'now', 'd',
    'll', 'm', 'o', 're', 've', 'y', 'ain', 'aren', 'couldn', 'didn', 'doesn', 'hadn',
    'hasn', 'haven', 'isn', 'ma', 'mightn', 'mustn', 'needn', 'shan', 'shouldn', 'wasn',
    'weren', 'won', 'wouldn', 'b', 'c', 'e', 'f', 'g', 'h', 'j', 'k', 'l', 'n', 'p', 'q',
    'r', 'u', 'v', 'w', 'x', 'z'
"""


@query(f"""WITH {DOCUMENT_TOKENS_SQL}
  SELECT doc_id, array_to_string(
    list_filter(tokens, lambda x: NOT list_contains([{_STOP_LIST}], x)), ' ') AS tokens
  FROM document_tokens""")
def remove_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(spark, sf_dir).select(
        "doc_id", joined(text.remove_stopwords(F.col("tokens")), " ").alias("tokens")
    )


@query(rf"""WITH {CRAWLED_SQL}
  SELECT domain, regexp_replace(categories, '^Top/', '') AS categories FROM crawled""")
def strip_top_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawled(spark, sf_dir).select(
        "domain", categories.strip_top_prefix(F.col("categories")).alias("categories")
    )


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host,
  'none' AS without_scheme FROM pages""")
def host_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.host_of(F.col("url")).alias("host"),
        F.coalesce(urls.host_of(bare), F.lit("none")).alias("without_scheme"),
    )


# Word lengths of a document are whole-number sequences of very different size.
_LENGTHS_SQL = f"""WITH {DOCUMENT_TOKENS_SQL}, sized AS (
  SELECT doc_id, list_transform(tokens, lambda t: length(t)::INTEGER) AS ids FROM document_tokens)"""


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(spark, sf_dir).select(
        "doc_id", F.transform("tokens", F.length).alias("ids")
    )


@query(f"""{_LENGTHS_SQL} SELECT doc_id, array_to_string(
  CASE WHEN len(ids) < {SHORT} THEN list_resize(ids, {SHORT}, 0) ELSE ids END, ',') AS ids
  FROM sized""")
def pad_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lengths(spark, sf_dir).select(
        "doc_id", joined(arrays.pad_post(F.col("ids"), SHORT)).alias("ids")
    )


@query(f"""{_LENGTHS_SQL} SELECT doc_id, array_to_string(
  list_concat(list_resize([]::INTEGER[], {SHORT}, 0), ids)[-{SHORT}:], ',') AS ids FROM sized""")
def pad_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lengths(spark, sf_dir).select(
        "doc_id", joined(arrays.pad_pre(F.col("ids"), SHORT)).alias("ids")
    )


@query(f"""{_LENGTHS_SQL} SELECT doc_id, array_to_string(ids[1:{SHORT}], ',') AS ids FROM sized""")
def truncate_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lengths(spark, sf_dir).select(
        "doc_id", joined(arrays.truncate(F.col("ids"), SHORT)).alias("ids")
    )


@query("""WITH l AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS idx
                     FROM documents GROUP BY lang),
  n AS (SELECT count(*) AS n FROM l)
  SELECT doc_id, array_to_string(list_transform(range(0, n), lambda i: (i = idx)::INTEGER), ',')
    AS category
  FROM documents JOIN l USING (lang), n""")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    counts = category_counts(documents.select(F.array("lang").alias("categories")))
    labels = label_index(counts).withColumnRenamed("label", "lang")
    size = labels.count()
    return lookup_join(documents, labels, "lang", known_rows=size).select(
        "doc_id", joined(arrays.one_hot(F.col("idx"), size)).alias("category")
    )


@query("""SELECT conv_id, turn, array_to_string(string_split_regex(text, '[;? '']+'), '|') AS as_is,
  array_to_string(string_split_regex(lower(text), '[;? '']+'), '|') AS lowered
  FROM conversations""", name="question_tokens")
def split_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        joined(question_tokens(F.col("text"), lower=False), "|").alias("as_is"),
        joined(question_tokens(F.col("text")), "|").alias("lowered"),
    )


@query(r"""SELECT conv_id, turn,
  regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS text
  FROM (SELECT conv_id, turn, chr(9) || '  ' || text || ' ' || chr(10) AS text
        FROM conversations)""")
def trim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.concat(F.lit("\t  "), F.col("text"), F.lit(" \n"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.trim_line(wide).alias("text")
    )


@query("""SELECT vec_id, (unnest(range(len(embedding))))::INTEGER AS pos,
  unnest(embedding)::DOUBLE AS value FROM embeddings""")
def parse_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<string>").alias("parts")
    )
    return components(
        written.select("vec_id", arrays.parse_floats(F.col("parts")).alias("vector")), "vec_id"
    )


@query(rf"""WITH {CRAWLED_SQL} SELECT domain, len(parts)::INTEGER AS n,
    array_to_string(parts, ';') AS categories
  FROM (SELECT domain, string_split(regexp_replace(categories, '\|+$', ''), '|') AS parts
        FROM crawled)""")
def split_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = crawled(spark, sf_dir).select(
        "domain", categories.split_categories(F.col("categories")).alias("parts")
    )
    return parts.select("domain", F.size("parts").alias("n"),
                        joined("parts", ";").alias("categories"))


@query(f"""WITH {DOCUMENT_VOCABULARY_SQL},
  {encoded_sql("document_tokens", "doc_id", keep_zero=False)}
  SELECT doc_id, array_to_string(ids, ',') AS ids, len(ids)::INTEGER AS n FROM encoded""")
def drop_oov(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = token_ids(document_tokens(spark, sf_dir), document_vocabulary(spark, sf_dir))
    return drop_unknown(encoded).select("doc_id", joined("ids").alias("ids"),
                                        F.size("ids").alias("n"))
