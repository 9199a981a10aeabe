"""Page extraction, language, hosts, taxonomy, topic counts and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.inputs import (
    CRAWLED_SQL,
    RULES_SQL,
    TOPIC_PAGES_SQL,
    crawled,
    document_pages,
    joined,
    match_sql,
    rules,
    table,
    topic_pages,
    visible_sql,
)
from catalog.registry import query
from topicloom.functions import categories, html
from topicloom.operators import labels, language, pages, splits, taxonomy
from topicloom.scale import lookup_join

_UNEVEN_SQL = """uneven AS (
  SELECT source AS orig_domain, doc_id::VARCHAR AS domain,
         'Top/quality/' || quality AS categories, nullif(text, '') AS text
  FROM documents LEFT JOIN labels USING (doc_id))"""


def _uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl rows of which many have no categories: documents without a label row."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents.join(quality, "doc_id", "left").select(
        F.col("source").alias("orig_domain"),
        F.col("doc_id").cast("string").alias("domain"),
        F.concat(F.lit("Top/quality/"), "quality").alias("categories"),
        F.nullif("text", F.lit("")).alias("text"),
    )


@query(f"""WITH {_UNEVEN_SQL}
  SELECT * FROM uneven WHERE length(text) > 0 AND categories IS NOT NULL""")
def valid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.valid_pages(_uneven(spark, sf_dir))


@query(f"SELECT page_id, {visible_sql('html')} AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", html.html_to_text(F.col("html")).alias("text")
    )


@query(rf"""WITH {CRAWLED_SQL} SELECT domain AS uri, orig_domain AS orig_uri,
  replace(regexp_replace(categories, '\|+$', ''), '|', ';') AS categories, text,
  0 AS n_orig FROM crawled""")
def project_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.project_page(crawled(spark, sf_dir)).select(
        "uri",
        F.col("origUri").alias("orig_uri"),
        joined("categories", ";").alias("categories"),
        "text",
        F.size("origCategories").alias("n_orig"),
    )


def _trigram_sql(key: str, text: str, source: str) -> str:
    return f"""(SELECT {key}, unnest(list_transform(range(1, len(c) - 1),
      lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram
    FROM (SELECT {key}, string_split(lower({text}), '') AS c FROM {source}))"""


@query(f"""WITH counts AS (
    SELECT lang, gram, count(*) AS n FROM {_trigram_sql("lang", "text", "documents")}
    GROUP BY lang, gram),
  profile AS (SELECT DISTINCT gram FROM counts),
  weights AS (SELECT lang, max(count(*)) OVER () / count(*)::DOUBLE AS w
              FROM documents GROUP BY lang),
  sums AS (SELECT lang, any_value(w) * sum(n) + (SELECT count(*) FROM profile) AS total
           FROM counts JOIN profile USING (gram) JOIN weights USING (lang) GROUP BY lang),
  theta AS (SELECT s.lang, p.gram, ln(w.w * coalesce(c.n, 0) + 1) - ln(s.total) AS t
            FROM sums s CROSS JOIN profile p JOIN weights w ON w.lang = s.lang
            LEFT JOIN counts c ON c.lang = s.lang AND c.gram = p.gram),
  page_grams AS (SELECT page_id, gram, count(*) AS n FROM
    {_trigram_sql("page_id", "text", f"(SELECT page_id, {visible_sql('html')} AS text FROM pages)")}
    GROUP BY page_id, gram),
  scores AS (SELECT page_id, lang, sum(n * t) AS s
             FROM page_grams JOIN theta USING (gram) GROUP BY page_id, lang),
  english AS (SELECT page_id, s AS en FROM scores WHERE lang = 'en')
  SELECT page_id, any_value(p.url) AS url
  FROM scores JOIN english USING (page_id) JOIN pages p USING (page_id)
  GROUP BY page_id HAVING 1 / sum(exp(least(s - en, 700))) >= 0.5""")
def english_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit_language_model(table(spark, sf_dir, "documents"))
    visible = table(spark, sf_dir, "pages").select(
        "page_id", "url", html.html_to_text(F.col("html")).alias("text")
    )
    return language.english_only(visible, model).select("page_id", "url")


@query(r"""SELECT uri, orig_uri FROM (
    SELECT url AS uri, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS orig_uri FROM pages)
  WHERE regexp_matches(orig_uri, '\.com|\.gov|\.uk|\.ie|\.nz|\.(net|org|id)\.au')""")
def english_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected = pages.project_page(crawled(spark, sf_dir))
    return pages.english_hosts(projected).select("uri", F.col("origUri").alias("orig_uri"))


@query(f"""WITH {RULES_SQL}, paths AS (
    SELECT doc_id, 'Top/' || lang || '/' || source AS category FROM documents)
  SELECT doc_id, category, (SELECT coalesce(string_agg(name, ',' ORDER BY rule), '') FROM rules r
    WHERE {match_sql("category")}) AS names FROM paths""")
def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the rules that each document's category matches."""
    path = F.concat(F.lit("Top/"), F.col("lang"), F.lit("/"), F.col("source"))
    matches = F.array(*[
        F.when(
            categories.rule_match(
                F.col("category"),
                F.array(*map(F.lit, r.includes)).cast("array<string>"),
                F.array(*map(F.lit, r.excludes)).cast("array<string>"),
            ),
            F.lit(r.name),
        )
        for r in rules(spark).collect()
    ])
    documents = table(spark, sf_dir, "documents").select("doc_id", path.alias("category"))
    return documents.select("doc_id", "category", joined(F.array_compact(matches)).alias("names"))


_MAPPED_SQL = f"""WITH {TOPIC_PAGES_SQL} SELECT uri, orig_uri, topic,
  array_to_string(orig_categories, ';') AS orig_categories, text FROM topic_pages"""


def _shown(mapped: DataFrame) -> DataFrame:
    """The topic as text, and the categories that the page came with."""
    return mapped.select(
        "uri",
        F.col("origUri").alias("orig_uri"),
        joined("categories").alias("topic"),
        joined("origCategories", ";").alias("orig_categories"),
        "text",
    )


@query(_MAPPED_SQL)
def map_to_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(topic_pages(spark, sf_dir))


@query(_MAPPED_SQL)
def map_to_topics_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = taxonomy.map_to_topics_by_prefix(document_pages(spark, sf_dir), rules(spark))
    return _shown(found)


@query(f"""WITH {CRAWLED_SQL}, seeds AS (
    SELECT regexp_replace(orig_domain, '^www\\.', '') AS site, min(categories) AS categories
    FROM crawled GROUP BY site)
  SELECT site AS orig_domain, domain, s.categories, text
  FROM crawled c JOIN seeds s ON s.site = regexp_replace(c.orig_domain, '^www\\.', '')"""
       .replace("\\\\", "\\"))
def pages_with_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.regexp_replace("orig_domain", r"^www\.", "")
    seeds = crawled(spark, sf_dir).groupBy(site.alias("domain")).agg(
        F.min("categories").alias("categories")
    )
    return pages.pages_with_seeds(table(spark, sf_dir, "pages"), seeds, ignore_www=True)


@query(f"""WITH {TOPIC_PAGES_SQL}
  SELECT topic AS category, count(*) AS count FROM topic_pages GROUP BY topic""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.category_counts(topic_pages(spark, sf_dir))


@query(f"""WITH {TOPIC_PAGES_SQL}
  SELECT topic AS category, count(*) AS count,
         max(count(*)) OVER ()::DOUBLE / count(*) AS weight FROM topic_pages GROUP BY topic""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.class_weights(labels.category_counts(topic_pages(spark, sf_dir)))


_LABEL_SQL = f"""WITH {TOPIC_PAGES_SQL}, label_index AS (
  SELECT topic AS label, (row_number() OVER (ORDER BY count(*) DESC, topic) - 1)::INTEGER AS idx
  FROM topic_pages GROUP BY topic)"""


@query(f"{_LABEL_SQL} SELECT label, idx FROM label_index")
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_index(labels.category_counts(topic_pages(spark, sf_dir)))


_SOURCE_WEIGHTS_SQL = """weights AS (
    SELECT source AS label, max(count(*)) OVER ()::DOUBLE / count(*) AS weight
    FROM documents GROUP BY source),
  known AS (SELECT source AS label,
                   (row_number() OVER (ORDER BY count(*) DESC, source) - 1)::INTEGER AS idx
            FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source)"""


def _source_weights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Weights of all sources, and class numbers of the sources with toxic documents."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    weights = labels.class_weights(
        labels.category_counts(documents.select(F.array("source").alias("categories")))
    ).withColumnRenamed("category", "label")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    counts = labels.category_counts(
        documents.join(toxic, "doc_id").select(F.array("source").alias("categories"))
    )
    return weights.select("label", "weight"), labels.label_index(counts)


@query(f"WITH {_SOURCE_WEIGHTS_SQL} SELECT w.label, weight FROM weights w JOIN known USING (label)")
def known_labels_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.known_labels_only(*_source_weights(spark, sf_dir))


@query(f"WITH {_SOURCE_WEIGHTS_SQL} SELECT idx, weight FROM weights JOIN known USING (label)")
def weights_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.weights_by_index(*_source_weights(spark, sf_dir))


SPLIT_SQL = """CASE WHEN ('0x' || substr(md5(uri), 1, 8))::BIGINT < 0.1 * 4294967296 THEN 'valid'
  WHEN ('0x' || substr(md5(uri), 1, 8))::BIGINT < 0.2 * 4294967296 THEN 'test'
  ELSE 'train' END"""


@query(f"WITH {TOPIC_PAGES_SQL} SELECT uri, topic, {SPLIT_SQL} AS split FROM topic_pages")
def split_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_dataset(topic_pages(spark, sf_dir)).select(
        "uri", joined("categories").alias("topic"), "split"
    )


@query(f"""WITH {TOPIC_PAGES_SQL}, parts AS (SELECT uri, {SPLIT_SQL} AS split FROM topic_pages),
  names(n, part) AS (VALUES (0, 'valid'), (1, 'test'), (2, 'train'))
  SELECT a.part, b.part AS other,
    (SELECT count(*) FROM parts WHERE split = a.part) AS rows,
    (SELECT count(*) FROM (SELECT uri FROM parts WHERE split = a.part INTERSECT
                           SELECT uri FROM parts WHERE split = b.part)) AS shared
  FROM names a JOIN names b ON a.n <= b.n""")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_report(splits.split_dataset(topic_pages(spark, sf_dir)))


@query("""SELECT part, true AS near, (SELECT count(*) FROM documents) AS total
  FROM (VALUES ('valid'), ('test'), ('train')) t(part)""")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a drawn split: near their share (four standard deviations), whole together."""
    shares = {"valid": 0.1, "test": 0.1, "train": 0.8}
    drawn = splits.random_split(table(spark, sf_dir, "documents").select("doc_id"), shares, 5)
    share = F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("part"))
    sizes = drawn.groupBy(F.col("split").alias("part")).agg(F.count("*").alias("n"))
    total = F.col("total")
    return sizes.withColumn("total", sizes.agg(F.sum("n")).scalar()).select(
        "part",
        (F.abs(F.col("n") - share * total) <= 4 * F.sqrt(total * share * (1 - share))).alias("near"),
        "total",
    )
