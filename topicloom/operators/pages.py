"""From crawled pages to pages with text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.categories import split_categories
from topicloom.functions.html import html_to_text
from topicloom.functions.urls import host_of, is_english_host, site_of
from topicloom.scale import lookup_join, written_lookup


def valid_pages(raw: DataFrame) -> DataFrame:
    """Rows with some text and with categories; other rows are dropped, not failed."""
    return raw.where("length(text) > 0 and categories is not null")


def project_page(raw: DataFrame) -> DataFrame:
    """Name the columns of a page: final address ``uri``, seed address ``origUri``."""
    return raw.select(
        F.col("domain").alias("uri"),
        F.col("orig_domain").alias("origUri"),
        split_categories(F.col("categories")).alias("categories"),
        "text",
        F.array().cast("array<string>").alias("origCategories"),
    )


def extract_pages(raw: DataFrame) -> DataFrame:
    """Valid pages with their visible text."""
    return project_page(valid_pages(raw)).withColumn("text", html_to_text(F.col("text")))


def english_hosts(pages: DataFrame) -> DataFrame:
    """Pages whose host name looks English; pages without a readable host are dropped."""
    return pages.where(is_english_host(F.col("uri")))


def pages_with_seeds(
    fetched: DataFrame,
    seeds: DataFrame,
    ignore_www: bool = False,
    known_seeds: int | None = None,
) -> DataFrame:
    """Fetched pages (url, html) with the categories of the seed row of their host.

    One host may own a large part of all pages, see ``lookup_join``.
    """
    host = host_of(F.col("url"))
    site = site_of(host) if ignore_www else host
    seed_site = site_of(F.col("domain")) if ignore_www else F.col("domain")
    keyed = fetched.withColumn("_site", site).where("_site is not null")
    lookup = written_lookup(seeds.select(
        seed_site.alias("_site"), F.col("domain").alias("orig_domain"), "categories"
    ))
    return lookup_join(keyed, lookup, "_site", known_rows=known_seeds).select(
        "orig_domain", F.col("url").alias("domain"), "categories", F.col("html").alias("text")
    )
