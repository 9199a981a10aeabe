"""Readers for the inputs of the pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom import schemas
from topicloom.functions.arrays import parse_floats
from topicloom.functions.text import trim_line
from topicloom.scale import dense_index, lookup_join

Paths = str | list[str]


def line_order() -> Column:
    """Sort key that follows file name, then the order of lines within a file."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def read_parquet(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A Parquet table.

    Parquet is split between row groups only, so a file with one row group is one task
    however much work its texts are; ``partitions`` spreads its rows for what follows.
    """
    rows = spark.read.parquet(path)
    return rows.repartition(partitions) if partitions else rows


def read_seeds(spark: SparkSession, path: Paths) -> DataFrame:
    """Tab separated seed list of (domain, categories); the first line is data.

    The quote is ``'``, so double quotes belong to the values.
    """
    return spark.read.schema(schemas.SEED).csv(path, sep="\t", quote="'", escape="'")


def read_pages(spark: SparkSession, path: Paths, partitions: int | None = None) -> DataFrame:
    """Crawled pages, one JSON object per line, plain or gzipped.

    A gzipped file is one task whatever its size; ``partitions`` spreads its rows for
    the work that follows.
    """
    pages = spark.read.schema(schemas.CRAWLED_PAGE).json(path)
    return pages.repartition(partitions) if partitions else pages


def read_pages_checked(
    spark: SparkSession, path: Paths, folder: str, schema: str = schemas.CRAWLED_PAGE
) -> tuple[DataFrame, DataFrame]:
    """(pages, malformed): ``read_pages`` with the lines that are no JSON of the schema set apart.

    The input is read and parsed once; both parts are written below ``folder``. ``malformed``
    has the file, the first byte of the part of the file that was read as one piece (0 for
    gzipped files), the number of the line in that piece from 1, and the line itself. Every
    line that is not blank is in one of the two.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("_line"),
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.withColumn("page", F.from_json("value", f"{schema}, _corrupt string", options))
    bad = F.col("page._corrupt").isNotNull() | F.col("page").isNull()
    blank = F.trim(F.regexp_replace("value", r"\s+", " ")) == ""
    parsed.select(
        F.when(blank, "blank").when(bad, "malformed").otherwise("pages").alias("part"),
        F.when(bad & ~blank, F.col("value")).alias("record"),
        F.when(~bad, F.col("page").dropFields("_corrupt")).alias("page"),
        F.struct("file", "block_start", "_line").alias("place"),
    ).write.partitionBy("part").parquet(folder)
    made = spark.read.parquet(folder)
    # One row per piece of a file; its first line tells where its numbers begin.
    first = made.groupBy("place.file", "place.block_start").agg(
        F.min("place._line").alias("_first"))
    malformed = made.where("part = 'malformed'").select("place.*", "record")
    numbered = lookup_join(malformed, first, ["file", "block_start"]).select(
        "file", "block_start", (F.col("_line") - F.col("_first") + 1).alias("line"), "record")
    return made.where("part = 'pages'").select("page.*"), numbered


def read_json_lines(spark: SparkSession, path: Paths, schema: str) -> DataFrame:
    """JSON lines over files, folders or globs; gzipped files are read as they are."""
    return spark.read.schema(schema).json(path)


def read_text_lines(spark: SparkSession, path: Paths, keep_blank: bool = False) -> DataFrame:
    """Trimmed lines (``value``) over files, folders or globs; hidden files are skipped."""
    lines = spark.read.text(path).select(trim_line(F.col("value")).alias("value"))
    return lines if keep_blank else lines.where("value <> ''")


def load_rules(spark: SparkSession, path: Paths) -> DataFrame:
    """Topic rules (name, includes, excludes); missing lists are empty, repeats dropped."""
    rules = spark.read.schema(schemas.RULE).json(path)
    none = F.array().cast("array<string>")

    def prefixes(field: str) -> Column:
        return F.array_distinct(F.coalesce(F.col(f"filters.{field}"), none)).alias(field)

    return rules.select("name", prefixes("includes"), prefixes("excludes"))


def load_word_vectors(
    spark: SparkSession,
    path: Paths,
    tolerant: bool = False,
    partitions: int | None = None,
    with_line: bool = False,
) -> DataFrame:
    """Word vectors: a word and its numbers per line, separated by single spaces.

    A bad number fails the job unless ``tolerant``. ``with_line`` adds the sort key
    ``line`` that tells which of several vectors of a word came first.
    """
    parts = F.split("value", " ")
    lines = spark.read.text(path)
    vectors = lines.select(
        F.element_at(parts, 1).alias("word"),
        parse_floats(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), tolerant).alias(
            "vector"
        ),
        *([line_order().alias("line")] if with_line else []),
    )
    return vectors.repartition(partitions) if partitions else vectors


def read_directory_xml(spark: SparkSession, path: Paths) -> DataFrame:
    """(topic, link) of every page element of the directory dump that has a topic."""
    pages = (
        spark.read.format("xml").schema(schemas.DIRECTORY_PAGE).option("rowTag", "ExternalPage")
    )
    return (
        pages.load(",".join(path) if isinstance(path, list) else path)
        .where("topic is not null and _about is not null")
        .select("topic", F.col("_about").alias("link"))
    )


def read_vocabulary(spark: SparkSession, path: Paths) -> DataFrame:
    """Word to id from JSON lines; of a repeated word the last line counts."""
    lines = spark.read.schema(schemas.VOCABULARY).json(path)
    return (
        lines.select("word", "id", line_order().alias("line"))
        .groupBy("word")
        .agg(F.max_by("id", "line").alias("id"))
    )


def read_label_table(spark: SparkSession, path: Paths) -> DataFrame:
    """(label, idx) from files written by ``write_dictionaries``."""
    return spark.read.schema("label string, idx int").csv(path)


def read_labels(spark: SparkSession, path: Paths) -> list[str]:
    """Class labels in class order, from files written by ``write_dictionaries``."""
    return [row.label for row in read_label_table(spark, path).orderBy("idx").collect()]


def read_label_lines(spark: SparkSession, path: Paths) -> DataFrame:
    """(label, idx) of a file with one label per line; the line number is the class."""
    lines = spark.read.text(path).select(F.col("value").alias("label"), line_order().alias("line"))
    numbered = dense_index(lines, ["line"], "idx")
    return numbered.select("label", F.col("idx").cast("int").alias("idx"))


def read_matrix_lines(spark: SparkSession, path: Paths) -> DataFrame:
    """(id, vector) of a JSON lines file with one vector per line; the line number is the id."""
    lines = spark.read.schema("vector array<float>").json(path)
    numbered = dense_index(lines.select("vector", line_order().alias("line")), ["line"], "id")
    return numbered.select(F.col("id").cast("int").alias("id"), "vector")


def read_class_weights(spark: SparkSession, path: Paths) -> DataFrame:
    """(label, weight) from the weights file, one row per label."""
    return (
        spark.read.schema(schemas.CLASS_WEIGHTS)
        .json(path)
        .select(F.explode("weights").alias("label", "weight"))
    )


def concat_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of several frames with the same columns, repeats kept."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first
