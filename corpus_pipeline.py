"""A cleaning pipeline over documents, as five stages written one after another.

Toxic documents go; of each group of near duplicates one document stays; documents with
benchmark passages go; secrets are replaced; what is left is packed into token sequences.
All stages but the last return the columns of documents. A document with a null text counts
as empty. Every row is judged by its own text, with a null or a shared id too; only labels
are found by the id. An empty table goes through all stages. Further columns of documents are
kept by all stages but the last, whatever their names: the operators see only id and text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.decontamination import find_benchmark
from topicloom.llm.jaccard_join import keep_one_row
from topicloom.llm.labelled import fold
from topicloom.llm.packing import pack_documents
from topicloom.llm.registry import QUERIES, table
from topicloom.llm.secrets import find_secrets, redact, train_markov
from topicloom.llm.store import ship_package, stored
from topicloom.llm.toxicity import THRESHOLD, toxicity_scores


def _narrow(docs: DataFrame) -> DataFrame:
    """Id, text and, as one column, the rest of the row: no name can clash with a result."""
    return docs.select("doc_id", "text", F.struct(
        F.lit(None).cast("int").alias("_"), *(c for c in docs.columns if c != "text")
    ).alias("_document"))


def _wide(narrow: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again."""
    rest = F.col("_document")
    return narrow.select(*(
        changed.get(c, F.col("text") if c == "text" else rest[c]).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    ship_package(spark)
    held_out = fold(F.col("doc_id"), 4) == 2
    scored = toxicity_scores(_narrow(docs), table(spark, sf_dir, "labels"), held_out,
                             keep=("text", "_document"))
    return _wide(scored.where(F.col("score") < THRESHOLD), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8."""
    ship_package(spark)
    return keep_one_row(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in a 10-word window of a benchmark item."""
    ship_package(spark)
    found = find_benchmark(_narrow(docs), table(spark, sf_dir, "benchmark"),
                           keep=("text", "_document"))
    return _wide(found.where("n_hit = 0"), docs)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced, with the new number of characters."""
    ship_package(spark)
    clean = redact(find_secrets(_narrow(docs), train_markov(docs)))
    n_chars = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("_document.n_chars"))
    return _wide(clean, docs, n_chars=n_chars.cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2,048 tokens."""
    ship_package(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", replace_secrets),
    ("best-fit packing", pack),
]

#: Tokens, learned weights and random strings have no equivalent in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each to what its predecessor has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES["pipeline"] = run
