"""Words to padded id sequences."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.arrays import drop_zero_ids, fit_post, pad_post
from topicloom.operators.labels import sparse_labels
from topicloom.scale import BROADCAST_ROWS, bounded_arrow, salted_join, with_row_key

# Fixed value: default number of ids per page.
SEQUENCE_LENGTH = 1_000
LOOKED_UP_WORDS = 1_000_000


def token_ids(
    df: DataFrame,
    vocabulary: DataFrame,
    tokens: str = "tokens",
    out: str = "ids",
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the id of every token, in order; 0 for words outside the vocabulary.

    A vocabulary within the bound is sent to the executors and looked up in Arrow
    batches, so rows stay where they are. A larger one is joined, see
    ``token_ids_by_join``.
    """
    words = bounded_arrow(vocabulary.select("word", "id"), max_broadcast_rows)
    if words is None:
        return token_ids_by_join(df, vocabulary, tokens, out)
    shared = df.sparkSession.sparkContext.broadcast(
        (words["word"].combine_chunks(), words["id"].combine_chunks())
    )
    look_up = F.arrow_udf(word_finder(shared), T.ArrayType(T.IntegerType()))
    words_of_row = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    return df.withColumn(out, F.when(F.col(tokens).isNotNull(), look_up(words_of_row)))


def word_finder(shared) -> Callable[[pa.Array], pa.Array]:
    """Lists of words to lists of ids; ``shared`` holds the known words and their ids.

    A bounded number of words is looked up at a time, so that a worker needs little more
    than its batch and the ids.
    """
    most = LOOKED_UP_WORDS

    def look_up(lists: pa.Array) -> pa.Array:
        import pyarrow as pa
        import pyarrow.compute as pc

        known, ids = shared.value
        known = known.cast(lists.values.type)
        found = [
            pc.fill_null(pc.take(ids, pc.index_in(lists.values.slice(low, most), value_set=known)), 0)
            for low in range(0, len(lists.values), most)
        ]
        values = pa.concat_arrays(found) if found else pa.array([], pa.int32())
        return pa.ListArray.from_arrays(lists.offsets, values)

    return look_up


def token_ids_by_join(
    df: DataFrame, vocabulary: DataFrame, tokens: str = "tokens", out: str = "ids"
) -> DataFrame:
    """``token_ids`` for a vocabulary of any size.

    Only (row, place, word) is joined, salted against frequent words; the ids of a row
    are put in order again by its key and joined back.
    """
    keyed = with_row_key(df)
    places = keyed.select("_row", F.posexplode(tokens).alias("pos", "word"))
    joined = salted_join(places, vocabulary.select("word", "id"), "word", "left")
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(0)).alias("id"))))
    per_row = joined.groupBy("_row").agg(F.transform(pairs, lambda p: p["id"]).alias(out))
    empty = F.when(F.col(tokens).isNotNull(), F.array().cast("array<int>"))
    return (
        keyed.join(per_row, "_row", "left")
        .withColumn(out, F.coalesce(F.col(out), empty))
        .drop("_row")
    )


def drop_oov(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    """Drop the zeros of unknown words, before any padding."""
    return encoded.withColumn(ids, drop_zero_ids(F.col(ids)))


def encode(
    df: DataFrame,
    vocabulary: DataFrame,
    length: int = SEQUENCE_LENGTH,
    oov: str = "drop",
    truncate: bool = True,
    tokens: str = "tokens",
    out: str = "paddedWords",
) -> DataFrame:
    """Add padded word ids: the one encoder for training and for prediction.

    ``oov="drop", truncate=True`` is the training form, ``oov="zero", truncate=False``
    the serving form that keeps unknown words as 0 and long texts whole.
    """
    if oov not in ("drop", "zero"):
        raise ValueError("oov is 'drop' or 'zero'")
    encoded = token_ids(df, vocabulary, tokens, out)
    if oov == "drop":
        encoded = drop_oov(encoded, out)
    fit = fit_post if truncate else pad_post
    return encoded.withColumn(out, fit(F.col(out), length))


def sequence_features(
    token_rows: DataFrame,
    vocabulary: DataFrame,
    labels: DataFrame,
    length: int = SEQUENCE_LENGTH,
) -> DataFrame:
    """(uri, origUri, paddedWords, label): one feature row per token row.

    ``label`` is the category as (idx, size) over ``labels`` (label, idx); ``dense_label``
    makes it a one-hot array. A page without any known word stays, with zeros only.
    """
    slim = token_rows.select("uri", "origUri", "category", "tokens")
    numbered = sparse_labels(slim, labels, "category")
    return encode(numbered, vocabulary, length).select("uri", "origUri", "paddedWords", "label")
