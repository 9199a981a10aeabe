"""Word vectors for a vocabulary and page vectors from them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.operators.vocabulary import dense_word_ids
from topicloom.scale import bounded_arrow, lookup_join, salted_join, with_row_key

BROADCAST_FLOATS = 50_000_000
GATHERED_FLOATS = 2_000_000
GATHERED_IDS = 1_000_000


def vector_dim_check(vectors: DataFrame) -> DataFrame:
    """(vectors, min_dim, max_dim) over all vectors, not only the first."""
    size = F.size("vector")
    return vectors.agg(
        F.count("*").alias("vectors"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim")
    )


def vector_dim(vectors: DataFrame) -> int:
    """The common dimension; fails when vectors differ or there are none."""
    check = vector_dim_check(vectors).first()
    if check.min_dim is None or check.min_dim != check.max_dim:
        raise ValueError(f"vectors have dimensions {check.min_dim} to {check.max_dim}")
    return check.max_dim


def vocab_embeddings(
    vocabulary: DataFrame, vectors: DataFrame, known_words: int | None = None
) -> DataFrame:
    """(word, id, vector) for words in both tables, new ids 1, 2, ... by frequency.

    ``vocabulary`` has (word, count). Of several vectors of a word the first line
    counts when ``vectors`` has ``line``, else the smallest vector.
    """
    joined = lookup_join(vectors, vocabulary.select("word", "count"), "word",
                         known_rows=known_words)
    order = "line" if "line" in vectors.columns else "vector"
    unique = joined.groupBy("word").agg(
        F.max("count").alias("count"), F.min_by("vector", order).alias("vector")
    )
    return dense_word_ids(unique, known_words).select("word", "id", "vector")


def sort_matrix(embedded: DataFrame) -> DataFrame:
    """(id, vector) in the order of ids; the id stays as a column."""
    return embedded.select("id", "vector").orderBy("id")


def prepend_zero_vector(matrix: DataFrame, dim: int) -> DataFrame:
    """Add the zero vector of the padding id 0."""
    zero = matrix.sparkSession.range(1).select(
        F.lit(0).alias("id"), F.array_repeat(F.lit(0.0).cast("float"), dim).alias("vector")
    )
    return zero.unionByName(matrix.select("id", "vector"))


def embedding_matrix(embedded: DataFrame, dim: int) -> DataFrame:
    """(id, vector) of all words and of padding; row ``id`` belongs to word ``id``."""
    return sort_matrix(prepend_zero_vector(embedded, dim))


def mean_vectors(
    df: DataFrame,
    matrix: DataFrame,
    dim: int,
    ids: str = "ids",
    out: str = "meanVector",
    max_floats: int = BROADCAST_FLOATS,
) -> DataFrame:
    """Add the mean vector of the known words of a row; zeros when there is none.

    A matrix within the bound is sent to the executors once and averaged in Arrow
    batches. A larger one is joined, see ``mean_vectors_by_join``.
    """
    known = bounded_arrow(matrix.where("id <> 0").select("id", "vector"),
                          max_floats // max(dim, 1))
    if known is None:
        return mean_vectors_by_join(df, matrix, dim, ids, out)
    in_order = known.sort_by("id")
    # Looked up by their order, so gaps between the ids cost nothing.
    numbers = in_order["id"].to_numpy().astype(np.int64)
    flat = np.asarray(pc.list_flatten(in_order["vector"].combine_chunks()), dtype=np.float32)
    shared = df.sparkSession.sparkContext.broadcast((numbers, flat.reshape(len(numbers), dim)))

    average = F.arrow_udf(averager(shared, dim), T.ArrayType(T.DoubleType()))
    return df.withColumn(out, average(F.col(ids)))


def averager(shared, dim: int) -> Callable[[pa.Array], pa.Array]:
    """Lists of ids to their mean vectors; ``shared`` holds the known ids and their vectors.

    A bounded number of ids, or one row, is worked on at a time: besides its batch and the
    means a worker needs the same memory for any number of rows.
    """
    block, most = max(1, GATHERED_FLOATS // max(dim, 1)), GATHERED_IDS

    def average(lists: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        numbers, vectors = shared.value
        dim = vectors.shape[1]
        ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        flat = lists.flatten()
        means = np.zeros((len(lists), dim))
        low = 0
        while low < len(lists):
            start = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, start + most, side="right")))
            words = np.asarray(flat.slice(start, int(ends[high - 1]) - start))
            sizes = np.diff(ends[low:high], prepend=start)
            row = np.repeat(np.arange(low, high), sizes)
            # Padding is no word; most of a short row is padding.
            row, words = row[words != 0], words[words != 0]
            place = np.searchsorted(numbers, words)
            place[place == len(numbers)] = 0
            found = (numbers[place] == words) if len(numbers) else np.zeros(len(words), dtype=bool)
            row, place = row[found], place[found]
            # A bounded number of gathered vectors at a time.
            for first in range(0, len(row), block):
                part = row[first:first + block]
                heads = np.flatnonzero(np.diff(part, prepend=-1))
                gathered = vectors[place[first:first + block]].astype(np.float64)
                means[part[heads]] += np.add.reduceat(gathered, heads, axis=0)
            means[low:high] /= np.maximum(np.bincount(row - low, minlength=high - low), 1)[:, None]
            low = high
        offsets = np.arange(len(lists) + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(offsets, means.ravel())

    return average


def mean_vectors_by_join(
    df: DataFrame, matrix: DataFrame, dim: int, ids: str = "ids", out: str = "meanVector"
) -> DataFrame:
    """``mean_vectors`` for a matrix of any size: join, then average by row key."""
    keyed = with_row_key(df)
    words = keyed.select("_row", F.explode(ids).alias("id")).where("id <> 0")
    joined = salted_join(words, matrix.where("id <> 0").select("id", "vector"), "id")
    vector = array_to_vector(F.col("vector").cast("array<double>"))
    means = joined.groupBy("_row").agg(vector_to_array(Summarizer.mean(vector)).alias(out))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return (
        keyed.join(means, "_row", "left")
        .withColumn(out, F.coalesce(F.col(out), zeros))
        .drop("_row")
    )
