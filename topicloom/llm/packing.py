"""Documents packed into token sequences of a fixed capacity.

Every document becomes its ids and an end id. Only documents beyond the capacity are cut.
Pieces longer than a third of the capacity are large: a sequence holds at most two of them.
Large ones are paired greedily, the longest with the longest that still fits. Smaller ones
follow from long to short, each into the sequence with the smallest gap that takes it.

Only the number of pieces of each length matters for this, so the plan is made from that
histogram, whose size is the capacity. A piece finds its place by its length and its rank
among the pieces of that length.

Defined cases: a null or empty text is the end id alone. Repeated rows are packed each. A
null key is kept. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.blocks import BLOCK_BYTES, blocks
from topicloom.llm.store import stored
from topicloom.llm.tokens import encoder

CAPACITY = 2048
# Fixed value: the id that ends every document.
END_ID = 0


@dataclass
class Plan:
    """Where the pieces of each length go.

    Row i: pieces of ``length`` with ranks from ``rank`` on go to sequences from
    ``sequence`` on, ``each`` of them one after another from ``offset``.
    """

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0

    def put(self, length: int, rank: int, sequence: int, each: int, offset: int) -> None:
        self.length.append(length)
        self.rank.append(rank)
        self.sequence.append(sequence)
        self.each.append(each)
        self.offset.append(offset)


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for so many pieces of each length, from 1 to ``capacity``."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in counts.items():
        left[length] = count
    used = np.zeros(capacity + 1, dtype=np.int64)
    plan = Plan()
    #: For every gap, runs of sequences (first, how many) with that gap.
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def take(length: int, sequence: int, each: int, offset: int, pieces: int) -> None:
        plan.put(length, int(used[length]), sequence, each, offset)
        used[length] += pieces
        left[length] -= pieces

    least_large = capacity // 3 + 1
    for x in range(capacity, least_large - 1, -1):
        while left[x] > 0:
            y = next((y for y in range(min(x, capacity - x), least_large - 1, -1)
                      if left[y] > (1 if y == x else 0)), 0)
            first = plan.sequences
            if not y:
                n = int(left[x])
                take(x, first, 1, 0, n)
            elif y == x:
                n = int(left[x]) // 2
                take(x, first, 2, 0, 2 * n)
            else:
                n = int(min(left[x], left[y]))
                take(x, first, 1, 0, n)
                take(y, first, 1, x, n)
            gaps[capacity - x - y].append((first, n))
            plan.sequences += n
    for s in range(least_large - 1, 0, -1):
        for gap in range(s, capacity):
            while left[s] > 0 and gaps[gap]:
                first, n = gaps[gap].pop()
                each = gap // s
                full = min(n, int(left[s]) // each)
                if full:
                    take(s, first, each, capacity - gap, full * each)
                    gaps[gap - each * s].append((first, full))
                if full < n:
                    rest = int(left[s])
                    if rest:
                        take(s, first + full, rest, capacity - gap, rest)
                        gaps[gap - rest * s].append((first + full, 1))
                        full += 1
                    if full < n:
                        gaps[gap].append((first + full, n - full))
            if not left[s]:
                break
        while left[s] > 0:
            each = capacity // s
            n = int(left[s]) // each
            first = plan.sequences
            if n:
                take(s, first, each, 0, n * each)
            else:
                each, n = int(left[s]), 1
                take(s, first, each, 0, each)
            gaps[capacity - each * s].append((first, n))
            plan.sequences += n
    return plan


def token_pieces(
    docs: DataFrame, tokenizer: str, key: str, text: str, capacity: int, ids: bool
) -> DataFrame:
    """Pieces of every document, with their rank among those of the same length and task."""

    def run(batches):
        encode = encoder(tokenizer).encode
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for rows, data, offsets in blocks(batches, text, BLOCK_BYTES):
            texts = pa.LargeStringArray.from_buffers(
                len(rows), pa.py_buffer(np.ascontiguousarray(offsets)),
                pa.py_buffer(np.ascontiguousarray(data)),
            )
            flat, sizes = encode(texts)
            flat = np.insert(flat, np.cumsum(sizes), END_ID).astype("<u4")
            sizes = sizes + 1
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            number = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), number)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            begin = first[doc] + start
            raw = flat.view(np.uint8)
            crc = [zlib.crc32(raw[4 * b:4 * (b + n)]) for b, n in zip(begin, length)]
            order = np.argsort(length, kind="stable")
            counts = np.bincount(length, minlength=capacity + 1)
            rank = np.empty(len(length), dtype=np.int64)
            heads = np.cumsum(counts) - counts
            rank[order] = np.arange(len(length)) - heads[length[order]]
            rank += seen[length]
            seen += counts
            columns = [
                rows.column(key).take(pa.array(doc)), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()),
                pa.array(rank, pa.int64()),
            ]
            names = [key, "piece", "start", "length", "ids_crc32", "part", "rank"]
            if ids:
                bounds = pa.array(np.append(begin, len(flat)).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(bounds, pa.array(flat.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    more = ", ids array<int>" if ids else ""
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, "
             f"part int, rank long{more}"
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    ids: bool = False,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) per piece of a document.

    With ``ids`` the token ids of the piece come along. ``sequence_id`` counts from 0.
    """
    pieces = stored(token_pieces(docs, tokenizer, key, text, capacity, ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # One row per task and length; the totals are one row per length.
    counts = stored(counts, "piece-counts")
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    plan = plan_sequences({row.length: row.n for row in totals}, capacity)
    order = np.lexsort((plan.rank, plan.length))
    arrays = [np.array(x, dtype=np.int64)[order]
              for x in (plan.length, plan.rank, plan.sequence, plan.each, plan.offset)]
    # Its size follows from the capacity, not from the number of documents.
    shared = docs.sparkSession.sparkContext.broadcast(arrays)

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        lengths, ranks, sequence, each, offset = shared.value
        size, number = np.asarray(length), np.asarray(rank)
        shift = np.int64(1 << 50)
        row = np.searchsorted(lengths * shift + ranks, size * shift + number, side="right") - 1
        inner = number - ranks[row]
        return pa.StructArray.from_arrays(
            [pa.array(sequence[row] + inner // each[row]),
             pa.array(offset[row] + inner % each[row] * size)],
            names=["sequence_id", "offset"],
        )

    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    earlier = counts.select(
        "part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")
    )
    ranked = pieces.join(earlier, ["part", "length"])
    placed = ranked.withColumn("place", place("length", F.col("rank") + F.col("earlier")))
    columns = [key, "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset"]
    return placed.select(*columns, *(["ids"] if ids else []))
