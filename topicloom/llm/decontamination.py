"""Benchmark passages in documents, by a prefix-filtered join of word shingles.

Every item is cut into windows of consecutive words. A window is the set of its shingles,
which are ordered by rarity: by how often they occur in all documents, then by hash. A
window lies in a document only if all its shingles do, so one prefix shingle per window, its
rarest, is enough to look for. Where a document has that shingle, its place in the window
gives the only place the window can have; it must lie within the document, and every byte of
every word must be the same there.

Only the shingles of the items are counted and only windows of the items are sent to the
tasks, in blocks of bounded size; documents are not moved.

Defined cases: a null text has no words; an item without words has no window. An item
without an id, or whose id is no whole number, is looked for like any other and its words
count as hit, but no id of it is listed. Repeated items or ids count once. Repeated documents are reported each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.blocks import (
    Words,
    blocks,
    bytes_in,
    find_words,
    lower_ascii,
    mix,
    shingle_hashes,
)
from topicloom.llm.store import stored
from topicloom.scale import with_row_key

#: Words are runs of digits, a-z and everything beyond ASCII.
WORD_BYTES = bytes_in((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Words of a shingle.
SHINGLE = 5
#: Windows that are sent to the tasks at once.
BLOCK_WINDOWS = 200_000

_FILTER_BITS = 20
_HIT = "array<struct<first: int, last: int>>"


def item_windows(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(words, items, unnamed): distinct windows, their words joined by spaces.

    ``items`` has the ids of their items, ``unnamed`` tells whether one of these has none.
    """

    def run(batches):
        lower = lower_ascii()
        for rows, data, offsets in blocks(batches, text):
            found = find_words(lower[data], offsets, WORD_BYTES)
            spelled = [lower[data[x:y]].tobytes() for x, y in zip(found.starts, found.ends)]
            out = ([], [])
            for item, a, b in zip(rows.column(key).to_pylist(), found.first, found.first[1:]):
                for start in range(a, max(b - window, a) + 1 if b > a else a):
                    stop = min(start + window, b)
                    out[0].append(b" ".join(spelled[start:stop]))
                    out[1].append(item)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64())],
                names=["words", "item"],
            )

    narrow = items.select(F.col(key).try_cast("long").alias(key), F.col(text).alias(text))
    windows = narrow.mapInArrow(run, "words binary, item long")
    # Null ids are left out of the list only.
    return windows.groupBy("words").agg(
        F.collect_set("item").alias("items"), F.bool_or(F.col("item").isNull()).alias("unnamed"))


class Windows:
    """A block of windows, ready to be looked for."""

    def __init__(self, rows: list) -> None:
        self.items = [sorted(row.items) for row in rows]
        self.unnamed = np.array([row.unnamed for row in rows], dtype=bool)
        joined = b"".join(row.words for row in rows)
        size = np.array([len(row.words) for row in rows], dtype=np.int64)
        found = find_words(np.frombuffer(joined, dtype=np.uint8),
                           np.concatenate([[0], np.cumsum(size)]), WORD_BYTES)
        bounds = list(zip(found.first[:-1], found.first[1:]))
        self.words = [found.hashes[a:b] for a, b in bounds]
        length = found.ends - found.starts
        self.lengths = [length[a:b] for a, b in bounds]
        #: Letters of all windows without the spaces, and where those of each window begin.
        self.letters = np.frombuffer(joined.replace(b" ", b""), dtype=np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([n.sum() for n in self.lengths])]).astype(
            np.int64)
        hashes, window, place, sizes = [], [], [], []
        for number, words in enumerate(self.words):
            size = min(SHINGLE, len(words))
            whole = Words(np.empty(0), np.empty(0), words, np.array([0, len(words)]))
            found, _ = shingle_hashes(whole, size)
            hashes.append(mix(found + np.uint64(size)))
            window.append(np.full(len(found), number))
            place.append(np.arange(len(found)))
            sizes.append(size)
        self.sizes = sorted(set(sizes))
        self.hash = np.concatenate(hashes)
        self.window = np.concatenate(window)
        self.place = np.concatenate(place)
        self.shingles = np.unique(self.hash)

    def keep_prefixes(self, counts: dict[int, int]) -> None:
        """Keep the rarest shingle of every window; ``counts`` by place in ``shingles``."""
        index = np.searchsorted(self.shingles, self.hash)
        often = np.zeros(len(self.shingles), dtype=np.int64)
        for at, count in counts.items():
            often[at] = count
        order = np.lexsort((self.place, self.hash, often[index], self.window))
        first = np.flatnonzero(np.diff(self.window[order], prepend=-1))
        chosen = order[first]
        by_hash = chosen[np.argsort(self.hash[chosen], kind="stable")]
        self.hash, self.window, self.place = (
            x[by_hash] for x in (self.hash, self.window, self.place)
        )
        self.shingles = np.unique(self.hash)

    def bitmap(self) -> np.ndarray:
        bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
        bits[(self.shingles >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return bits

    def spelled_at(self, data, found: Words, start: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether the windows' words, of the same lengths as those there, are the same bytes."""
        count = np.array([len(self.words[n]) for n in number], dtype=np.int64)
        before = np.cumsum(count) - count
        word = np.repeat(start - before, count) + np.arange(count.sum())
        size = found.ends[word] - found.starts[word]
        place = np.repeat(found.starts[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        letters = self.begin[number + 1] - self.begin[number]
        first = np.cumsum(letters) - letters
        wanted = np.repeat(self.begin[number] - first, letters) + np.arange(letters.sum())
        return np.logical_and.reduceat(data[place] == self.letters[wanted], first)

    def hits(self, found: Words, bits: np.ndarray):
        """Yield (places in the block's shingles, positions of their first words)."""
        for size in self.sizes:
            rolled, first = shingle_hashes(found, size)
            counts = np.diff(found.first)
            whole = np.repeat(counts >= size, np.diff(first))
            start = np.arange(len(rolled)) - np.repeat(first[:-1] - found.first[:-1], np.diff(first))
            rolled = mix(rolled + np.uint64(size))
            maybe = np.flatnonzero(
                bits[(rolled >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] & whole
            )
            at = np.searchsorted(self.shingles, rolled[maybe])
            at[at == len(self.shingles)] = 0
            same = self.shingles[at] == rolled[maybe]
            yield at[same], start[maybe[same]]


def _shingle_counts(docs: DataFrame, text: str, shared) -> dict[int, int]:
    """How often each shingle of the block occurs in all documents."""

    def run(batches):
        windows = shared.value
        lower, bits = lower_ascii(), windows.bitmap()
        total = np.zeros(len(windows.shingles), dtype=np.int64)
        for _, data, offsets in blocks(batches, text):
            found = find_words(lower[data], offsets, WORD_BYTES)
            for at, _ in windows.hits(found, bits):
                total += np.bincount(at, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(total[some])], names=["at", "n"]
        )

    counts = docs.select(text).mapInArrow(run, "at long, n long")
    # As many rows as the block has shingles.
    return {row.at: row.n for row in counts.groupBy("at").agg(F.sum("n").alias("n")).collect()}


def _matches(docs: DataFrame, keys: list[str], text: str, shared) -> DataFrame:
    """(keys, n_words, n_hit, items, unnamed, hits) of every document for a block of windows."""

    def run(batches):
        windows = shared.value
        lower, bits = lower_ascii(), windows.bitmap()
        sizes = np.array([len(w) for w in windows.words], dtype=np.int64)
        begin = np.searchsorted(windows.hash, windows.shingles, side="left")
        end = np.searchsorted(windows.hash, windows.shingles, side="right")
        for rows, data, offsets in blocks(batches, text):
            data = lower[data]
            found = find_words(data, offsets, WORD_BYTES)
            length = found.ends - found.starts
            text_of = found.text_of
            starts, numbers = [], []
            for at, position in windows.hits(found, bits):
                many = end[at] - begin[at]
                entry = np.repeat(begin[at], many) + np.arange(many.sum()) - np.repeat(
                    np.cumsum(many) - many, many
                )
                number = windows.window[entry]
                start = np.repeat(position, many) - windows.place[entry]
                doc = text_of[np.repeat(position, many)]
                inside = (start >= found.first[doc]) & (
                    start + sizes[number] <= found.first[doc + 1]
                )
                starts.append(start[inside])
                numbers.append(number[inside])
            start = np.concatenate(starts) if starts else np.empty(0, dtype=np.int64)
            number = np.concatenate(numbers) if numbers else np.empty(0, dtype=np.int64)
            equal = np.zeros(len(start), dtype=bool)
            for size in np.unique(sizes[number]):
                here = np.flatnonzero(sizes[number] == size)
                own, index = np.unique(number[here], return_inverse=True)
                words = np.stack([windows.words[n] for n in own])
                widths = np.stack([windows.lengths[n] for n in own])
                for low in range(0, len(here), 1 << 16):
                    part = slice(low, low + (1 << 16))
                    cells = start[here[part]][:, None] + np.arange(size)
                    equal[here[part]] = (
                        (found.hashes[cells] == words[index[part]])
                        & (length[cells] == widths[index[part]])
                    ).all(axis=1)
            start, number = start[equal], number[equal]
            same = [windows.spelled_at(data, found, start[low:low + (1 << 14)],
                                       number[low:low + (1 << 14)])
                    for low in range(0, len(start), 1 << 14)]
            if same:
                same = np.concatenate(same)
                start, number = start[same], number[same]
            edge = np.zeros(len(found.hashes) + 1, dtype=np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + sizes[number], -1)
            covered = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int64)])
            total = np.cumsum(covered)
            n_hit = total[found.first[1:]] - total[found.first[:-1]]
            items, hits = [[] for _ in n_hit], [[] for _ in n_hit]
            unnamed = np.zeros(len(n_hit), dtype=bool)
            doc = text_of[start] if len(start) else start
            order = np.argsort(doc, kind="stable")
            doc, number = doc[order], number[order]
            bounds = np.searchsorted(doc, np.arange(len(n_hit) + 1))
            for d in np.unique(doc):
                a, b = found.first[d], found.first[d + 1]
                seen = {i for n in np.unique(number[bounds[d]:bounds[d + 1]])
                        for i in windows.items[n]}
                items[d] = sorted(seen)
                unnamed[d] = windows.unnamed[number[bounds[d]:bounds[d + 1]]].any()
                change = np.flatnonzero(np.diff(covered[a + 1:b + 1], prepend=0, append=0))
                hits[d] = [{"first": int(x), "last": int(y) - 1}
                           for x, y in zip(change[::2], change[1::2])]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(k) for k in keys), pa.array(np.diff(found.first), pa.int64()),
                 pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64())),
                 pa.array(unnamed), pa.array(hits, pa.list_(pa.struct([("first", pa.int32()),
                                                    ("last", pa.int32())])))],
                names=[*keys, "n_words", "n_hit", "items", "unnamed", "hits"],
            )

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*dict.fromkeys([*keys, text])).mapInArrow(
        run, f"{kinds}, n_words long, n_hit long, items array<long>, unnamed boolean, "
        f"hits {_HIT}"
    )


def find_benchmark(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_windows: int = BLOCK_WINDOWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(key, n_words, n_hit, items, unnamed, hits) per document.

    ``n_hit``: words inside any occurrence of a window; ``items``: ids of the items with
    such windows; ``unnamed``: whether an item without an id has one; ``hits``: the first and last word of each run of hit words.

    Items are looked for in blocks of windows. With more than one block the runs of each
    document are brought together by a row key. The columns ``keep`` of each row come along.
    """
    spark = docs.sparkSession
    windows = stored(item_windows(items, item_key, item_text, window), "windows")
    parts = -(-windows.count() // block_windows)
    more = [c for c in dict.fromkeys(keep) if c != key]
    if parts <= 1:
        return _find_block(docs, [key, *more], text, windows.collect(), spark)
    dealt = windows.withColumn("_block", F.pmod(F.hash("words"), F.lit(parts)))
    dealt = stored(dealt, "window-blocks")
    keyed = with_row_key(docs.select(*dict.fromkeys([key, text, *more])))
    found = [
        stored(_find_block(keyed, ["_row", key], text,
                           dealt.where(F.col("_block") == block).collect(), spark), "matches")
        for block in range(parts)
    ]
    union = found[0]
    for other in found[1:]:
        union = union.union(other)
    merged = _merge(union, key)
    if more:
        merged = merged.join(keyed.select("_row", *more), "_row")
    return merged.select(key, *more, "n_words", "n_hit", "items", "unnamed", "hits")


def _find_block(docs, keys, text, rows, spark) -> DataFrame:
    if not rows:
        return _matches_none(docs, keys, text)
    windows = Windows(rows)
    shared = spark.sparkContext.broadcast(windows)
    windows.keep_prefixes(_shingle_counts(docs, text, shared))
    return _matches(docs, keys, text, spark.sparkContext.broadcast(windows))


def _matches_none(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The result where there is no window to look for."""

    def run(batches):
        lower = lower_ascii()
        for rows, data, offsets in blocks(batches, text):
            found = find_words(lower[data], offsets, WORD_BYTES)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(k) for k in keys), pa.array(np.diff(found.first), pa.int64())],
                names=[*keys, "n_words"],
            )

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    counted = docs.select(*dict.fromkeys([*keys, text])).mapInArrow(run, f"{kinds}, n_words long")
    return counted.select(
        "*", F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<long>").alias("items"),
        F.lit(False).alias("unnamed"), F.array().cast(_HIT).alias("hits"),
    )


def _merge(found: DataFrame, key: str) -> DataFrame:
    """The runs of all blocks of one document as one list of runs."""
    runs = F.array_sort(F.flatten(F.collect_list("hits")))
    joined = F.aggregate(
        runs,
        F.array().cast(_HIT),
        lambda done, run: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] + 1 >= run["first"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(
                    F.element_at(done, -1)["first"].alias("first"),
                    F.greatest(F.element_at(done, -1)["last"], run["last"]).alias("last"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(run))),
    )
    grouped = found.groupBy("_row").agg(
        F.first(key).alias(key), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.bool_or("unnamed").alias("unnamed"), joined.alias("hits"),
    )
    hit = F.aggregate("hits", F.lit(0).cast("long"),
                      lambda sum_, run: sum_ + run["last"] - run["first"] + 1)
    return grouped.select("_row", key, "n_words", hit.alias("n_hit"), "items", "unnamed", "hits")


def items_digest(items):
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ","),
                  256)


def clean_documents(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without a hit word. Rows with a null key stay."""
    bad = found.where("n_hit > 0").select(key).distinct()
    return docs.join(bad, key, "anti")
