"""Alignment of two tokenizers over the same texts, by inverted bitmaps of token pairs.

Every text, with a space before it, is cut into tokens by a byte-level BPE (A) and by a piece
model (B). Two token occurrences whose byte ranges overlap are a link; places where tokens of
both end cut the text into groups.

* Texts are cut at spaces where neither tokenizer joins what stands before and after, so
  equal chunks have equal tokens, groups and links, and are worked out once per block of text.
* Documents are numbered in blocks of bounded size. A block holds, for every pair of ids, the
  bitmap of its documents, merged by "or" over the chunks that hold the pair, as one plane per
  binary digit of the number of links. A plane is a list of 16-bit numbers or, where that is
  longer, a bit string.
* The number of documents of a pair is the sum of the popcounts of its bitmaps over all
  blocks. The scores go back along the postings: every plane adds its pair's count to the
  documents it names. Texts and tokens are never moved.

Defined cases: a text that is null or empty, or whose tokens do not spell it (one with U+2581
in it), has no tokens: zeros and an empty digest. Repeated rows and rows with equal or null keys
are documents of their own. Ties: all partners with the highest count of an A id count as best.
A very long text is cut and linked whole; it makes a block of its own. An empty table gives no
rows. Columns other than the key and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.blocks import blocks
from topicloom.llm.store import stored
from topicloom.scale import lookup_join

#: Bytes of text that are worked out at once, and chunks that are handed to the tokenizers.
BLOCK_BYTES = 2 << 20
BATCH_CHUNKS = 4096
#: Bytes of a chunk beyond which the slower library of the two for byte-level tokens cuts it.
LONG_CHUNK = 1000
#: Documents of a block, as slots have 16 bits, and the links of documents it is closed at.
BLOCK_DOCS = 1 << 16
BLOCK_LINKS = 1_000_000
#: Slots in a plane from which a bit string is shorter than a list.
DENSE = BLOCK_DOCS // 16

_POSTINGS = ("part long, block long, slot int, _key {kind}, n_a long, n_b long, n_groups long, "
             "groups_sha256 string, a int, b int, plane int, bits binary, n_docs long")
_RESULT = ("{key} {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
           "count_sum long, groups_sha256 string")

# Fixed value: how byte-level vocabularies cut a text before tokens are merged.
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_aligners: dict[tuple[str, str], "Aligner"] = {}


def aligner(byte_file: str, piece_file: str) -> "Aligner":
    """The aligner of this Python worker for two tokenizer files."""
    if (byte_file, piece_file) not in _aligners:
        _aligners[byte_file, piece_file] = Aligner(byte_file, piece_file)
    return _aligners[byte_file, piece_file]


def byte_letters() -> dict[str, int]:
    """The byte of each printable letter of byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(printable))
    return {**{chr(b): b for b in printable}, **{chr(256 + n): b for n, b in enumerate(others)}}


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()


@dataclass(frozen=True)
class Aligned:
    """Distinct chunks of a block of texts, worked out for all of them at once.

    ``pairs`` has one code per link, chunk by chunk as ``n_links`` says: the A id times the
    number of B ids, plus the B id. ``groups`` has the groups of each chunk, each after ";".
    """

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    groups: list[bytes]


class Table:
    """Byte strings by number."""

    def __init__(self, strings: list[bytes]) -> None:
        self.size = np.array([len(x) for x in strings], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def join(self, numbers: np.ndarray) -> np.ndarray:
        """The strings of the numbers, one after another."""
        size = self.size[numbers]
        moved = self.begin[numbers] - (np.cumsum(size) - size)
        return self.data[np.repeat(moved, size) + np.arange(size.sum())]


class Aligner:
    """Chunks to tokens, links and groups of both tokenizers."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.byte_level = Tokenizer.from_file(byte_file)
        # The names of special tokens inside a text are plain text.
        self.byte_level.encode_special_tokens = True
        self.pieces = SentencePieceProcessor(model_file=piece_file)
        letters = byte_letters()
        vocabulary = self.byte_level.get_vocab(with_added_tokens=False)
        of_id = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
        self.spelled_a = [of_id.get(i, b"") for i in range(max(of_id) + 1)]
        merges = json.loads(self.byte_level.to_str())["model"]["merges"]
        if any(vocabulary["".join(pair)] != 256 + n for n, pair in enumerate(merges)):
            raise ValueError("ids are not in the order of merges")
        # The same tokens, several times faster: ids tell which merge comes first.
        self.ranked = Encoding("ranked", pat_str=_PIECES, special_tokens={},
                               mergeable_ranks={x: i for i, x in of_id.items()})
        pieces = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any("▁" in piece.lstrip("▁") for piece in pieces):
            raise ValueError("pieces with a space inside: texts cannot be cut at spaces")
        self.spelled_b = [piece_bytes(p, self.pieces.is_byte(i)) for i, p in enumerate(pieces)]
        self.space = self.pieces.piece_to_id("▁")
        self.table_a, self.table_b = Table(self.spelled_a), Table(self.spelled_b)
        # Every number after each separator of the group text.
        self.most = max(len(self.spelled_a), len(self.spelled_b))
        self.decimal = Table(
            [sep + b"%d" % n for sep in (b";", b",", b"|") for n in range(self.most)])

    def align(self, chunks: pa.Array) -> Aligned:
        """Work out chunks, which each begin with a space, as large binary values."""
        count = len(chunks)
        offsets = np.frombuffer(chunks.buffers()[1], np.int64)[
            chunks.offset:chunks.offset + count + 1]
        data = np.frombuffer(chunks.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        # Chunks that another one may follow without a change to their tokens.
        cuts = chunk_starts(data, np.array([0, len(data)]))
        closed = np.isin(offsets[1:], cuts) & (np.diff(offsets) <= LONG_CHUNK)
        texts = chunks.cast(pa.large_string())
        parts = [
            self._encode(texts.slice(low, BATCH_CHUNKS).to_pylist(),
                         closed[low:low + BATCH_CHUNKS], np.diff(offsets)[low:low + BATCH_CHUNKS])
            for low in range(0, count, BATCH_CHUNKS)
        ]
        a, n_a, b, n_b = (np.concatenate(x) for x in zip(*parts))
        lone = np.flatnonzero(n_b == 0)
        if len(lone):
            # A space alone: the model adds a first space to a text only.
            b = np.insert(b, (np.cumsum(n_b) - n_b)[lone], self.space)
            n_b[lone] = 1
        size, good = np.diff(offsets), np.ones(count, dtype=bool)
        each = np.arange(count)
        for ids, n, table in ((a, n_a, self.table_a), (b, n_b, self.table_b)):
            length = np.bincount(np.repeat(each, n), table.size[ids], count).astype(np.int64)
            same = length == size
            spelled = table.join(ids[np.repeat(same, n)])
            wrong = spelled != data[np.repeat(same, size)]
            same[np.repeat(each[same], size[same])[wrong]] = False
            good &= same
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)

        # Between two neighbouring ends of any tokens lies one link.
        ends_a, ends_b = np.cumsum(self.table_a.size[a]), np.cumsum(self.table_b.size[b])
        ends = np.union1d(ends_a, ends_b)
        i, j = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        chunk_a, chunk_b = np.repeat(each, n_a), np.repeat(each, n_b)
        n_links = np.bincount(chunk_a[i], minlength=count)
        pairs = a[i] * len(self.spelled_b) + b[j]
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_chunk = chunk_a[np.searchsorted(ends_a, cuts)]
        return Aligned(good, n_a, n_b, np.bincount(group_chunk, minlength=count), n_links, pairs,
                       self._groups(a, b, ends_a, ends_b, cuts, chunk_a, chunk_b, count))

    def _encode(self, texts: list[str], closed: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Ids and numbers of tokens of both tokenizers; ``closed`` chunks are cut as one text."""
        joined = "".join([t for t, c in zip(texts, closed) if c])
        of_joined = np.array(self.ranked.encode_ordinary(joined), dtype=np.int64)
        ends = np.cumsum(self.table_a.size[of_joined])
        last = np.cumsum(size[closed])
        last_token = np.searchsorted(ends, last)
        if not np.array_equal(ends[last_token], last):
            raise ValueError("a token of the byte-level vocabulary crosses a cut")
        others = [e.ids for e in self.byte_level.encode_batch_fast(
            [t for t, c in zip(texts, closed) if not c], add_special_tokens=False)]
        n_a = np.empty(len(texts), dtype=np.int64)
        n_a[closed] = np.diff(last_token, prepend=-1)
        n_a[~closed] = [len(ids) for ids in others]
        a = np.empty(int(n_a.sum()), dtype=np.int64)
        a[np.repeat(closed, n_a)] = of_joined
        a[np.repeat(~closed, n_a)] = list(chain.from_iterable(others))
        # The piece model puts the first space there itself.
        coded_b = self.pieces.encode([t[1:] for t in texts], num_threads=1)
        n_b = np.fromiter(map(len, coded_b), np.int64, len(coded_b))
        return [a, n_a, np.fromiter(chain.from_iterable(coded_b), np.int64, n_b.sum()), n_b]

    def _groups(self, a, b, ends_a, ends_b, cuts, chunk_a, chunk_b, count) -> list[bytes]:
        """The tokens of A, then those of B, group by group."""
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a = np.bincount(group_a, minlength=len(cuts))
        in_b = np.bincount(group_b, minlength=len(cuts))
        before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        place_a = np.arange(len(a)) + before_b[group_a]
        place_b = np.arange(len(b)) + (before_a + in_a)[group_b]
        numbers = np.empty(len(a) + len(b), dtype=np.int64)
        numbers[place_a] = a + np.where(np.arange(len(a)) == before_a[group_a], 0, self.most)
        numbers[place_b] = b + np.where(
            np.arange(len(b)) == before_b[group_b], 2 * self.most, self.most)
        chunk = np.empty(len(numbers), dtype=np.int64)
        chunk[place_a], chunk[place_b] = chunk_a, chunk_b
        size = np.bincount(chunk, self.decimal.size[numbers], count).astype(np.int64)
        text = self.decimal.join(numbers).tobytes()
        ends = np.cumsum(size)
        return [text[x:y] for x, y in zip((ends - size).tolist(), ends.tolist())]


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of spaces that no token crosses: text starts, and spaces after what is no space.

    The byte-level tokenizer puts runs of any Unicode white space together, so a space after
    one of them is no place to cut. Every text begins with a space.
    """
    before = np.concatenate([np.zeros(2, np.uint8), data])
    second, last = before[:-2], before[1:-1]
    # Ends of the UTF-8 forms of white space beyond ASCII; a few other letters share them,
    # and there the text is just not cut.
    white = ((second == 0xC2) & ((last == 0x85) | (last == 0xA0))) | (
        (second == 0x9A) & (last == 0x80)) | ((second == 0x81) & (last == 0x9F)) | (
        (second == 0x80) & (last <= 0xAF))
    cut = (data == 0x20) & (last > 0x20) & ~((last >= 0x80) & white)
    cut[offsets[:-1]] = True
    return np.flatnonzero(cut)


class Block:
    """Links of up to ``BLOCK_DOCS`` documents, collected as (pair, slot, number)."""

    def __init__(self) -> None:
        self.docs = 0
        self.links = 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, pair: np.ndarray, slot: np.ndarray, number: np.ndarray) -> None:
        self.parts.append((pair, slot, number))
        self.links += len(pair)

    def planes(self):
        """Yield (pairs, plane, n_docs, slots, ends): all pairs' documents, one plane per digit.

        ``n_docs``, the popcount of all planes of the pair together, comes with its first plane.
        """
        pair, slot, number = (np.concatenate(x) for x in zip(*self.parts))
        place = pair * BLOCK_DOCS + slot
        order = np.argsort(place, kind="stable")
        place = place[order]
        new = np.flatnonzero(np.diff(place, prepend=-1))
        number = np.add.reduceat(number[order], new, dtype=np.int64)
        pair, slot = place[new] // BLOCK_DOCS, (place[new] % BLOCK_DOCS).astype(np.uint16)
        heads = np.flatnonzero(np.diff(pair, prepend=-1))
        docs = np.diff(np.append(heads, len(pair)))
        of = np.repeat(np.arange(len(heads)), docs)
        counted = np.zeros(len(heads), dtype=bool)
        for plane in range(int(number.max()).bit_length()):
            here = np.flatnonzero((number >> plane) & 1)
            size = np.bincount(of[here], minlength=len(heads))
            some = np.flatnonzero(size)
            ends = np.concatenate([[0], np.cumsum(size[some])])
            n_docs = np.where(counted[some], 0, docs[some])
            counted[some] = True
            yield pair[heads[some]], plane, n_docs, slot[here], ends


def bitmaps(slots: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ascending slots of many planes as lists of 16-bit numbers or as bit strings."""
    sizes = np.diff(ends)
    if not (sizes >= DENSE).any():
        offsets = pa.array((ends * 2).astype(np.int32))
        return pa.Array.from_buffers(
            pa.binary(), len(sizes), [None, offsets.buffers()[1], pa.py_buffer(slots.tobytes())])
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a < DENSE:
            out.append(slots[a:b].tobytes())
        else:
            bits = np.zeros(BLOCK_DOCS, dtype=bool)
            bits[slots[a:b]] = True
            out.append(np.packbits(bits).tobytes())
    return pa.array(out, pa.binary())


def read_bitmaps(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all planes one after another, number of slots of each plane)."""
    values = column.to_pylist()
    found = [
        np.flatnonzero(np.unpackbits(np.frombuffer(v, dtype=np.uint8))).astype(np.uint16)
        if len(v) == BLOCK_DOCS // 8 else np.frombuffer(v, dtype=np.uint16) for v in values
    ]
    if not found:
        return np.empty(0, dtype=np.uint16), np.empty(0, dtype=np.int64)
    return np.concatenate(found), np.array([len(f) for f in found])


def _postings(docs: DataFrame, key: str, text: str, byte_file: str, piece_file: str) -> DataFrame:
    """Rows of two kinds: a document with its block and slot, or a plane of a pair in a block."""
    kind = docs.schema[key].dataType.simpleString()
    columns = ["part", "block", "slot", "_key", "n_a", "n_b", "n_groups", "groups_sha256", "a",
               "b", "plane", "bits", "n_docs"]

    def run(batches):
        tool = aligner(byte_file, piece_file)
        width = len(tool.spelled_b)
        block, number, part = Block(), 0, 0
        types: pa.Schema | None = None

        def rows(count: int, **given) -> pa.RecordBatch:
            arrays = [given[c] if c in given else pa.nulls(count, types.field(c).type)
                      for c in columns]
            return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, types)],
                                              schema=types)

        def close():
            if not block.links:
                return
            for pairs, plane, n_docs, slots, ends in block.planes():
                yield rows(
                    len(pairs), part=pa.array(np.full(len(pairs), part)),
                    block=pa.array(np.full(len(pairs), number)),
                    a=pa.array(pairs // width), b=pa.array(pairs % width),
                    plane=pa.array(np.full(len(pairs), plane)), bits=bitmaps(slots, ends),
                    n_docs=pa.array(n_docs))

        for own, data, offsets in blocks(batches, "_text", BLOCK_BYTES):
            if types is None:
                part = own.column("part")[0].as_py()
                types = pa.schema([
                    ("part", pa.int64()), ("block", pa.int64()), ("slot", pa.int32()),
                    ("_key", own.column("_key").type), ("n_a", pa.int64()), ("n_b", pa.int64()),
                    ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("a", pa.int32()),
                    ("b", pa.int32()), ("plane", pa.int32()), ("bits", pa.binary()),
                    ("n_docs", pa.int64())])
            if block.docs + own.num_rows > BLOCK_DOCS or block.links >= BLOCK_LINKS:
                yield from close()
                block, number = Block(), number + 1
            count = own.num_rows
            empty = np.diff(offsets) == 0
            data = np.insert(data, offsets[:-1], 0x20)
            offsets = offsets + np.arange(count + 1)
            starts = chunk_starts(data, offsets)
            first = np.searchsorted(starts, offsets)
            cuts = pa.array(np.append(starts, len(data)).astype(np.int64))
            cut = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                        [None, cuts.buffers()[1], pa.py_buffer(data)])
            coded = pc.dictionary_encode(cut)
            found = tool.align(coded.dictionary)
            index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            bad = empty | (np.add.reduceat(~found.good[index], first[:-1], dtype=np.int64) > 0)
            sums = [np.where(bad, 0, np.add.reduceat(each[index], first[:-1]))
                    for each in (found.n_a, found.n_b, found.n_groups)]
            digests = [
                "" if bad[d] else hashlib.sha256(b"".join(
                    [found.groups[i] for i in index[first[d]:first[d + 1]].tolist()])[1:]
                ).hexdigest() for d in range(count)
            ]
            slots = np.arange(block.docs, block.docs + count)
            yield rows(
                count, part=pa.array(np.full(count, part)), block=pa.array(np.full(count, number)),
                slot=pa.array(slots), _key=own.column("_key"), n_a=pa.array(sums[0]),
                n_b=pa.array(sums[1]), n_groups=pa.array(sums[2]),
                groups_sha256=pa.array(digests))
            doc = np.repeat(np.arange(count), np.diff(first))
            fine = ~bad[doc]
            held, times = np.unique(doc[fine] * len(found.good) + index[fine], return_counts=True)
            doc, chunk = held // len(found.good), held % len(found.good)
            many = found.n_links[chunk]
            begins = np.cumsum(found.n_links) - found.n_links
            source = np.repeat(begins[chunk] - (np.cumsum(many) - many), many) + np.arange(
                many.sum())
            pairs, links = found.pairs[source], np.repeat(times, many)
            block.add(pairs, slots[np.repeat(doc, many)].astype(np.int32), links.astype(np.int32))
            block.docs += count
        yield from close()

    narrow = docs.select(F.spark_partition_id().alias("part"), F.col(key).alias("_key"),
                         F.col(text).alias("_text"))
    return narrow.mapInArrow(run, _POSTINGS.format(kind=kind))


@dataclass(frozen=True)
class Alignment:
    """``documents``: one row per document; ``pairs``: (a, b, n_docs, best) of linked id pairs."""

    documents: DataFrame
    pairs: DataFrame


def align_tokens(
    docs: DataFrame, byte_file: str, piece_file: str, key: str = "doc_id", text: str = "text"
) -> Alignment:
    """Links of the tokens of two tokenizers, per document and per pair of ids.

    ``documents`` has (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).
    ``n_docs`` of a pair: documents that hold it linked; ``best``: whether it is the highest
    one of its A id.
    """
    kind = docs.schema[key].dataType.simpleString()
    postings = stored(_postings(docs, key, text, byte_file, piece_file), "pair-postings")
    counts = postings.where("a is not null").groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"))
    # An A id has at most as many partners as B has ids.
    best = F.max("n_docs").over(Window.partitionBy("a"))
    pairs = stored(counts.withColumn("best", F.col("n_docs") == best), "pair-counts")
    scores = pairs.select("a", "b", F.col("n_docs").alias("score"), "best")
    planes = postings.where("a is not null").select("part", "block", "a", "b", "plane", "bits")
    scored = lookup_join(planes, scores, ["a", "b"]).drop("a", "b")
    own = postings.where("a is null").drop("a", "b", "plane", "bits", "n_docs")
    both = own.unionByName(scored, allowMissingColumns=True)

    def score(group: pa.Table) -> pa.Table:
        is_doc = pc.is_valid(group.column("slot"))
        rows = group.filter(is_doc)
        planes = group.filter(pc.invert(is_doc)).combine_chunks()
        slots, sizes = read_bitmaps(planes.column("bits"))
        links = np.left_shift(1, planes.column("plane").to_numpy().astype(np.int64))
        sums = []
        for weight in (
            links, links * planes.column("best").to_numpy().astype(np.int64),
            links * planes.column("score").to_numpy().astype(np.int64),
        ):
            total = np.zeros(BLOCK_DOCS, dtype=np.int64)
            np.add.at(total, slots, np.repeat(weight, sizes))
            sums.append(pa.array(total[rows.column("slot").to_numpy()]))
        return pa.table(
            [rows.column("_key"), rows.column("n_a"), rows.column("n_b"),
             rows.column("n_groups"), *sums, rows.column("groups_sha256")],
            names=[key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                   "groups_sha256"],
        )

    # A group is one block: bounded in documents and, but for one long text, in links.
    documents = both.groupBy("part", "block").applyInArrow(
        score, _RESULT.format(key=f"`{key}`", kind=kind))
    return Alignment(documents, pairs)
