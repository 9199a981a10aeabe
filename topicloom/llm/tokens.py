"""Token ids of whole texts, exactly as the tokenizer file gives them, with remembered chunks.

White space never joins into a token of the supported tokenizers, so the ids of a text are
the ids of its white-space separated chunks. Every distinct chunk of a block is looked up
once, and chunks of plain Latin letters, digits and ASCII signs are put together from
remembered pieces; anything else goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Remembered chunks and pieces of one Python worker; beyond, it forgets all and goes on.
MOST_CHUNKS = 400_000
MOST_PIECES = 600_000

_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
# Fixed value: how the tokenizer's own rule cuts lower-case text, for plain characters.
_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder of this Python worker for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level tokenizers use for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    others = (b for b in range(256) if b not in letters)
    letters.update({b: chr(256 + n) for n, b in enumerate(others)})
    return {ord(chr(b)): c for b, c in letters.items()}


class Encoder:
    """Texts to token ids with the word-level BPE tokenizer of one file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(spelled)], np.uint32).tobytes()
            if len(self.pieces) >= MOST_PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return b"".join([self._piece(p) for p in _PIECES.findall(chunk.lower())])
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return np.array(ids, np.uint32).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = pc.dictionary_encode(lists.flatten())
        known, found = self.chunks, []
        for chunk in coded.dictionary.to_pylist():
            ids = known.get(chunk)
            if ids is None:
                ids = self._chunk(chunk)
                if len(known) >= MOST_CHUNKS:
                    known.clear()
                known[chunk] = ids
            found.append(ids)
        table = np.frombuffer(b"".join(found), dtype=np.uint32)
        sizes = np.array([len(ids) // 4 for ids in found], dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        index = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[index] if len(index) else np.empty(0, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        source = np.arange(ends[-1]) + np.repeat(begins[index] - ends[:-1], lengths) if len(
            index
        ) else np.empty(0, dtype=np.int64)
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        bounds = bounds - bounds[0]
        return table[source], np.diff(ends[bounds])
