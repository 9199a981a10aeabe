"""License notices in texts, by a positional index of their rarest words.

A template is a notice with mandatory key phrases. The words of all templates are the
license words; how many documents have each of them is counted over the whole table. Every
phrase enters the index under its words of highest inverse document frequency, each with its
place in the phrase. The license words of a text that the index knows are looked up, and
their postings intersected by relative position: a phrase can only stand where all its
indexed words do, each at its own distance from the start. What is left is verified byte by
byte. A template is found where all its phrases stand, each within ``SLACK`` words of the
place the first one gives it. Its score is the share of the template's words, weighted by
their frequency as above, that lie in the window.

Defined cases: a null or empty text has no words and no hit. Repeated rows, and rows with
equal or null keys, are scanned each. Ties in frequency go by the word. Phrases that overlap
or repeat are all reported. A very long text is scanned whole. An empty table gives no rows.
Columns other than the key and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.blocks import Words, blocks, bytes_in, find_words, lower_ascii

#: Words are runs of digits, a-z and everything beyond ASCII.
WORD_BYTES = bytes_in((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Words of a phrase that are looked up.
RARE_WORDS = 3
#: Words by which later phrases may be off their place.
SLACK = 12

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HITS = "array<struct<first: int, last: int, label: string, base: boolean, score: double>>"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_UPPER))


@dataclass(frozen=True)
class Template:
    """A notice under a label; ``base`` marks the fixed phrases that are counted apart."""

    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False
    words: list[str] = field(init=False, repr=False)
    places: list[int] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        words, places, start = words_of(self.text), [], 0
        for phrase in self.phrases:
            wanted = words_of(phrase)
            while words[start:start + len(wanted)] != wanted:
                if start >= len(words):
                    raise ValueError(f"{phrase!r} is not in the text of {self.label!r}, in order")
                start += 1
            if not wanted:
                raise ValueError(f"{self.label!r} has a phrase without words")
            places.append(start)
            start += len(wanted)
        if not places:
            raise ValueError(f"{self.label!r} has no key phrase")
        object.__setattr__(self, "words", words)
        object.__setattr__(self, "places", places)


def _phrase(label: str, phrase: str) -> Template:
    return Template(label, phrase, (phrase,), base=True)


# The phrases that are counted, with their labels.
BASE = (
    _phrase("mit", "under the mit license"),
    _phrase("apache-2", "apache license version 2"),
    _phrase("cc-by-nc", "cc by nc"),
)
#: Beginnings of well-known public notices.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy "
             "of this software and associated documentation files (the Software), to deal in the "
             "Software without restriction, including without limitation the rights to use, copy, "
             "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
             ("hereby granted, free of charge", "to deal in the Software without restriction")),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may "
             "not use this file except in compliance with the License",
             ("Apache License, Version 2.0", "in compliance with the License")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without "
             "modification, are permitted provided that the following conditions are met",
             ("in source and binary forms", "provided that the following conditions are met")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any "
             "purpose with or without fee is hereby granted",
             ("distribute this software for any purpose", "without fee is hereby granted")),
    Template("gpl-2", "you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation; either version 2 of "
             "the License", ("GNU General Public License", "either version 2 of the License")),
    Template("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation, either version 3 of "
             "the License", ("GNU General Public License", "either version 3 of the License")),
    Template("gpl-2", "licensed under the GNU General Public License, version 2",
             ("GNU General Public License, version 2",)),
    Template("gpl-3", "licensed under the GNU General Public License, version 3",
             ("GNU General Public License, version 3",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License",
             ("GNU Lesser General Public License",)),
    Template("agpl-3", "under the terms of the GNU Affero General Public License, version 3",
             ("GNU Affero General Public License",)),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public "
             "License, v. 2.0", ("Mozilla Public License, v. 2.0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain",
             ("free and unencumbered software", "into the public domain")),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License",
             ("Creative Commons Attribution 4.0",)),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 "
             "International License", ("Creative Commons Attribution-ShareAlike",)),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", ("CC BY-SA",)),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 "
             "International License", ("Creative Commons Attribution-NonCommercial",)),
    Template("cc0", "dedicated to the public domain under CC0 1.0 Universal", ("CC0 1.0",)),
)


@dataclass(frozen=True)
class Posting:
    """An indexed word of a phrase, and its place there."""

    word: str
    place: int


class Index:
    """Phrases by their rarest words, and the weight of every license word."""

    def __init__(self, templates: Sequence[Template], weights: dict[str, float]) -> None:
        self.templates = list(templates)
        self.weights = weights
        self.phrases: dict[tuple[str, ...], list[Posting]] = {}
        for template in templates:
            for phrase in map(tuple, map(words_of, template.phrases)):
                rare = sorted(set(phrase), key=lambda w: (-weights[w], w))[:RARE_WORDS]
                self.phrases[phrase] = [Posting(w, phrase.index(w)) for w in rare]
        self.indexed = Vocabulary({p.word for all_ in self.phrases.values() for p in all_})
        self.licensed = Vocabulary({w for t in templates for w in t.words})


class Vocabulary:
    """Words that are looked up by their hash."""

    def __init__(self, words) -> None:
        self.words = sorted(words)
        joined = "\n".join(self.words).encode()
        data = np.frombuffer(joined, dtype=np.uint8)
        hashes = find_words(data, np.array([0, len(data)]), WORD_BYTES).hashes
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.bits = np.zeros(1 << 16, dtype=bool)
        self.bits[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of known words, their numbers)."""
        maybe = np.flatnonzero(self.bits[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(self.hashes, hashes[maybe])
        at[at == len(self.hashes)] = 0
        same = self.hashes[at] == hashes[maybe]
        return maybe[same], self.order[at[same]]


def _spelled(data: np.ndarray, found: Words, starts: np.ndarray, phrase) -> np.ndarray:
    """Which of the word places begin the phrase, byte by byte."""
    good = np.ones(len(starts), dtype=bool)
    for number, word in enumerate(phrase):
        spelled = np.frombuffer(word.encode(), dtype=np.uint8)
        at = found.starts[starts[good] + number]
        same = found.ends[starts[good] + number] - at == len(spelled)
        cells = at[same][:, None] + np.arange(len(spelled))
        same[same] = (data[cells] == spelled).all(axis=1)
        good[good] = same
    return good


def _phrase_places(index: Index, data: np.ndarray, found: Words) -> dict:
    """Where each phrase stands: ascending numbers of first words, within one text each."""
    places, numbers = index.indexed.lookup(found.hashes)
    of = {w: places[numbers == n] for n, w in enumerate(index.indexed.words)}
    out = {}
    for phrase, postings in index.phrases.items():
        starts = of[postings[0].word] - postings[0].place
        for posting in postings[1:]:
            if not len(starts):
                break
            starts = np.intersect1d(starts, of[posting.word] - posting.place, assume_unique=True)
        if len(starts):
            low = starts + postings[0].place
            text = np.searchsorted(found.first, low, side="right") - 1
            inside = (starts >= found.first[text]) & (
                starts + len(phrase) <= found.first[text + 1])
            starts = starts[inside]
            starts = starts[_spelled(data, found, starts, phrase)]
        out[phrase] = starts
    return out


def _template_places(template: Template, places: dict, found: Words) -> np.ndarray:
    """First words of the template's first phrase where all its phrases are in place."""
    phrases = [tuple(words_of(p)) for p in template.phrases]
    starts = places[phrases[0]]
    for phrase, place in zip(phrases[1:], template.places[1:]):
        if not len(starts):
            break
        other = places[phrase]
        text = np.searchsorted(found.first, starts, side="right") - 1
        due = starts + place - template.places[0]
        low = np.maximum(due - SLACK, found.first[text])
        high = np.minimum(due + SLACK + 1, found.first[text + 1])
        starts = starts[np.searchsorted(other, low) < np.searchsorted(other, high)]
    return starts


def _scores(index: Index, template: Template, starts: np.ndarray, found: Words,
            known: dict[str, np.ndarray]) -> np.ndarray:
    """Weighted share of the template's words in the window of each place."""
    text = np.searchsorted(found.first, starts, side="right") - 1
    begin = starts - template.places[0]
    low = np.maximum(begin - SLACK, found.first[text])
    high = np.minimum(begin + len(template.words) + SLACK, found.first[text + 1])
    total, seen = 0.0, np.zeros(len(starts))
    for word in sorted(set(template.words)):
        there = np.searchsorted(known[word], low) < np.searchsorted(known[word], high)
        total += index.weights[word]
        seen += np.where(there, index.weights[word], 0.0)
    return np.minimum(seen / total, 1.0) if total else np.ones(len(starts))


def document_counts(docs: DataFrame, text: str, words: Sequence[str]) -> tuple[int, dict[str, int]]:
    """(number of documents, how many of them have each word)."""
    vocabulary = Vocabulary(words)

    def run(batches):
        lower = lower_ascii()
        total = np.zeros(len(vocabulary.words) + 1, dtype=np.int64)
        for rows, data, offsets in blocks(batches, text):
            found = find_words(lower[data], offsets, WORD_BYTES)
            places, numbers = vocabulary.lookup(found.hashes)
            doc = np.searchsorted(found.first, places, side="right") - 1
            held = np.unique(doc * len(vocabulary.words) + numbers)
            total[:-1] += np.bincount(held % len(vocabulary.words), minlength=len(total) - 1)
            total[-1] += rows.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    counts = docs.select(text).mapInArrow(run, "word long, n long")
    # One row per license word, and one for the number of documents.
    found = dict.fromkeys(range(len(vocabulary.words) + 1), 0)
    found.update((r.word, r.n) for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect())
    return found[len(vocabulary.words)], {w: found[i] for i, w in enumerate(vocabulary.words)}


def scan_licenses(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: Sequence[Template] = (*BASE, *NOTICES),
) -> DataFrame:
    """(key, n_words, hits) per document.

    ``hits`` has, in order, the first and last word of each template found (words from 0),
    its label, whether it is a base phrase, and its score. Templates are a small fixed set:
    their index is sent to every task.
    """
    words = sorted({w for t in templates for w in t.words})
    n_docs, counts = document_counts(docs, text, words)
    weights = {w: float(np.log((n_docs + 1) / (counts[w] + 0.5))) for w in words}
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates, weights))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        index, lower = shared.value, lower_ascii()
        for rows, data, offsets in blocks(batches, text):
            data = lower[data]
            found = find_words(data, offsets, WORD_BYTES)
            places = _phrase_places(index, data, found)
            held = [_template_places(t, places, found) for t in index.templates]
            hits = [[] for _ in range(rows.num_rows)]
            if any(len(x) for x in held):
                at, numbers = index.licensed.lookup(found.hashes)
                known = {w: at[numbers == n] for n, w in enumerate(index.licensed.words)}
            for template, starts in zip(index.templates, held):
                if not len(starts):
                    continue
                score = _scores(index, template, starts, found, known)
                doc = np.searchsorted(found.first, starts, side="right") - 1
                first = starts - found.first[doc]
                last = first + len(words_of(template.phrases[0])) - 1
                for d, a, b, s in zip(doc.tolist(), first.tolist(), last.tolist(),
                                      score.tolist()):
                    hits[d].append((a, b, template.label, template.base, s))
            hits = [
                [dict(zip(("first", "last", "label", "base", "score"), hit))
                 for hit in sorted(of, key=lambda h: (h[0], h[2], not h[3], h[1], h[4]))]
                for of in hits
            ]
            yield pa.RecordBatch.from_arrays(
                [rows.column(key), pa.array(np.diff(found.first), pa.int64()),
                 pa.array(hits, pa.list_(pa.struct([
                     ("first", pa.int32()), ("last", pa.int32()), ("label", pa.string()),
                     ("base", pa.bool_()), ("score", pa.float64())])))],
                names=[key, "n_words", "hits"],
            )

    return docs.select(*dict.fromkeys([key, text])).mapInArrow(
        run, f"`{key}` {kind}, n_words long, hits {_HITS}")


def label_list(hits: Column) -> Column:
    """The distinct labels of hits, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
