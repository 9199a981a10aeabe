"""License scans, against a search word by word in plain Python."""

import math
import random

import pytest

pytest.importorskip("public_tokenizers")

from topicloom.llm import licenses, queries  # noqa: E402, F401
from topicloom.llm.licenses import BASE, NOTICES, SLACK, Template, words_of  # noqa: E402
from topicloom.llm.registry import QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TEMPLATES = (*BASE, *NOTICES)


def brute_scan(texts):
    """(n_words, hits) per text."""
    split = [words_of(t or "") for t in texts]
    vocabulary = {w for t in TEMPLATES for w in t.words}
    n = {w: sum(w in set(words) for words in split) for w in vocabulary}
    weight = {w: math.log((len(texts) + 1) / (n[w] + 0.5)) for w in vocabulary}
    out = []
    for words in split:
        hits = []
        for t in TEMPLATES:
            phrases = [words_of(p) for p in t.phrases]
            at = [[i for i in range(len(words)) if words[i:i + len(p)] == p] for p in phrases]
            for s in at[0]:
                due = [s + place - t.places[0] for place in t.places]
                if all(any(abs(x - d) <= SLACK for x in found)
                       for found, d in zip(at[1:], due[1:])):
                    begin = s - t.places[0]
                    window = set(words[max(begin - SLACK, 0):begin + len(t.words) + SLACK])
                    total = sum(weight[w] for w in set(t.words))
                    share = sum(weight[w] for w in set(t.words) & window) / total
                    hits.append((s, s + len(phrases[0]) - 1, t.label, t.base,
                                 round(min(share, 1.0), 9)))
        out.append((len(words), sorted(hits, key=lambda h: (h[0], h[2], not h[3], h[1], h[4]))))
    return out


def scanned(df):
    return [(r.n_words, [(h.first, h.last, h.label, h.base, round(h.score, 9)) for h in r.hits])
            for r in df.collect()]


def notices():
    draw = random.Random(5)
    plain = "the license of this software is by version under public general copy nc cc 2".split()
    texts = [None, "", " .\n", "MIT", "under the MIT License", "UNDER THE MIT-LICENSE under the mit "
             "license", "cc by nc cc by nc", "under the mit licenses", "Apache License, Version 2.0",
             "apache license version 20", "ünder the mit license", "under the mit license é" * 3,
             "under the mit license " * 4000]
    for t in NOTICES:
        texts.append(t.text)
        words = t.text.split()
        for _ in range(4):
            copy = list(words)
            for _ in range(draw.randrange(1, 6)):
                copy.insert(draw.randrange(len(copy)), draw.choice(plain))
            texts.append(" ".join(["x"] * draw.randrange(3) + copy))
        texts.append(" ".join(words[len(words) // 2:]))
        texts.append(f"{t.phrases[0]} {'filler ' * 30} {t.phrases[-1]}")
    for _ in range(60):
        texts.append(" ".join(draw.choice(plain) for _ in range(draw.randrange(60))))
    return texts


def test_notices_like_brute_force(spark):
    texts = notices()
    frame = spark.createDataFrame(
        [(i, t, "x", 1) for i, t in enumerate(texts)],
        "doc_id long, text string, hits string, n_words int").coalesce(1)
    found = licenses.scan_licenses(frame)
    assert found.columns == ["doc_id", "n_words", "hits"]
    wanted = brute_scan(texts)
    for text, ours, theirs in zip(texts, scanned(found), wanted):
        assert ours == theirs, text
    assert sum(bool(h) for _, h in wanted) > 50
    labels = {label for _, h in wanted for _, _, label, _, _ in h}
    assert labels == {t.label for t in TEMPLATES}


def test_query_like_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in QUERIES["op12_license_scans"](spark, SMALL).collect()}
    assert len(found) == len(docs)
    for row, (n_words, hits) in zip(docs, brute_scan([d.text for d in docs])):
        got, base = found[row.doc_id], [h for h in hits if h[3]]
        starts = [h[0] for h in base]
        assert (got.n_words, got.n_base) == (n_words, len(base))
        assert got.first_word == (min(starts) if starts else None)
        assert got.last_word == (max(starts) if starts else None)
        assert got.base_labels == ",".join(sorted({h[2] for h in base}))
        assert got.labels == ",".join(sorted({h[2] for h in hits}))
        assert abs(got.score - max([h[4] for h in hits], default=0.0)) < 1e-8


def test_repeated_rows_null_keys_and_empty_tables(spark):
    text = "Licensed under CC BY-NC 4.0."
    frame = spark.createDataFrame([(None, text), (1, text), (1, text)], "doc_id long, text string")
    rows = licenses.scan_licenses(frame).collect()
    assert [len(r.hits) for r in rows] == [1, 1, 1]
    assert licenses.scan_licenses(frame.limit(0)).collect() == []


def test_templates_without_their_phrases_are_refused():
    with pytest.raises(ValueError, match="not in the text"):
        Template("x", "some words", ("other words",))
    with pytest.raises(ValueError, match="no key phrase"):
        Template("x", "some words", ())


def test_index_takes_the_rarest_words():
    weights = {w: 1.0 for t in TEMPLATES for w in t.words} | {"the": 0.1, "under": 0.2, "mit": 5.0}
    index = licenses.Index(TEMPLATES, weights)
    postings = index.phrases["under", "the", "mit", "license"]
    assert [(p.word, p.place) for p in postings] == [("mit", 2), ("license", 3), ("under", 0)]
