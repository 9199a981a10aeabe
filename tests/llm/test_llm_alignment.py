"""Alignment of two tokenizers, against whole texts aligned in plain Python."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from topicloom.llm import queries, token_alignment  # noqa: E402, F401
from topicloom.llm.registry import QUERIES  # noqa: E402

A_FILE = public_tokenizers.path("byte_bpe_50k.json")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


def whole_alignment(rows):
    """(key, text) rows to result rows, each text encoded as a whole."""
    tool = token_alignment.Aligner(A_FILE, B_FILE)
    out, docs_of, held = [], Counter(), []
    for key, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            a = tool.byte_level.encode(" " + text, add_special_tokens=False).ids
            b = tool.pieces.encode(text)
            spelled_a = [tool.spelled_a[i] for i in a]
            spelled_b = [tool.spelled_b[i] for i in b]
            whole = (" " + text).encode()
            if b"".join(spelled_a) != whole or b"".join(spelled_b) != whole:
                a, b = [], []
        if a:
            ends_a = np.cumsum([len(x) for x in spelled_a])
            ends_b = np.cumsum([len(x) for x in spelled_b])
            starts_a = ends_a - [len(x) for x in spelled_a]
            starts_b = ends_b - [len(x) for x in spelled_b]
            for i in range(len(a)):
                low = np.searchsorted(ends_b, starts_a[i], side="right")
                high = np.searchsorted(starts_b, ends_a[i], side="left")
                links += [(a[i], b[j]) for j in range(low, high)]
            i = j = 0
            for cut in np.intersect1d(ends_a, ends_b):
                x, y = np.searchsorted(ends_a, cut) + 1, np.searchsorted(ends_b, cut) + 1
                groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
                i, j = x, y
        held.append(links)
        docs_of.update(set(links))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append([key, len(a), len(b), len(groups), len(links), digest])
    best = defaultdict(int)
    for (x, _), n in docs_of.items():
        best[x] = max(best[x], n)
    return [
        (key, n_a, n_b, n_groups, n_links, sum(docs_of[p] == best[p[0]] for p in links),
         sum(docs_of[p] for p in links), digest)
        for (key, n_a, n_b, n_groups, n_links, digest), links in zip(out, held)
    ], docs_of, best


def as_rows(df):
    return sorted((tuple(r[c] for c in (
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
        for r in df.collect()), key=repr)


EDGES = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "a▁b"), (6, "word  word"),
    (7, "x　 y   z\u0085 w"), (8, "<|endoftext|> <s> </s> <unk>"), (9, "tab\t end\r\n  x"),
    (10, "it's we'll 12345 !!! ..."), (11, "été à Zürich 東京 😀😀 кириллица"), (12, "́ x \x00 y"),
    (13, "same text here"), (13, "same text here"), (None, "same text here"),
    (14, "ab" * 6000 + " end"), (15, "the cat " * 9000), (16, "\n\nfoo  \n bar   "),
    (17, "à à   b  c  d"),
]


def test_edges_like_whole_texts(spark):
    docs = spark.createDataFrame(
        [(k, t, "x", 1, 2, "y") for k, t in EDGES],
        "doc_id long, text string, bits string, part int, slot int, n_docs string")
    found = token_alignment.align_tokens(docs, A_FILE, B_FILE)
    rows, docs_of, best = whole_alignment(EDGES)
    assert as_rows(found.documents) == sorted(rows, key=repr)
    pairs = {(r.a, r.b): (r.n_docs, r.best) for r in found.pairs.collect()}
    assert pairs == {p: (n, n == best[p[0]]) for p, n in docs_of.items()}


def test_query_like_whole_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows, _, _ = whole_alignment([tuple(r) for r in docs])
    found = QUERIES["op11_cross_tokenizer_alignment"](spark, SMALL)
    assert as_rows(found) == sorted(rows, key=repr)


def test_small_blocks_and_bit_strings(spark, monkeypatch):
    texts = [(n, f"the word{n % 7} of the day") for n in range(300)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    rows, _, _ = whole_alignment(texts)
    assert as_rows(token_alignment.align_tokens(frame, A_FILE, B_FILE).documents) == sorted(
        rows, key=repr)
    slots = np.concatenate([np.arange(0, 9000, 2), np.array([1, 5])]).astype(np.uint16)
    ends = np.array([0, 4500, 4502])
    column = token_alignment.bitmaps(slots, ends)
    assert len(column[0].as_py()) == token_alignment.BLOCK_DOCS // 8
    back, sizes = token_alignment.read_bitmaps(column)
    assert (back == slots).all() and sizes.tolist() == [4500, 2]


def test_block_of_links_is_closed():
    block = token_alignment.Block()
    block.add(np.array([5, 3, 5]), np.array([1, 0, 1]), np.array([1, 1, 2]))
    block.add(np.array([3]), np.array([2]), np.array([2]))
    planes = [[x.tolist() if hasattr(x, "tolist") else x for x in p] for p in block.planes()]
    # Pair 3: one link in document 0, two in 2; pair 5: three in document 1.
    assert planes == [[[3, 5], 0, [2, 1], [0, 1], [0, 1, 2]], [[3, 5], 1, [0, 0], [2, 1], [0, 1, 2]]]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    found = token_alignment.align_tokens(none, A_FILE, B_FILE)
    assert found.documents.collect() == [] and found.pairs.collect() == []
