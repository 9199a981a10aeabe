"""Toxicity: misspelled terms of a learned lexicon, weighed by the window they stand in.

The lexicon is learned from labelled texts: words that stand in toxic texts, between ever
different words, far more often than chance allows. An automaton finds the terms in a text,
misspelled ones included. How much a match says is the smoothed share of toxic texts among the labelled ones
with such a match, for each term and number of edits. The window of words around a match
tells quotation (quotation marks on both sides, words of saying) from abuse (second person);
the weight of these signs is learned from the same matches, from a starting value.

Bounded: lexicon and weights come from about ``MOST_ROWS`` labelled documents, chosen by a
hash of the key; every document is scored over its whole text.

Defined cases: a null or empty text has no match and gets the score of texts without any.
Without a toxic labelled text the lexicon is empty and all scores are that share. Repeated
rows are scored each; a null key is kept. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.blocks import blocks
from topicloom.llm.labelled import labelled_sample
from topicloom.llm.spelling import SpellingTable, allowed_edits, spelling_table
from topicloom.llm.store import Scratch

#: Bytes of text that are taken apart at once: scoring, and learning the lexicon.
SCORE_BYTES = 512 << 10
LEARN_BYTES = 256 << 10
#: Labelled documents to learn from, at most (in expectation).
MOST_ROWS = 20_000
#: Chance that any word at all becomes a term by accident.
CHANCE = 0.01
#: Least score that counts as toxic.
THRESHOLD = 0.3
#: Words on each side of a match that make its window.
WINDOW = 6
#: Starting values: share of toxic texts for a match with so many edits, and their weight.
EDIT_SHARE = (0.9, 0.6, 0.4)
#: The same where an ordinary word comes as close to the term.
CROWDED_SHARE = 0.1
SHARE_WEIGHT = 2.0
#: Starting values: logarithmic odds of the signs in a window, and their weight.
SIGN_ODDS = {"quoted": -2.0, "said": -1.0, "addressed": 0.5}
SIGN_WEIGHT = 10.0

_QUOTES = [ord(c) for c in "\"“”„«»‹›"]
_SAID = frozenset((
    "said says say wrote writes quoted quote quotes called calls word term reported claimed "
    "sagte sagt schrieb wort dit disait mot dijo dice palabra"
).split())
_YOU = frozenset("you your yours u ur du dich dir dein ihr tu te toi ton vous votre tú usted".split())


def _char_tables() -> tuple[np.ndarray, np.ndarray]:
    """(characters inside words, characters a word may start or end with), below 0x300."""
    inside, core = np.ones(0x300, dtype=bool), np.ones(0x300, dtype=bool)
    for code in range(0x300):
        c = chr(code)
        core[code] = c.isalnum()
        inside[code] = core[code] or c in "*@$!#%&'-_+"
    return inside, core


_INSIDE, _CORE = _char_tables()


@dataclass(frozen=True)
class Tokens:
    """Lower-case words of a block: character codes, ranges, first word of each text."""

    text: str
    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    quotes: np.ndarray
    bounds: np.ndarray

    def word(self, at: int) -> str:
        return self.text[self.starts[at]:self.ends[at]]


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Words of the texts of a block; signs at their ends do not belong to them."""
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace").replace("\0", " ").lower()
             for a, b in zip(offsets[:-1], offsets[1:])]
    text = "\0".join(texts)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    small = np.minimum(codes, 0x2FF)
    wide = (codes >= 0x300) & ~((codes >= 0x2000) & (codes <= 0x206F)) & (codes != 0x3000)
    inside = np.where(codes < 0x300, _INSIDE[small], wide)
    core = np.where(codes < 0x300, _CORE[small], wide)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cores = np.flatnonzero(core)
    if len(cores):
        low = np.searchsorted(cores, starts)
        high = np.searchsorted(cores, ends) - 1
        some = high >= low
        starts, ends = cores[low[some]], cores[high[some]] + 1
    else:
        starts = ends = np.empty(0, dtype=np.int64)
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return Tokens(text, codes, starts, ends, np.searchsorted(starts, bounds),
                  np.flatnonzero(np.isin(codes, _QUOTES)), bounds)


def signs_of(tokens: Tokens, at: int, low: int, high: int, begin: int, end: int) -> list[str]:
    """Signs in the window around word ``at`` of a text with words [low, high)."""
    first, last = max(at - WINDOW, low), min(at + WINDOW + 1, high)
    around = [tokens.word(i) for i in range(first, last) if i != at]
    left = max(tokens.starts[first] - 2, begin)
    right = min(tokens.ends[last - 1] + 2, end)
    q = tokens.quotes
    before = np.searchsorted(q, tokens.starts[at]) - np.searchsorted(q, left)
    after = np.searchsorted(q, right) - np.searchsorted(q, tokens.ends[at])
    # An odd number of marks before the word means that a quotation is open.
    opened = (np.searchsorted(q, tokens.starts[at]) - np.searchsorted(q, begin)) % 2 == 1
    signs = ["quoted"] if opened and before and after else []
    if any(w in _SAID for w in around):
        signs.append("said")
    if any(w in _YOU for w in around):
        signs.append("addressed")
    return signs


@dataclass(frozen=True)
class ToxicityModel:
    """Lexicon, odds of a match by (term, edits), odds of signs, score without a match."""

    table: SpellingTable
    odds: dict[tuple[int, int], float]
    sign_odds: dict[str, float]
    base: float

    def match_score(self, term: int, edits: int, signs: list[str]) -> float:
        odds = self.odds[term, edits] + sum(self.sign_odds[s] for s in signs)
        return 1 / (1 + np.exp(-odds))


def _log_odds(share: float) -> float:
    return float(np.log(share / (1 - share)))


def _matches(tokens: Tokens, table: SpellingTable):
    """Yield (text, list of (word, term, edits, signs)) for texts with a match."""
    token, term, edits = table.read(tokens.codes, tokens.starts, tokens.ends)
    doc = np.searchsorted(tokens.first, token, side="right") - 1
    found = defaultdict(list)
    for w, t, e, d in zip(token.tolist(), term.tolist(), edits.tolist(), doc.tolist()):
        signs = signs_of(tokens, w, int(tokens.first[d]), int(tokens.first[d + 1]),
                         int(tokens.bounds[d]), int(tokens.bounds[d + 1]) - 1)
        found[d].append((w, t, e, signs))
    yield from found.items()


def learn_lexicon(
    sample: DataFrame, scratch: Scratch
) -> tuple[SpellingTable, set[tuple[int, int]]]:
    """The table of all words of a stored sample (text, label) that mark its toxic texts.

    Also the (term, edits) by which an ordinary word of the other texts comes close to one.

    A word is counted by the different pairs of neighbours it has in toxic and in other
    texts, so copies of a text add nothing. It is a term if it has more of them in toxic
    texts, and so many more than the share of toxic text lets expect that not even one of
    all words would by chance.
    """

    def run(batches):
        for rows, data, offsets in blocks(batches, "text", LEARN_BYTES):
            tokens = tokens_of(data, offsets)
            words = [tokens.word(i) for i in range(len(tokens.starts))]
            found = [[{"word": words[i],
                       "near": f"{words[i - 1] if i > a else ''} "
                               f"{words[i + 1] if i + 1 < b else ''}"}
                      for i in range(a, b)]
                     for a, b in zip(tokens.first[:-1].tolist(), tokens.first[1:].tolist())]
            kind = pa.list_(pa.struct([("word", pa.string()), ("near", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, kind), rows.column("label")], names=["words", "label"]
            )

    words = sample.select("text", "label").mapInArrow(
        run, "words array<struct<word: string, near: string>>, label int"
    ).select(F.explode("words").alias("w"), "label").select("w.word", F.xxhash64("w.near").alias(
        "near"), "label").distinct()
    counts = scratch.keep(words.groupBy("word").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other")
    ), "sample-words")
    total = counts.agg(
        F.count("*").alias("words"), F.sum("toxic").alias("toxic"), F.sum("other").alias("other")
    ).first()
    if not total.toxic or not total.other:
        return spelling_table([]), set()
    base = total.toxic / (total.toxic + total.other)
    least = float(np.log(total.words / CHANCE))
    n = F.col("toxic") + F.col("other")
    share = F.col("toxic") / n
    # Chernoff bound of the chance to see such a share.
    odd = n * (
        share * F.log(share / base)
        + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    )
    marked = counts.where((F.col("toxic") > F.col("other")) & (F.length("word") > 1))
    # Every word that passes is a term; the sample bounds how many there can be.
    table = spelling_table([row.word for row in marked.where(odd > least).collect()])
    return table, _crowded(counts.where("other > 0").select("word"), table)


def _crowded(words: DataFrame, table: SpellingTable) -> set[tuple[int, int]]:
    """(term, edits) that some word of other texts is as close to."""
    shared = words.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table, seen = shared.value, set()
        for _, data, offsets in blocks(batches, "word", SCORE_BYTES):
            tokens = tokens_of(data, offsets)
            _, term, edits = table.read(tokens.codes, tokens.starts, tokens.ends)
            seen.update(zip(term.tolist(), edits.tolist()))
        pairs = sorted(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in pairs], pa.int32()),
             pa.array([e for _, e in pairs], pa.int32())], names=["term", "edits"],
        )

    found = words.mapInArrow(run, "term int, edits int").distinct().collect()
    return {(row.term, row.edits) for row in found}


def fit_toxicity(
    sample: DataFrame, table: SpellingTable, crowded: set[tuple[int, int]]
) -> ToxicityModel:
    """Learn the weights of matches on a bounded sample (text, label)."""
    terms = table.terms
    shared = sample.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table = shared.value
        for rows, data, offsets in blocks(batches, "text", SCORE_BYTES):
            tokens = tokens_of(data, offsets)
            found = dict(_matches(tokens, table))
            # What an edited match says is learned from texts without an exact one.
            out = []
            for d in range(len(rows)):
                exact = any(e == 0 for _, _, e, _ in found.get(d, []))
                out.append(sorted({f"{t}:{e}:{'+'.join(s)}" for _, t, e, s in found.get(d, [])
                                   if e == 0 or not exact}))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.list_(pa.string())), rows.column("label")],
                names=["found", "label"],
            )

    rows = sample.select("text", "label").mapInArrow(run, "found array<string>, label int")
    kinds = rows.groupBy("found").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other")
    ).collect()
    base = [1.0, 20.0]
    seen: dict[tuple[int, int], list[float]] = defaultdict(lambda: [0.0, 0.0])
    signs: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    total = [0.0, 0.0]
    for row in kinds:
        counts = (row.toxic, row.other)
        if not row.found:
            base = [b + c for b, c in zip(base, counts)]
        for match in row.found:
            term, edits, here = match.split(":")
            pair = seen[int(term), int(edits)]
            for i in (0, 1):
                pair[i] += counts[i]
                total[i] += counts[i]
            for sign in filter(None, here.split("+")):
                signs[sign][0] += row.toxic
                signs[sign][1] += row.other
    odds = {}
    pairs = [(t, e) for t in range(len(terms)) for e in range(allowed_edits(terms[t]) + 1)]
    for term, edits in pairs:
        yes, no = seen[term, edits]
        near = edits > 0 and (term, edits) in crowded
        prior = CROWDED_SHARE if near else EDIT_SHARE[edits]
        odds[term, edits] = _log_odds(
            (yes + SHARE_WEIGHT * prior) / (yes + no + SHARE_WEIGHT)
        )
    sign_odds = {}
    for sign, start in SIGN_ODDS.items():
        yes, no = signs[sign]
        ratio = np.log((yes + 1) / (total[0] + 2)) - np.log((no + 1) / (total[1] + 2))
        share = min(yes, no) / (min(yes, no) + SIGN_WEIGHT)
        sign_odds[sign] = float((1 - share) * start + share * ratio)
    return ToxicityModel(table, odds, sign_odds, base[0] / sum(base))


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(key, score, matches) per document, with the columns ``keep`` of its row after the key.

    The score is that of the worst match, joined with that of texts without any. ``matches``
    has the term, the word as found, its number in the text, the edits and the signs.
    """
    # Its size follows from the lexicon.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = list(dict.fromkeys([key, *keep]))
    match = "struct<term: string, found: string, word: int, edits: int, signs: array<string>>"

    def run(batches):
        model = shared.value
        kind = pa.list_(pa.struct([
            ("term", pa.string()), ("found", pa.string()), ("word", pa.int32()),
            ("edits", pa.int32()), ("signs", pa.list_(pa.string())),
        ]))
        for rows, data, offsets in blocks(batches, text, SCORE_BYTES):
            tokens = tokens_of(data, offsets)
            scores = np.full(len(rows), model.base)
            matches: list[list[dict]] = [[] for _ in range(len(rows))]
            for d, found in _matches(tokens, model.table):
                worst = max(model.match_score(t, e, s) for _, t, e, s in found)
                scores[d] = 1 - (1 - model.base) * (1 - worst)
                matches[d] = [
                    {"term": model.table.terms[t], "found": tokens.word(w),
                     "word": int(w - tokens.first[d]), "edits": e, "signs": s}
                    for w, t, e, s in found
                ]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(k) for k in kept), pa.array(scores), pa.array(matches, kind)],
                names=[*kept, "score", "matches"],
            )

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in kept)
    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(
        run, f"{kinds}, score double, matches array<{match}>"
    )


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most_rows: int = MOST_ROWS,
    threshold: float = THRESHOLD,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(key, held_out, score, predicted, matches); ``held_out`` rows are not learned from.

    The columns ``keep`` of each row come along, after the key.
    """
    scratch = Scratch(docs.sparkSession)
    sample = scratch.keep(
        labelled_sample(docs, labels, key, text, label, ~held_out, most_rows), "toxicity-sample"
    )
    model = fit_toxicity(sample, *learn_lexicon(sample, scratch))
    scratch.clear()
    return score_toxicity(docs, model, key, text, keep).select(
        *dict.fromkeys([key, *keep]), held_out.alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "matches",
    )
