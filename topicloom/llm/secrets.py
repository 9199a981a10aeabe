"""Secrets in texts: three fixed patterns, and strings that look random to Markov models.

Everything is a DataFrame expression. A pattern's matches and the text between them give the
places of the matches. Further candidates are long runs of letters, digits and a few signs;
they are judged by two Markov models of adjacent characters, one of random strings and one
of ordinary identifiers, by the logarithm of the ratio of their likelihoods. The labelled
samples are what the fixed patterns find (random) and words of letters that are too short
to be candidates (ordinary).

Bounded: the models are trained on about ``MOST_ROWS`` documents for the random strings and
``WORD_ROWS`` for the ordinary ones, chosen by a hash of the text; every document is
searched over its whole text.

Defined cases: a null text counts as empty and has no span. Matches of a pattern do not
overlap; those of different patterns may. A string that lies within a match of a fixed pattern
is not added; one that only overlaps it is judged whole and added beside it. Places count code
points from 0, the end is exclusive. A very long text, run or list of matches costs in proportion
to its length, or nearly so. Spans of equal place go by their kind. Repeated rows are searched
each; null keys and other columns are kept, but for ``base`` and ``spans``, which the results
replace. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in their order, and what each looks for.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Runs that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Words that the model of ordinary identifiers learns from.
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z_-]{6,19}(?![A-Za-z0-9+/_=-])"
#: Documents that the two models are trained on, at most (in expectation).
MOST_ROWS = 20_000
WORD_ROWS = 1_000
#: Least logarithm of the likelihood ratio, natural, that counts as random.
LEAST_RATIO = 12.0
#: Share of the uniform distribution that is mixed into the model of random strings.
UNIFORM = 0.5
#: What the share of a single character weighs against the pairs seen, in pairs.
BACK_OFF = 5.0

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIZE = len(ALPHABET) + 1
_STEPS = 1 << 30
_BLOCK = 256
_SPAN = "array<struct<start: int, kind: int, end: int>>"


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda total, n: total + n)


def _most(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda most, n: F.greatest(most, n))


def _running(
    values: Column, whole: Callable[[Column], Column] = _sum,
    step: Callable[[Column, Column], Column] = lambda total, n: total + n,
) -> Column:
    """``whole`` of the elements before each element, block by block to stay near linear.

    ``step`` adds one element to what is known of those before.
    """
    n = F.size(values)
    heads = F.when(n > 0, F.sequence(F.lit(0), F.ceil(n / _BLOCK).cast("int") - 1)).otherwise(
        F.array().cast("array<int>"))
    parts = F.transform(heads, lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))

    def before(parts: Column) -> Column:
        of_parts = F.transform(parts, whole)

        def within(part: Column, at: Column) -> Column:
            start = whole(F.slice(of_parts, F.lit(1), at))
            first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("all"))
            done = F.aggregate(
                part, first,
                lambda acc, x: F.struct(
                    step(acc["at"], x).alias("at"),
                    F.concat(acc["all"], F.array(acc["at"])).alias("all")),
            )
            return done["all"]

        return F.flatten(F.transform(parts, within))

    # Named once, so that the parts are not cut again for each of them.
    return F.element_at(F.transform(F.array(parts), before), 1)


def _most_before(values: Column) -> Column:
    """The greatest of the elements before each element, at least 0."""
    return _running(values, _most, lambda most, n: F.greatest(most, n))


def _places(found: Column, between: Column, kind: int) -> Column:
    """Spans of matches, from the matches and the texts between them."""
    gaps = F.transform(F.slice(between, F.lit(1), F.size(found)), lambda x: F.length(x))
    sizes = F.transform(found, lambda x: F.length(x))
    moved = _running(F.zip_with(gaps, sizes, lambda g, s: g + s))
    starts = F.zip_with(moved, gaps, lambda at, g: at + g)
    return F.zip_with(
        starts, sizes,
        lambda start, size: F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), (start + size).alias("end")
        ),
    )


def _with_matches(docs: DataFrame, text: str) -> DataFrame:
    """Add ``_spans``, the spans of the fixed patterns, and ``_runs``, those of candidates."""
    value = F.coalesce(F.col(text), F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "run": CANDIDATE}
    found = docs.select(
        "*", *(F.regexp_extract_all(value, F.lit(p), F.lit(0)).alias(f"_{k}")
               for k, p in patterns.items())
    )
    # Only texts with a match are cut.
    cut = found.select(
        "*", *(F.when(F.size(f"_{k}") > 0, F.split(value, p, -1)).alias(f"_{k}_between")
               for k, p in patterns.items()),
        F.when(F.size("_assign") > 0,
               F.regexp_extract_all(value, F.lit(ASSIGN), F.lit(2))).alias("_values"),
    )
    none = F.array().cast(_SPAN)

    def places(name: str, kind: int) -> Column:
        spans = _places(F.col(f"_{name}"), F.col(f"_{name}_between"), kind)
        return F.when(F.size(f"_{name}") > 0, spans).otherwise(none)

    assigned = F.zip_with(
        places("assign", 0), F.coalesce("_values", F.array().cast("array<string>")),
        lambda span, v: F.when(F.length(v) >= ASSIGN_VALUE, span),
    )
    kept = F.filter(assigned, lambda span: span.isNotNull())
    spans = F.array_sort(F.concat(kept, places("access", 1), places("hex", 2)))
    judged = F.zip_with(
        places("run", 3), F.col("_run"),
        lambda span, run: F.struct(span["start"].alias("start"), span["kind"].alias("kind"),
                                   span["end"].alias("end"), run.alias("run")),
    )
    placed = cut.select(*docs.columns, spans.alias("_spans"), judged.alias("_judged"))
    return placed.select(*docs.columns, "_spans", F.when(
        F.size("_judged") > 0, _outside("_judged", "_spans")).otherwise(
            F.col("_judged")).alias("_runs"))


def _outside(runs: str, spans: str) -> Column:
    """The runs that no span holds whole: both lists in one order, then the furthest end so far.

    Where a span and a run begin together the span comes first.
    """
    marked = F.array_sort(F.concat(
        F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
            F.lit("").alias("run"))), F.col(runs)))
    run_kind = KINDS.index("markov")

    def kept(marked: Column) -> Column:
        ends = F.transform(marked, lambda m: F.when(m["kind"] == run_kind, 0).otherwise(m["end"]))
        judged = F.zip_with(marked, _most_before(ends), lambda m, end: F.when(
            (m["kind"] == run_kind) & (m["end"] > end), m))
        return F.filter(judged, lambda m: m.isNotNull())

    return F.element_at(F.transform(F.array(marked), kept), 1)


def _pair_codes(run: Column) -> Column:
    """Pairs (a, b) of the numbers of adjacent characters, by one walk over the string."""
    codes = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), _code)

    def pairs(codes: Column) -> Column:
        return F.zip_with(
            F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0))),
            F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))),
            lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return F.element_at(F.transform(F.array(codes), pairs), 1)


def _wide(text: Column) -> Column:
    """Four bytes per character, so that a piece is found without a walk from the start."""
    return F.encode(text, "UTF-32")


def _piece(wide: Column, start: Column, length: Column) -> Column:
    return F.decode(F.substring(wide, 4 * start + 1, 4 * length), "UTF-32")


@dataclass(frozen=True)
class MarkovModel:
    """Logarithm of the likelihood ratio of each pair of adjacent characters."""

    ratio: list[float]

    def judge(self, run: Column) -> Column:
        """The ratio of a whole string, as a column."""
        table = F.split(F.lit(",".join(f"{x:.6f}" for x in self.ratio)), ",").cast("array<double>")

        return F.aggregate(
            _pair_codes(run), F.lit(0.0),
            lambda total, p: total + F.element_at(table, p["a"] * _SIZE + p["b"] + 1),
        )


def _code(letter: Column) -> Column:
    """Number of a character: 0 for those outside the alphabet."""
    return F.position(letter, F.lit(ALPHABET))


def train_markov(docs: DataFrame, text: str = "text", most_rows: int = MOST_ROWS) -> MarkovModel:
    """Count adjacent characters of random and ordinary strings in a sample of documents."""
    rows = docs.count()

    def sample(most: int) -> DataFrame:
        share = min(_STEPS, _STEPS * most // max(rows, 1))
        return docs.select(F.col(text).alias("text")).where(
            F.pmod(F.xxhash64(F.lit("sample"), text), F.lit(_STEPS)) < share
        )

    chosen = sample(most_rows)
    found = _with_matches(chosen, "text")
    found = found.where(F.size("_spans") > 0).withColumn("_wide", _wide(F.col("text")))
    random = F.transform("_spans", lambda s: F.struct(
        _piece(F.col("_wide"), s["start"], s["end"] - s["start"]).alias("run"),
        F.lit(1).alias("random")))
    # Of an assignment only the value is random.
    random = F.transform(random, lambda r: F.struct(
        F.regexp_extract(r["run"], r"""[A-Za-z0-9+/_.=-]+$""", 0).alias("run"),
        r["random"].alias("random")))
    strings = found.select(F.explode(random).alias("s")).select("s.*")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(ORDINARY), F.lit(0))
    ordinary = sample(min(most_rows, WORD_ROWS)).select(F.explode(words).alias("run"))
    strings = strings.unionByName(ordinary.withColumn("random", F.lit(0)))
    strings = strings.where(F.length("run") > 1)
    pairs = strings.select("random", F.explode(_pair_codes(F.col("run"))).alias("p"))
    # At most two rows per pair of characters of the alphabet.
    counts = {
        (row.random, row.a, row.b): row.n
        for row in pairs.groupBy("random", "p.a", "p.b").agg(F.count("*").alias("n")).collect()
    }
    return MarkovModel(_log_ratios(counts))


def _log_ratios(counts: dict[tuple[int, int, int], int]) -> list[float]:
    """Pairs that were not seen count by their second character, then all alike."""
    single = {k: [1.0] * _SIZE for k in (0, 1)}
    for (k, _, b), n in counts.items():
        single[k][b] += n
    share = {k: [n / sum(row) for n in row] for k, row in single.items()}
    out = []
    for a in range(_SIZE):
        total = [sum(counts.get((k, a, b), 0) for b in range(_SIZE)) for k in (0, 1)]
        for b in range(_SIZE):
            ordinary, random = ((counts.get((k, a, b), 0) + BACK_OFF * share[k][b])
                                / (total[k] + BACK_OFF) for k in (0, 1))
            random = (1 - UNIFORM) * random + UNIFORM / _SIZE
            out.append(math.log(random / ordinary))
    return out


def find_secrets(
    docs: DataFrame, model: MarkovModel, text: str = "text", least_ratio: float = LEAST_RATIO
) -> DataFrame:
    """Add ``base`` and ``spans``: arrays of (start, kind, end) in order.

    ``base`` has the matches of the fixed patterns, ``spans`` also the random strings;
    ``kind`` is the place in ``KINDS``.
    """
    docs = docs.drop("base", "spans")
    found = _with_matches(docs, text)
    random = F.filter("_runs", lambda r: model.judge(r["run"]) >= least_ratio)
    added = F.transform(random, lambda r: F.struct(
        r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")))
    spans = F.when(F.size("_runs") > 0, F.array_sort(F.concat("_spans", added))).otherwise(
        F.col("_spans"))
    return found.select(*docs.columns, F.col("_spans").alias("base"), spans.alias("spans"))


def span_names(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
            s["end"].cast("string"))),
        ",",
    )


def redact(docs: DataFrame, found_spans: str = "spans", text: str = "text") -> DataFrame:
    """Replace every span by ``[secret]``; overlapping spans become one."""
    value = F.col(text)
    ends = F.transform(found_spans, lambda s: s["end"])

    def pieces(wide: Column) -> Column:
        before = F.zip_with(found_spans, _most_before(ends), lambda s, at: F.when(
            s["start"] >= at,
            F.concat(_piece(wide, at, s["start"] - at), F.lit("[secret]"))).otherwise(F.lit("")))
        last = _piece(wide, _most(ends), F.length(wide))
        return F.array_join(F.concat(before, F.array(last)), "")

    joined = F.element_at(F.transform(F.array(_wide(value)), pieces), 1)
    return docs.withColumn(text, F.when(F.size(found_spans) > 0, joined).otherwise(value))
