"""Word level text cleaning."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Site markers that are blanked out, tried in this order.
SITE_MARKERS = r"\.net|\.com|www\.|\.org|\.gov|\.co\.uk|\.uk"

# English stop words ("yo" is in the list, "you" is not). The single
# letters a to z are added by rule.
_ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "yo", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers",
    "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now", "d",
    "ll", "m", "o", "re", "ve", "y", "ain", "aren", "couldn", "didn", "doesn", "hadn",
    "hasn", "haven", "isn", "ma", "mightn", "mustn", "needn", "shan", "shouldn", "wasn",
    "weren", "won", "wouldn",
]
STOP_WORDS = sorted(set(_ENGLISH_STOP_WORDS) | set(string.ascii_lowercase))

# A run of capitals that does not run into a lower-case letter, or a word with at most
# one leading capital. Everything that is not an ASCII letter separates.
WORD_PIECE = "[A-Z]+(?![a-z])|[A-Z]?[a-z]+"


def remove_site_markers(text: Column) -> Column:
    """Blank out site markers, also inside words; case-sensitive.

    The look-ahead rejects most positions with one comparison instead of seven.
    """
    return F.regexp_replace(text, f"(?=[.w])(?:{SITE_MARKERS})", " ")


def letters_only(text: Column) -> Column:
    """Replace every character but ASCII letters by a space."""
    return F.regexp_replace(text, "[^a-zA-Z]", " ")


def split_words(text: Column) -> Column:
    """Split on white space, without empty words."""
    return F.filter(F.split(text, r"\s+"), lambda word: word != "")


def split_camel_case(words: Column) -> Column:
    """Split each word of letters at its case changes: fooBar -> foo, Bar."""
    return F.flatten(
        F.transform(words, lambda word: F.regexp_extract_all(word, F.lit(WORD_PIECE), F.lit(0)))
    )


def lowercase(words: Column) -> Column:
    return F.transform(words, F.lower)


def clean_tokens(text: Column) -> Column:
    """Markers off, letters only, words, case changes split, lower case.

    The same result as chaining the five functions above. One expression finds the
    pieces directly, so the text is read twice instead of five times.
    """
    pieces = F.regexp_extract_all(remove_site_markers(text), F.lit(WORD_PIECE), F.lit(0))
    return lowercase(pieces)


def remove_stopwords(words: Column) -> Column:
    """Drop stop words and single letters; repeated other words stay repeated."""
    return F.filter(words, lambda word: ~word.isin(STOP_WORDS))


def trim_line(line: Column) -> Column:
    """Strip white space at both ends of a line."""
    return F.regexp_replace(line, r"^\s+|\s+$", "")
