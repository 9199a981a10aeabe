"""Visible text of an HTML page as one Column expression."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions.arrays import computed_once

# Parts without visible text. An unclosed part runs to the end of the page.
HIDDEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script\b.*?(?:</script\s*>|\z)"
    r"|<style\b.*?(?:</style\s*>|\z)"
)

# Elements that separate words (block elements of HTML, and br).
_SEPARATING = (
    "html|head|body|title|meta|link|base|frameset|frame|noframes|noscript|template"
    "|section|nav|aside|hgroup|header|footer|main|article|address"
    "|h1|h2|h3|h4|h5|h6|p|ul|ol|dl|dt|dd|li|menu|pre|div|blockquote|center|hr|br"
    "|figure|figcaption|form|fieldset|legend|details|summary|dialog"
    "|table|caption|thead|tfoot|tbody|colgroup|col|tr|th|td"
    "|ins|del|video|audio|canvas|svg|math|plaintext"
)


def _by_first_letter(names: str) -> str:
    """The same names as a pattern that tries those of one first letter only.

    What follows the pattern tells where a name ends, so their order is of no matter.
    """
    rest: dict[str, list[str]] = {}
    for name in names.split("|"):
        rest.setdefault(name[0], []).append(name[1:])
    return "|".join(f"{first}(?:{'|'.join(ends)})" for first, ends in rest.items())


# Up to the closing bracket; a bracket inside a quoted attribute value does not close.
_TAG_REST = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>"""
SEPARATING_TAG = rf"(?i)</?(?:{_by_first_letter(_SEPARATING)})(?=[\s/>]){_TAG_REST}|<[!?][^>]*+>"
# A tag that the page ends in is no text either.
OTHER_TAG = rf"</?[a-zA-Z]{_TAG_REST}|</?[a-zA-Z][^>]*+\z"

# Old names are entities without the semicolon, too; the longest one counts.
_BARE = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
ENTITY = (
    r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*(?=;)|" + "|".join(_BARE) + r");?+"
)

# White space that is not one space already.
_SPACES = r"[\t\n\f\r][ \t\n\f\r]*+| [ \t\n\f\r]++"

OLD_NAME = "^(" + "|".join(_BARE) + ")"

# Often used names come first because the lookup scans in order.
_FREQUENT = ["nbsp", "amp", "quot", "lt", "gt", "copy", "middot", "raquo", "laquo", "ndash",
             "mdash", "rsquo", "lsquo", "rdquo", "ldquo", "hellip", "bull", "reg", "apos"]


def entity_names() -> dict[str, str]:
    """Name to text for all named entities of HTML, from the Python standard library."""
    table = {n.rstrip(";"): t for n, t in html.entities.html5.items() if n.endswith(";")}
    return {**{n: table[n] for n in _FREQUENT}, **table}


def _entity_table() -> Column:
    return F.from_json(F.lit(json.dumps(entity_names())), "map<string,string>")


def _code_point(number: Column) -> Column:
    """The character of a code point, through its four UTF-32 bytes."""
    hexed = F.lpad(F.hex(number), 8, "0")
    valid = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number <= 0x10FFFF))
    return F.when(valid, F.decode(F.unhex(hexed), "UTF-32")).otherwise(F.lit("�"))


def _decode_entity(entity: Column) -> Column:
    """The text of an entity; frequent ones are compared before anything is parsed."""
    decoded, names = _decode_parsed(entity), entity_names()
    return F.coalesce(*[F.when(entity == f"&{n};", F.lit(names[n])) for n in _FREQUENT], decoded)


def _decode_parsed(entity: Column) -> Column:
    name = F.regexp_extract(entity, ENTITY, 1)
    digits = F.regexp_extract(name, "^#([0-9]+)$", 1)
    hexits = F.regexp_extract(name, "^#[xX]([0-9a-fA-F]+)$", 1)
    known = F.element_at(_entity_table(), name)
    # An unknown name may begin with an old one.
    old = F.regexp_extract(name, OLD_NAME, 1)
    begun = F.concat(F.element_at(_entity_table(), old), F.substring(entity, F.length(old) + 2,
                                                                     F.length(entity)))
    named = F.coalesce(known, F.when(old != "", begun), entity)
    return (
        F.when(digits != "", _code_point(digits.try_cast("long")))
        .when(hexits != "", _code_point(F.conv(hexits, 16, 10).try_cast("long")))
        .otherwise(named)
    )


def decode_entities(text: Column) -> Column:
    """Decode named and numeric entities in one pass: ``&amp;lt;`` becomes ``&lt;``."""
    between = F.split(text, ENTITY)
    entities = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    decoded = F.transform(entities, _decode_entity)
    joined = F.array_join(
        F.zip_with(between, decoded, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def html_to_text(page: Column) -> Column:
    """Title and body text of a page, white space collapsed.

    Separating elements become a space, other elements vanish without one. U+00A0 is
    text, not white space, and stays.
    """
    visible = F.regexp_replace(page, HIDDEN, "")
    spaced = F.regexp_replace(visible, SEPARATING_TAG, " ")
    plain = F.regexp_replace(spaced, OTHER_TAG, "")
    decoded = computed_once(plain, decode_entities)
    return F.trim(F.regexp_replace(decoded, _SPACES, " "))
