"""The Column functions as SQL functions, and topics of pages as a table function.

``register_sql`` makes them temporary functions of a session; plain SQL over temp views then
does what the DataFrame operators do. All of them are SQL functions: the optimizer sees their
bodies and puts them into the query, nothing is called per row.

| Function | Column form |
|---|---|
| ``visible_text(page)`` | ``html_to_text`` |
| ``clean_tokens(text)`` | ``clean_tokens`` |
| ``without_stopwords(words)`` | ``remove_stopwords`` |
| ``split_categories(categories)`` | ``split_categories`` |
| ``has_prefix(category, prefixes)`` | any of the prefixes, after one leading ``Top/`` |
| ``rule_match(category, includes, excludes)`` | ``rule_match`` |
| ``host_of(uri)``, ``is_english_host(uri)`` | the same |
| ``pad_post``, ``fit_post``, ``pad_pre`` ``(ids, length)`` | the same |
| ``one_hot(idx, size)`` | ``one_hot`` |
| ``top2_labels(scores, labels)`` | ``top_labels`` |
| ``category_topics()``, a table | ``category_topics`` over views ``topic_pages_in``, ``topic_rules`` |
| ``page_topics()``, a table | ``map_to_topics`` over the same views |
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from topicloom.functions import html, text, urls

#: Views that the table functions read: pages with ``uri`` and ``categories``, and rules.
PAGES_VIEW = "topic_pages_in"
RULES_VIEW = "topic_rules"


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _decoded(entity: str) -> str:
    """SQL for the text of one entity, as ``html.decode_entities`` has it."""
    names = f"from_json({quoted(json.dumps(html.entity_names()))}, 'map<string,string>')"
    name = f"regexp_extract({entity}, {quoted(html.ENTITY)}, 1)"
    old = f"regexp_extract({name}, {quoted(html.OLD_NAME)}, 1)"

    def code(number: str) -> str:
        return (f"if(({number} > 0 and {number} < 55296) or ({number} > 57343 and "
                f"{number} <= 1114111), decode(unhex(lpad(hex({number}), 8, '0')), 'UTF-32'), '�')")

    digits = f"regexp_extract({name}, '^#([0-9]+)$', 1)"
    hexits = f"regexp_extract({name}, '^#[xX]([0-9a-fA-F]+)$', 1)"
    return f"""CASE WHEN {digits} <> '' THEN {code(f"try_cast({digits} AS BIGINT)")}
      WHEN {hexits} <> '' THEN {code(f"try_cast(conv({hexits}, 16, 10) AS BIGINT)")}
      ELSE coalesce(element_at({names}, {name}),
        if({old} <> '', concat(element_at({names}, {old}),
          substring({entity}, length({old}) + 2)), NULL), {entity}) END"""


def _scalar_functions() -> dict[str, str]:
    """Signature to body."""
    plain = "page"
    for pattern, put in ((html.HIDDEN, ""), (html.SEPARATING_TAG, " "), (html.OTHER_TAG, "")):
        plain = f"regexp_replace({plain}, {quoted(pattern)}, '{put}')"
    entity = quoted(html.ENTITY)
    joined = f"""array_join(zip_with(split(t, {entity}),
      transform(regexp_extract_all(t, {entity}, 0), e -> {_decoded("e")}),
      (a, b) -> concat(a, coalesce(b, ''))), '')"""
    decoded = f"element_at(transform(array({plain}), t -> if(contains(t, '&'), {joined}, t)), 1)"
    piece = quoted(text.WORD_PIECE)
    markers = quoted(f"(?=[.w])(?:{text.SITE_MARKERS})")
    stop_words = ", ".join(map(quoted, text.STOP_WORDS))
    zeros = "array_repeat(0, {})"
    return {
        "visible_text(page STRING) RETURNS STRING":
            f"trim(regexp_replace({decoded}, '[ \\\\t\\\\n\\\\f\\\\r]+', ' '))",
        "clean_tokens(text STRING) RETURNS ARRAY<STRING>":
            f"transform(regexp_extract_all(regexp_replace(text, {markers}, ' '), {piece}, 0), "
            "w -> lower(w))",
        "without_stopwords(words ARRAY<STRING>) RETURNS ARRAY<STRING>":
            f"filter(words, w -> w NOT IN ({stop_words}))",
        "split_categories(categories STRING) RETURNS ARRAY<STRING>":
            r"if(regexp_replace(categories, '\\|+$', '') = '' AND categories <> '', "
            r"CAST(array() AS ARRAY<STRING>), split(regexp_replace(categories, '\\|+$', ''), '\\|'))",
        "has_prefix(category STRING, prefixes ARRAY<STRING>) RETURNS BOOLEAN":
            "exists(prefixes, p -> startswith(regexp_replace(category, '^Top/', ''), p))",
        "rule_match(category STRING, includes ARRAY<STRING>, excludes ARRAY<STRING>) "
        "RETURNS BOOLEAN":
            "has_prefix(category, includes) AND NOT has_prefix(category, excludes)",
        "host_of(uri STRING) RETURNS STRING": "try_parse_url(uri, 'HOST')",
        "is_english_host(uri STRING) RETURNS BOOLEAN":
            f"coalesce(rlike(host_of(uri), {quoted(urls.ENGLISH_HOST_PARTS)}), false)",
        "pad_post(ids ARRAY<INT>, length INT) RETURNS ARRAY<INT>":
            f"concat(ids, {zeros.format('greatest(length - size(ids), 0)')})",
        "fit_post(ids ARRAY<INT>, length INT) RETURNS ARRAY<INT>":
            f"slice(concat(ids, {zeros.format('length')}), 1, length)",
        "pad_pre(ids ARRAY<INT>, length INT) RETURNS ARRAY<INT>":
            f"slice(concat({zeros.format('length')}, ids), -length, length)",
        "one_hot(idx INT, size INT) RETURNS ARRAY<INT>":
            "if(size = 0, CAST(array() AS ARRAY<INT>), "
            "transform(sequence(0, size - 1), i -> CAST(i = idx AS INT)))",
        "top2_labels(scores ARRAY<FLOAT>, labels ARRAY<STRING>) RETURNS ARRAY<STRING>":
            "transform(slice(reverse(array_sort(transform("
            "slice(scores, 1, least(size(scores), size(labels))), "
            "(s, i) -> struct(s AS s, i AS i)))), 1, 2), x -> element_at(labels, x.i + 1))",
    }


# A category is cut at each length that a prefix has and meets the prefixes by equality.
_CATEGORY_TOPICS = f"""WITH numbered AS (
    SELECT monotonically_increasing_id() AS rule, name, includes, excludes FROM {RULES_VIEW}),
  prefixes AS (
    SELECT rule, name, p.prefix, p.inc FROM (SELECT rule, name, explode(concat(
      transform(includes, x -> struct(x AS prefix, 1 AS inc)),
      transform(excludes, x -> struct(x AS prefix, 0 AS inc)))) AS p FROM numbered)),
  paths AS (
    SELECT category, regexp_replace(category, '^Top/', '') AS path
    FROM (SELECT DISTINCT explode(categories) AS category FROM {PAGES_VIEW})),
  lengths AS (SELECT collect_set(length(prefix)) AS all_lengths FROM prefixes),
  cuts AS (
    SELECT category, left(path, n) AS prefix FROM (SELECT category, path, explode(
      (SELECT all_lengths FROM lengths)) AS n FROM paths) WHERE n <= length(path))
  SELECT category, name FROM cuts JOIN prefixes USING (prefix)
  GROUP BY category, rule, name HAVING min(inc) = 1"""

_TABLE_FUNCTIONS = {
    "category_topics() RETURNS TABLE(category STRING, topic STRING)": _CATEGORY_TOPICS,
    "page_topics() RETURNS TABLE(uri STRING, topic STRING, category STRING)":
        "SELECT p.uri, t.topic, p.category "
        f"FROM (SELECT uri, explode(categories) AS category FROM {PAGES_VIEW}) p "
        "JOIN category_topics() t ON p.category = t.category",
}


def register_sql(spark: SparkSession, tables: bool = True) -> None:
    """Make the functions known to a session.

    The table functions are bound to the two views when they are made; without ``tables``
    the views need not be there.
    """
    made = dict(_scalar_functions(), **(_TABLE_FUNCTIONS if tables else {}))
    for signature, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
