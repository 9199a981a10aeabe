"""SQL functions must give what the Column functions give."""

import pytest
from pyspark.sql import functions as F

from topicloom.functions import arrays, categories, html, text, urls
from topicloom.functions.sql import PAGES_VIEW, RULES_VIEW, quoted, register_sql
from topicloom.operators.scoring import top_labels
from topicloom.operators.taxonomy import map_to_topics
from topicloom.topic_rules import standard_rules

PAGES = [
    "<title>A &amp; B</title><p class=\"a>b\">x&#65;&#x42;&eacute;<br>y</p><script>no</script>",
    "&amp;lt; &notit; &unknown; &#xD800; &#0; &#99999999; &copy2", "<!-- <p>x</p> --> a\t\n b<b>c</b>d",
    "no tags 'quotes' \"double\" back\\slash", "", None, "<style>x", "a <b", "fooBar www.site.com USAToday",
]


@pytest.fixture(scope="module")
def sql(spark):
    register_sql(spark, tables=False)
    return spark


def pairs(df, by_sql, by_column):
    return df.select(F.expr(by_sql).alias("s"), by_column.alias("c")).collect()


def test_text_functions(sql):
    df = sql.createDataFrame([(p,) for p in PAGES], "p string")
    for by_sql, by_column in (
        ("visible_text(p)", html.html_to_text(F.col("p"))),
        ("clean_tokens(p)", text.clean_tokens(F.col("p"))),
        ("without_stopwords(clean_tokens(p))", text.remove_stopwords(text.clean_tokens(F.col("p")))),
    ):
        for row in pairs(df, by_sql, by_column):
            assert row.s == row.c


def test_category_and_host_functions(sql):
    df = sql.createDataFrame(
        [("Top/a|b||", ["a"], ["ab"]), ("||", ["x"], []), ("", [""], []), (None, ["a"], None),
         ("Top/ab/c", ["a"], ["ab"]), ("a", ["a", "b"], [])],
        "c string, inc array<string>, exc array<string>")
    for by_sql, by_column in (
        ("split_categories(c)", categories.split_categories(F.col("c"))),
        ("rule_match(c, inc, exc)", categories.rule_match(F.col("c"), F.col("inc"), F.col("exc"))),
    ):
        for row in pairs(df, by_sql, by_column):
            assert row.s == row.c
    hosts = sql.createDataFrame([("http://a.com/x",), ("nope",), (None,), ("http://b.fr",)], "u string")
    for row in pairs(hosts, "is_english_host(u)", urls.is_english_host(F.col("u"))):
        assert row.s == row.c
    for row in pairs(hosts, "host_of(u)", urls.host_of(F.col("u"))):
        assert row.s == row.c


def test_array_functions(sql):
    df = sql.createDataFrame(
        [([1, 2, 3], [0.5, 0.5, 0.1], ["a", "b", "c"]), ([], [], ["a"]), ([7], [1.0, 2.0], ["a"])],
        "ids array<int>, scores array<float>, labels array<string>")
    for n in (0, 2, 5):
        for name in ("pad_post", "fit_post", "pad_pre"):
            if (name, n) == ("pad_pre", 0):
                continue
            for row in pairs(df, f"{name}(ids, {n})", getattr(arrays, name)(F.col("ids"), n)):
                assert row.s == row.c, (name, n)
    for row in pairs(df, "one_hot(size(ids), 4)", arrays.one_hot(F.size("ids"), 4)):
        assert row.s == row.c
    for row in pairs(df, "top2_labels(scores, labels)", top_labels(F.col("scores"), F.col("labels"))):
        assert row.s == row.c


def test_table_functions_like_the_operator(sql):
    paths = ["Top/Science/Technology/X", "Top/Home/Family/Babies", "Top/News/Weather", "Top/Games",
             "Top/Shopping/Home_and_Garden/Plants", "Top/Newsgroups", None, ""]
    rows = [(str(n), [paths[n % 8], paths[(n * 3 + 1) % 8]], "t", "o", []) for n in range(40)]
    pages = sql.createDataFrame(
        rows, "uri string, categories array<string>, text string, origUri string, "
        "origCategories array<string>")
    rules = standard_rules(sql)
    pages.createOrReplaceTempView(PAGES_VIEW)
    rules.createOrReplaceTempView(RULES_VIEW)
    register_sql(sql)
    found = sorted((r.uri, r.topic) for r in sql.sql("SELECT * FROM page_topics()").collect())
    mapped = sorted((r.uri, r.categories[0]) for r in map_to_topics(pages, rules).collect())
    assert found == mapped and found
    plan = sql.sql("SELECT * FROM page_topics()")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_quoted_literals(sql):
    for value in ("a'b", "back\\slash", "\\n", "a\\'b", "%_\\%", "line\nbreak"):
        assert sql.sql(f"SELECT {quoted(value)} AS v").first().v == value
