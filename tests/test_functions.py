"""Column functions."""

import pytest
from pyspark.sql import functions as F

from topicloom.functions import arrays, categories, html, text, urls


def one(spark, value, schema, expression):
    return spark.createDataFrame([(value,)], f"v {schema}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "tokens"),
    [
        ("fooBar HTMLParser iPad ABCd ASOS",
         ["foo", "bar", "html", "parser", "i", "pad", "ab", "cd", "asos"]),
        ("x.co.uk foo.common a.network", ["x", "foo", "mon", "a", "work"]),
        ("WWW.A.COM", ["www", "a", "com"]),
        ("café 24/7", ["caf"]),
        ("", []),
        ("  \n\t 1 2 ", []),
    ],
)
def test_clean_tokens(spark, raw, tokens):
    assert one(spark, raw, "string", text.clean_tokens) == tokens

    def chained(value):
        words = text.split_words(text.letters_only(text.remove_site_markers(value)))
        return text.lowercase(text.split_camel_case(words))

    assert one(spark, raw, "string", chained) == tokens


def test_markers_are_case_sensitive_and_leftmost_first(spark):
    assert one(spark, "www.a.com A.COM b.co.uk w.org", "string", text.remove_site_markers) == (
        " a  A.COM b  w "
    )


def test_stopwords_keep_repeats_and_you(spark):
    words = ["the", "you", "x", "fox", "fox", "yo"]
    assert one(spark, words, "array<string>", text.remove_stopwords) == ["you", "fox", "fox"]
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS))


@pytest.mark.parametrize(
    ("page", "visible"),
    [
        ("<html><head><title>hello</title></head><body><div>some text here</div></body></html>",
         "hello some text here"),
        ("<p>a<b>b</b>c</p><p>d</p>", "abc d"),
        ("one<br>two<br/>three", "one two three"),
        ("<!-- no -->x<script>var a='</p>';</script><STYLE>p{}</STYLE>y", "xy"),
        ("x<!-- open <p>never seen</p>", "x"),
        ('<a title="1 > 0" href=x>link</a>', "link"),
        ("a < b and 3<4", "a < b and 3<4"),
        ("&lt;p&gt; &amp;lt; &quot;q&quot; &eacute; &#233; &#xe9; &nope; &#0;",
         '<p> &lt; "q" é é é &nope; �'),
        ("&#128512;", "😀"),
        ("x&nbsp;y", "x y"),
        ("  lots \n\t of   space ", "lots of space"),
        ("<!DOCTYPE html><?xml version='1'?>t", "t"),
        ("", ""),
        ("a &copy 2020 &copyright &amp b &#233 c", "a © 2020 ©right & b é c"),
        ("&notit; x&am", "¬it; x&am"),
        ("tail <div class=x", "tail"),
    ],
)
def test_html_to_text(spark, page, visible):
    assert one(spark, page, "string", html.html_to_text) == visible


def test_html_to_text_is_linear_on_long_pages(spark):
    page = "<p title='a>b'>word &amp; word</p>" * 50_000 + "<!-- " * 20_000
    shown = one(spark, page, "string", html.html_to_text)
    assert shown.split(" ") == ["word", "&", "word"] * 50_000


@pytest.mark.parametrize(
    ("raw", "parts"),
    [
        ("some|other", ["some", "other"]),
        ("x|y||", ["x", "y"]),
        ("|x||y", ["", "x", "", "y"]),
        ("||", []),
        ("", [""]),
        (None, None),
    ],
)
def test_split_categories(spark, raw, parts):
    assert one(spark, raw, "string", categories.split_categories) == parts


def test_strip_top_prefix_once(spark):
    assert one(spark, "Top/Top/News", "string", categories.strip_top_prefix) == "Top/News"
    assert one(spark, "top/News", "string", categories.strip_top_prefix) == "top/News"


@pytest.mark.parametrize(
    ("uri", "kept"),
    [
        ("http://www.blerg.com", True),
        ("http://www.blerg.co.uk", True),
        ("http://www.blerg.fr", False),
        ("www.blerg.com", False),
        ("http://x.communist.fr", True),
        ("http://x.org", False),
        ("http://x.org.au/", True),
        ("http://a b.com", False),
        (None, False),
    ],
)
def test_english_host(spark, uri, kept):
    assert one(spark, uri, "string", urls.is_english_host) is kept


def test_padding(spark):
    ids = [1, 0, 2, 3]

    def run(expression):
        return one(spark, ids, "array<int>", expression)

    assert run(lambda v: arrays.pad_post(v, 6)) == [1, 0, 2, 3, 0, 0]
    assert run(lambda v: arrays.pad_post(v, 2)) == ids
    assert run(lambda v: arrays.fit_post(v, 2)) == [1, 0]
    assert run(lambda v: arrays.pad_pre(v, 6)) == [0, 0, 1, 0, 2, 3]
    assert run(lambda v: arrays.pad_pre(v, 2)) == [2, 3]
    assert run(arrays.drop_zero_ids) == [1, 2, 3]
    assert run(lambda v: arrays.truncate(v, 3)) == [1, 0, 2]
    assert run(lambda v: arrays.one_hot(F.lit(1), 3)) == [0, 1, 0]
    assert run(lambda v: arrays.one_hot(F.lit(1), 0)) == []


def test_bad_floats_fail_unless_tolerant(spark):
    parts = ["1.5", "x"]
    tolerant = one(spark, parts, "array<string>", lambda v: arrays.parse_floats(v, tolerant=True))
    assert tolerant == [1.5, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, parts, "array<string>", arrays.parse_floats)


def test_grouped_tags_and_frequent_entities(spark):
    assert html._by_first_letter("pre|p|h1") == "p(?:re|)|h(?:1)"
    page = "a<P>b<pre >c<prex>d<TaBLE x='>'>e<br/>f<h1\n>g&nbsp;&amp;lt;&amp;amp; \t h&lt &apos;&nbspx"
    text = "a b cd e f g\u00a0&lt;&amp; h< '\u00a0x"
    assert spark.range(1).select(html.html_to_text(F.lit(page))).first()[0] == text
