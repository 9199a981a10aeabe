"""Page extraction, hosts, seeds, taxonomy and language."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topicloom import schemas
from topicloom.operators import language, pages, taxonomy
from topicloom.topic_rules import standard_rules


def topics(df):
    return sorted((r.uri, r.categories[0]) for r in df.collect())


def page_rows(spark, rows):
    full = [(uri, "orig", cats, "text", []) for uri, cats in rows]
    return spark.createDataFrame(full, schemas.TOPIC_PAGE)


def rule_rows(spark, rows):
    return spark.createDataFrame(
        rows, "name string, includes array<string>, excludes array<string>"
    )


def test_extract_pages(spark):
    raw = spark.createDataFrame(
        [
            ("www.blerg.com", "http://www.blerg.com", "some|other",
             "<html><head><title>hello</title></head><body><div>some text here</div></body></html>"),
            ("a", "http://a", "x", None),
            ("a", "http://a", "x", ""),
            ("a", "http://a", None, "<p>t</p>"),
            (None, None, "x|y||", "<p>t</p>"),
        ],
        schemas.CRAWLED_PAGE,
    )
    assert sorted(pages.extract_pages(raw).collect(), key=str) == sorted(
        [
            ("http://www.blerg.com", "www.blerg.com", ["some", "other"], "hello some text here", []),
            (None, None, ["x", "y"], "t", []),
        ],
        key=str,
    )


def test_english_hosts(spark):
    rows = page_rows(spark, [("http://www.blerg.com", []), ("http://www.blerg.fr", []),
                             ("http://www.blerg.co.uk", [])])
    kept = sorted(r.uri for r in pages.english_hosts(rows).collect())
    assert kept == ["http://www.blerg.co.uk", "http://www.blerg.com"]


@pytest.mark.parametrize("known", [None, 2_000_000])
def test_pages_with_seeds(spark, known):
    fetched = spark.createDataFrame(
        [("http://www.a.com/x", "1"), ("http://a.com/y", "2"), ("http://b.com", "3"), ("bad", "4")],
        "url string, html string",
    )
    seeds = spark.createDataFrame([("a.com", "C"), ("d.com", "D")], schemas.SEED)
    paired = pages.pages_with_seeds(fetched, seeds, ignore_www=True, known_seeds=known)
    assert sorted(paired.collect()) == [
        ("a.com", "http://a.com/y", "C", "2"), ("a.com", "http://www.a.com/x", "C", "1")
    ]
    exact = pages.pages_with_seeds(fetched, seeds, known_seeds=known)
    assert exact.collect() == [("a.com", "http://a.com/y", "C", "2")]


BOTH = pytest.mark.parametrize(
    "mapping", [taxonomy.map_to_topics, taxonomy.map_to_topics_by_prefix]
)


@BOTH
def test_excludes(spark, mapping):
    rules = rule_rows(spark, [("science", ["Science"], ["Science/Technology"]),
                              ("technology", ["Science/Technology"], [])])
    found = mapping(page_rows(spark, [("u", ["Top/Science/Technology"])]), rules).collect()
    assert found == [("u", "orig", ["technology"], "text", ["Top/Science/Technology"])]


@BOTH
def test_one_and_two_matches(spark, mapping):
    rows = page_rows(spark, [("u", ["TV/Sports", "Sports", "Lifestyle"])])
    sport, lifestyle = ("sport", ["TV/Sports"], []), ("lifestyle", ["Lifestyle"], [])
    assert topics(mapping(rows, rule_rows(spark, [sport]))) == [("u", "sport")]
    both = mapping(rows, rule_rows(spark, [sport, lifestyle]))
    assert topics(both) == [("u", "lifestyle"), ("u", "sport")]
    assert mapping(rows, rule_rows(spark, [])).collect() == []


@BOTH
def test_standard_rules(spark, mapping):
    expected = {
        "Top/Science/Technology/X": ["technology"],
        "Top/Health/Medicine": ["medical"],
        "Top/Shopping/Home_and_Garden/Plants": ["gardening", "home"],
        "Top/Kids_and_Teens/Arts/Photography": ["parents", "photography"],
        "Top/Home/Family/Babies": ["parents"],
        "Top/Sports/Cycling": ["bikes"],
        "Top/Shopping/Sports/Cycling": ["bikes"],
        "Top/Newsgroups": ["news"],
        "Top/News/Weather": [],
        "Top/Top/News": [],
        "top/News": [],
        "Top/World/Deutsch": [],
    }
    rows = page_rows(spark, [(path, [path]) for path in expected])
    found = topics(mapping(rows, standard_rules(spark)))
    assert found == sorted((path, t) for path, names in expected.items() for t in names)


@BOTH
def test_duplicates_dedupe_and_segments(spark, mapping):
    rules = rule_rows(spark, [("news", ["News"], [])])
    rows = page_rows(spark, [("u", ["Top/News/A", "Top/News/B", "Top/Newsgroups"]),
                             ("u", ["Top/News/A"])])
    assert topics(mapping(rows, rules)) == [("u", "news")] * 4
    assert topics(mapping(rows, rules, dedupe=True)) == [("u", "news")] * 2
    assert topics(mapping(rows, rules, segment_aware=True)) == [("u", "news")] * 3


def test_rules_beyond_the_bound_take_the_join_and_agree(spark):
    rules = standard_rules(spark)
    rows = page_rows(spark, [("u", ["Top/Home/Family/X", "Top/Games"]), ("v", ["Top/Arts/Music"])])
    sent = topics(taxonomy.map_to_topics(rows, rules))
    assert topics(taxonomy.map_to_topics(rows, rules, max_broadcast_rows=3)) == sent
    assert sent == [("u", "entertainment"), ("u", "parents"), ("v", "music")]


def test_many_rules_have_the_plan_of_few(spark):
    few = [(f"r{n}", [f"A/{n}/"], [f"A/{n}/x"]) for n in range(6)]
    many = [(f"r{n}", [f"A/{n}/"], [f"A/{n}/x"]) for n in range(30_000)]
    rows = page_rows(spark, [("u", ["Top/A/29999/y", "A/5/x", None]), ("v", ["Top/A/3/"]),
                             ("w", [])])
    few, many = (taxonomy.map_to_topics(rows, rule_rows(spark, r)) for r in (few, many))
    assert topics(few) == [("v", "r3")]
    assert topics(many) == [("u", "r29999"), ("v", "r3")]
    plans = [re.sub(r"[0-9]+", "", df._jdf.queryExecution().executedPlan().toString())
             for df in (few, many)]
    assert plans[0] == plans[1]
    assert "Join" not in plans[0] and "Exchange" not in plans[0]


def test_computed_lookups_are_computed_once(spark):
    # The lookup fails on its second pass: it counts how often it was computed.
    passes = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    seeds = spark.createDataFrame([("a.org", "x"), ("b.org", "y")], "domain string, categories string")
    counted = seeds.coalesce(1).mapInArrow(seen, seeds.schema)
    fetched = spark.createDataFrame([("http://a.org/1", "t")], "url string, html string")
    assert pages.pages_with_seeds(fetched, counted).count() == 1
    assert passes.value == 2


paths = st.lists(st.sampled_from("abA/"), max_size=5).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    cats=st.lists(st.lists(paths, max_size=3), min_size=1, max_size=8),
    ruled=st.lists(st.tuples(st.lists(paths, max_size=3), st.lists(paths, max_size=2)), max_size=5),
    segments=st.booleans(),
)
def test_both_mappings_agree_with_brute_force(spark, cats, ruled, segments):
    def hit(path, prefix):
        plain = path.startswith(prefix)
        return plain if not segments else path == prefix or path.startswith(prefix + "/")

    named = [(f"r{i}", inc, exc) for i, (inc, exc) in enumerate(ruled)]
    expected = sorted(
        (str(i), name)
        for i, listed in enumerate(cats)
        for path in listed
        for name, inc, exc in named
        if any(hit(path, p) for p in inc) and not any(hit(path, p) for p in exc)
    )
    rows = page_rows(spark, [(str(i), listed) for i, listed in enumerate(cats)])
    rules = rule_rows(spark, named)
    assert topics(taxonomy.map_to_topics(rows, rules, segments)) == expected
    assert topics(taxonomy.map_to_topics_by_prefix(rows, rules, segments)) == expected


SENTENCES = {
    "en": ["the dog and the cat sat by the house", "a quick walk over the hill is healthy",
           "this is the story of a fox who jumped over that lazy bear", "where have they gone now"],
    "fr": ["le chien et le chat sont dans la maison", "nous avons une grande table et des chaises",
           "les enfants vont à l'école tous les jours", "il est très heureux de vous recevoir"],
    "de": ["der Hund und die Katze sind im Haus", "wir haben einen großen Tisch und viele Stühle",
           "die Kinder gehen jeden Tag zur Schule", "das ist nicht so schlecht wie es scheint"],
}


@pytest.fixture(scope="module")
def language_model(spark):
    rows = [(text, lang) for lang, texts in SENTENCES.items() for text in texts]
    return language.fit_language_model(spark.createDataFrame(rows, "text string, lang string"))


def test_english_only(spark, language_model):
    rows = spark.createDataFrame(
        [("Le jour est brillant et nous avons des journaux à recevoir",),
         ("the quick brown fox jumps over the lazy old dog",),
         ("the quick brow fox jumped over the lazy dog",),
         ("die Stühle sind im großen Haus",)],
        "text string",
    )
    kept = sorted(r.text for r in language.english_only(rows, language_model).collect())
    assert kept == ["the quick brow fox jumped over the lazy dog",
                    "the quick brown fox jumps over the lazy old dog"]


def test_language_probabilities_are_the_smoothed_trigram_model(spark, language_model):
    import math

    def grams(text):
        return [text.lower()[i:i + 3] for i in range(len(text) - 2)]

    counts = {lang: {} for lang in SENTENCES}
    for lang, texts in SENTENCES.items():
        for gram in (g for t in texts for g in grams(t)):
            counts[lang][gram] = counts[lang].get(gram, 0) + 1
    known = {g for c in counts.values() for g in c}
    text = "les the der 😀é"
    scores = {
        lang: sum(math.log((c.get(g, 0) + 1) / (sum(c.values()) + len(known)))
                  for g in grams(text) if g in known)
        for lang, c in counts.items()
    }
    top = max(scores.values())
    total = sum(math.exp(s - top) for s in scores.values())
    row = language_model.probabilities(spark.createDataFrame([(text,)], "text string")).first()
    expected = [math.exp(scores[lang] - top) / total for lang in language_model.languages]
    assert row.languageProbabilities == pytest.approx(expected, rel=1e-9)
    assert row.language == max(sorted(scores), key=scores.get)


def test_texts_without_evidence_are_dropped(spark):
    rows = [("the dog and the cat", "en"), ("le chien et le chat", "fr")]
    two = language.fit_language_model(spark.createDataFrame(rows, "text string, lang string"))
    odd = spark.createDataFrame([("",), (None,), ("漢字漢字",), ("the cat",)], "text string")
    assert [r.language for r in two.probabilities(odd).collect()] == [None, None, None, "en"]
    assert language.english_only(odd, two).collect() == [("the cat",)]


def test_both_joins_score_alike(spark, language_model):
    draw = random.Random(4)
    words = [w for texts in SENTENCES.values() for t in texts for w in t.split()]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(12))) for _ in range(60)]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate([*texts, None, "the " * 5000])],
                                 "id int, text string")
    sent = {r.id: r for r in language_model.probabilities(rows).collect()}
    joined = {r.id: r for r in language_model.probabilities(rows, max_broadcast_rows=5).collect()}
    assert sent.keys() == joined.keys() and len(sent) == 62
    for key, row in sent.items():
        assert row.language == joined[key].language
        if row.language is not None:
            assert row.languageProbabilities == pytest.approx(joined[key].languageProbabilities)
    kept = [sorted(r.id for r in language_model.keep(rows, max_broadcast_rows=n).collect())
            for n in (5, 1_000_000)]
    assert kept[0] == kept[1] and 61 in kept[0]


def test_profile_of_a_given_size(spark):
    rows = [("ababab", "xx"), ("cdcdcd", "yy")]
    small = language.fit_language_model(
        spark.createDataFrame(rows, "text string, lang string"), size=2)
    assert sorted(r.gram for r in small.grams.collect()) == ["aba", "bab"]


def test_language_model_round_trip(spark, language_model, tmp_path):
    language_model.save(f"{tmp_path}/model")
    loaded = language.LanguageModel.load(spark, f"{tmp_path}/model")
    rows = spark.createDataFrame([("the fox",), ("le chat",)], "text string")
    assert (loaded.probabilities(rows).select("language").collect()
            == language_model.probabilities(rows).select("language").collect())


def test_trigrams_of_whole_text(spark):
    long = "abc" * 2_000 + "xyz"
    df = spark.createDataFrame([(long,), ("ab",), ("a😀b",)], "t string")
    found = [r[0] for r in df.select(language.trigrams(F.col("t"))).collect()]
    assert len(found[0]) == len(long) - 2
    assert found[0][-1] == "xyz"
    assert found[1:] == [[], ["a😀b"]]
