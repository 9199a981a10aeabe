"""Operators that learn or look up: quality, toxicity, search, sharding, pages, URLs, pipeline."""

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from topicloom.llm import (  # noqa: E402
    html_content,
    quality,
    secrets,
    sharding,
    spelling,
    top_k,
    toxicity,
    urls,
)
from topicloom.llm.labelled import fold  # noqa: E402

SF = "/root/testdata/sf0.01"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé", min_size=2, max_size=9), min_size=1, max_size=5, unique=True),
       st.lists(st.text("abcéx", min_size=1, max_size=11), min_size=1, max_size=12))
def test_spelling_like_edit_distance(terms, words):
    table = spelling.spelling_table(terms)
    codes = np.array([ord(c) for c in "".join(words)], dtype=np.uint32)
    ends = np.cumsum([len(w) for w in words])
    token, term, found = table.read(codes, ends - [len(w) for w in words], ends)
    got = dict(zip(token.tolist(), found.tolist()))
    for i, word in enumerate(words):
        near = [edits(word, t) for t in terms if edits(word, t) <= spelling.allowed_edits(t)]
        assert got.get(i) == (min(near) if near else None)
    for i, t, e in zip(token.tolist(), term.tolist(), found.tolist()):
        assert edits(words[i], table.terms[t]) == e


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abcé", min_size=2, max_size=9), min_size=1, max_size=9, unique=True),
       st.lists(st.text("abcéx", min_size=1, max_size=11), min_size=1, max_size=12))
def test_spelling_in_blocks(terms, words):
    whole, cut = spelling.spelling_table(terms, 99), spelling.spelling_table(terms, 2)
    codes = np.array([ord(c) for c in "".join(words)], dtype=np.uint32)
    ends = np.cumsum([len(w) for w in words])
    for one, other in zip(*(t.read(codes, ends - [len(w) for w in words], ends)
                            for t in (whole, cut))):
        assert one.tolist() == other.tolist()


def toxic_rows(n=400, seed=5):
    draw = random.Random(seed)
    plain = [a + b for a in ("bar", "den", "fol", "gim", "lor", "mun") for b in ("do", "ka", "pel")]
    docs, labels = [], []
    for i in range(n):
        words = [draw.choice(plain) + draw.choice(["", "s", "ta"]) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words.insert(draw.randrange(30), draw.choice(["zwarkoth", "quibnaster"]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_rows()
    extra = [(1000, None, "x"), (1001, "", "x"), (1002, "you zwarkoht !", "x"),
             (1003, "you are a QUIBNASTER.", "x"), (1004, "bardo denka " * 20_000, "x"),
             (1005, 'he wrote "zwarkoth" and left', "x"), (1001, "", "x"),
             (None, "quibnaste$r$$$", "x")]
    table = spark.createDataFrame(docs + extra, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = fold(F.col("doc_id"), 4) == 2
    rows = toxicity.toxicity_scores(table, known, held).collect()
    assert len(rows) == len(docs) + len(extra)
    score = {r.doc_id: r.score for r in rows}
    wrong = [i for i, _, toxic in labels if (score[i] >= 0.3) != bool(toxic)]
    assert not wrong
    assert score[1002] >= 0.3 and score[1003] >= 0.3 and score[None] >= 0.3
    assert max(score[1000], score[1001], score[1004]) < 0.3
    assert score[1005] < score[1003]
    found = next(r for r in rows if r.doc_id == 1002).matches[0]
    assert (found.term, found.found, found.word, found.signs) == ("zwarkoth", "zwarkoht", 1,
                                                                  ["addressed"])
    none = toxicity.toxicity_scores(table, known.where("false"), held).collect()
    assert len({r.score for r in none}) == 1 and none[0].score < 0.3
    assert toxicity.toxicity_scores(table.where("false"), known, held).collect() == []


def test_toxicity_keeps_every_term(spark):
    draw = random.Random(3)
    planted = ["".join(draw.choice("bdfgklmnprstvz") for _ in range(8)) for _ in range(240)]
    # Three vowels are more edits from a planted term than any of them allows.
    plain = ["".join(draw.choice("bdfgklm") + draw.choice("aou") for _ in range(3))
             for _ in range(400)]
    docs = [(" ".join(draw.choice(plain) for _ in range(30)), 0) for _ in range(2000)]
    for i in range(15 * len(planted)):
        words = [draw.choice(plain) for _ in range(4)]
        docs.append((" ".join([*words[:2], planted[i % len(planted)], *words[2:]]), 1))
    table = spark.createDataFrame(
        [(i, text) for i, (text, _) in enumerate(docs)]
        + [(10_000 + i, f"{plain[0]} {t[:4]}{t[5:]} {plain[1]}") for i, t in enumerate(planted)],
        "doc_id long, text string")
    known = spark.createDataFrame([(i, label) for i, (_, label) in enumerate(docs)],
                                  "doc_id long, toxic int")
    rows = toxicity.toxicity_scores(table, known, F.col("doc_id") >= 10_000).where("held_out")
    found = {r.doc_id - 10_000: r for r in rows.collect()}
    assert len(found) == len(planted)
    for i, term in enumerate(planted):
        assert [m.term for m in found[i].matches] == [term] and found[i].predicted == 1


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(
        f"{SF}/labels.parquet")
    for scored, label, least in (
        (quality.quality_scores(docs, labels, fold(F.col("doc_id"), 5) == 0), "quality", 0.97),
        (toxicity.toxicity_scores(docs, labels, fold(F.col("doc_id"), 4) == 2), "toxic", 0.9),
    ):
        right = F.avg((F.col(label) == F.col("predicted")).cast("double"))
        assert scored.join(labels, "doc_id").where("held_out").agg(right).first()[0] >= least


def test_quality_edges(spark):
    docs, _ = toxic_rows(200)
    junk = [(i, re.sub(r"(\w+)", r"\1%%%", t) if i % 3 == 0 else t, "x") for i, t, _ in docs]
    labels = [(i, int(i % 3 != 0)) for i, _, _ in docs]
    extra = [(900, None, "x"), (901, "", "x"), (901, "", "x"), (None, "barka%%% dendo%%%", "x"),
             (902, "bardo denka " * 20_000, "x")]
    table = spark.createDataFrame(junk + extra, "doc_id long, text string, label string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    held = fold(F.col("doc_id"), 5) == 0
    rows = quality.quality_scores(table, known, held).collect()
    score = {r.doc_id: r.score for r in rows}
    assert len(rows) == 205 and all(0 <= r.score <= 1 for r in rows)
    assert all((score[i] >= 0.3) == bool(good) for i, good in labels)
    assert score[900] == score[901] and score[None] < 0.3 <= score[902]
    flat = quality.quality_scores(table, known.where("false"), held).collect()
    assert {round(r.score, 6) for r in flat} == {0.5}
    assert quality.quality_scores(table.where("false"), known, held).collect() == []


def test_dual_descent_reaches_the_optimum():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(60, 4))
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0, 1.0, -1.0)
    rows = [np.arange(4)] * 60
    weight, bias = quality.coordinate_descent(rows, list(x), y, np.full(60, 0.5), 4, rounds=2000)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + 0.5 * np.maximum(0, 1 - y * (x @ w + b)).sum()

    best = loss(weight, bias)
    for _ in range(300):
        move = draw.normal(size=5) * 0.05
        assert loss(weight + move[:4], bias + move[4]) >= best - 1e-3


@pytest.mark.parametrize(("shard", "block"), [(8192, 512), (40, 3)])
def test_top_k_like_brute_force(spark, shard, block):
    draw = np.random.default_rng(4)
    rows = [(i, [float(v) for v in draw.integers(-3, 4, 6) / 4], "x") for i in range(0, 900, 3)]
    rows += [(5, None, "x"), (7, [1.0, None], "x"), (8, [float("nan")] * 6, "x"),
             (10, [float("inf")] * 6, "x"), (None, [1.0] * 6, "x"), (11, [], "x"), (13, [2.0], "x"),
             (0, rows[0][1], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score)
           for r in top_k.top_k(table, F.col("vec_id") % 100 == 0, shard_rows=shard,
                                block_queries=block).collect()}
    whole = []
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((i, [int(np.floor(1024 * x)) for x in v] + [0] * (6 - len(v))))
    expected = {}
    for q in range(0, 900, 300):
        own = next(v for i, v in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q)[:10]
        expected |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    assert got == expected
    assert top_k.top_k(table.where("false"), F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize("spread", [1, 3, 4000])
def test_list_reads_like_brute_force(spread):
    draw = np.random.default_rng(spread)
    rows = draw.integers(-spread, spread + 1, (2000, 7)).astype(np.int64)
    ids = draw.permutation(2000).astype(np.int64)
    lists = top_k.sorted_lists(rows)
    for own in range(0, 200, 10):
        query = draw.integers(-spread, spread + 1, 7).astype(np.int64)
        score = rows @ query
        best = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if i != own)[:3]
        assert top_k.best_of_shard(ids, rows, own, query, 3, lists) == [(i, -s) for s, i in best]


def test_lists_are_read_at_every_size_until_nobody_else_can_qualify():
    draw = np.random.default_rng(1)
    # One dimension decides: reading may stop long before the end.
    rows = (draw.integers(-5, 6, (500, 8)) * ([1000] + [1] * 7)).astype(np.int64)
    rows[:20, 0] += 90_000
    query = np.array([3, 1, -1, 1, 1, -1, 1, 1], dtype=np.int64)
    left, read = top_k.read_lists(np.arange(500), 500, query, 10, top_k.sorted_lists(rows))
    assert 0 < read < 500 and len(left) <= 20
    best = np.argsort(-(rows @ query), kind="stable")[:10]
    assert set(best) <= set(left)
    # Nothing decides: the lists are read to the end, on a small table too.
    even = draw.integers(-3, 4, (500, 8)).astype(np.int64)
    left, read = top_k.read_lists(np.arange(500), 500, query, 10, top_k.sorted_lists(even))
    assert read > 250
    assert set(np.argsort(-(even @ query), kind="stable")[:10]) <= set(left) or len(left) >= 10


def test_results_replace_columns_of_their_names(spark):
    text = "AKIA" + "B" * 20
    rows = spark.createDataFrame(
        [(1, text, "http://a.org/x", "<p>t</p>", "old", "old", "old", "old", "old", "old", "old")],
        "doc_id long, text string, url string, html string, slot string, shard string, "
        "spans string, base string, n_chars string, host string, verdict string")
    placed = sharding.place_on_shards(rows, "doc_id", {"a": 1, "b": 1}, 101).first()
    assert placed.shard in ("a", "b") and placed.host == "old"
    flat = secrets.MarkovModel([-1.0] * secrets._SIZE ** 2)
    found = secrets.find_secrets(rows, flat).first()
    assert [(s.start, s.end) for s in found.spans] == [(0, 24)] and found.shard == "old"
    judged = urls.judge_urls(rows, urls.default_rules()).first()
    assert (judged.host, judged.verdict, judged.spans) == ("a.org", "allow", "old")
    pages = html_content.extract_content(rows, html_content.learn_content(rows)).first()
    assert pages.n_chars == len(pages.text) and pages.base == "old"


def test_many_end_tags_without_a_partner():
    start = time.perf_counter()
    tree = html_content.Tree("<div>" * 20_000 + "x" + "</span>" * 20_000)
    assert len(tree.tag) >= 20_001
    assert time.perf_counter() - start < 10


def test_shards(spark):
    names = {f"s{n}": 1 for n in range(10)}
    owner = sharding.fill_slots(names, 1009)
    sizes = [owner.count(n) for n in names]
    assert max(sizes) - min(sizes) <= 1
    # Brute force: each shard's whole order of slots, walked in turns.
    order = {n: [(sharding._hash(n, "start") + j * (sharding._hash(n, "step") % 1008 + 1)) % 1009
                 for j in range(1009)] for n in names}
    taken = {}
    while len(taken) < 1009:
        for n in sorted(names):
            slot = next((s for s in order[n] if s not in taken), None)
            if slot is not None:
                taken[slot] = n
    assert [taken[s] for s in range(1009)] == owner
    fewer = sharding.fill_slots({n: 1 for n in list(names)[:-1]}, 1009)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != "s9")
    assert moved < 0.2 * 1009
    double = sharding.fill_slots({"a": 2, "b": 1}, 1009)
    assert abs(double.count("a") - 2 * double.count("b")) <= 2
    rows = spark.createDataFrame([(1, "k"), (1, "k"), (None, "z")], "id long, other string")
    placed = sharding.place_on_shards(rows, "id", names, 1009).collect()
    assert len(placed) == 3 and placed[0].shard == placed[1].shard
    for r in placed:
        assert r.shard == owner[r.slot]
    with pytest.raises(ValueError):
        sharding.fill_slots(names, 1000)


PAGES = [
    ('<html><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>'
     '<nav><a href=x>Home</a></nav><main><h1>Title here</h1><p>First &amp; paragraph of the text, '
     'long enough to be one.</p><aside class="sidebar">Side</aside><form><input><button>Go</button>'
     '</form><p>Second</p><section id="comments"><p>Nice article, said a reader with a long comment '
     'that goes on and on.</p></section></main><footer>foot</footer></body></html>',
     "Title here First & paragraph of the text, long enough to be one. Second"),
    ('<body><div id="header">Menu Home</div><div class="content"><h2>T</h2><p>Body text one.</p>'
     '<div class="ad">Buy</div><p>Body text two<br>line.</p><div class="comments"><p>Hi</p></div>'
     '</div><div class="sidebar"><ul><li>x</li></ul></div></body>',
     "T Body text one. Body text two line."),
    ('<article><p>a &lt b<p>c &#8364;&nbsp;d<script>var x="</p>";</script>'
     '<div class="share">tweet</div></article', "a < b c € d"),
    ("just text without any tag at all", "just text without any tag at all"),
    ("", ""), (None, ""), ("<article>" + "<p>x</p>" * 20_000 + "</article>", " ".join("x" * 20_000)),
    ("<article>" + "<div>" * 20 + "deep", "deep"), ("<a href='never closed", ""),
    ("<div>" * 5_000 + "<nav>menu", ""),
]


def test_pages(spark):
    learned = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_content.learn_content(learned)
    rows = spark.createDataFrame([(i, h, "clash") for i, (h, _) in enumerate(PAGES)],
                                 "page_id long, html string, n_chars string")
    found = {r.page_id: r for r in html_content.extract_content(rows, model).collect()}
    for i, (_, text) in enumerate(PAGES):
        assert found[i].text == text, i
        assert found[i].n_chars == len(text)
    article = F.regexp_extract("html", "(?s)<article>(.*)</article>", 1)
    marked = article.contains("<")
    pages = html_content.extract_content(learned.withColumn("own", article).where(marked), model)
    for r in pages.limit(50).collect():
        plain = re.sub(r"<(?!/?b>)[^>]*>", " ", r.own).replace("<b>", "").replace("</b>", "")
        assert r.text == " ".join(html_content.html.unescape(plain).split())
    empty = learned.where("false")
    assert html_content.extract_content(empty, html_content.learn_content(empty)).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>", "</p>", "text", "<nav>", "</nav>",
                                 '<ul class="menu">', "</ul>", "<li>", "<article>", "</article>"]),
                max_size=9))
def test_messages_like_brute_force_on_stars(parts):
    """Where no node has two children, averaging is no averaging, and marginals are exact."""
    tree = html_content.Tree("".join(parts))
    children = [tree.parent.count(i) for i in range(len(tree.tag))]
    if max(children) > 1 or len(tree.tag) > 7:
        return
    tables = html_content.ContentModel({}).tables()
    own = []
    for i in range(len(tree.tag)):
        fit = np.array(tables.sizes[html_content._size(tree.length[i])])
        for word in tree.words[i]:
            fit = fit * np.array(tables.word(word))
        own.append(fit)
    total = np.zeros(len(tree.tag))
    whole = 0.0
    for labels in np.ndindex(*[3] * len(tree.tag)):
        weight = (0.98, 0.01, 0.01)[labels[0]]
        for i, label in enumerate(labels):
            weight *= own[i][label]
            if i:
                weight *= tables.chances(tree.tag[i])[labels[tree.parent[i]]][label]
        whole += weight
        total += weight * (np.array(labels) == html_content.CONTENT)
    assert html_content.content_chances(tree, tables) == pytest.approx(total / whole, abs=1e-6)


def test_urls(spark):
    named = [urls.host_rule(a, r) for a, r in (
        ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"))]
    addresses = [
        ("http://Blog.Example.ORG/en/12?x#y", "blog.example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org.uk/org/", "notexample.org.uk", "/org/", None, "allow"),
        ("http://a.org", "a.org", "", None, "allow"), (None, "", "", None, "allow"),
        ("mailto:x", "", "", None, "allow"), ("", "", "", None, "allow"),
        ("https://www.casino-win.net/x", "www.casino-win.net", "/x", None, "block"),
        ("https://casino.org/x", "casino.org", "/x", "org/", "allow"),
        ("https://casinos.net/casino", "casinos.net", "/casino", None, "allow"),
        ("x://h" + "/a" * 50_000, "h", "/a" * 50_000, None, "allow"),
    ]
    rows = spark.createDataFrame([(i, u[0], "w") for i, u in enumerate(addresses * 2)],
                                 "page_id long, url string, weight string")
    found = urls.judge_urls(rows, named + urls.default_rules()).collect()
    assert len(found) == 2 * len(addresses)
    for r in found:
        assert (r.url, r.host, r.path, r.rule, r.verdict) == addresses[r.page_id % len(addresses)]
    counts = spark.createDataFrame([("example", 9), ("org", 50), ("en", 3)], "token string, n long")
    index = {r.rule: r.token for r in urls.rule_index(spark, named, counts).collect()}
    assert index == {"org/": "org", "example.org/es/": "es", "example.org/en/1": "en"}
    assert urls.judge_urls(rows.where("false"), named).collect() == []
    with pytest.raises(ValueError):
        urls.host_rule("allow", "org")


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-2, "", "en", "s", 0),
         (None, "no id here at all", "en", "s", 17)], docs.schema)
    docs = docs.limit(200).unionByName(odd)
    columns, sizes = docs.columns, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(number))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if number < 4:
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[2] == sizes[3] > 50
    assert "[secret]" in " ".join(
        r.text or "" for r in spark.read.parquet(str(tmp_path / "3")).collect())
    assert docs.where("doc_id = -1 and length = 1").count() == 1
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_judges_rows(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1")
    scored = toxicity.toxicity_scores(
        source, spark.read.parquet(f"{SF}/labels.parquet"), fold(F.col("doc_id"), 4) == 2)
    worst = scored.join(labels.select("doc_id"), "doc_id").orderBy(F.desc("score")).first()
    toxic = source.where(F.col("doc_id") == worst.doc_id).first().text
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = "a calm walk by the river on a mild morning in may with old friends"
    other = "seven ships sailed north before dawn carrying salt timber and wool for trade"

    def rows(*pairs):
        return spark.createDataFrame(
            [(i, t, "en", "s", len(t)) for i, t in pairs], source.schema)

    def texts(df):
        found = df.where(F.col("doc_id").isNull() | (F.col("doc_id") < 0)).collect()
        return sorted(r.text for r in found)

    mixed = source.unionByName(rows((None, toxic), (-5, toxic), (-5, clean), (None, other)))
    assert texts(corpus_pipeline.drop_toxic(spark, mixed, SF)) == sorted([clean, other])
    mixed = rows((None, item), (-5, item), (-5, clean), (None, other))
    assert texts(corpus_pipeline.drop_contaminated(spark, mixed, SF)) == sorted([clean, other])
    mixed = rows((-5, clean), (-5, other), (-5, clean), (-4, clean), (None, clean),
                 (-3, ""), (-3, ""), (None, ""))
    kept = corpus_pipeline.drop_near_duplicates(spark, mixed, SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [
        (-5, clean), (-5, other), (-3, ""), (0, "")]


def test_pipeline_keeps_columns_that_clash(spark):
    extra = ["score", "items", "spans", "matches", "held_out", "n_hit", "base", "key", "label"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for name in extra:
        docs = docs.withColumn(name, F.concat(F.lit(name), "doc_id"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r[name] == f"{name}{r.doc_id}" for r in rows for name in extra)
        kept = spark.createDataFrame(rows, docs.schema)
