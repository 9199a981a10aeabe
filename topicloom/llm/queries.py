"""Registered queries of this folder, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.decontamination import find_benchmark, items_digest
from topicloom.llm.html_content import extract_content, learn_content
from topicloom.llm.jaccard_join import jaccard_groups
from topicloom.llm.labelled import fold
from topicloom.llm.licenses import label_list, scan_licenses
from topicloom.llm.packing import pack_documents
from topicloom.llm.prefix_trie import prefix_trie, turn_lists, with_shared_heads
from topicloom.llm.quality import quality_scores
from topicloom.llm.registry import query, table
from topicloom.llm.secrets import find_secrets, span_names, train_markov
from topicloom.llm.sharding import place_on_shards
from topicloom.llm.store import stored
from topicloom.llm.token_alignment import align_tokens
from topicloom.llm.top_k import top_k
from topicloom.llm.toxicity import toxicity_scores
from topicloom.llm.urls import BLOCKED_WORDS, default_rules, host_rule, judge_urls

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LINKED_GROUPS = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), sets AS (
  SELECT doc_id, CASE
    WHEN len(words) >= 4 THEN list_distinct(list_transform(
      range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')]
    ELSE [] END AS shingles
  FROM split
), elements AS (
  SELECT doc_id, len(shingles) AS size, unnest(shingles) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM elements a JOIN elements b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.size, b.size
  HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.y FROM reached r JOIN links l ON r.b = l.x
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, g.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) g ON s.doc_id = g.a
"""


@query(_LINKED_GROUPS)
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 4-word shingles at a similarity of 0.85."""
    groups = jaccard_groups(table(spark, sf_dir, "documents"), words=4, percent=85)
    return groups.select("doc_id", "n_shingles", "component_id")


@query()
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2,048 tokens."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer)


_BENCHMARK_HITS = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(coalesce({_LOWER}, ''),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), wanted AS (
  SELECT DISTINCT item_id, len(w) AS size, array_to_string(w, ' ') AS win FROM (
    SELECT item_id, unnest(list_transform(range(1, greatest(len(words) - 9, 1) + 1),
      lambda i: words[i:i + 9])) AS w FROM items WHERE len(words) > 0)
), sizes AS (
  SELECT DISTINCT size FROM wanted
), places AS (
  SELECT doc_id, size, words, unnest(range(1, len(words) - size + 2)) AS i
  FROM docs, sizes WHERE len(words) >= size
), found AS (
  SELECT p.doc_id, p.i, p.size, w.item_id
  FROM places p JOIN wanted w ON w.size = p.size
    AND w.win = array_to_string(p.words[p.i:p.i + p.size - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (
    SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words,
  CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(n.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""


@query(_BENCHMARK_HITS)
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that lie in a 10-word window of a benchmark item."""
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        # All items without an id count as one.
        (F.size("items") + F.col("unnamed").cast("int")).cast("long").alias("n_items"),
        items_digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labels outside one fold of five."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_scores(docs, labels, fold(F.col("doc_id"), 5) == 0)


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels outside one fold of four."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity_scores(docs, labels, fold(F.col("doc_id"), 4) == 2).drop("matches")


@query()
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents by fixed patterns, and random strings besides."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, train_markov(docs))

    def number(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"),
        number(2).alias("n_hex"), F.sha2(span_names(F.col("base")), 256).alias("base_sha256"),
        span_names(F.col("spans")).alias("spans"),
    )


# The rules of this query.
URL_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)

_URL_VERDICTS = rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rest
), named AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1')
      THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/')
      THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
    END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|[^A-Za-z0-9])({"|".join(BLOCKED_WORDS)})([^A-Za-z0-9]|$)')
    THEN 'block'
  ELSE 'allow' END AS verdict
FROM named
"""


@query(_URL_VERDICTS)
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page URL by named host rules, else by blocked words."""
    rules = [host_rule(action, rule) for action, rule in URL_RULES] + default_rules()
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).drop("url")


_NEAREST = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding,
    lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(
    range(1, least(len(q.x), len(c.x)) + 1), lambda i: q.x[i] * c.x[i])), 0) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query(_NEAREST)
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors with the greatest inner product, for every hundredth vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, of 256 shards of equal weight."""
    shards = {f"shard-{n:03d}": 1 for n in range(256)}
    return place_on_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", shards)


@query()
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_content(pages, learn_content(pages))


@query()
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two tokenizers, in all documents."""
    return align_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    ).documents


@query()
def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("hits", lambda h: h["base"])
    first = F.transform(base, lambda h: h["first"])
    score = F.array_max(F.transform("hits", lambda h: h["score"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(first).cast("long").alias("first_word"),
        F.array_max(first).cast("long").alias("last_word"),
        label_list(base).alias("base_labels"), label_list(F.col("hits")).alias("labels"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
    )


_TRIE_NODES = r"""
WITH turns AS (
  SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list(d ORDER BY turn NULLS FIRST, d) AS ds,
    list(w ORDER BY turn NULLS FIRST, d) AS ws,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
      string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)),
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 4 AS h
  FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.ds, [])[1:c.h], c.ds[c.h + 1:]) AS ds,
    list_concat(coalesce(b.ws, [])[1:c.h], c.ws[c.h + 1:]) AS ws
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20
), places AS (
  SELECT conv_id, ds, ws, unnest(range(len(ds) + 1)) AS k FROM rebuilt
), prefixes AS (
  SELECT conv_id, k, k = len(ds) AS ends, array_to_string(ds[1:k], ',') AS path,
    CASE WHEN k > 0 THEN array_to_string(ds[1:k - 1], ',') END AS up,
    CASE WHEN k > 0 THEN ws[k] ELSE 0 END AS w FROM places
), nodes AS (
  SELECT path, any_value(up) AS up, any_value(k) AS depth, min(conv_id) AS conv_id,
    count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ended
  FROM prefixes GROUP BY path
), kids AS (
  SELECT up AS path, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up
), below AS (
  SELECT DISTINCT a.path AS top, b.path
  FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND a.k <= b.k
), sums AS (
  SELECT top AS path, sum(own) AS saved, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM below JOIN nodes USING (path) LEFT JOIN kids USING (path) GROUP BY top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs,
  coalesce(c.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
  sha256(n.ended) AS ends_sha256
FROM nodes n JOIN sums s USING (path) LEFT JOIN kids c USING (path)
LEFT JOIN nodes p ON p.path = n.up
"""


@query(_TRIE_NODES)
def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, some of which begin like another one."""
    own = stored(turn_lists(table(spark, sf_dir, "conversations")), "turn-lists")
    conv = F.col("conv_id")
    heads = (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")
    return prefix_trie(with_shared_heads(own, conv - conv % 20, heads, 3))
