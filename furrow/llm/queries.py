"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import (
    chat, common, embedding_dedup, fingerprints, hard_negatives, language_id, minhash_dedup, mixing,
    packing, pii, prefix_trie, token_files, url_filters, warc,
)
from furrow.session import work_dir

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(common.configure(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    _REGISTRY[fn.__name__] = run
    return fn


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query
def op1_token_files(spark, sf_dir):
    """Token ids of all documents, written to files and read back."""
    path = work_dir(spark, "token-files")
    token_files.write(common.table(spark, sf_dir, "documents"), path, tokenizer_path(), end=0)
    return token_files.read_digests(spark, path)


@query
def op2_fingerprints(spark, sf_dir):
    """Every document's fingerprint, against its edited text and the next document."""
    return fingerprints.edit_report(common.table(spark, sf_dir, "documents"))


@query
def op3_language_id(spark, sf_dir):
    """The language of every document, learned from four fifths of the labelled ones."""
    docs = common.table(spark, sf_dir, "documents")
    held_out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs, ~held_out)
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"),
        "language.score", "language.rejected")


# The rules of the URL query.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query
def op4_url_filters(spark, sf_dir):
    """Every page's host, path, and the verdict of the longest rule that fits."""
    judged = url_filters.judge(
        common.table(spark, sf_dir, "pages"), url_filters.rule_table(spark, URL_RULES))
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


_SQL["op4_url_filters"] = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM u),
r(verdict, rhost, rpath) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS nr
  FROM p JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND nr = 1
"""


@query
def op5_minhash_near_dedup(spark, sf_dir):
    """Components of documents alike by 0.75 in their sets of five-word shingles."""
    return minhash_dedup.near_duplicates(common.table(spark, sf_dir, "documents"), percent=75, n=5)


@query
def op6_warc_round_trip(spark, sf_dir):
    """Every page as a WARC record, read back along verified record boundaries."""
    path = work_dir(spark, "warc")
    warc.write(common.table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read(spark, path))


_SQL["op6_warc_round_trip"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
h AS (
  SELECT html, max(page_id) AS holder FROM p WHERE n >= 1000 AND page_id IS NOT NULL GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM p LEFT JOIN h ON p.html = h.html
"""


@query
def op7_chat_threads(spark, sf_dir):
    """All chat messages without quotes, in reply order."""
    return chat.reply_order(common.table(spark, sf_dir, "conversations"))


@query
def op8_best_fit_packing(spark, sf_dir):
    """All documents as pieces in sequences of 1024 tokens."""
    return packing.pack(common.table(spark, sf_dir, "documents"), tokenizer_path(), end=2)


@query
def op9_source_mixing(spark, sf_dir):
    """How many words of each document a mix of 150% of all words takes."""
    mixed = mixing.mix(common.table(spark, sf_dir, "documents"), share=1.5, epochs=2.0)
    return mixed.select(
        "doc_id", "mixed.size", "mixed.source_size", "mixed.target",
        (F.col("mixed.times") * F.col("mixed.size")).alias("taken"))


_SQL["op9_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS spot,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS nr
  FROM d GROUP BY source),
c AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][(nr - 1) % 3 + 1] AS weight,
         source_size * 2.0::DOUBLE AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS total
  FROM s),
l AS (
  SELECT *, cap / weight AS ratio,
         (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
t AS (
  SELECT source, source_size,
         CASE WHEN ratio > level
              THEN max(CASE WHEN ratio > level THEN level END) OVER () * weight ELSE cap END AS target
  FROM l),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
m AS (
  SELECT d.*, g.source_size, g.target, g.whole,
         greatest(g.target - g.whole * g.source_size, 0.0) AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY spot, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND before + size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM m
"""


@query
def op10_embedding_near_dedup(spark, sf_dir):
    """Links and components of vectors with a cosine of 0.95 or more."""
    return embedding_dedup.near_duplicates(common.table(spark, sf_dir, "embeddings"), threshold=0.95)


@query
def op11_prefix_trie(spark, sf_dir):
    """The prefix trie of all rebuilt conversations, with totals of subtrees."""
    return prefix_trie.trie(common.table(spark, sf_dir, "conversations"))


_SQL["op11_prefix_trie"] = r"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nr
  FROM conversations WHERE conv_id IS NOT NULL),
b AS (
  SELECT conv_id, list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(
             range(1, length(conv_id::VARCHAR) + 1),
             lambda i: list_prepend(ascii(substr(conv_id::VARCHAR, i::BIGINT, 1))::BIGINT,
                                    [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
           lambda c, v: CASE WHEN v >= 0 THEN xor(c, v)
                             ELSE xor(c >> 1, (c & 1) * 3988292384) END) AS crc
  FROM (SELECT DISTINCT conv_id FROM o)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(crc, 4294967295) % 4 AS h FROM b),
r AS (
  SELECT c.conv_id, nr AS spot, role, text FROM c JOIN o ON o.conv_id = base AND nr <= h
  UNION ALL
  SELECT c.conv_id, nr + 3, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND nr > h),
n AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY spot) AS depth,
         sha256(length(role) || ':' || role || text) AS turn,
         CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM r),
p AS (
  SELECT conv_id, depth, words, sha256(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM n
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM c),
g AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words
  FROM p GROUP BY depth, node),
t AS (
  SELECT g.*, p.node AS parent FROM g LEFT JOIN p ON p.conv_id = g.conv_id AND p.depth = g.depth - 1),
k AS (SELECT parent, count(*) AS n_children FROM t WHERE parent IS NOT NULL GROUP BY parent),
v AS (SELECT t.*, coalesce(n_children, 0) AS n_children FROM t LEFT JOIN k ON k.parent = t.node),
s AS (
  SELECT p.node, p.depth, CAST(sum((v.n_children = 0)::BIGINT) AS BIGINT) AS n_leaves,
         CAST(sum((n_convs - 1) * v.words) AS BIGINT) AS saved_tokens
  FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.node, p.depth),
e AS (
  SELECT node, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, max(depth) AS depth, max_by(node, depth) AS node FROM p GROUP BY conv_id)
  GROUP BY node, depth)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens,
       coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM v JOIN s ON s.node = v.node AND s.depth = v.depth
LEFT JOIN e ON e.node = v.node AND e.depth = v.depth
LEFT JOIN v AS u ON u.node = v.parent AND u.depth = v.depth - 1
"""


@query
def op12_pii(spark, sf_dir):
    """Personal data in every document, by checked patterns and by weak supervision."""
    return pii.personal_data(common.table(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark, sf_dir):
    """Hard negatives for every anchor and positive, a seventh of the labels moved by one."""
    return hard_negatives.mine(
        common.table(spark, sf_dir, "embeddings"),
        relabel=lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label))


_SQL["op13_hard_negatives"] = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score
  FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id, anchor_label ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.anchor_label, positive_id
                               ORDER BY score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.anchor_label = p.anchor_label AND s.label <> p.anchor_label
             AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
