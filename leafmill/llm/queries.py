"""Registered queries of the training-data operators: whole tables, whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, common, fingerprint, minhash, neardup_vectors, negatives, packing, quality, rules, toxicity, trie, urlfilter, warc

#: The rules of op9 (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: The text of conversation -7's two turns.
MARKED = "</s>[INST] ok [/INST]"


def tokenizer_path(name: str) -> str:
    """A vocabulary file's place; the folder is installed with the public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), split_pattern(), 2048, 0)


def _scored(spark: SparkSession, sf_dir: str, module, threshold: float) -> DataFrame:
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    scores = module.score(docs, module.fit(docs, labels))
    return scores.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, 0.5)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(common.read(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(common.read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), split_pattern())


def op6_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_vectors(common.read(spark, sf_dir, "embeddings"), 0.93)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.read(spark, sf_dir, "documents"), 2, 80)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], rows.schema)
    return chat.digests(chat.render(chat.fold(chat.from_rows(rows.unionByName(marked)))))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(common.read(spark, sf_dir, "pages"), URL_RULES)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality, 0.3)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), "vec_id % 100 = 0", 5, 10, 30, 90, 256)


def op12_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_neighbours(common.read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(common.read(spark, sf_dir, "conversations"), 20, 4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_toxicity, op3_warc, op4_quality_rules, op5_byte_bpe, op6_vector_near_dedup, op7_minhash_near_dedup, op8_chat_format, op9_url_filter, op10_quality_classifier, op11_hard_negatives, op12_fingerprint, op13_prefix_trie)}


#: SQL for the queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha256(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM f""",
    "op6_vector_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.93),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.c FROM r JOIN pairs p ON p.a = r.id WHERE r.c < p.b),
g AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, g.c AS component_id, v.vec_id = g.c AS kept FROM v JOIN g ON g.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    "op7_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s), n AS (SELECT doc_id, len(s) AS n FROM s),
i AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM e p JOIN e q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
r(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.c FROM r JOIN links l ON l.a = r.id WHERE r.c < l.b),
g AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, g.c AS component_id, n.doc_id = g.c AS kept FROM n JOIN g ON g.id = n.doc_id""",
    "op8_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(CASE WHEN role = 'assistant' THEN n + 7 ELSE n + length(role) + 14 END)::BIGINT AS formatted_chars FROM x GROUP BY conv_id""".replace("\\\\", "\\\\"),
    "op9_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
 FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op13_prefix_trie": r"""
WITH r AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii((c::VARCHAR)[i])::BIGINT)),
 lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 4 AS h FROM (SELECT DISTINCT c FROM r)),
b AS (SELECT k.c, p, role, text FROM k JOIN r ON r.c = k.c - k.c % 20 AND p < h UNION ALL SELECT c, p, role, text FROM k JOIN r USING (c) WHERE p >= h),
s AS (SELECT k.c, coalesce(list({'role': role, 'text': text} ORDER BY p) FILTER (p IS NOT NULL), []) AS s FROM k LEFT JOIN b USING (c) GROUP BY k.c),
m AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM s),
n AS (SELECT s[1:d] AS q, d, min(c) AS conv, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = d), '') AS ends FROM m GROUP BY ALL),
w AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(q[d].text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) END AS words FROM n),
k2 AS (SELECT q[1:d - 1] AS q, d - 1 AS d, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
t AS (SELECT w.*, coalesce(kids, 0) AS kids FROM w LEFT JOIN k2 USING (q, d)),
a AS (SELECT q[1:e] AS q, e AS d, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * words) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM t) GROUP BY ALL)
SELECT t.conv AS conv_id, t.d AS depth, u.conv AS parent_conv_id, t.n AS n_convs, t.kids AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(t.ends) AS ends_sha256
FROM t JOIN a USING (q, d) LEFT JOIN n u ON u.d = t.d - 1 AND u.q = t.q[1:t.d - 1]""",
}
