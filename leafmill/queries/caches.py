"""The content-keyed cache, checkpoints and answer quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import cache
from . import query

_WS = r"[\s\x{A0}\x{3000}]"
_MARKS = "(" + "|".join(fx.REFUSALS).replace("'", "''") + ")"
#: Answers with kana, with kana and Chinese, with refusals, and blank ones.
_VALUE = "CASE doc_id % 6 WHEN 0 THEN translate(text, 'aeiou', 'あえいおう') WHEN 1 THEN '译文' || text WHEN 2 THEN 'I CANNOT ' || text WHEN 3 THEN chr(10) || '  ' WHEN 4 THEN repeat('译', 12) || 'か' ELSE '汉' || translate(text, 'aeiou', 'あえいおう') END"
_BASE = f"v0 AS (SELECT doc_id, text, {_VALUE} AS value FROM documents), v1 AS (SELECT *, regexp_replace(value, '^{_WS}+|{_WS}+$', '', 'g') AS v FROM v0), v2 AS (SELECT *, length(regexp_replace(v, '[^\\x{{3040}}-\\x{{30FF}}]', '', 'g')) AS kana, length(regexp_replace(v, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) AS cjk FROM v1), q AS (SELECT *, v <> '' AND NOT regexp_matches(lower(v), '{_MARKS}') AND NOT (kana > 0 AND cjk = 0) AS usable FROM v2)"


def _values(read):
    k, text = F.col("doc_id") % 6, F.col("text")
    kana = lambda c: F.translate(c, "aeiou", "あえいおう")
    value = (
        F.when(k == 0, kana(text)).when(k == 1, F.concat(F.lit("译文"), text)).when(k == 2, F.concat(F.lit("I CANNOT "), text)).when(k == 3, "\n  ")
        .when(k == 4, F.concat(F.repeat(F.lit("译"), F.lit(12)), F.lit("か"))).otherwise(F.concat(F.lit("汉"), kana(text)))
    )
    return read("documents").select("doc_id", "text", value.alias("value"))


@query(f"WITH {_BASE} SELECT doc_id, usable FROM q")
def p8_usable(read):
    return _values(read).select("doc_id", fx.usable(F.col("value"), "简体中文").alias("usable"))


@query(f"WITH {_BASE} SELECT doc_id, usable AND kana * 10 <= greatest(kana + cjk, 1) AS trustworthy FROM q")
def p9_trustworthy(read):
    return _values(read).select("doc_id", fx.trustworthy(F.col("value"), "简体中文").alias("trustworthy"))


_LINES = f"WITH {_BASE}, lines AS (SELECT doc_id AS n, md5('t5|zh|' || (doc_id % 200)) AS k, value AS t, v, kana, cjk, usable, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS ver FROM q)"


def _lines(read):
    ver = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 7 == 0, 2).otherwise(1)
    return _values(read).select(F.col("doc_id").alias("n"), fx.text_key(F.lit("zh"), (F.col("doc_id") % 200).cast("string")).alias("k"), F.col("value").alias("t"), ver.alias("v"))


@query(_LINES + " SELECT k, t FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS r FROM lines WHERE ver = 1) WHERE r = 1 AND usable")
def a8_first_wins(read):
    return cache.load_cache(_lines(read), "zh")


@query(_LINES + " SELECT n, k FROM lines WHERE ver = 1")
def p11_cache_version(read):
    return _lines(read).where("v = 1").select("n", "k")


@query(_LINES + ", g AS (SELECT usable AND kana * 10 <= greatest(kana + cjk, 1) AS good, ver FROM lines) SELECT count(*)::BIGINT AS total, count(*) FILTER (good)::BIGINT AS good, count(*) FILTER (NOT good)::BIGINT AS bad, count(*) FILTER (ver IS NULL)::BIGINT AS legacy FROM g")
def a6_cache_audit(read):
    return cache.audit(_lines(read), "zh")


@query(_LINES + ", g AS (SELECT n, k, usable AND kana * 10 <= greatest(kana + cjk, 1) AS is_good FROM lines) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY is_good ORDER BY n) <= CASE WHEN is_good THEN 3 ELSE 6 END")
def a6_cache_samples(read):
    """The first three lines to trust and the first six others, as the audit shows them."""
    return cache.samples(_lines(read), "zh", ["n"]).select("n", "k", "is_good")


@query(_LINES + " SELECT n, k, t FROM lines WHERE usable AND kana * 10 <= greatest(kana + cjk, 1)")
def k11_cache_clean(read):
    return cache.clean(_lines(read), "zh").select("n", "k", "t")


@query("SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def a7_digest_dedup(read):
    rows = read("documents").select(F.md5("text").alias("digest"), "doc_id", "text")
    return cache.first_wins(rows, ["digest"], ["doc_id"]).select("doc_id", "text")


@query("""WITH c AS (SELECT k, min(t) AS t FROM (SELECT md5('t5|zh|' || text) AS k, CASE WHEN min(doc_id) OVER (PARTITION BY text) % 4 = 0 THEN text ELSE '译' || left(text, 5) END AS t FROM documents WHERE doc_id % 3 = 0) GROUP BY k)
SELECT doc_id, CASE WHEN c.t IS NULL THEN 'miss' WHEN c.t = text THEN 'rejected_cache' ELSE 'hit' END AS state FROM documents LEFT JOIN c ON c.k = md5('t5|zh|' || text)""".replace("min(doc_id) OVER (PARTITION BY text) % 4 = 0", "length(text) % 4 = 0"))
def j1_cache_lookup(read):
    docs = read("documents")
    t = F.when(F.length("text") % 4 == 0, F.col("text")).otherwise(F.concat(F.lit("译"), F.left("text", F.lit(5))))
    known = docs.where("doc_id % 3 = 0").select(fx.text_key(F.lit("zh"), F.col("text")).alias("k"), t.alias("t")).groupBy("k").agg(F.min("t").alias("t"))
    return cache.lookup(docs.select("doc_id", "text"), known, fx.text_key(F.lit("zh"), F.col("text")), F.col("cached") == F.col("text")).select("doc_id", "state")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND md5(e.text) = md5(d.text))")
def j2_checkpoint_pending(read):
    keyed = read("documents").select("doc_id", F.md5("text").alias("key"))
    return cache.pending(keyed, keyed.where("doc_id % 2 = 0")).select("doc_id")


@query("SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) > 0 AS has_letter, length(trim(text)) = 0 AS blank FROM documents")
def p4_blank_segments(read):
    return read("documents").select("doc_id", F.col("text").rlike("\\p{L}").alias("has_letter"), (F.length(F.trim("text")) == 0).alias("blank"))


@query("SELECT doc_id, '【译】' || regexp_replace(translate(text, 'aeiou', 'あえいおう'), '[\\x{3040}-\\x{30FF}]', '*', 'g') AS out FROM documents")
def s11_stub_model(read):
    return read("documents").select("doc_id", fx.stub_translation(F.translate("text", "aeiou", "あえいおう")).alias("out"))


@query()
def p10_echo(read):
    """Answers that copy their source; a sequence matcher judges what the lengths leave open."""
    from ..functions.echo import is_echo

    source = F.translate("text", "aeiou", "あえいおう")
    value = F.when(F.col("doc_id") % 2 == 0, F.concat(source, F.lit("。"))).otherwise(F.concat(F.lit("译"), source))
    return read("documents").select("doc_id", is_echo(source, value).alias("echo"))
