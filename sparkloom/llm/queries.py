"""The training-data queries as registered with the driver, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.exact_dedup import exact_dedup, normalised
from sparkloom.llm.html_text import main_text
from sparkloom.llm.line_dedup import line_dedup
from sparkloom.llm.mixing import mix
from sparkloom.llm import quality_rules as rules
from sparkloom.llm.ordinal_quality import ordinal_quality
from sparkloom.llm.pieces import encode
from sparkloom.llm.simhash import simhash_dedup
from sparkloom.llm.substring_dedup import substring_dedup
from sparkloom.llm.toxicity import toxicity
from sparkloom.session import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


@query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op2_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || md5(coalesce(text, ''))) AS row_key,
    greatest(coalesce(len(regexp_extract_all(text, '\p{L}'))
      / CAST(nullif(len(regexp_extract_all(text, '[^\x20\x09-\x0D]')), 0) AS DOUBLE), 0.05), 0.05) AS q
  FROM documents
), k AS (
  SELECT *, row_number() OVER (PARTITION BY row_key) AS no,
    -ln((CAST(CAST('0x' || substr(row_key, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / q AS key FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w
  FROM k GROUP BY source
), c AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, (SELECT sum(source_size) FROM s) AS total FROM s
), l AS (
  SELECT *, row_number() OVER o AS place,
    (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl
  FROM c WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST)
), t AS (
  SELECT source, source_size,
    coalesce(least(cap, w * (SELECT arg_min(lvl, place) FROM l WHERE lvl <= cap / w)), cap) AS target FROM l
), r AS (
  SELECT k.*, source_size, target,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, target - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY source ORDER BY key, row_key, no) <= target - epochs * source_size AS chosen FROM r
), g AS (
  SELECT source, any_value(rest) - sum(CASE WHEN chosen THEN size ELSE 0 END) AS gap FROM p GROUP BY source
), z AS (
  SELECT p.source, arg_min({'r': row_key, 'n': no}, {'m': abs(size - gap), 'k': key, 'r': row_key, 'n': no}) AS final
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
  WHERE NOT chosen AND size > 0 AND abs(size - gap) < gap GROUP BY p.source
)
SELECT doc_id, size, source_size, target,
  size * (epochs + CASE WHEN chosen OR coalesce(row_key = final.r AND no = final.n, false) THEN 1 ELSE 0 END) AS taken
FROM p LEFT JOIN z ON p.source IS NOT DISTINCT FROM z.source
"""


@query
def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return exact_dedup(docs, carry={"text_sha256": F.sha2(normalised(F.col("text")), 256)})


ORACLE["op6_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(read_table(spark, sf_dir, "documents"))


def _words_sql(ws) -> str:
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


_COUNT = "len(regexp_extract_all(t, '{}'))"
_CLASSES = ", ".join(_COUNT.format(c.replace("'", "''")) for c in rules.CLASSES)
_OWN = " ".join(f"WHEN lang = '{k}' THEN {_words_sql(v)}" for k, v in rules.COMMON_WORDS.items())
_EVERY = _words_sql(sorted({w for ws in rules.COMMON_WORDS.values() for w in ws}))


def _js_sql(own: str, ref: str) -> str:
    part = "CASE WHEN z[{0}] > 0 THEN z[{0}] * log2(z[{0}] / ((z[1] + z[2]) / 2)) ELSE 0 END"
    shares = f"list_zip(list_transform({own}, lambda v: v / list_sum({own})), list_transform({ref}, lambda v: v / list_sum({ref})))"
    terms = f"list_transform({shares}, lambda z: ({part.format(1)} + {part.format(2)}) / 2)"
    return f"CASE WHEN list_sum({own}) = 0 OR list_sum({ref}) = 0 THEN 0 ELSE round(sqrt(greatest(list_sum({terms}), 0)), 6) END"


ORACLE["op8_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    [{_CLASSES}] AS cs, CASE {_OWN} ELSE {_EVERY} END AS own FROM d
), g AS (
  SELECT rid, i, ws[i:i + 7] AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)
), c AS (
  SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (
    SELECT rid, unnest(range(i, i + 8)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1
  ) GROUP BY rid
), f AS (
  SELECT w.*, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ws) AS n_words, len(t) AS n_chars,
    list_append(cs, len(t) - list_sum(cs)) AS ch,
    list_transform(own, lambda o: len(list_filter(ws, lambda x: rtrim(lower(x), '.,') = o))) AS found
  FROM w LEFT JOIN c USING (rid)
), h AS (
  SELECT *, list_append(found, len(ws) - coalesce(list_sum(found), 0)) AS wh FROM f
), r AS (
  SELECT lang, list(s ORDER BY i) AS rc FROM (
    SELECT lang, i, sum(ch[i]) AS s FROM (SELECT lang, ch, unnest(range(1, len(ch) + 1)) AS i FROM h) GROUP BY lang, i) GROUP BY lang
), q AS (
  SELECT lang, list(s ORDER BY i) AS rw FROM (
    SELECT lang, i, sum(wh[i]) AS s FROM (SELECT lang, wh, unnest(range(1, len(wh) + 1)) AS i FROM h) GROUP BY lang, i) GROUP BY lang
), j AS (
  SELECT doc_id, n_words, n_chars, coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0) AS word_chars,
    {_COUNT.format('[#*$%&|<>]')} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_repeat_words,
    {_js_sql('ch', 'rc')} AS char_distance, {_js_sql('wh', 'rw')} AS word_distance
  FROM h JOIN r ON h.lang IS NOT DISTINCT FROM r.lang JOIN q ON h.lang IS NOT DISTINCT FROM q.lang
)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
  char_distance, word_distance, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND NOT (n_chars >= {rules.MIN_CHARS_FOR_CHARS} AND char_distance > {rules.MAX_CHAR_DISTANCE}
      OR n_words >= {rules.MIN_WORDS_FOR_WORDS} AND word_distance > {rules.MAX_WORD_DISTANCE}) AS kept
FROM j
"""


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read_table(spark, sf_dir, "documents"), unit="passage")
    return found.select("doc_id", "text", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), "removed")


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "removed")


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"))


@query
def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ordinal_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("selected", "kept")
