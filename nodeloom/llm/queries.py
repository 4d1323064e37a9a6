"""Registered queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nodeloom.llm import (
    contamination,
    infill,
    langid,
    maincontent,
    nearcopies,
    packing,
    pii,
    quality,
    resampling,
    secrets,
    urlrules,
    warc,
    weaklabel,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.report(table(spark, sf, "documents"))


SQL["op1_quality"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t,
    list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines
  FROM d
), g AS (
  SELECT rid, i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS win
  FROM w, unnest(range(1, len(words) - 3)) AS u(i)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1
), n AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM r, unnest(range(0, 5)) AS u(k) GROUP BY rid
), f AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN n USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words
       OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) OR 2 * word_chars < 3 * n_words) AS kept
FROM f
"""


@query
def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


SQL["op2_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS u(i) WHERE len(w) > 0
), ks AS (
  SELECT DISTINCT k FROM bw
), dw AS (
  SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM d, ks, unnest(range(1, len(w) - k + 2)) AS u(i)
), h AS (
  SELECT rid, i, k, item_id FROM dw JOIN bw USING (k, win)
), n AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM (SELECT DISTINCT rid, i, k FROM h), unnest(range(0, k)) AS u(j) GROUP BY rid
), m AS (
  SELECT rid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(m.n, 0) AS BIGINT) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256,
  coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""

#: The rules of the URL filter query.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@query
def op7_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf, "pages"), rules)


SQL["op7_url_filters"] = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(h, q, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT rid, h || q AS rule, v FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
), b AS (
  SELECT rid, rule, v FROM m QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC, rule DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN b USING (rid)
"""


@query
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return packing.report(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.report(table(spark, sf, "documents"))


@query
def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.report(table(spark, sf, "pages"))


SQL["op4_warc"] = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages
), b AS (
  SELECT rid, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST(concat('0x', substr(d, 1 + 10 * g, 10)) AS BIGINT)) >> (35 - 5 * k)) & 31 AS INTEGER) + 1, 1), '' ORDER BY g, k) AS digest
  FROM p, unnest(range(0, 4)) AS u(g), unnest(range(0, 8)) AS v(k) GROUP BY rid
), m AS (
  SELECT d, max(page_id) AS first FROM p GROUP BY d
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM p JOIN m USING (d) JOIN b USING (rid)
"""


@query
def op8_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return maincontent.report(table(spark, sf, "pages"))


@query
def op6_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.report(table(spark, sf, "documents"))


@query
def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return weaklabel.report(table(spark, sf, "documents"))


@query
def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return nearcopies.report(table(spark, sf, "documents"))


@query
def op13_infill(spark: SparkSession, sf: str) -> DataFrame:
    return infill.report(table(spark, sf, "documents"))


SQL["op13_infill"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines,
    CAST(concat('0x', substr(s, 1, 8)) AS BIGINT) AS h1, CAST(concat('0x', substr(s, 9, 8)) AS BIGINT) AS h2,
    CAST(concat('0x', substr(s, 17, 8)) AS BIGINT) AS h3, CAST(concat('0x', substr(s, 25, 8)) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT doc_id, t, len(lines) AS n, form, array_to_string(lines[1:a], '') AS pre,
    array_to_string(lines[a + 1:b], '') AS mid, array_to_string(lines[b + 1:], '') AS suf
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid)
    ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@query
def op11_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


#: CRC-32 of each half byte, for SQL that has no such function.
CRC_NIBBLES = [
    0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
    3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108,
]

SQL["op11_resampling"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), df AS (
  SELECT rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d
), dn AS (
  SELECT rid, f, count(*) AS n FROM df GROUP BY rid, f
), bf AS (
  SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b
), bn AS (
  SELECT f, count(*) AS n FROM bf GROUP BY f
), names AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM dn UNION SELECT f FROM bn)
), crc AS (
  SELECT f, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(h)),
        lambda i: CAST(strpos('0123456789ABCDEF', substr(h, xor(i, 1) + 1, 1)) - 1 AS BIGINT))),
      lambda c, x: xor(c >> 4, CRC_NIBBLES[(xor(c, x) & 15) + 1])), CAST(4294967295 AS BIGINT)) % 10000 AS bucket
  FROM names
), s AS (
  SELECT bucket, sum(n) AS n FROM dn JOIN crc USING (f) GROUP BY bucket
), t AS (
  SELECT bucket, sum(n) AS n FROM bn JOIN crc USING (f) GROUP BY bucket
), a AS (
  SELECT (SELECT coalesce(sum(n), 0) FROM s) AS s_all, (SELECT coalesce(sum(n), 0) FROM t) AS t_all
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE))
      / (CAST(s.n + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), a
), m AS (
  SELECT rid, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight
  FROM dn JOIN crc USING (f) JOIN g USING (bucket) GROUP BY rid
), r AS (
  SELECT rid, doc_id, len(w) >= 20 AS open, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))
      AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN m USING (rid)
), k AS (
  SELECT *, row_number() OVER (PARTITION BY open ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY open) AS n FROM r
)
SELECT doc_id, n_features, weight, score, CASE WHEN open AND place <= 25 * n // 100 THEN place END AS rank FROM k
""".replace("CRC_NIBBLES", str(CRC_NIBBLES))


@query
def op12_language(spark: SparkSession, sf: str) -> DataFrame:
    return langid.report(table(spark, sf, "documents"))
