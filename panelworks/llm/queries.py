"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelworks.llm import ctw, decontam, divergence, langid, mixing, quality, recompress, sharding, sigtree, simhash, urlfilter, warc, whitening

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@query
def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 16)


@query
def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir), keep=["doc_id"])
    return judged.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op5_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pages(spark, sf_dir)
    judged = urlfilter.judge(table, urlfilter.listed_urls(table), keep=["page_id"])
    return judged.select("_row.page_id", "host", "path", "rule", "verdict", "listed")


ORACLES["op5_bloom_url_filter"] = r"""
WITH u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
c AS (SELECT *, regexp_replace(host, '^(www|m|blog)\.', '') || regexp_replace(path, '(\.html)?/*$', '') AS canonical,
             list_has_any(string_split(host, '.'), ['casino-win', 'free-bets', 'cheap-pills', 'ads-track']) AS bad FROM u),
t AS (SELECT host, path FROM c WHERE bad UNION ALL SELECT host, regexp_extract(x, '(?s)^([^?#]*)', 1) FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '<a href="([^"]*)"', 1)) AS x FROM c WHERE bad) WHERE starts_with(x, '/')),
l AS (SELECT DISTINCT canonical FROM (SELECT regexp_replace(host, '^(www|m|blog)\.', '') || regexp_replace(path, '(\.html)?/*$', '') AS canonical FROM t) WHERE canonical <> ''),
r AS (SELECT c.*, l.canonical IS NOT NULL AS listed,
  CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c LEFT JOIN l USING (canonical))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
""".replace("\\\\", "\\")


@query
def op9_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), keep=["doc_id"])
    return mixed.select("_row.doc_id", "size", "source_size", "target", "taken")


@query
def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op2_spaced_seed_decontamination"] = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS v FROM benchmark),
ds AS (SELECT doc_id, pos, w[pos+1] AS x, w[pos+2] AS y FROM (SELECT doc_id, w, unnest(range(0, len(w) - 1)) AS pos FROM d)),
bs AS (SELECT item_id, q, v[q+1] AS x, v[q+2] AS y FROM (SELECT item_id, v, unnest(range(0, len(v) - 1)) AS q FROM b)),
h AS (SELECT DISTINCT doc_id, item_id, pos - q AS diag FROM ds JOIN bs USING (x, y)),
p AS (SELECT doc_id, item_id, diag, len(v) AS n, [CASE WHEN v[i] = w[diag + i] THEN 1 ELSE 0 END FOR i IN range(greatest(-diag, 0) + 1, least(len(v), len(w) - diag) + 1)] AS same
      FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
r AS (SELECT doc_id, item_id, diag, n, list_sum(same) AS n_agree, list_max([list_sum(same[i:i+12]) FOR i IN range(1, greatest(len(same) - 12, 1) + 1)]) AS n_best FROM p)
SELECT doc_id, item_id, diag AS doc_start, n_best::BIGINT AS n_best, n_agree::BIGINT AS n_agree FROM r WHERE n_best >= CASE WHEN n < 8 THEN n ELSE ceil(least(13, n) * 0.8) END
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_best DESC, n_agree DESC, diag) = 1
"""


@query
def op8_signature_tree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.jaccard_components(documents(spark, sf_dir))


ORACLES["op8_signature_tree_jaccard"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE [w[i:i+2] FOR i IN range(1, len(w) - 1)] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
m AS (SELECT v, min(c) AS component_id FROM r GROUP BY v),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.v = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""


@query
def op6_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op6_recompression_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS m FROM x),
f AS (SELECT m, min(doc_id) AS first FROM h GROUP BY m),
r AS (SELECT DISTINCT doc_id, i + k AS pos FROM h JOIN f USING (m), (SELECT unnest(range(0, 13)) AS k) WHERE first < doc_id),
g AS (SELECT doc_id, list(pos) AS gone FROM r GROUP BY doc_id),
o AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)),
z AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, w, gone FROM o),
y AS (SELECT z.doc_id, string_agg(w[pos], ' ' ORDER BY pos) AS kept FROM z WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = z.doc_id AND r.pos = z.pos) GROUP BY z.doc_id)
SELECT o.doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM o LEFT JOIN y USING (doc_id)
"""


@query
def op3_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(documents(spark, sf_dir))


@query
def op7_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(pages(spark, sf_dir)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


@query
def op11_generalised_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


ORACLES["op12_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT row, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v))::BIGINT AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN gn USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v)))::BIGINT AS q FROM c JOIN v USING (lang) GROUP BY lang, term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pv ON pv.lang = x.lang AND pv.source = x.source AND pv.item = y.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pr
UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM t) WHERE rank <= 10
"""

@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES["op7_warc_writer"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p),
d AS (SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1) FOR i IN range(0, 32)], '') AS b FROM s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, b AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d
"""


def _quality_sql() -> str:
    """The same rules and the same EM, 25 rounds of it, in SQL."""
    rules = quality.RULES
    at = [(r, x) for r in range(len(rules)) for x in (-1, 0, 1)]
    votes = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END" for r in rules)
    start = {k: "[" + ", ".join(f"{quality.START[k][x]}::DOUBLE" for _, x in at) + "]" for k in ("good", "bad")}
    odds = " + ".join(f"ln(good[{3 * r + 2} + v[{r + 1}]] / bad[{3 * r + 2} + v[{r + 1}]])" for r in range(len(rules)))
    sums = {k: "[" + ", ".join(f"(sum(CASE WHEN v[{r + 1}] = {x} THEN n * {w} ELSE 0 END) + 0.5) / (sum(n * {w}) + 1.5)" for r, x in at) + "]" for k, w in (("good", "q"), ("bad", "(1 - q)"))}
    stops = ", ".join(f"'{x}'" for x in quality.STOPS)
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT row, unnest(range(1, len(w) - 1)) AS i, w FROM (SELECT row_number() OVER () AS row, w FROM (SELECT DISTINCT w FROM t)) WHERE len(w) >= 3),
k AS (SELECT w, i, count(*) OVER (PARTITION BY row, w[i], w[i+1], w[i+2]) AS c FROM g),
rep AS (SELECT w, count(DISTINCT i + j) AS n_repeat_words FROM k, (SELECT unnest([0, 1, 2]) AS j) WHERE c > 1 GROUP BY w),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
  len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '!')) AS n_shouts, len(list_filter(w, lambda x: NOT regexp_matches(x, '[\pL\pN.,;:?)"'']$'))) AS n_odd_ends, len(list_intersect(list_distinct(w), [{stops}])) AS n_stops FROM t LEFT JOIN rep USING (w)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{votes}] AS v FROM m),
p AS (SELECT v, count(*) AS n FROM f WHERE NOT base_failed GROUP BY v),
em AS (SELECT 0 AS round, 0.8::DOUBLE AS prior, {start["good"]} AS good, {start["bad"]} AS bad UNION ALL
  SELECT round + 1, (sum(n * q) + 1) / (sum(n) + 2), {sums["good"]}, {sums["bad"]} FROM (SELECT round, v, n, 1 / (1 + exp(-(ln(prior / (1 - prior)) + {odds}))) AS q FROM em, p WHERE round < 25) GROUP BY round)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 1 / (1 + exp(-(ln(prior / (1 - prior)) + {odds}))) >= 0.5 AS kept FROM f, (SELECT * FROM em ORDER BY round DESC LIMIT 1)
"""


ORACLES["op4_weak_supervision"] = _quality_sql()
