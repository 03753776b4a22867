"""The queries ``opN_<name>`` and ``pipeline``: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.llm import decontamination, html_extraction, jaccard_join, language_id, line_dedup, periodic_runs, pseudonyms, quality_rules, secret_scan, sequence_packing, spelling_variants, token_counts, toxicity

from postroom.llm.common import fold, table, tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_id FROM documents
), w AS (
  SELECT doc_id, row_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), m AS (
  SELECT doc_id, row_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
         (length(text) - length(replace(text, '!!', ''))) // 2 AS shouts
  FROM w
), g AS (
  SELECT row_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT row_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), twice AS (
  SELECT row_id, i FROM g QUALIFY count(*) OVER (PARTITION BY row_id, win) > 1
), r AS (
  SELECT row_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row_id
), f AS (
  SELECT m.*, coalesce(r.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed
  FROM m LEFT JOIN r USING (row_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_symbols <= 25 * n_words AND 100 * n_dup_lines <= 60 * n_lines
         AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 100 * capitals <= 50 * letters
         AND 100 * shouts <= 30 * n_words AS kept
FROM f
"""


@query(OP10_SQL)
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"), measures=True).drop("rejected_by")


@query()
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return sequence_packing.pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query()
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.measure(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


def held_out(df: DataFrame) -> DataFrame:
    """Result rows with the fold that learning never sees."""
    return df.withColumn("held_out", F.coalesce(fold("doc_id") == 2, F.lit(False)))


@query()
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return held_out(language_id.identify(docs, language_id.fit(docs, train=fold("doc_id") != 2)))


@query()
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), train=fold("doc_id") != 2)
    return held_out(toxicity.score(docs, model))


@query()
def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.extract(table(spark, folder, "pages"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, row_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS g
  FROM d
), k AS (
  SELECT min(row_id) AS node, min(doc_id) AS least, g FROM s WHERE len(g) > 0 GROUP BY g
), t AS (
  SELECT node, len(g) AS n, unnest(g) AS t FROM k
), links AS (
  SELECT a.node AS x, b.node AS y FROM t a JOIN t b ON a.t = b.t AND a.node < b.node AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), walk AS (
  WITH RECURSIVE r AS (SELECT node, node AS other FROM k UNION SELECT r.node, b.y FROM r JOIN both_ways b ON r.other = b.x)
  SELECT r.node, min(k.least) AS component_id FROM r JOIN k ON k.node = r.other GROUP BY r.node
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE w.component_id END AS component_id
FROM s LEFT JOIN k ON k.g = s.g LEFT JOIN walk w ON w.node = k.node
"""


@query(OP9_SQL)
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join(table(spark, folder, "documents"))


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
), d AS (
  SELECT doc_id, row_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    ELSE [array_to_string(w, ' ')] END AS h
  FROM words WHERE len(w) > 0
), item_words AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
), b AS (
  SELECT item_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    ELSE [array_to_string(w, ' ')] END AS g
  FROM item_words WHERE len(w) > 0
), met AS (
  SELECT DISTINCT x.row_id, y.item_id
  FROM (SELECT row_id, unnest(h) AS t FROM d) x JOIN (SELECT item_id, unnest(g) AS t FROM b) y USING (t)
), windows AS (
  SELECT d.doc_id, b.item_id, d.h[p:p + least(len(d.h), len(b.g)) - 1] AS part, b.g
  FROM met JOIN d USING (row_id) JOIN b USING (item_id), unnest(range(1, len(d.h) - least(len(d.h), len(b.g)) + 2)) AS s(p)
), counted AS (
  SELECT doc_id, item_id, len(part) + len(g) AS total, CAST(list_sum(list_transform(list_distinct(part),
           lambda t: least(len(list_filter(part, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))) AS BIGINT) AS both_have
  FROM windows WHERE len(list_intersect(part, g)) > 0
)
SELECT doc_id, item_id, max(both_have / (total - both_have)) AS similarity
FROM counted WHERE 100 * both_have >= 80 * (total - both_have) GROUP BY doc_id, item_id
"""


@query(OP8_SQL)
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op6_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymize(docs, "pseudonym key of the test tables")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), k AS (
  SELECT doc_id, row_id, lines, list_transform(lines, lambda x: translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys
  FROM d
), common AS (
  SELECT key FROM (SELECT row_id, unnest(list_distinct(keys)) AS key FROM k) WHERE length(key) >= 1 GROUP BY key HAVING count(*) >= 10
), marked AS (
  SELECT x.row_id, x.line, c.key IS NOT NULL AS dropped
  FROM (SELECT row_id, unnest(keys) AS key, generate_subscripts(keys, 1) AS line FROM k) x LEFT JOIN common c USING (key)
), per AS (
  SELECT row_id, list(line ORDER BY line) FILTER (NOT dropped) AS stay, count(*) FILTER (dropped) AS n_dropped FROM marked GROUP BY row_id
)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped,
       sha256(array_to_string(list_transform(coalesce(stay, []), lambda i: lines[i]), chr(10))) AS kept_sha256
FROM k JOIN per USING (row_id)
"""


@query(OP11_SQL)
def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.drop_common_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query()
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.group_variants(table(spark, folder, "documents"), spoil=True)


@query()
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.find_runs(table(spark, folder, "documents"), plant=True).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    )


@query()
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
