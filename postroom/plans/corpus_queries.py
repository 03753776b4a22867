"""Queries over documents and pages: cleaning, sections, chunks, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.functions import quality as ql
from postroom.functions import lexicon as lx
from postroom.functions import text as tx
from postroom.functions.lexicon import PROTECTED_TOKEN
from postroom.operators import corpus as cp
from postroom.operators import dedup as dd
from postroom.plans import rules as ru
from postroom.plans import sql
from postroom.plans.registry import Tables, query

NEAR = (7, 10)
_JOIN = r"([^。！？.!?:：；;\n])\n([^\n#\-*0-9])"
_CLEAN_SQL = rf"""lined AS (
      SELECT doc_id, text, list_transform(string_split(text, chr(10)),
          lambda l: trim(regexp_replace(regexp_replace(l, '[\x00-\x08\x0b\x0c\x0e-\x1f]+', ' ', 'g'), '\s+', ' ', 'g'))) AS lines
      FROM documents),
    kept AS (SELECT *, list_filter(lines, lambda l: NOT (regexp_matches(l, '^[-_—=]{{3,}}$')
          OR regexp_matches(l, '(?i)^(page\s*)?\d+(/\d+)?$') OR regexp_matches(l, '^第\s*\d+\s*页\s*(共\s*\d+\s*页)?$'))) AS good
      FROM lined),
    joined AS (SELECT *, regexp_replace(regexp_replace(array_to_string(good, chr(10)), '{_JOIN}', '\1 \2', 'g'),
          '{_JOIN}', '\1 \2', 'g') AS j FROM kept),
    cleaned AS (SELECT *, trim(regexp_replace(regexp_replace(j, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'),
          ' ' || chr(10)) AS clean FROM joined)"""


@query(
    f"""WITH {_CLEAN_SQL}
    SELECT doc_id, length(text)::INT AS original_chars, length(clean)::INT AS cleaned_chars,
      (len(lines) - len(good))::INT AS noise_lines_removed, sha256(clean) AS content_hash FROM cleaned"""
)
def doc_clean_report(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaning report and hash of the cleaned text of every document."""
    cleaned = cp.clean_documents(Tables(spark, sf).spread("documents", "doc_id", "text"), "text")
    return cleaned.select(
        "doc_id", "original_chars", "cleaned_chars", "noise_lines_removed", F.sha2("clean_text", 256).alias("content_hash")
    )


def _heading(block):
    """Section headings, or a very short line."""
    return F.coalesce(F.nullif(tx.section_heading(block), F.lit("")), F.when(F.length(block) <= 12, block), F.lit(""))


def _standalone(block):
    return tx.is_standalone_heading(block) | (F.length(block) <= 12)


_SECTIONS_SQL = rf"""parts AS (
      SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
    blocks AS (SELECT doc_id, unnest(l) AS b, unnest(range(1, len(l) + 1)) AS pos FROM parts),
    headed AS (SELECT *, regexp_extract(b, '^#{{1,4}}\s+(.+)$', 1) AS md FROM blocks),
    titled AS (SELECT *, CASE WHEN md <> '' THEN left(trim(md), 120)
          WHEN length(b) <= 80 AND (regexp_matches(b, '^\d+(\.\d+)*[.、 ]+[一-鿿A-Za-z].+') OR regexp_matches(b, '[:：]$'))
            THEN left(trim(b, ':：'), 120)
          WHEN length(b) <= 12 THEN b ELSE '' END AS heading,
        md <> '' OR length(b) <= 12 AS alone FROM headed),
    assigned AS (SELECT *, sum((heading <> '')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM titled),
    sectioned AS (SELECT doc_id, part, coalesce(max(heading), '') AS section_title,
        string_agg(b, chr(10) ORDER BY pos) FILTER (NOT (heading <> '' AND alone)) AS body,
        count(*) FILTER (NOT (heading <> '' AND alone)) AS block_count
      FROM assigned GROUP BY doc_id, part),
    sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS position, section_title,
        block_count, body FROM sectioned WHERE block_count > 0)"""


def doc_section_rows(t: Tables) -> DataFrame:
    docs = cp.with_sections(
        t.spread("documents", "doc_id", "text"), "text", separator="\n", heading=_heading, standalone=_standalone
    )
    return docs.select("doc_id", F.posexplode_outer("sections").alias("position", "s")).filter("position IS NOT NULL").select(
        "doc_id",
        F.col("position").cast("long").alias("position"),
        F.col("s.section_title").alias("section_title"),
        F.size("s.blocks").cast("long").alias("block_count"),
        F.array_join("s.blocks", "\n").alias("content"),
    )


@query(
    f"""WITH {_SECTIONS_SQL} SELECT doc_id, position, section_title, block_count, sha256(body) AS content_hash FROM sections"""
)
def doc_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of every document, whole texts."""
    rows = doc_section_rows(Tables(spark, sf))
    return rows.withColumn("content_hash", F.sha2("content", 256)).drop("content")


@query()
def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of every document: clean, section, split, pack with overlap."""
    docs = cp.clean_documents(Tables(spark, sf).spread("documents", "doc_id", "source", "text"), "text")
    titled = docs.select("doc_id", "source", "clean_text", tx.title(F.col("clean_text"), F.col("source")).alias("title"))
    return cp.chunk_documents(
        titled,
        key="doc_id",
        text="clean_text",
        title="title",
        source="source",
        separator="\n",
        heading=_heading,
        standalone=_standalone,
        category_rules=ru.FIRST_MATCH,
    )


@query(
    rf"""WITH {_SECTIONS_SQL}
    SELECT doc_id, count(*) AS chunk_count, sum(length(body))::BIGINT AS content_chars,
      sum(len(regexp_extract_all(body, '[a-zA-Z0-9_]+')))::BIGINT AS token_estimate,
      count(DISTINCT CASE WHEN section_title <> '' THEN section_title END) AS section_count,
      count(*) FILTER (length(body) > 0) AS chunks_with_text
    FROM sections GROUP BY doc_id"""
)
def doc_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Parse report per document, sections as its pieces."""
    rows = doc_section_rows(Tables(spark, sf))
    return cp.document_rollup(rows.withColumn("token_estimate", tx.word_count_tokens(F.col("content"))), "doc_id")


@query(
    f"""WITH {_SECTIONS_SQL}, c AS (SELECT doc_id, count(*) AS n FROM sections GROUP BY doc_id),
    v AS (SELECT doc_id, max(quality + 1) AS v FROM labels GROUP BY doc_id)
    SELECT doc_id, source, coalesce(n, 0) AS chunk_count, coalesce(v, 0) AS current_version
    FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN v USING (doc_id)"""
)
def document_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with piece count and current version, newest first."""
    t = Tables(spark, sf)
    versions = t.labels.select("doc_id", (F.col("quality") + 1).alias("version_number"))
    docs = t.documents.select("doc_id", "source")
    return cp.document_listing(docs, doc_section_rows(t), versions, "doc_id", "doc_id")


_HTML_SQL = "html"
for _name, _char in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("amp", "&")):
    _HTML_SQL = f"replace({_HTML_SQL}, '&{_name};', {sql.text(_char)})"
for _tag in tx.HIDDEN_TAGS:
    _HTML_SQL = rf"regexp_replace({_HTML_SQL}, '<{_tag}([\s/][^>]*)?>.*?</{_tag}\s*>', '', 'gis')"
for _pattern, _put, _mode in (
    ("<!--.*?-->", "", "gs"),
    ("<![^>]*>", "", "g"),
    (r">\s+<", "><", "g"),
    (r"<li([\s/][^>]*)?>", "\n- ", "gi"),
    (rf"<(?:{tx.BREAK_BEFORE_TAGS})([\s/][^>]*)?>", "\n", "gi"),
    (rf"</(?:{tx.BREAK_AFTER_TAGS})\s*>", "\n", "gi"),
    ("</?[A-Za-z][^>]*>", "", "g"),
):
    _HTML_SQL = f"regexp_replace({_HTML_SQL}, {sql.text(_pattern)}, {sql.text(_put)}, '{_mode}')"


@query(
    rf"""WITH v AS (SELECT page_id, url, trim({_HTML_SQL}, ' ' || chr(10)) AS t FROM pages),
    w AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(t, '<[^>]+>', '', 'g'), '[ \t]+\n', chr(10), 'g'),
        '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS visible FROM v)
    SELECT page_id, length(visible)::INT AS visible_chars, sha256(visible) AS visible_hash FROM w"""
)
def html_visible_text(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text of every page."""
    shown = tx.with_visible_text(Tables(spark, sf).spread("pages", "page_id", "html"), "html", "visible")
    return shown.select(
        "page_id", F.length("visible").alias("visible_chars"), F.sha2("visible", 256).alias("visible_hash")
    )


_KEY_SQL = r"regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_]+', '', 'g')"


@query(
    f"""SELECT sha256(k) AS content_hash, min(doc_id) AS first_id, count(*) AS copies
    FROM (SELECT doc_id, {_KEY_SQL} AS k FROM documents) GROUP BY 1 HAVING count(*) > 1"""
)
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of documents with the same normalised body."""
    return dd.exact_duplicates(Tables(spark, sf).documents, "doc_id", tx.content_key(F.col("text")))


_SHINGLES = " UNION ALL ".join(
    f"SELECT id, unnest(regexp_extract_all(substr(body, {i}), '.{{12}}')) AS s FROM bodies WHERE chars >= 12" for i in range(1, 13)
)


def _near_sql(threshold: tuple[int, int]) -> str:
    return f"""WITH keyed AS (SELECT doc_id, {_KEY_SQL} AS body FROM documents),
    firsts AS (SELECT body, min(doc_id) AS id FROM keyed GROUP BY body),
    bodies AS MATERIALIZED (SELECT id, body, length(body) AS chars FROM firsts WHERE body <> ''),
    shingles AS MATERIALIZED (SELECT DISTINCT id, hash(s) AS h FROM ({_SHINGLES}
        UNION ALL SELECT id, body FROM bodies WHERE chars < 12)),
    sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
    shared AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.h = b.h AND a.id < b.id GROUP BY 1, 2),
    short AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, 0 AS c FROM bodies a JOIN bodies b
        ON a.chars < 12 AND b.chars >= a.chars AND b.id <> a.id AND b.chars * {threshold[0]} <= a.chars * {threshold[1]} AND contains(b.body, a.body)),
    pairs AS (SELECT a, b, max(c) AS c FROM (SELECT * FROM shared UNION ALL SELECT * FROM short) GROUP BY a, b),
    judged AS (SELECT p.a, p.b, c,
        CASE WHEN x.chars <= y.chars THEN contains(y.body, x.body) ELSE contains(x.body, y.body) END AS inside,
        least(x.chars, y.chars) AS lo, greatest(x.chars, y.chars) AS hi, s.n + t.n - c AS u
      FROM pairs p JOIN bodies x ON x.id = a JOIN bodies y ON y.id = b JOIN sizes s ON s.id = a JOIN sizes t ON t.id = b),
    scored AS (SELECT a, b, CASE WHEN inside THEN lo ELSE c END AS top, CASE WHEN inside THEN hi ELSE u END AS bottom FROM judged),
    hits AS (SELECT b, min(a) AS a, arg_min(top / bottom, a) AS similarity FROM scored
        WHERE top * {threshold[1]} >= bottom * {threshold[0]} GROUP BY b)
    SELECT doc_id, f.id AS first_id, h.a AS similar_id, round(h.similarity, 6) AS similarity
    FROM keyed k JOIN firsts f USING (body) LEFT JOIN hits h ON h.b = f.id"""


@query(_near_sql(NEAR))
def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Earliest earlier near copy of every document, over whole texts."""
    docs = Tables(spark, sf).spread("documents", "doc_id", "text")
    near = dd.near_duplicates(docs, key="doc_id", text="text", threshold=NEAR)
    return near.withColumn("similarity", F.round("similarity", 6))


@query(
    f"""SELECT count(similar_id) AS with_copy, true AS recall_is_enough, 0::BIGINT AS wrong
    FROM (SELECT DISTINCT first_id, similar_id FROM ({_near_sql(NEAR)}))"""
)
def near_duplicate_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate against exact mode: bodies with an earlier near copy, whether nine in ten are found, hits that are none."""
    docs = Tables(spark, sf).spread("documents", "doc_id", "text")
    keyed = dd.stored_bodies(docs, "doc_id", "text")
    exact = dd.similar_bodies(docs, key="doc_id", text="text", threshold=NEAR, keyed=keyed)
    fast = dd.similar_bodies_approximate(docs, key="doc_id", text="text", threshold=NEAR, keyed=keyed)
    both = exact.select("id", F.lit(1).alias("e")).join(fast.select("id", F.lit(1).alias("f")), "id", "full")
    found = F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull())
    return both.agg(
        F.count("e").alias("with_copy"), (10 * found >= 9 * F.count("e")).alias("recall_is_enough"),
        F.count_if(F.col("e").isNull()).alias("wrong"),
    )


_BLOCKS_SQL = r"""WITH s AS (SELECT doc_id, lower(source) AS stem, regexp_replace(lower(left(trim(list_filter(list_transform(
          string_split(text, chr(10)), lambda x: trim(x, '# ')), lambda x: x <> '')[1], '# '), 120)), '[^0-9a-z一-鿿]+', '', 'g') AS title
        FROM documents),
    n AS (SELECT s.doc_id, min(o.doc_id) AS same_name_id FROM s JOIN s o ON o.stem = s.stem AND o.doc_id < s.doc_id GROUP BY 1),
    t AS (SELECT s.doc_id, min(o.doc_id) AS similar_title_id FROM s JOIN s o ON o.doc_id < s.doc_id AND s.title <> ''
        AND o.title <> '' AND (contains(s.title, o.title) OR contains(o.title, s.title)) GROUP BY 1)
    SELECT doc_id, same_name_id, similar_title_id FROM s LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query(_BLOCKS_SQL)
def blocking_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Earliest document with the same file stem, and with a title inside or around this one's."""
    title = tx.title(F.col("text"), F.col("source"), strict=False)
    docs = Tables(spark, sf).documents.select("doc_id", "source", title.alias("title"))
    return (
        docs.select("doc_id")
        .join(dd.same_file_name(docs, "doc_id", "source"), "doc_id", "left")
        .join(dd.similar_titles(docs, "doc_id", "title"), "doc_id", "left")
    )


@query(
    f"""WITH {_CLEAN_SQL},
    strong AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY clean) < doc_id AS is_strong, min(doc_id) OVER (PARTITION BY clean) AS first_id FROM cleaned),
    near AS ({_near_sql(lx.NEAR_DUPLICATE_THRESHOLD)}), blocks AS ({_BLOCKS_SQL}),
    found AS (SELECT doc_id, CASE WHEN is_strong THEN s.first_id END AS strong_id,
        CASE WHEN n.first_id < doc_id THEN least(n.first_id, coalesce(n.similar_id, n.first_id)) ELSE n.similar_id END AS similar_id,
        same_name_id, similar_title_id FROM strong s LEFT JOIN near n USING (doc_id) JOIN blocks USING (doc_id))
    SELECT *, CASE WHEN strong_id IS NOT NULL THEN 'content_hash' WHEN similar_id IS NOT NULL THEN 'content_similarity'
        WHEN same_name_id IS NOT NULL THEN 'same_filename' WHEN similar_title_id IS NOT NULL THEN 'similar_title' ELSE '' END AS reason,
      CASE WHEN strong_id IS NOT NULL THEN 'reject' WHEN coalesce(similar_id, same_name_id, similar_title_id) IS NOT NULL THEN 'confirm'
        ELSE 'accept' END AS decision FROM found"""
)
def upload_precheck(spark: SparkSession, sf: str) -> DataFrame:
    """Upload decision of every document against all earlier ones; equal means equal once cleaned."""
    docs = cp.clean_documents(Tables(spark, sf).spread("documents", "doc_id", "source", "text"), "text").withColumn(
        "title", tx.title(F.col("text"), F.col("source"), strict=False)
    )
    return dd.precheck(docs, key="doc_id", text="text", title="title", source="source", content="clean_text")


def _fold(column: str) -> str:
    """The checker's word class is ASCII only, so other letters become a word character there."""
    return f"regexp_replace({column}, '[^\\x00-\\x7f¥￥€£年月日]', '_', 'g')"


def _tokens_sql(column: str) -> str:
    return f"regexp_extract_all({_fold(column)}, {sql.text('(?i)' + PROTECTED_TOKEN)})"


@query(
    f"""WITH {_CLEAN_SQL}, found AS (SELECT *, {_tokens_sql('text')} AS a, {_tokens_sql('clean')} AS b FROM cleaned)
    SELECT doc_id, len(a) AS token_count, sha256(array_to_string(a, ' ')) AS token_hash,
      clean <> '' AND a = b AND abs(length(clean) - length(text)) / greatest(length(text), 1) <= 0.22 AS edit_is_safe
    FROM found"""
)
def protected_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Protected tokens of every document, and whether cleaning it is a safe edit."""
    cleaned = cp.clean_documents(Tables(spark, sf).spread("documents", "doc_id", "text"), "text")
    found = cleaned.withColumns(
        {"before": ql.protected_tokens(F.col("text")), "after": ql.protected_tokens(F.col("clean_text"))}
    )
    folded = F.regexp_replace(F.array_join("before", " "), "[^\\x00-\\x7f¥￥€£年月日]", "_")
    return found.select(
        "doc_id",
        F.size("before").cast("long").alias("token_count"),
        F.sha2(folded, 256).alias("token_hash"),
        ql.edit_is_safe(F.col("text"), F.col("clean_text"), tokens=(F.col("before"), F.col("after"))).alias("edit_is_safe"),
    )


@query(
    r"""SELECT doc_id, CASE WHEN length(f) <= 260 THEN f ELSE rtrim(left(f, 260)) || '...' END AS snippet,
      trim(left(text, 3000), ' ' || chr(10)) AS preview, (len(regexp_extract_all(text, '[a-zA-Z0-9_]+')))::INT AS words,
      greatest(1, round_even((length(text) - length(o)) / 4.0::DOUBLE + length(o) / 1.6::DOUBLE, 0))::BIGINT AS tokens,
      round((length(regexp_replace(text, '[^一-鿿A-Za-z0-9，。！？、；：,.!?;:''"()\[\]《》<>/\-_\s]', '', 'g')) / length(text))::DOUBLE, 6) AS readable
    FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f,
        regexp_replace(text, '[\x00-\x7f]', '', 'g') AS o FROM documents)"""
)
def text_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Snippet, preview, token estimates and readable share of every document."""
    text = F.col("text")
    return Tables(spark, sf).spread("documents", "doc_id", "text").select(
        "doc_id",
        tx.snippet(text).alias("snippet"),
        tx.preview(text).alias("preview"),
        tx.word_count_tokens(text).alias("words"),
        tx.byte_class_tokens(text).alias("tokens"),
        F.round(tx.readable_ratio(text), 6).alias("readable"),
    )
