"""Queries over vectors and search terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.functions import lexicon as lx
from postroom.functions import scoring as sc
from postroom.functions.matching import first_match
from postroom.operators import evaluation as ev
from postroom.operators import retrieval as rt
from postroom.operators.expectations import judge
from postroom.operators.lifecycle import document_status
from postroom.plans import rules as ru
from postroom.plans import sql
from postroom.plans.registry import Tables, query
from postroom.session import cut_lineage

DIM = lx.VECTOR_DIMENSIONS


def _weights_sql(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name`` with the sparse hashed vectors of a relation."""
    return f"""{name}_tokens AS (SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '[a-z0-9_]+')) AS tok FROM {source}),
    {name}_counts AS (SELECT id, tok, count(*) AS n, sha256(tok) AS h FROM {name}_tokens GROUP BY id, tok),
    {name}_sums AS (SELECT id, (('0x' || substr(h, 1, 8))::BIGINT % {DIM})::INT AS bucket,
        sum(n * CASE WHEN contains('02468ace', substr(h, 10, 1)) THEN 1 ELSE -1 END)::DOUBLE AS s FROM {name}_counts GROUP BY 1, 2),
    {name} AS (SELECT id, bucket, round(s / sqrt(sum(s * s) OVER (PARTITION BY id)), 6) AS weight FROM {name}_sums WHERE s <> 0)"""


@query(f"WITH {_weights_sql('w', 'documents', 'doc_id', 'text')} SELECT id AS doc_id, bucket, weight FROM w")
def hashed_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse hashed vectors of all documents."""
    return rt.hashed_weights(Tables(spark, sf).spread("documents", "doc_id", "text"), "doc_id", "text")


_PAIR_SQL = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"""


@query(
    f"""WITH {_PAIR_SQL},
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS row_id, round(list_cosine_similarity(q.e, c.e), 9) AS similarity
        FROM v q JOIN v c ON q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS recall_rank FROM s)
    SELECT query_id, row_id, round(similarity, 6) AS similarity, recall_rank FROM r WHERE recall_rank <= 3"""
)
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Exact nearest three of every vector."""
    vectors = Tables(spark, sf).embeddings
    found = rt.vector_recall(vectors, vectors, query_key="vec_id", corpus_key="vec_id", limit=3, exclude_self=True)
    return found.withColumn("similarity", F.round("similarity", 6)).withColumn("recall_rank", F.col("recall_rank").cast("long"))


LISTS, PROBES = 32, 24  # the vectors of the test tables have no clusters: three lists in four hold nine neighbours in ten


@query("""SELECT count(*) AS queries, sum(least(10, n - 1))::BIGINT AS wanted, true AS recall_is_enough
    FROM embeddings, (SELECT count(*) AS n FROM embeddings) WHERE vec_id % 100 = 0""")
def vector_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Inverted vector index against the exact ten nearest, for every hundredth vector: are nine in ten found?"""
    vectors = Tables(spark, sf).embeddings.select("vec_id", "embedding")
    asked = vectors.filter("vec_id % 100 = 0")
    names = {"query_key": "vec_id", "corpus_key": "vec_id", "limit": 10, "exclude_self": True}
    exact = rt.vector_recall(asked, vectors, **names).select("query_id", "row_id")
    found = rt.indexed_recall(asked, vectors, rt.learn_lists(vectors, lists=LISTS), probes=PROBES, **names).select("query_id", "row_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "row_id"], "left").agg(
        F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), (10 * F.count("hit") >= 9 * F.count("*")).alias("recall_is_enough")
    )


@query(
    f"""WITH {_PAIR_SQL},
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS row_id, round(list_cosine_similarity(q.e, c.e), 9) AS similarity
        FROM v q JOIN v c ON q.label = c.label AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS recall_rank FROM s)
    SELECT query_id, row_id, round(similarity, 6) AS similarity, recall_rank FROM r WHERE recall_rank <= 24"""
)
def category_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall stage: the nearest 24 rows of the query's own category."""
    vectors = Tables(spark, sf).embeddings
    found = rt.vector_recall(
        vectors, vectors, query_key="vec_id", corpus_key="vec_id", limit=lx.RECALL_MINIMUM, group="label", exclude_self=True
    )
    return found.withColumn("similarity", F.round("similarity", 6)).withColumn("recall_rank", F.col("recall_rank").cast("long"))


@query(
    """SELECT vec_id, len(embedding) AS dimensions,
      round(list_sum(list_transform(embedding, lambda x: round(x::DOUBLE, 6))), 4) AS total,
      0 AS broken_dimensions FROM embeddings"""
)
def vector_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors to their text form and back; damaged text decodes to an empty vector."""
    literal = Tables(spark, sf).embeddings.select("vec_id", sc.vector_literal(F.col("embedding")).alias("text"))
    decoded = literal.select(
        "vec_id",
        sc.decode_vector(F.col("text")).alias("v"),
        sc.decode_vector(F.concat(F.lit("x"), F.col("text"))).alias("broken"),
    )
    return decoded.select(
        "vec_id",
        F.size("v").cast("long").alias("dimensions"),
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
        F.size("broken").alias("broken_dimensions"),
    )


@query(
    f"""WITH {_weights_sql('w', 'documents', 'doc_id', 'text')},
    stored AS (SELECT doc_id, CASE WHEN label < 5 THEN len(embedding) END AS d FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
    filled AS (SELECT id, count(*) AS n, round(sum(weight) * 1000000)::BIGINT AS total FROM w GROUP BY id)
    SELECT doc_id, {DIM} AS dimensions, coalesce(n, 0) AS non_zero, coalesce(total, 0) AS total
    FROM stored LEFT JOIN filled ON doc_id = id"""
)
def vector_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors that are missing, also for want of a row, or of a wrong length are hashed anew from the text."""
    t = Tables(spark, sf)
    stored = t.embeddings.select(
        F.col("vec_id").alias("doc_id"), F.when(F.col("label") < 5, F.col("embedding")).alias("embedding")
    )
    rows = t.documents.select("doc_id").join(stored, "doc_id", "left")
    repaired = rt.repair_vectors(rows, "doc_id", "text", texts=t.spread("documents", "doc_id", "text"))
    return repaired.select(
        "doc_id",
        F.size("embedding").alias("dimensions"),
        F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("non_zero"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x) * 1000000).cast("long").alias("total"),
    )


def _terms_sql(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name`` (id, terms): distinct words, pairs and triples."""
    return f"""{name}_words AS (SELECT {key} AS id, list_filter(regexp_extract_all(lower({text}), '[a-z0-9_]+'),
        lambda w: (length(w) >= 3 OR list_contains({sql.lister(lx.SHORT_SEARCH_TERMS)}, w))
            AND NOT list_contains({sql.lister(lx.STOP_WORDS)}, w)) AS w FROM {source}),
    {name} AS (SELECT id, list_distinct(list_concat(w, list_concat(
        list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS terms FROM {name}_words)"""


def _expand_sql(terms: str) -> str:
    groups = ", ".join(sql.lister(group) for group in ru.SYNONYMS)
    return (
        f"list_distinct(list_concat({terms}, flatten(list_filter([{groups}], lambda g: list_has_any({terms}, g)))))"
    )


@query(
    f"""WITH {_terms_sql('t', 'documents', 'doc_id', 'text')}, x AS (SELECT id, terms, {_expand_sql('terms')} AS expanded FROM t)
    SELECT id AS doc_id, len(terms) AS term_count, len(expanded) AS expanded_count,
      array_to_string(list_sort(list_filter(expanded, lambda e: NOT list_contains(terms, e))), ',') AS added FROM x"""
)
def term_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Search terms of every document and what the synonym groups add."""
    docs = Tables(spark, sf).spread("documents", "doc_id", "text")
    terms = sc.with_search_terms(docs, "text").drop("text")
    expanded = terms.withColumn("expanded", sc.expand_terms(F.col("terms"), ru.SYNONYMS))
    return expanded.select(
        "doc_id",
        F.size("terms").cast("long").alias("term_count"),
        F.size("expanded").cast("long").alias("expanded_count"),
        F.array_join(F.array_sort(F.array_except("expanded", "terms")), ",").alias("added"),
    )


def _weight(term: str) -> str:
    return (
        f"CASE WHEN contains({term}, ' ') THEN least(2.4::DOUBLE, 1.4::DOUBLE + 0.2::DOUBLE * len(string_split({term}, ' '))) "
        f"WHEN length({term}) >= 9 THEN 1.4::DOUBLE WHEN length({term}) >= 6 THEN 1.15::DOUBLE ELSE 0.8::DOUBLE END"
    )


def _weights(terms: str) -> str:
    return f"list_transform({terms}, lambda x: {_weight('x')})"


_CATEGORY_LIST = "CASE q.category " + " ".join(
    f"WHEN {sql.text(name)} THEN {sql.lister(terms)}" for name, terms in ru.VOCABULARY.items()
) + " ELSE []::VARCHAR[] END"
LIMIT = 3


@query(
    f"""WITH queries AS MATERIALIZED (SELECT item_id AS query_id, text, {sql.first_match("lower(text)", ru.FIRST_MATCH)} AS category FROM benchmark),
    chunks AS MATERIALIZED (SELECT doc_id AS row_id, 'Document ' || doc_id AS title, source, text AS content,
        {sql.first_match("lower(source || chr(10) || text)", ru.FIRST_MATCH)} AS category FROM documents WHERE regexp_matches(text, '\\S')),
    {_weights_sql('qw', 'queries', 'query_id', 'text')}, {_weights_sql('cw', 'chunks', 'row_id', 'content')},
    qn AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM qw GROUP BY id),
    cn AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM cw GROUP BY id),
    present AS (SELECT DISTINCT category FROM chunks),
    routed AS (SELECT *, category <> 'other' AND category IN (SELECT category FROM present) AS own FROM queries),
    dots AS (SELECT q.id AS qid, c.id AS cid, sum(q.weight * c.weight) AS dot FROM qw q JOIN cw c ON q.bucket = c.bucket GROUP BY 1, 2),
    sims AS (SELECT q.query_id, c.row_id, round(coalesce(dot / (qn.norm * cn.norm), 0), 9) AS similarity
        FROM routed q JOIN chunks c ON NOT q.own OR c.category = q.category
        LEFT JOIN dots ON qid = q.query_id AND cid = c.row_id LEFT JOIN qn ON qn.id = q.query_id LEFT JOIN cn ON cn.id = c.row_id),
    recalled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS r FROM sims) WHERE r <= 24),
    {_terms_sql('qt', 'queries', 'query_id', 'text')},
    asked AS (SELECT id, {_expand_sql('terms')} AS terms FROM qt),
    pairs AS (SELECT p.*, c.title, c.source, c.category AS row_category, q.category, c.content, a.terms,
        lower(c.title || chr(10) || c.source || chr(10) || c.content) AS body,
        list_filter(a.terms, lambda x: list_contains({_CATEGORY_LIST}, x)) AS intent
      FROM recalled p JOIN chunks c USING (row_id) JOIN queries q USING (query_id) JOIN asked a ON a.id = p.query_id),
    scored AS (SELECT *, least(1.0::DOUBLE, round(coalesce(list_sum((list_reverse_sort({_weights('list_filter(terms, lambda y: contains(body, y))')}))[1:6]), 0), 4) / 8.0::DOUBLE) AS k,
        CASE WHEN category = 'other' OR category <> row_category THEN 0.0::DOUBLE WHEN len(intent) = 0 THEN 0.65::DOUBLE
          ELSE least(1.0::DOUBLE, 0.65::DOUBLE + 0.35::DOUBLE * round(coalesce(list_sum({_weights('list_filter(intent, lambda y: contains(body, y))')}), 0), 4)
            / round(list_sum({_weights('intent')}), 4)) END AS c FROM pairs),
    mixed AS (SELECT *, greatest(0.0::DOUBLE, least(0.99::DOUBLE, similarity * 0.48::DOUBLE + k * 0.34::DOUBLE + c * 0.18::DOUBLE)) AS m FROM scored),
    final AS (SELECT *, CASE WHEN c > 0 AND (k > 0 OR similarity > 0) THEN greatest(m, 0.24::DOUBLE) ELSE m END AS s FROM mixed),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r) AS hit_rank FROM final WHERE s >= 0.18)
    SELECT query_id, row_id, hit_rank, title, source, row_category AS category,
      round(s, 2) AS score, round(similarity, 2) AS semantic_score, round(k, 2) AS keyword_score, round(c, 2) AS category_score,
      CASE WHEN s >= 0.6 THEN 'strong' WHEN s >= 0.35 THEN 'medium' ELSE 'weak' END AS reliability,
      CASE WHEN length(f) <= 260 THEN f ELSE rtrim(left(f, 260)) || '...' END AS snippet,
      coalesce(nullif(array_to_string({sql.compact((
        "CASE WHEN similarity >= 0.55 THEN '语义相似度较高' WHEN similarity >= 0.35 THEN '语义相关' END",
        "CASE WHEN k >= 0.4 THEN '关键词重合' WHEN k > 0 THEN '存在少量关键词交集' END",
        "CASE WHEN c > 0 THEN '邮件分类与知识分类一致' END"))}, '；'), ''), '综合语义、关键词和分类信号命中') AS match_reason
    FROM (SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS f FROM ranked) WHERE hit_rank <= {LIMIT}"""
)
def hybrid_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid retrieval of all documents for every benchmark text."""
    t = Tables(spark, sf)
    queries = t.benchmark.withColumn("t", F.lower("text")).select(
        F.col("item_id").alias("query_id"), "text", first_match("t", ru.FIRST_MATCH).alias("category")
    )
    queries = cut_lineage(queries.join(rt.hashed_vectors(queries, "query_id", "text"), "query_id"))
    # the status is the registered document's: indexed once its expectations hold
    known = judge(t.documents.select("doc_id", "text"), {"content": F.col("text").rlike(r"\S")}).select(
        "doc_id", document_status(F.col("is_valid"), F.array_join("broken", ", "))["status"].alias("status")
    )
    docs = t.spread("documents", "doc_id", "source", "text")
    chunks = docs.join(known, "doc_id").withColumn("t", F.lower(F.concat_ws("\n", "source", "text"))).select(
        F.col("doc_id").alias("chunk_id"),
        F.concat_ws(" ", F.lit("Document"), F.col("doc_id").cast("string")).alias("title"),
        "source",
        F.col("text").alias("content"),
        first_match("t", ru.FIRST_MATCH).alias("category"),
        "status",
    )
    # the index is stored once; recall and rerank read it several times
    chunks = cut_lineage(chunks.join(rt.hashed_vectors(chunks, "chunk_id", "content"), "chunk_id"))
    return rt.retrieve(queries, chunks, limit=LIMIT, synonyms=ru.SYNONYMS, vocabulary=ru.VOCABULARY).withColumn(
        "hit_rank", F.col("hit_rank").cast("long")
    )


@query(
    f"""WITH {_PAIR_SQL},
    s AS (SELECT q.vec_id AS qid, q.label AS ql, c.label AS cl, c.vec_id AS cid, round(list_cosine_similarity(q.e, c.e), 9) AS sim
        FROM v q JOIN v c ON q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cid) AS k FROM s),
    d AS (SELECT qid, ql, cl, min(k) AS k FROM r WHERE k <= 8 GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY k) AS n FROM d),
    j AS (SELECT qid, ql, min(CASE WHEN ql = cl THEN n END) AS f, count(*) FILTER (ql = cl) AS m FROM o WHERE n <= 3 GROUP BY ALL)
    SELECT ql AS label, count(*) AS evaluated_cases, round(avg(CASE WHEN f = 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_at_1,
      round(avg(CASE WHEN f IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_at_3,
      round(avg(coalesce(1.0::DOUBLE / f, 0)), 4) AS mrr, round(avg(m / 3.0::DOUBLE), 4) AS precision_at_3 FROM j GROUP BY ql"""
)
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Recall@1, Recall@3, MRR and P@3 per label: eight hits, first three distinct sources."""
    vectors = Tables(spark, sf).embeddings
    found = rt.vector_recall(vectors, vectors, query_key="vec_id", corpus_key="vec_id", limit=8, exclude_self=True)
    names = vectors.select(
        F.col("vec_id").alias("row_id"), F.format_string("kb/label-%d.md#chunk-%d", "label", "vec_id").alias("source")
    )
    sources = ev.distinct_sources(found.join(names, "row_id"), "query_id", "source", "recall_rank", 3)
    cases = vectors.select(
        F.col("vec_id").alias("query_id"), "label", F.array(F.format_string("Label-%d.md", "label")).alias("expected_sources")
    )
    judged = ev.retrieval_judgements(cases, sources, "query_id", "expected_sources")
    return ev.retrieval_metrics(judged.join(cases.select("query_id", "label"), "query_id"), ["label"])
