"""Hashed vectors, exact vector recall, hybrid rerank."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postroom.functions import lexicon as lx
from postroom.functions import scoring as sc
from postroom.functions.text import snippet

ANY = "*"
BLOCK_ROWS = 16_384
SCORED_PAIRS = 1 << 20
PARTS = 256  # of a row of scores, whose best ones bound the best of the row
SENT_QUERIES = 5000


def hashed_weights(
    texts: DataFrame, key: str, text: str, dimensions: int = lx.VECTOR_DIMENSIONS
) -> DataFrame:
    """Sparse hashed bag of tokens: (key, bucket, weight), L2-normalised, zeros left out.

    The sum combines on the map side, where all tokens of a text are, so at most
    ``dimensions`` numbers per text are shuffled.
    """
    tokens = texts.select(key, F.explode_outer(sc.hash_tokens(F.col(text))).alias("_token"))
    digests = tokens.filter(F.col("_token").isNotNull()).select(key, F.sha2("_token", 256).alias("_digest"))
    summed = (
        digests.groupBy(key, sc.digest_bucket(F.col("_digest"), dimensions).cast("int").alias("bucket"))
        .agg(F.sum(sc.digest_sign(F.col("_digest"))).alias("_sum"))
        .filter(F.col("_sum") != 0)
    )
    packed = summed.groupBy(key).agg(
        F.collect_list(F.struct("bucket", "_sum")).alias("_entries"), F.sqrt(F.sum(F.col("_sum") * F.col("_sum"))).alias("_norm")
    )
    return packed.select(key, "_norm", F.inline_outer("_entries")).select(
        key, "bucket", F.round(F.col("_sum") / F.col("_norm"), 6).alias("weight")
    )


def hashed_vectors(
    texts: DataFrame, key: str, text: str, dimensions: int = lx.VECTOR_DIMENSIONS, name: str = "embedding"
) -> DataFrame:
    """Dense form of :func:`hashed_weights`; texts without tokens get the zero vector."""
    return _dense(texts.select(key), hashed_weights(texts, key, text, dimensions), key, dimensions, name)


def _dense(keys: DataFrame, weights: DataFrame, key: str, dimensions: int, name: str) -> DataFrame:
    """The weights of each row of ``keys`` as an array; the zero vector where there are none."""
    filled = weights.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("_weights"))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)),
        lambda i: F.coalesce(F.try_element_at(F.col("_weights"), i), F.lit(0.0)),
    )
    return keys.join(filled, key, "left").select(key, dense.alias(name))


def repair_vectors(
    rows: DataFrame, key: str, text: str, dimensions: int = lx.VECTOR_DIMENSIONS, name: str = "embedding",
    texts: DataFrame | None = None,
) -> DataFrame:
    """Hash new vectors for the rows whose stored vector has another length.

    The texts lie in ``rows``, or in ``texts`` by the same key. Given apart they are hashed where they are read, and
    only their weights meet the rows, so that no join sorts or shuffles whole texts; all of them are hashed then.
    """
    stale = rows.filter(F.coalesce(F.size(name), F.lit(0)) != dimensions)
    if texts is None:
        renewed = hashed_vectors(stale.select(key, text), key, text, dimensions, "_renewed")
    else:
        renewed = _dense(stale.select(key), hashed_weights(texts.select(key, text), key, text, dimensions), key, dimensions, "_renewed")
    return (
        rows.join(renewed, key, "left")
        .withColumn(name, F.coalesce("_renewed", F.col(name).cast("array<double>")))
        .drop("_renewed")
    )


def _blocked(rows: DataFrame, key: str, group: str, block_rows: int, name: str) -> DataFrame:
    """Spread each group over blocks of about ``block_rows`` rows by hash of the key."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias(f"{name}s"))
    return rows.join(sizes, group).withColumn(name, F.pmod(F.xxhash64(F.col(key)), F.col(f"{name}s")).cast("int"))


def _unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The vectors, their lengths, the vectors of length one in half the bytes, and whether the latter can be relied on."""
    wide = np.array(vectors.tolist(), dtype=np.float64)
    length = np.linalg.norm(wide, axis=1)
    usual = bool(np.all((length == 0) | (length > 1e-100) & (length < 1e100)))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return wide, length, np.where(length[:, None] > 0, wide / length[:, None], 0.0).astype(np.float32), usual


def _candidates(left: np.ndarray, right: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) that hold each query's ``limit`` best rows, with what lies too close to tell in single precision.

    The ``limit``-th of the best scores of a row's parts is at most the ``limit``-th best of the row.
    """
    scores = left @ right.T
    parts = max(limit, min(PARTS, scores.shape[1]))
    width = scores.shape[1] // parts
    tops = scores[:, : parts * width].reshape(len(scores), width, parts).max(axis=1)
    least = np.partition(tops, parts - limit, axis=1)[:, parts - limit]
    slack = 4 * (left.shape[1] + 4) * 2.0**-24 + 2e-9  # errors of two scores, and of rounding to nine digits
    return np.divmod(np.flatnonzero(scores >= (least - np.float32(slack))[:, None]), scores.shape[1])


def _block_matcher(limit: int, exclude_self: bool):
    """Best ``limit`` corpus rows per query of two blocks; equal scores go by row id.

    Queries are taken ``SCORED_PAIRS`` pairs at a time. A product in single precision finds the rows that may be among the best,
    and only these are scored in double precision. Where too many are close, rows are few, or numbers are not finite, all are.
    """

    def first(scores: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((columns, np.where(np.isnan(scores), np.inf, -scores), rows))  # undefined ones come last
        rows, columns = rows[order], columns[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < limit
        return rows[kept], columns[kept], scores[order][kept]

    def every(scores: np.ndarray, excluded: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the scores that are not below the ``limit``-th best of their row."""
        keys = np.where(np.isnan(scores), -np.finfo(np.float64).max, scores)
        if excluded is not None:
            keys[excluded] = -np.inf
        last = keys.shape[1] - limit
        least = np.partition(keys, last, axis=1)[:, last, None] if last > 0 else -np.inf
        return np.nonzero((keys >= least) & (keys > -np.inf))

    def match(queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(corpus):
            corpus = corpus.sort_values("row_id", kind="stable")
            ids, asked = corpus["row_id"].to_numpy(), queries["query_id"].to_numpy()
            left, left_norm, left_unit, usual = _unit(queries["vector"])
            right, right_norm, right_unit, also = _unit(corpus["vector"])
            copies = int(pd.Series(ids).value_counts().iloc[0]) if exclude_self else 0  # rows that a query may leave out
            wanted = limit + copies
            step = max(1, SCORED_PAIRS // len(ids))
            for at in range(0, len(asked), step):
                some, part = asked[at : at + step], slice(at, at + step)
                near = _candidates(left_unit[part], right_unit, wanted) if usual and also and len(ids) > max(wanted, PARTS) else None
                with np.errstate(divide="ignore", invalid="ignore"):
                    if near is not None and len(near[0]) <= max(SCORED_PAIRS // 16, 2 * wanted * len(some)):
                        rows, columns = near
                        if exclude_self:
                            others = some[rows] != ids[columns]
                            rows, columns = rows[others], columns[others]
                        scale = left_norm[at + rows] * right_norm[columns]
                        scores = np.where(scale > 0, np.einsum("ij,ij->i", left[at + rows], right[columns]) / scale, 0.0)
                        scores = np.round(scores, 9) + 0.0
                    else:
                        scale = left_norm[part, None] * right_norm[None, :]
                        dense = np.round(np.where(scale > 0, left[part] @ right.T / scale, 0.0), 9) + 0.0
                        rows, columns = every(dense, some[:, None] == ids[None, :] if exclude_self else None)
                        scores = dense[rows, columns]
                rows, columns, scores = first(scores, rows, columns)
                found.append(pd.DataFrame({"query_id": some[rows], "row_id": ids[columns], "similarity": scores}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "row_id": [], "similarity": []})

    return match


def _scan_matcher(sent: list, limit: int, exclude_self: bool):
    """Best rows per sent query over all batches of a partition."""
    match = _block_matcher(limit, exclude_self)
    asked = pd.DataFrame({name: [row[name] for row in sent] for name in ("query_id", "_group", "vector")})
    asked = {name: part for name, part in asked.groupby("_group")}

    def scan(batches):
        kept: dict[str, pd.DataFrame] = {}
        for batch in batches:
            for name, rows in batch.groupby("_group"):
                if name in asked:
                    found = pd.concat([kept[name], match(asked[name], rows)]) if name in kept else match(asked[name], rows)
                    found = found.sort_values(["query_id", "similarity", "row_id"], ascending=[True, False, True], kind="stable")
                    kept[name] = found.groupby("query_id").head(limit)
        yield from kept.values()

    return scan


def vector_recall(
    queries: DataFrame,
    corpus: DataFrame,
    *,
    query_key: str,
    corpus_key: str,
    vector: str = "embedding",
    limit: int,
    group: str | None = None,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
    sent_queries: int = SENT_QUERIES,
) -> DataFrame:
    """Exact top ``limit`` corpus rows per query by cosine: (query_id, row_id, similarity, recall_rank).

    At most ``sent_queries`` queries are sent to the tasks that scan the corpus: each
    keeps its best rows per query, and only those are shuffled. More queries meet the
    corpus in a block join: both sides are cut into blocks inside each group (and vector
    length), every pair of blocks meets in one task as a matrix product, and only
    the block's best rows per query leave it. Hot groups therefore split into many
    small tasks, and pairs are never materialised. Both ways give the same rows.
    """
    key_type = dict(corpus.dtypes)[corpus_key]
    schema = f"query_id {dict(queries.dtypes)[query_key]}, row_id {key_type}, similarity double"

    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        shared = F.col(group).cast("string") if group else F.lit(ANY)
        return df.filter(F.size(vector) > 0).select(
            F.col(key).alias(name),
            F.concat_ws("|", F.size(vector).cast("string"), shared).alias("_group"),
            F.col(vector).alias("vector"),  # as stored: the matcher widens the numbers
        )

    ranked = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "row_id")

    def best(partial: DataFrame) -> DataFrame:
        return partial.withColumn("recall_rank", F.row_number().over(ranked)).filter(F.col("recall_rank") <= limit)

    asked, rows = side(queries, query_key, "query_id"), side(corpus, corpus_key, "row_id")
    sent = asked.limit(sent_queries + 1).collect()
    if len(sent) <= sent_queries:
        return best(rows.mapInPandas(_scan_matcher(sent, limit, exclude_self), schema))
    left = _blocked(asked, "query_id", "_group", block_rows, "_qblock")
    right = _blocked(rows, "row_id", "_group", block_rows, "_cblock")
    q_counts = left.select("_group", "_qblocks").distinct()
    c_counts = right.select("_group", "_cblocks").distinct()

    def copies(upper: str) -> Column:
        return F.explode_outer(F.sequence(F.lit(0), F.col(upper) - 1))

    left = left.join(c_counts, "_group").withColumn("_cblock", copies("_cblocks"))
    right = right.join(q_counts, "_group").withColumn("_qblock", copies("_qblocks"))
    cell = ["_group", "_qblock", "_cblock"]
    partial = (
        left.select(*cell, "query_id", "vector")
        .groupBy(*cell)
        .cogroup(right.select(*cell, "row_id", "vector").groupBy(*cell))
        .applyInPandas(_block_matcher(limit, exclude_self), schema)
    )
    return best(partial)


SAMPLE_ROWS = 50_000


def learn_lists(corpus: DataFrame, vector: str = "embedding", *, lists: int, sample_rows: int = SAMPLE_ROWS, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of an inverted vector index, unit length, one row each: spherical k-means on a bounded sample.

    The sample are the ``sample_rows`` vectors of smallest hash (one pass, at most so many from a task); it only decides
    where the lists lie. Vectors of another length than most, empty ones and zeros take no part.
    """
    rows = corpus.filter(F.size(vector) > 0).select(F.col(vector).cast("array<double>").alias("v"))
    picked = rows.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample_rows).collect()
    lengths = [len(r["v"]) for r in picked]
    size = max(set(lengths), key=lengths.count) if lengths else 1
    points = np.array([r["v"] for r in picked if len(r["v"]) == size], dtype=np.float64).reshape(-1, size)
    norms = np.linalg.norm(points, axis=1)
    points = points[norms > 0] / norms[norms > 0, None]
    count = max(1, min(lists, len(points)))
    rng = np.random.default_rng(seed)
    centers = points[rng.permutation(len(points))[:count]] if len(points) else np.zeros((1, size))
    for _ in range(rounds if len(points) else 0):
        nearest = np.argmax(points @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, points)
        length = np.linalg.norm(sums, axis=1)
        centers = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-12)[:, None], centers)
    return centers


def with_lists(rows: DataFrame, centers: np.ndarray, vector: str = "embedding", *, count: int = 1, name: str = "lists") -> DataFrame:
    """Add ``name``: the ``count`` nearest lists of each vector as an array, nearest first; vectors that fit no centroid go to list 0."""

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        width, taken = centers.shape[1], min(count, len(centers))
        right = np.array([v is not None and len(v) == width for v in vectors], dtype=bool)
        chosen = np.zeros((len(vectors), taken), dtype=np.int32)
        chosen[:] = np.arange(taken)
        if right.any():
            scores = np.stack([np.asarray(v, dtype=np.float64) for v in vectors[right]]) @ centers.T
            chosen[right] = np.argsort(-scores, axis=1, kind="stable")[:, :taken]
        return pd.Series(list(chosen))

    return rows.withColumn(name, nearest(F.col(vector).cast("array<double>")))


def indexed_recall(
    queries: DataFrame,
    corpus: DataFrame,
    centers: np.ndarray,
    *,
    query_key: str,
    corpus_key: str,
    vector: str = "embedding",
    limit: int,
    probes: int,
    group: str | None = None,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
    sent_queries: int = SENT_QUERIES,
) -> DataFrame:
    """Approximate form of :func:`vector_recall` by an inverted index: only the query's ``probes`` nearest lists are looked at.

    Every corpus row lies in one list (``corpus`` may bring its column ``_list`` stored, as :func:`with_lists` gives it);
    a query is copied per probe. Lists are the groups of the exact recall, which scores all their rows, cuts hot lists
    into blocks and merges the probes' best rows. With as many probes as lists the result is exact.
    """
    listed = corpus if "_list" in corpus.columns else with_lists(corpus, centers, vector, name="_near").withColumn("_list", F.get("_near", F.lit(0)))
    asked = with_lists(queries, centers, vector, count=probes, name="_near").withColumn("_list", F.explode_outer("_near"))
    cell = F.concat_ws("|", F.col("_list").cast("string"), F.col(group).cast("string")) if group else F.col("_list").cast("string")
    return vector_recall(
        asked.select(F.col(query_key), F.col(vector), cell.alias("_cell")), listed.select(F.col(corpus_key), F.col(vector), cell.alias("_cell")),
        query_key=query_key, corpus_key=corpus_key, vector=vector, limit=limit, group="_cell", exclude_self=exclude_self,
        block_rows=block_rows, sent_queries=sent_queries,
    )


def recall_groups(queries: DataFrame, corpus: DataFrame, category: str = "category") -> tuple[DataFrame, DataFrame]:
    """Add ``_recall_group`` to both sides.

    A query looks inside its own category; without one, or when the corpus has no
    row of it, the query looks everywhere.
    """
    present = corpus.filter(F.col(category).isNotNull()).select(category).distinct().withColumn("_present", F.lit(True))
    own = F.coalesce("_present", F.lit(False)) & (F.col(category) != "other")
    routed = (
        queries.join(present, category, "left")
        .withColumn("_recall_group", F.when(own, F.col(category)).otherwise(F.lit(ANY)))
        .drop("_present")
    )
    groups = F.array_distinct(F.array(F.coalesce(F.col(category), F.lit(ANY)), F.lit(ANY)))
    return routed, corpus.withColumn("_recall_group", F.explode_outer(groups))


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    *,
    query_key: str = "query_id",
    chunk_key: str = "chunk_id",
    text: str = "text",
    content: str = "content",
    vector: str = "embedding",
    category: str = "category",
    limit: int = 3,
    synonyms=lx.SYNONYM_GROUPS,
    vocabulary=lx.CATEGORY_TERMS,
    stop_words=lx.STOP_WORDS,
) -> DataFrame:
    """Ranked hits per query: vector recall of ``max(8k, 24)`` rows, then hybrid rerank.

    ``chunks`` has key, title, source, content, category, vector and document
    status; only rows of indexed documents take part.
    """
    indexed = chunks.filter((F.col("status") == "indexed") & F.col(vector).isNotNull())
    routed, reachable = recall_groups(queries.select(query_key, vector, category), indexed.select(chunk_key, vector, category), category)
    recalled = vector_recall(
        routed,
        reachable,
        query_key=query_key,
        corpus_key=chunk_key,
        vector=vector,
        limit=max(limit * lx.RECALL_FACTOR, lx.RECALL_MINIMUM),
        group="_recall_group",
    )
    asked = sc.with_search_terms(queries.select(query_key, category, text), text, "_found", stop_words=stop_words).select(
        F.col(query_key).alias("query_id"),
        F.col(category).alias("_query_category"),
        sc.expand_terms(F.col("_found"), synonyms).alias("_terms"),
    )
    searched = indexed.select(
        F.col(chunk_key).alias("row_id"),
        "title",
        "source",
        F.col(category).alias("_row_category"),
        F.col(content).alias("_content"),
        F.lower(F.concat_ws("\n", "title", "source", content)).alias("_searchable"),
    )
    scored = (
        recalled.join(searched, "row_id")
        .join(asked, "query_id")
        .withColumns(
            {
                "_keyword": sc.keyword_score(F.col("_terms"), F.col("_searchable")),
                "_category": sc.category_score(
                    F.col("_query_category"), F.col("_terms"), F.col("_row_category"), F.col("_searchable"), vocabulary
                ),
            }
        )
        .withColumn("_score", sc.hybrid_score(F.col("similarity"), F.col("_keyword"), F.col("_category")))
        .filter(F.col("_score") >= lx.RERANK_MINIMUM)
    )
    best_first = Window.partitionBy("query_id").orderBy(F.col("_score").desc(), "recall_rank")
    return (
        scored.withColumn("hit_rank", F.row_number().over(best_first))
        .filter(F.col("hit_rank") <= limit)
        .select(
            "query_id",
            "row_id",
            "hit_rank",
            "title",
            "source",
            F.col("_row_category").alias("category"),
            snippet(F.col("_content")).alias("snippet"),
            F.round("_score", 2).alias("score"),
            F.round("similarity", 2).alias("semantic_score"),
            F.round("_keyword", 2).alias("keyword_score"),
            F.round("_category", 2).alias("category_score"),
            sc.match_reason(F.col("similarity"), F.col("_keyword"), F.col("_category")).alias("match_reason"),
            sc.reliability(F.col("_score")).alias("reliability"),
        )
    )


def nest_hits(hits: DataFrame) -> DataFrame:
    """One row per query with its ranked hits as an array; their number is the retrieval limit."""
    fields = [name for name in hits.columns if name not in ("query_id", "hit_rank")]
    ordered = F.sort_array(F.collect_list(F.struct("hit_rank", *fields)))
    return hits.groupBy("query_id").agg(ordered.alias("knowledge_hits"))
