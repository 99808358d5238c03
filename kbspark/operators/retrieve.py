"""Hybrid retrieval: vector and keyword arms, rank fusion, scope, top-k, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators.blocks import row_index, time_block, top_k
from kbspark.operators.fulltext import bm25
from kbspark.operators.vectors import MAX_DISTANCE, knn
from kbspark.session import NARROW_ROWS, at_most, small_side

# Fusion constant and result sizes.
RRF_K = 60
TOP_K = 6
NOTE_TOP_K = 5
MAX_TOP_K = 20


def rrf(vec: DataFrame, fts: DataFrame, id_col: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Full outer join of the arms with the summed reciprocal ranks (best rank is 0)."""
    joined = vec.select("query_id", id_col, "vec_rank", F.col("distance").alias("vec_distance")).join(
        fts.select("query_id", id_col, "fts_rank"), ["query_id", id_col], "full"
    )
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return joined.withColumn("score", F.round(part("vec_rank") + part("fts_rank"), 9))


def arms(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame, fetch: int, max_dist: float = MAX_DISTANCE, index: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The vector and the keyword arm, each with its best ``fetch`` chunks per query."""
    return (knn(queries.select("query_id", "qvec"), vectors, fetch, max_dist),
            bm25(queries.select("query_id", "query"), chunks, fetch, index=index))


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    sources: DataFrame,
    top_k_: int = TOP_K,
    max_dist: float = MAX_DISTANCE,
    scope_source: int | None = None,
    scope_collection: int | None = None,
    scope: str = "post",
    index: DataFrame | None = None,
    searched: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Best chunks per query: (query_id, rank, chunk, source columns, provenance).

    Queries carry query_id, query and qvec. With a scope each arm fetches four times the
    wanted rows instead of two, and rows outside the scope are dropped after fusion
    (``scope="post"``, which may return fewer rows than exist) or before the arms
    (``scope="pre"``). ``searched`` are the arms of :func:`arms` where they are at hand, at least
    as wide as the fetch.
    """
    scoped = scope_source is not None or scope_collection is not None
    # id 0 narrows the result but does not widen the fetch
    fetch = top_k_ * (4 if (scope_source or scope_collection) else 2)
    keep = F.lit(True)
    if scope_source is not None:
        keep = keep & (F.col("source_id") == scope_source)
    if scope_collection is not None:
        keep = keep & (F.col("collection_id") == scope_collection)
    if scoped and scope == "pre":
        if scope_collection is None:
            chunks = chunks.filter(F.col("source_id") == scope_source)
        else:
            in_scope = sources.filter(keep).select("source_id")
            chunks = chunks.join(small_side(in_scope, at_most(in_scope, NARROW_ROWS)), "source_id", "left_semi")
        ids = chunks.select("chunk_id")
        vectors = vectors.join(small_side(ids, at_most(ids, NARROW_ROWS)), "chunk_id", "left_semi")
    vec, fts = searched or arms(queries, chunks, vectors, fetch, max_dist, index)
    if searched:
        vec, fts = vec.filter(F.col("vec_rank") < fetch), fts.filter(F.col("fts_rank") < fetch)
    fused = rrf(vec, fts)
    # metadata joins only the fused survivors, at most 2 * fetch narrow rows per query: with few
    # queries they are sent to the chunks and then to the sources, which are never shuffled
    few = at_most(queries.select("query_id"), NARROW_ROWS // (2 * fetch))
    rows = small_side(small_side(fused, few).join(chunks, "chunk_id"), few).join(sources, "source_id")
    if scoped:
        rows = rows.filter(keep)
    rows = rows.withColumn("title", T.display_name(F.lit(None).cast("string"), "title"))
    return top_k(
        rows, ["query_id"], [F.desc("score"), F.asc("chunk_id")], top_k_, "rank"
    )


def clamp_top_k(col, default: int = TOP_K):
    """Requested result size as an expression: 1..20, default when absent or zero."""
    wanted = F.coalesce(F.nullif(col.cast("int"), F.lit(0)), F.lit(default))
    return F.least(F.greatest(wanted, F.lit(1)), F.lit(MAX_TOP_K))


def bounded_search(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame, sources: DataFrame, max_dist: float = MAX_DISTANCE,
    scope_source: int | None = None, scope_collection: int | None = None, index: DataFrame | None = None,
) -> DataFrame:
    """Retrieval with a size of its own for every query (column ``top_k``, clamped to 1..20).

    Rank fusion depends on the fetch width, so every query's arms are cut to its own width. Both
    arms are ranked once, at the width of the largest size: the best 2n of an arm are the
    first 2n of its best 40. Then each query keeps its own share of ranks, and of results.
    """
    sized = queries.withColumn("_k", clamp_top_k(F.col("top_k")))
    wide = 4 if (scope_source or scope_collection) else 2
    widest = (sized.agg(F.max("_k")).first()[0] or 1) * wide
    few = at_most(queries.select("query_id"), NARROW_ROWS // (2 * widest))
    own = small_side(sized.select("query_id", "_k"), few)
    vec = knn(queries.select("query_id", "qvec"), vectors, widest, max_dist).join(own, "query_id").filter(F.col("vec_rank") < F.col("_k") * wide)
    fts = bm25(queries.select("query_id", "query"), chunks, widest, index=index).join(own, "query_id").filter(F.col("fts_rank") < F.col("_k") * wide)
    rows = small_side(rrf(vec, fts), few).join(chunks, "chunk_id").join(sources, "source_id")
    if scope_source is not None:
        rows = rows.filter(F.col("source_id") == scope_source)
    if scope_collection is not None:
        rows = rows.filter(F.col("collection_id") == scope_collection)
    rows = rows.withColumn("title", T.display_name(F.lit(None).cast("string"), "title"))
    ranked = top_k(rows, ["query_id"], [F.desc("score"), F.asc("chunk_id")], MAX_TOP_K, "rank")
    return ranked.join(own, "query_id").filter(F.col("rank") <= F.col("_k")).drop("_k")


def note_search(
    queries: DataFrame, notes: DataFrame, vectors: DataFrame, top_k_: int = NOTE_TOP_K,
    max_dist: float = MAX_DISTANCE,
) -> DataFrame:
    """Hybrid search over kept notes; the keyword arm filters status before its limit.

    The index spans title, content and application. Corpus statistics cover every note.
    """
    fields = ["title", "content", "application"]
    size = sum((F.greatest(F.length(F.coalesce(F.col(c), F.lit(""))) - 2, F.lit(0)) for c in fields), F.lit(0))
    # the separator keeps terms from matching across fields; lengths are per field
    indexed = notes.select("note_id", "status", F.concat_ws("\u0000", *fields).alias("text"), size.alias("n_grams"))
    kept = notes.filter(F.col("status") == "kept")
    fetch = top_k_ * 2
    vec = knn(queries.select("query_id", "qvec"), vectors, fetch, max_dist, id_col="note_id")
    fts = bm25(queries.select("query_id", "query"), indexed, fetch, id_col="note_id", length="n_grams",
               allowed=F.col("status") == "kept")
    few = at_most(queries.select("query_id"), NARROW_ROWS // (2 * fetch))
    rows = small_side(rrf(vec, fts, "note_id"), few).join(kept, "note_id")
    return top_k(rows, ["query_id"], [F.desc("score"), F.asc("note_id")], top_k_, "rank")


def context_block(results: DataFrame) -> DataFrame:
    """(query_id, context): escaped source frames of one query's results, in rank order."""
    span = F.concat(T.format_timestamp("start_sec"), F.lit("-"), T.format_timestamp("end_sec"))
    published = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("未知"))
    block = F.concat(
        F.lit('<source label="S'), F.col("rank").cast("string"), F.lit('" title="'),
        T.html_escape("title", True), F.lit('" platform="'), F.col("platform"),
        F.lit('" timestamp="'), span, F.lit('" published="'), published, F.lit('">\n'),
        T.html_escape("text"), F.lit("\n</source>"),
    )
    # a query has at most MAX_TOP_K results, so the list is bounded
    listed = results.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs")
    )
    body = F.array_join(F.transform("bs", lambda x: x["b"]), "\n")
    return listed.select(
        "query_id", F.concat(F.lit("<retrieved_sources>\n"), body, F.lit("\n</retrieved_sources>")).alias("context")
    )


def trace_rows(results: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """Audit row per result: label, provenance, rounded figures, cited flag.

    ``cited`` is (query_id, labels array<int>); without it nothing counts as cited.
    """
    rows = results.select(
        "query_id", F.col("rank").alias("label"), "chunk_id", "source_id",
        T.display_name("display_title", "title").alias("title"), "platform", "start_sec",
        T.format_timestamp("start_sec").alias("timestamp"), "vec_rank",
        F.round("vec_distance", 3).alias("vec_distance"), "fts_rank",
        F.round("score", 4).alias("rrf_score"),
    )
    if cited is None:
        return rows.withColumn("cited", F.lit(False))
    return rows.join(cited, "query_id", "left").withColumn(
        "cited", F.coalesce(F.array_contains("labels", F.col("label").cast("int")), F.lit(False))
    ).drop("labels")


def retrieval_trace(results: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """(query_id, trace array<struct>) ordered by label; bounded by the result size."""
    rows = trace_rows(results, cited)
    cols = [c for c in rows.columns if c != "query_id"]
    return rows.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct(*cols))).alias("trace")
    )


def citation_rows(results: DataFrame, answers: DataFrame) -> DataFrame:
    """Cited results per stored answer (query_id, answer); all results if none is cited."""
    n = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    labels = answers.join(n, "query_id").select(
        "query_id", F.explode(T.cited_or_all(T.citation_labels("answer"), F.col("n"))).alias("rank")
    )
    return results.join(labels, ["query_id", "rank"], "left_semi")


def context_window(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """The hit chunk and its neighbours in start order, or the first two when it is gone.

    Hits are (query_id, source_id, chunk_id). Positions come from a block-wise index, so
    a source with very many chunks is numbered by many tasks; only the sources of hits are.
    """
    named = hits.select("source_id").distinct()
    chunks = chunks.join(small_side(named, at_most(named, NARROW_ROWS)), "source_id", "left_semi")
    placed = row_index(
        chunks.withColumn("_start", F.coalesce("start_sec", F.lit(0.0))),
        ["source_id"], ["_start", "chunk_id"], "pos", block=time_block("start_sec"),
    ).drop("_start")
    at = hits.join(
        placed.select("source_id", "chunk_id", F.col("pos").alias("hit_pos")),
        ["source_id", "chunk_id"], "left",
    ).withColumn("missing", F.col("hit_pos").isNull())
    wanted = at.select(
        "query_id", "source_id", F.col("chunk_id").alias("hit_chunk_id"), "missing",
        F.explode(
            F.when(F.col("missing"), F.array(F.lit(0), F.lit(1)).cast("array<long>")).otherwise(
                F.array(F.col("hit_pos") - 1, F.col("hit_pos"), F.col("hit_pos") + 1))
        ).alias("pos"),
    )
    return wanted.join(placed, ["source_id", "pos"]).withColumn(
        "is_hit", F.col("chunk_id") == F.col("hit_chunk_id"))
