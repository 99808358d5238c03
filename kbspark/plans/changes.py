"""Table-change queries: deletes, upserts, change feeds, audits, schema growth."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark import schemas
from kbspark.functions import dates as D
from kbspark.operators import fulltext as X
from kbspark.operators import maintain as M
from kbspark.operators import vectors as V
from kbspark.plans import sql
from kbspark.sources import tables as S

NOW = F.lit


def _b(c, name=None):
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("long").alias(name or c)


def _now():
    return F.lit(S.NOW).cast("timestamp")


def _store(spark, sf):
    """Documents as sources and chunks; embeddings as the vectors of the chunks they name."""
    vectors = S.given(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return {"sources": S.sources(spark, sf), "chunks": S.whole_chunks(spark, sf), "chunk_vectors": vectors, "jobs": S.jobs(spark, sf)}


def _low_quality(spark, sf):
    return S.given(spark, sf, "labels").filter(F.col("quality") == 0).select(F.col("doc_id").alias("source_id"))


def cascade_delete(spark, sf):
    """Rows left in every table after the low-quality sources are removed."""
    out = M.remove_sources(_store(spark, sf), _low_quality(spark, sf))
    rows = None
    for name in ("sources", "chunks", "chunk_vectors", "jobs"):
        r = out[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        rows = r if rows is None else rows.unionByName(r)
    return rows


def delete_report(spark, sf):
    """Page ids asked to be deleted as sources: which existed."""
    ids = S.given(spark, sf, "pages").select((F.col("page_id") * 7).alias("source_id"))
    return M.remove_sources(_store(spark, sf), ids)["report"]


def set_null(spark, sf):
    """Labelled ids taken as deleted collections: sources left unfiled."""
    gone = S.given(spark, sf, "labels").select(F.col("doc_id").alias("collection_id"))
    cleared, _ = M.set_null(S.sources(spark, sf), "collection_id", gone)
    return cleared.select("source_id", "collection_id")


def released(spark, sf):
    gone = S.given(spark, sf, "labels").select(F.col("doc_id").alias("collection_id"))
    return M.set_null(S.sources(spark, sf), "collection_id", gone)[1]


def upsert(spark, sf):
    """Last event type per user over a base of one row per document id."""
    base = S.given(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("value"))
    new = S.given(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), "ts", "event_id")
    return M.upsert(base, new, ["key"], ["ts", "event_id"])


def apply_changes(spark, sf):
    base = S.sources(spark, sf).select("source_id", "title", "status")
    feed = S.given(spark, sf, "events").select(
        F.col("user_id").alias("source_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("status"), "ts", "event_id")
    return M.apply_changes(base, feed, "source_id", ["ts", "event_id"], ["status"])


def rename_sources(spark, sf):
    feed = S.given(spark, sf, "events").select(
        F.col("user_id").alias("source_id"), "event_id",
        F.when(F.col("event_type") == "view", "  ").when(F.col("event_type") == "error", F.repeat(F.lit("x"), 41))
        .otherwise(F.concat(F.lit(" a   b "), F.col("props"))).alias("display_title"))
    return M.rename_sources(S.sources(spark, sf), feed, ["event_id"]).select("source_id", "display_title")


def assign_collections(spark, sf):
    feed = S.given(spark, sf, "events").select(
        F.col("user_id").alias("source_id"), "event_id",
        F.when(F.col("event_type") == "view", F.lit(None).cast("string")).when(F.col("event_type") == "click", "src3")
        .otherwise(F.concat(F.lit(" new  "), F.col("event_type"))).alias("name"))
    moved, every = M.assign_collections(S.sources(spark, sf), S.collections(spark, sf), feed, ["event_id"], _now())
    names = every.select("collection_id", "name")
    return moved.select("source_id", "collection_id").join(names, "collection_id", "left").select("source_id", "name")


def decide_notes(spark, sf):
    decisions = S.given(spark, sf, "events").select(
        F.col("user_id").alias("note_id"), (F.col("event_type") == "purchase").alias("keep"), "event_id")
    return M.decide_notes(S.notes(spark, sf), decisions, ["event_id"], _now()).select("note_id", "status", D.iso_z("decided_at").alias("decided"))


def attach_summary(spark, sf):
    new = S.given(spark, sf, "labels").select(F.col("doc_id").alias("source_id"), F.concat(F.lit("s"), F.col("toxic").cast("string")).alias("summary"))
    out = M.attach_summaries(S.sources(spark, sf), new, _now())
    return out.select("source_id", "status", "summary", D.iso_z("summary_generated_at").alias("generated"))


def replace_visual(spark, sf):
    """Odd turns are visual rows; user turns of every conversation with a system turn are redone."""
    turns = S.given(spark, sf, "conversations")
    chunks = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("source_id"),
                          F.when(F.col("turn") % 2 == 1, "visual").otherwise("audio").alias("modality"))
    redo = turns.filter(F.col("role") == "system").select((F.col("conv_id") * 1000 + 900 + F.col("turn")).alias("chunk_id"),
                                                          F.col("conv_id").alias("source_id"), F.lit("visual").alias("modality"))
    out, _ = M.replace_visual(chunks, chunks.select("chunk_id"), redo, redo.select("chunk_id"))
    return out


def delete_sessions(spark, sf):
    gone = S.messages(spark, sf).filter(F.col("role") == "system").select("session_id")
    return M.delete_sessions(S.messages(spark, sf), gone)[0].select("session_id", "msg_id")


def removed_messages(spark, sf):
    gone = S.messages(spark, sf).filter(F.col("role") == "system").select("session_id")
    return M.delete_sessions(S.messages(spark, sf), gone)[1]


def audit(spark, sf):
    return M.audit(_store(spark, sf), dim=64)


def vector_report(spark, sf):
    return V.vector_report(S.given(spark, sf, "embeddings"), model="label")


def evolve(spark, sf):
    old = S.sources(spark, sf).drop("display_title", "collection_id", "summary_generated_at")
    out = M.evolve(old, schemas.SOURCES)
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.count("collection_id").alias("n_collection"), F.count("title").alias("n_title"))


def index_growth(spark, sf):
    """Index of the labelled documents, extended to all: postings per document."""
    chunks = S.whole_chunks(spark, sf)
    registry = S.given(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"))
    labelled = chunks.join(registry, "chunk_id", "left_semi")
    index = X.extend_gram_index(X.gram_index(labelled, "chunk_id"), chunks, "chunk_id", registry=registry)
    return index.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_grams"))


QUERIES = {f.__name__: f for f in (
    cascade_delete, delete_report, set_null, released, upsert, apply_changes, rename_sources, assign_collections, decide_notes, attach_summary,
    replace_visual, delete_sessions, removed_messages, audit, vector_report, evolve, index_growth)}

_GONE = "gone AS (SELECT doc_id FROM labels WHERE quality = 0)"
ORACLES = {
    "cascade_delete": f"""WITH {_GONE}, {sql.JOBS} SELECT 'sources' AS table_name, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)
 UNION ALL SELECT 'chunks', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)
 UNION ALL SELECT 'chunk_vectors', count(*) FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM gone JOIN documents USING (doc_id) WHERE gone.doc_id = vec_id)
 UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE source_id IS NULL OR source_id NOT IN (SELECT doc_id FROM gone)""",
    "delete_report": "SELECT page_id * 7 AS source_id, CASE WHEN page_id * 7 IN (SELECT doc_id FROM documents) THEN 'deleted' ELSE 'missing' END AS outcome FROM pages",
    "set_null": f"WITH {sql.SOURCES} SELECT source_id, CASE WHEN collection_id NOT IN (SELECT doc_id FROM labels ) THEN collection_id END AS collection_id FROM src",
    "released": f"WITH {sql.SOURCES} SELECT collection_id, count(*) AS released FROM src WHERE collection_id IN (SELECT doc_id FROM labels ) GROUP BY 1",
    "upsert": """WITH n AS (SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY 1)
SELECT key, value FROM n UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT key FROM n)""",
    "apply_changes": f"""WITH {sql.SOURCES}, n AS (SELECT user_id, arg_max(event_type, event_id) AS s FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT source_id, title, coalesce(s, status) AS status FROM src LEFT JOIN n ON n.user_id = source_id""",
    "rename_sources": """WITH n AS (SELECT user_id, arg_max('a b ' || props, event_id) AS t FROM events WHERE event_type NOT IN ('view', 'error') GROUP BY 1)
SELECT doc_id AS source_id, t AS display_title FROM documents LEFT JOIN n ON n.user_id = doc_id""",
    "assign_collections": """WITH n AS (SELECT user_id, arg_max(event_type, event_id) AS e FROM events GROUP BY 1)
SELECT doc_id AS source_id, CASE WHEN e IS NULL THEN (CASE WHEN source <> 'src0' THEN source END) WHEN e = 'view' THEN NULL WHEN e = 'click' THEN 'src3' ELSE 'new ' || e END AS name
FROM documents LEFT JOIN n ON n.user_id = doc_id""",
    "decide_notes": f"""WITH {sql.NOTES}, n AS (SELECT user_id, arg_max(event_type, event_id) AS e FROM events GROUP BY 1)
SELECT note_id, CASE WHEN e IS NULL THEN status WHEN e = 'purchase' THEN 'kept' ELSE 'dropped' END AS status,
 CASE WHEN e IS NOT NULL THEN '2024-01-31T00:00:00Z' WHEN status <> 'candidate' THEN strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(note_id % 720 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') END AS decided
FROM notes LEFT JOIN n ON n.user_id = note_id""",
    "attach_summary": f"""WITH {sql.SOURCES}, j AS (SELECT src.*, 's' || toxic AS ns FROM src LEFT JOIN labels l ON l.doc_id = source_id),
t AS (SELECT *, ns IS NOT NULL AND (status = 'ready' OR summary IS NULL) AS take FROM j)
SELECT source_id, CASE WHEN take AND status = 'ready' THEN 'enriched' ELSE status END AS status, CASE WHEN take THEN ns ELSE summary END AS summary,
 CASE WHEN take THEN '2024-01-31T00:00:00Z' END AS generated FROM t""",
    "replace_visual": """WITH r AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system')
SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS source_id, CASE WHEN turn % 2 = 1 THEN 'visual' ELSE 'audio' END AS modality FROM conversations
 WHERE NOT (turn % 2 = 1 AND conv_id IN (SELECT conv_id FROM r)) UNION ALL SELECT conv_id * 1000 + 900 + turn, conv_id, 'visual' FROM conversations WHERE role = 'system'""",
    "delete_sessions": """SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id * 1000 + turn AS msg_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""",
    "removed_messages": """SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS removed FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY 1""",
    "audit": f"""WITH {sql.SOURCES}, {sql.JOBS} SELECT 'chunks_without_source' AS check_name, 0::BIGINT AS violations
 UNION ALL SELECT 'vectors_without_chunk', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
 UNION ALL SELECT 'chunks_without_vector', count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
 UNION ALL SELECT 'source_id_repeated', 0 UNION ALL SELECT 'identity_repeated', count(*) FROM (SELECT video_id FROM src GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'chunk_id_repeated', 0 UNION ALL SELECT 'jobs_without_source', count(*) FROM jobs WHERE source_id NOT IN (SELECT doc_id FROM documents)
 UNION ALL SELECT 'vector_dimension', count(*) FROM embeddings WHERE len(embedding) <> 64""",
    "vector_report": "SELECT count(*) AS n_vectors, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim, count(DISTINCT label) AS n_models FROM embeddings",
    "evolve": "SELECT count(*) AS n_rows, 0::BIGINT AS n_collection, count(text) AS n_title FROM documents",
    "index_growth": f"""WITH {sql.chars('ch', 'SELECT doc_id, lower(text) AS t FROM documents', 'doc_id')},
g AS (SELECT DISTINCT doc_id, c || lead(c) OVER w || lead(c, 2) OVER w AS gram FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY p))
SELECT doc_id AS chunk_id, count(*) AS n_grams FROM g WHERE gram IS NOT NULL GROUP BY 1""",
}
