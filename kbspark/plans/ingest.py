"""Ingest queries: mixed batches of links, texts and rejects; sources that fail by themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import chunking as K
from kbspark.operators import ingest as N
from kbspark.operators import vectors as V
from kbspark.plans import content, sql
from kbspark.session import cut_lineage
from kbspark.sources import tables as S

WIDTH = 16


def _b(c, name=None):
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("long").alias(name or c)


def _items(spark, sf):
    """Every document and page as an arriving item: texts, links, pastes of links, blanks, texts over the limit."""
    d, k = F.col("doc_id"), F.col("doc_id") % 6
    paste = F.concat(F.lit("https://youtu.be/"), F.left(F.md5("text"), F.lit(11)), F.lit("\n\n https://news.example/a/"),
                     (d % 50).cast("string"), F.lit("?utm="), d.cast("string"), F.lit(" \n"))
    text = (F.when(k.isin(1, 2), content._shared_link()).when(k == 3, F.lit(" \n  ")).when(k == 5, paste)
            .when(d % 60 == 4, F.rpad("text", 100_001, F.col("text"))).otherwise(F.col("text")))
    docs = S.given(spark, sf, "documents").select(d.alias("item_id"), text.alias("text"))
    return docs.unionByName(S.given(spark, sf, "pages").select((F.col("page_id") + 1_000_000_000).alias("item_id"), F.col("url").alias("text")))


def _library(spark, sf):
    """Labelled documents as stored texts and as stored videos; bad ones failed."""
    docs = S.given(spark, sf, "documents").join(S.given(spark, sf, "labels"), "doc_id")
    status = F.when(F.col("quality") == 1, "ready").otherwise("failed").alias("status")
    texts = docs.select((F.col("doc_id") + 5_000_000).alias("source_id"), F.lit("manual").alias("platform"), T.content_id("text").alias("video_id"), status)
    return texts.unionByName(docs.select((F.col("doc_id") + 6_000_000).alias("source_id"), F.lit("youtube").alias("platform"),
                                         F.left(F.md5("text"), F.lit(11)).alias("video_id"), status))


def ingest_routing(spark, sf):
    """What becomes of every item of a mixed batch."""
    out = N.route_items(N.classify_items(_items(spark, sf)), _library(spark, sf))
    return out.select("item_id", _b("part"), "kind", "platform", "content_id", "canonical_url", "reason", "routing", "known_source_id", "source_id")


def ingest_jobs(spark, sf):
    out = N.ingest_items(_items(spark, sf), _library(spark, sf))["jobs"]
    return out.select("item_id", _b("part"), "kind", "status", "source_id", "error")


def ingest_sources(spark, sf):
    """New sources of the batch with the number of their chunks."""
    new = N.ingest_items(_items(spark, sf), _library(spark, sf))
    n = new["chunks"].groupBy("source_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return new["sources"].join(n, "source_id", "left").select(
        "source_id", "type", "platform", "video_id", "title", "url_normalized", "status", "error", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def _faulty_store(spark, sf):
    """Packed documents with faults: a short last vector, a lost one, one twice, a chunk id twice, orphans."""
    sources = S.sources(spark, sf).select("source_id", "platform", "video_id", "title", "status")
    chunks = cut_lineage(K.build_chunks(S.document_segments(spark, sf), S.sources(spark, sf)))
    last = chunks.groupBy("source_id").agg(F.max("chunk_id").alias("chunk_id"), F.count(F.lit(1)).alias("n"))
    vectors = V.embed_chunks(chunks.withColumn("title", F.lit("")), encoder=lambda x: V.hash_trigram_vector(x, WIDTH)).join(
        last.select("chunk_id", "n"), "chunk_id", "left")
    d = F.col("source_id")
    vectors = vectors.filter(~((d % 11 == 3) & F.col("n").isNotNull())).select(
        F.when(d % 17 == 1, F.col("chunk_id") - 500_000).otherwise(F.col("chunk_id")).alias("chunk_id"), "source_id",
        F.when((d % 7 == 2) & (F.col("n") > 1), F.slice("embedding", 1, WIDTH - 1)).otherwise(F.col("embedding")).alias("embedding"))
    vectors = vectors.unionByName(vectors.filter(d % 13 == 5)).drop("source_id")
    chunks = chunks.unionByName(chunks.filter(d % 19 == 6)).filter(d % 23 != 7)
    orphans = chunks.filter(d % 29 == 8).withColumn("chunk_id", F.col("chunk_id") + 900_000_000_000).withColumn("source_id", -d)
    return {"sources": sources, "chunks": cut_lineage(chunks.unionByName(orphans)), "chunk_vectors": cut_lineage(vectors)}


def settle_sources(spark, sf):
    """Per source: status, fault, and the chunks and vectors that are published."""
    out = N.settle(_faulty_store(spark, sf), WIDTH)
    c = out["chunks"].groupBy("source_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    v = out["chunk_vectors"].join(out["chunks"].select("chunk_id", "source_id"), "chunk_id").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_vectors"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return out["sources"].join(c, "source_id", "full").join(v, "source_id", "full").select(
        "source_id", "status", "error", zero("n_chunks"), zero("n_vectors"))


QUERIES = {f.__name__: f for f in (ingest_routing, ingest_jobs, ingest_sources, settle_sources)}

_BATCH = f"""
d AS (SELECT doc_id, text, md5(text) AS h, doc_id % 6 AS k, doc_id % 10 AS f FROM documents),
links AS (
  SELECT doc_id AS item_id, 0 AS part, CASE WHEN f IN (0, 1, 2, 6, 8) THEN 'youtube' WHEN f IN (4, 9) THEN 'tiktok' WHEN f = 5 THEN 'instagram' END AS platform,
   CASE WHEN f IN (0, 1, 2, 8) THEN left(h, 11) WHEN f = 4 THEN CAST(doc_id AS VARCHAR) WHEN f = 5 THEN left(h, 9) WHEN f = 3 THEN 'youtube.com.evil.com/watch' END AS content_id,
   CASE WHEN f IN (0, 1, 2, 8) THEN 'https://www.youtube.com/watch?v=' || left(h, 11) WHEN f = 4 THEN 'https://www.tiktok.com/@u' || doc_id || '/video/' || doc_id
    WHEN f = 5 THEN 'https://www.instagram.com/reel/' || left(h, 9) || '/' WHEN f = 3 THEN 'https://youtube.com.evil.com/watch?v=' || left(h, 11) END AS canonical_url,
   CASE f WHEN 6 THEN '無法從 YouTube 連結取出影片 ID:https://youtu.be/' || left(h, 8)
    WHEN 9 THEN '無法從 TikTok 連結取出影片 ID(短連結需先展開):https://vm.tiktok.com/' || left(h, 7) END AS reason,
   CASE f WHEN 6 THEN 'https://youtu.be/' || left(h, 8) WHEN 9 THEN 'https://vm.tiktok.com/' || left(h, 7) END AS link, f
  FROM d WHERE k IN (1, 2) AND f <> 7
  UNION ALL SELECT doc_id, 0, 'youtube', left(h, 11), 'https://www.youtube.com/watch?v=' || left(h, 11), NULL, NULL, 0 FROM d WHERE k = 5
  UNION ALL SELECT doc_id, 1, 'web', 'news.example/a/' || (doc_id % 50), 'https://news.example/a/' || (doc_id % 50) || '?utm=' || doc_id, NULL, NULL, 0 FROM d WHERE k = 5
  UNION ALL SELECT page_id + 1000000000, 0, 'web', rtrim({content._HOST} || {content._PATH}, '/'), url, NULL, NULL, 0 FROM pages
), given AS (
  SELECT doc_id AS item_id, CASE WHEN k IN (1, 2) THEN 'ftp://youtube.com/' || doc_id WHEN k = 3 THEN '' WHEN doc_id % 60 = 4 THEN rpad(text, 100001, text) ELSE text END AS text
  FROM d WHERE k IN (0, 3, 4) OR (k IN (1, 2) AND f = 7)
), texts AS (
  SELECT item_id, {sql.TRIMMED} AS t FROM given
), gated AS (
  SELECT item_id, t, CASE WHEN length(t) = 0 THEN '內容是空的' WHEN length(t) > 100000 THEN '內容過長' END AS reason, 'txt_' || left(sha256(t), 16) AS id FROM texts
), it AS (
  SELECT item_id, part, 'link' AS kind, CASE WHEN f = 3 THEN 'web' ELSE platform END AS platform, content_id, canonical_url, reason, link, CAST(NULL AS VARCHAR) AS t FROM links
  UNION ALL SELECT item_id, 0, 'text', 'manual', CASE WHEN reason IS NULL THEN id END, CASE WHEN reason IS NULL THEN 'manual:' || id END, reason, CAST(NULL AS VARCHAR), t FROM gated
), lib AS (
  SELECT doc_id + 5000000 AS source_id, 'manual' AS platform, 'txt_' || left(sha256({sql.TRIMMED}), 16) AS content_id, quality FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT doc_id + 6000000, 'youtube', left(md5(text), 11), quality FROM documents JOIN labels USING (doc_id)
), known AS (SELECT platform, content_id, min(source_id) FILTER (WHERE quality = 1) AS live_id, min(source_id) AS any_id FROM lib GROUP BY 1, 2),
own AS (SELECT *, CASE WHEN part = 0 THEN item_id ELSE 4611686018427387904 + CAST('0x' || left(md5(item_id || ':' || part), 15) AS BIGINT) END AS key FROM it),
firsts AS (SELECT platform, content_id, min_by(key, (item_id, part)) AS key FROM own WHERE reason IS NULL GROUP BY 1, 2),
ro AS (
  SELECT own.*, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN live_id IS NOT NULL OR own.key <> firsts.key THEN 'duplicate'
    WHEN any_id IS NOT NULL THEN 'reingest' ELSE 'queued' END AS routing, live_id, any_id, firsts.key AS first_key
  FROM own LEFT JOIN known USING (platform, content_id) LEFT JOIN firsts USING (platform, content_id)
), routed AS (
  SELECT *, CASE routing WHEN 'duplicate' THEN coalesce(live_id, first_key) WHEN 'reingest' THEN any_id END AS known_source_id,
    CASE WHEN routing <> 'duplicate' THEN key END AS source_id FROM ro
)"""
_READY = "ready AS (SELECT source_id, t FROM routed WHERE kind = 'text' AND routing IN ('queued', 'reingest'))"
_SEG = f"{_BATCH}, {_READY}, seg AS (SELECT source_id, 0 AS seq, t, 0.0 AS st, 0.0 AS en FROM ready)"
_STORE = f"""{content._PIECES_DOC}"""

ORACLES = {
    "ingest_routing": f"""WITH {_BATCH} SELECT item_id, CAST(part AS BIGINT) AS part, kind, platform, content_id, canonical_url, reason, routing, known_source_id, source_id FROM routed""",
    "ingest_jobs": f"""WITH {_BATCH} SELECT item_id, CAST(part AS BIGINT) AS part, kind, CASE routing WHEN 'rejected' THEN 'failed' WHEN 'duplicate' THEN 'duplicate' ELSE
 CASE kind WHEN 'link' THEN 'pending' ELSE 'done' END END AS status, coalesce(source_id, known_source_id) AS source_id, reason AS error FROM routed""",
    "ingest_sources": content.chunk_sql(_SEG) + """, nc AS (SELECT source_id, count(*) AS n FROM packed GROUP BY 1)
SELECT r.source_id, CASE WHEN kind = 'text' THEN 'text' WHEN platform = 'web' THEN 'article' ELSE 'video' END AS type, platform, content_id AS video_id,
 CASE WHEN kind = 'text' AND reason IS NULL THEN substr(trim(split_part(t, chr(10), 1)), 1, 80) END AS title, coalesce(canonical_url, link) AS url_normalized,
 CASE WHEN reason IS NOT NULL THEN 'failed' WHEN kind = 'link' THEN 'processing' ELSE 'ready' END AS status, reason AS error, coalesce(n, 0) AS n_chunks
FROM routed r LEFT JOIN nc ON nc.source_id = r.source_id WHERE routing <> 'duplicate'""",
    "settle_sources": content.chunk_sql(content._PIECES_DOC) + f""", {sql.SOURCES},
c AS (SELECT source_id, chunk_seq, count(*) OVER (PARTITION BY source_id) AS n, chunk_seq = max(chunk_seq) OVER (PARTITION BY source_id) AS last FROM packed WHERE source_id % 23 <> 7),
f AS (SELECT source_id, n, CASE WHEN source_id % 19 = 6 THEN 'chunk_id_repeated' WHEN source_id % 11 = 3 OR source_id % 17 = 1 THEN 'chunk_without_vector'
  WHEN source_id % 7 = 2 AND n > 1 AND source_id % 13 <> 5 THEN 'vector_dimension' WHEN source_id % 13 = 5 THEN 'vector_repeated' END AS why FROM c WHERE last)
SELECT src.source_id, CASE WHEN why IS NOT NULL THEN 'failed' ELSE status END AS status, why AS error,
 CASE WHEN why IS NULL THEN coalesce(n, 0) ELSE 0 END AS n_chunks, CASE WHEN why IS NULL THEN coalesce(n, 0) ELSE 0 END AS n_vectors
FROM src LEFT JOIN f USING (source_id)""",
}
