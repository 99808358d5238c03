"""Search queries: nearest neighbours, keyword ranking, fusion, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import fulltext as X
from kbspark.operators import retrieve as R
from kbspark.operators import vectors as V
from kbspark.plans import sql
from kbspark.session import stored
from kbspark.sources import tables as S

MAX_DIST = 1.25


def _b(name):
    return F.col(name).cast("long").alias(name)


def label_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query vector per label: the mean of its vectors (labels are few, vectors many)."""
    rows = S.given(spark, sf, "embeddings").select(
        "label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return rows.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("qvec"))


def knn_l2(spark, sf):
    vecs = S.given(spark, sf, "embeddings")
    out = V.knn(label_queries(spark, sf), vecs, 12, MAX_DIST, id_col="vec_id")
    return out.select(_b("query_id"), _b("vec_id"), _b("vec_rank"), "distance")


def knn_cosine(spark, sf):
    vecs = S.given(spark, sf, "embeddings")
    out = V.knn(label_queries(spark, sf), vecs, 10, None, id_col="vec_id", cosine=True)
    return out.select(_b("query_id"), _b("vec_id"), _b("vec_rank"), F.col("distance").alias("cosine"))


def terms(spark, sf):
    return S.questions(spark, sf).select("query_id", F.posexplode(T.query_terms("query")).alias("pos", "term")).select(
        "query_id", _b("pos"), "term")


def fts_match(spark, sf):
    hits = X.fts_match(S.questions(spark, sf), S.whole_chunks(spark, sf))
    return hits.groupBy("query_id", "chunk_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("total_tf"))


def bm25(spark, sf):
    out = X.bm25(S.questions(spark, sf), S.whole_chunks(spark, sf), 12)
    return out.select("query_id", "chunk_id", _b("fts_rank"), F.round("score", 6).alias("score"))


def bm25_indexed(spark, sf):
    """The same search over a posting table, with text ids."""
    chunks = S.whole_chunks(spark, sf).withColumn("chunk_id", F.format_string("c%012d", "chunk_id"))
    out = X.bm25(S.questions(spark, sf), chunks, 12, index=X.gram_index(chunks, "chunk_id"))
    return out.select("query_id", "chunk_id", _b("fts_rank"), F.round("score", 6).alias("score"))


def bm25_named(spark, sf):
    """The same search where the texts are read, with text ids."""
    chunks = S.whole_chunks(spark, sf).withColumn("chunk_id", F.format_string("c%012d", "chunk_id"))
    out = X.bm25(S.questions(spark, sf), chunks, 12)
    return out.select("query_id", "chunk_id", _b("fts_rank"), F.round("score", 6).alias("score"))


def gram_index(spark, sf):
    """Posting-list lengths of the trigram index."""
    return X.gram_index(S.whole_chunks(spark, sf), "chunk_id").groupBy("gram").agg(F.count(F.lit(1)).alias("postings"))


def embedded(spark, sf):
    """(questions with vectors, chunks, chunk vectors, sources) over whole documents."""
    chunks, sources = S.whole_chunks(spark, sf), S.sources(spark, sf)
    titled = S.given(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), T.first_line("text", 80).alias("title"), "text")
    vectors = V.embed_chunks(titled).select("chunk_id", "embedding")
    return V.embed(S.questions(spark, sf), "query", "qvec"), chunks, vectors, sources


def embed(spark, sf):
    """Encoded documents as (chunk_id, slot, value) of the non-zero slots."""
    _, _, vectors, _ = embedded(spark, sf)
    return vectors.select("chunk_id", F.posexplode("embedding").alias("slot", "value")).filter(
        F.col("value") != 0).select("chunk_id", _b("slot"), F.round(F.col("value").cast("double"), 5).alias("value"))


def hybrid_results(spark, sf, **kw):
    return R.retrieve(*embedded(spark, sf), max_dist=MAX_DIST, **kw)


def _result_columns(df, *extra):
    return df.select(
        "query_id", _b("rank"), "chunk_id", "source_id", _b("vec_rank"), "vec_distance", _b("fts_rank"),
        F.round("score", 6).alias("score"), *extra)


def rrf_hybrid(spark, sf):
    return _result_columns(hybrid_results(spark, sf), "title")


def rrf_scoped(spark, sf):
    return _result_columns(hybrid_results(spark, sf, scope_collection=7), "collection_id")


def rrf_prescoped(spark, sf):
    return _result_columns(hybrid_results(spark, sf, scope_collection=7, scope="pre"), "collection_id")


def _sized(spark, sf):
    """(questions with a size each, chunks, vectors, sources): sizes from none to far too large."""
    questions, *rest = embedded(spark, sf)
    wanted = F.when(F.col("query_id") % 5 == 0, F.lit(None).cast("int")).otherwise((F.col("query_id") * 7 % 29).cast("int") - 3)
    return questions.withColumn("top_k", wanted), *rest


def bounded_search(spark, sf):
    """Every question with a result size of its own."""
    return _result_columns(R.bounded_search(*_sized(spark, sf), max_dist=MAX_DIST), "title")


def retrieve_chunks(spark, sf):
    """Flagship: hybrid retrieval over real packed chunks of every document, packed once and encoded where they are searched."""
    from kbspark.operators.chunking import build_chunks

    sources = S.sources(spark, sf)
    # a document is one segment, and its title goes with its chunks: their texts are shuffled once
    chunks = stored(build_chunks(S.document_segments(spark, sf), sources, max_seq=0, carry=("title",)), "chunks")
    vectors = V.embed_chunks(chunks).select("chunk_id", "embedding")
    questions = V.embed(S.questions(spark, sf), "query", "qvec")
    return _result_columns(R.retrieve(questions, chunks.drop("title"), vectors, sources, max_dist=MAX_DIST), "title")


def keyword_snippet(spark, sf):
    out = X.keyword_search(S.questions(spark, sf), S.whole_chunks(spark, sf), S.sources(spark, sf))
    return out.select("query_id", "chunk_id", _b("fts_rank"), "title", "snippet")


def notes_prefilter(spark, sf):
    notes = S.notes(spark, sf)
    vectors = V.embed_chunks(notes.select("note_id", "title", F.col("content").alias("text"))).select("note_id", "embedding")
    out = R.note_search(V.embed(S.questions(spark, sf), "query", "qvec"), notes, vectors, max_dist=MAX_DIST)
    return out.select("query_id", _b("rank"), "note_id", _b("vec_rank"), _b("fts_rank"), F.round("score", 6).alias("score"), "kind")


def trace(spark, sf):
    """Audit rows; the labels cited are those whose rank equals the question id modulo six."""
    results = hybrid_results(spark, sf)
    cited = S.questions(spark, sf).select(
        "query_id", T.citation_labels(F.concat(F.lit("【S"), (F.col("query_id") % 6 + 1).cast("string"), F.lit("】"))).alias("labels"))
    rows = R.trace_rows(results, cited)
    return rows.select("query_id", _b("label"), "chunk_id", "title", "timestamp", _b("vec_rank"), "vec_distance",
                       _b("fts_rank"), "rrf_score", F.col("cited").cast("long").alias("cited"))


def context_frames(spark, sf):
    out = R.context_block(hybrid_results(spark, sf))
    return out.select("query_id", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("digest"))


def context_window(spark, sf):
    """Neighbours of the turn after each conversation's last user turn (which may not exist)."""
    turns = S.given(spark, sf, "conversations")
    chunks = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("source_id"),
                          "text", (F.col("turn") * 10.0).alias("start_sec"))
    hits = turns.filter(F.col("role") == "user").groupBy("conv_id").agg(F.max("turn").alias("t")).select(
        F.col("conv_id").alias("query_id"), F.col("conv_id").alias("source_id"), (F.col("conv_id") * 1000 + F.col("t") + 1).alias("chunk_id"))
    return R.context_window(chunks, hits).select(
        "query_id", "chunk_id", _b("pos"), F.col("is_hit").cast("long").alias("is_hit"), F.col("missing").cast("long").alias("missing"))


QUERIES = {f.__name__: f for f in (
    knn_l2, knn_cosine, terms, fts_match, bm25, bm25_indexed, bm25_named, gram_index, embed, rrf_hybrid, rrf_scoped, rrf_prescoped, bounded_search, retrieve_chunks,
    keyword_snippet, notes_prefilter, trace, context_frames, context_window)}

_CENTROIDS = """
e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
q AS (SELECT CAST(label AS BIGINT) AS query_id, i, avg(x) AS m FROM e GROUP BY 1, 2)"""
_TOP = """SELECT h.query_id, h.rn AS rank, h.chunk_id, h.source_id, h.vec_rank, h.vec_distance, h.fts_rank, round(h.score, 6) AS score"""
_HITS = """hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn
  FROM (SELECT f.*, s.source_id, s.title, s.collection_id, s.text, s.ingested_at FROM fused f JOIN src s ON s.source_id = f.chunk_id {where}))"""
_H = "WITH " + sql.SOURCES + "," + sql.hybrid() + "," + _HITS.format(where="")
_NOTE_TEXTS = """SELECT note_id AS chunk_id, title || chr(1) || content || chr(1) || application AS t, status,
  greatest(length(title) - 2, 0) + greatest(length(content) - 2, 0) + greatest(length(application) - 2, 0) AS n_grams FROM notes"""
_PRE = "SELECT doc_id AS chunk_id, text AS t, greatest(length(text) - 2, 0) AS n_grams FROM documents WHERE source = 'src7'"
_ESC = "replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

ORACLES = {
    "knn_l2": f"""WITH {_CENTROIDS},
d AS (SELECT q.query_id, e.vec_id, round(sqrt(sum((x - m) * (x - m))), 6) AS distance FROM e JOIN q USING (i) GROUP BY 1, 2)
SELECT query_id, vec_id, rn - 1 AS vec_rank, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rn FROM d WHERE distance <= 1.25) WHERE rn <= 12""",
    "knn_cosine": f"""WITH {_CENTROIDS},
d AS (SELECT q.query_id, e.vec_id, round(sum(x * m) / sqrt(sum(x * x)) / sqrt(sum(m * m)), 6) AS cosine FROM e JOIN q USING (i) GROUP BY 1, 2)
SELECT query_id, vec_id, rn - 1 AS vec_rank, cosine FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rn FROM d) WHERE rn <= 10""",
    "terms": """WITH t AS (SELECT item_id AS query_id, regexp_extract_all(text, '[A-Za-z0-9]{2,}|[一-鿿]{3,}') AS ts FROM benchmark),
u AS (SELECT query_id, unnest(ts) AS term, unnest(range(len(ts))) AS p FROM t),
f AS (SELECT query_id, term, min(p) AS p FROM u GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY p) - 1 AS pos, term FROM f""",
    "fts_match": f"""WITH {sql.bm25(sql.DOC_TEXTS)}
SELECT query_id, chunk_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS total_tf FROM occ JOIN terms USING (needle) GROUP BY 1, 2""",
    "bm25": f"""WITH {sql.bm25(sql.DOC_TEXTS)}, {sql.ranked()}
SELECT query_id, chunk_id, fts_rank, round(score, 6) AS score FROM fts""",
    **dict.fromkeys(("bm25_indexed", "bm25_named"), f"""WITH {sql.bm25(sql.DOC_TEXTS)}, {sql.ranked()}
SELECT query_id, format('c{{:012d}}', chunk_id) AS chunk_id, fts_rank, round(score, 6) AS score FROM fts"""),
    "gram_index": f"""WITH {sql.chars('ch', 'SELECT doc_id, lower(text) AS t FROM documents', 'doc_id')},
g AS (SELECT DISTINCT doc_id, c || lead(c) OVER w || lead(c, 2) OVER w AS gram FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY p))
SELECT gram, count(*) AS postings FROM g WHERE gram IS NOT NULL GROUP BY gram""",
    "embed": f"""WITH {sql.encoded('ed', f"SELECT doc_id AS chunk_id, substr(trim(split_part({sql.TRIMMED}, chr(10), 1)), 1, 80) || chr(10) || text AS t FROM documents", 'chunk_id')}
SELECT chunk_id, CAST(slot AS BIGINT) AS slot, round(v, 5) AS value FROM ed""",
    "rrf_hybrid": f"{_H} {_TOP}, h.title FROM hits h WHERE rn <= 6",
    "bounded_search": "WITH " + sql.SOURCES + """, sz AS (SELECT item_id AS query_id, CASE WHEN item_id % 5 = 0 OR item_id * 7 % 29 = 3 THEN 6
 ELSE least(greatest(item_id * 7 % 29 - 3, 1), 20) END AS k FROM benchmark),""" + ",".join([
        sql.bm25(sql.DOC_TEXTS), sql.ranked(k=40, name="fts0"),
        sql.encoded("eq", "SELECT item_id AS query_id, text AS t FROM benchmark", "query_id"),
        sql.encoded("ed", f"SELECT doc_id AS chunk_id, substr(trim(split_part({sql.TRIMMED}, chr(10), 1)), 1, 80) || chr(10) || text AS t FROM documents", "chunk_id"),
        sql.nearest("eq", "ed", 40, 1.25).replace("vec AS", "vec0 AS"),
        "fts AS (SELECT fts0.* FROM fts0 JOIN sz USING (query_id) WHERE fts_rank < 2 * k)", "vec AS (SELECT vec0.* FROM vec0 JOIN sz USING (query_id) WHERE vec_rank < 2 * k)",
        sql.fused()]) + "," + _HITS.format(where="") + f" {_TOP}, h.title FROM hits h JOIN sz USING (query_id) WHERE rn <= k",
    "rrf_scoped": "WITH " + sql.SOURCES + "," + sql.hybrid(fetch=24) + "," + _HITS.format(where="WHERE s.collection_id = 7")
    + f" {_TOP}, h.collection_id FROM hits h WHERE rn <= 6",
    "rrf_prescoped": "WITH " + sql.SOURCES + "," + ",".join([
        sql.bm25(_PRE), sql.ranked(k=24), sql.encoded("eq", "SELECT item_id AS query_id, text AS t FROM benchmark", "query_id"),
        sql.encoded("ed", f"SELECT doc_id AS chunk_id, substr(trim(split_part({sql.TRIMMED}, chr(10), 1)), 1, 80) || chr(10) || text AS t FROM documents WHERE source = 'src7'", "chunk_id"),
        sql.nearest("eq", "ed", 24, 1.25), sql.fused()]) + "," + _HITS.format(where="") + f" {_TOP}, h.collection_id FROM hits h WHERE rn <= 6",
    "keyword_snippet": f"""WITH {sql.SOURCES}, {sql.bm25(sql.DOC_TEXTS)}, {sql.ranked(k=20)},
pat AS (SELECT query_id, '(' || string_agg(needle, '|' ORDER BY length(needle) DESC, needle) || ')' AS pattern
        FROM (SELECT DISTINCT query_id, needle FROM terms) GROUP BY 1),
fh AS (SELECT f.query_id, f.chunk_id, min(strpos(lower(x.t), t.needle)) AS first
       FROM fts f JOIN texts x USING (chunk_id) JOIN terms t USING (query_id) WHERE strpos(lower(x.t), t.needle) > 0 GROUP BY 1, 2),
b AS (SELECT f.*, s.title, s.text, p.pattern, greatest(a.first - 4, 1) AS st FROM fts f JOIN fh a USING (query_id, chunk_id)
      JOIN pat p USING (query_id) JOIN src s ON s.source_id = f.chunk_id)
SELECT query_id, chunk_id, fts_rank, title, CASE WHEN st > 1 THEN '…' ELSE '' END
  || regexp_replace(substr(text, st, 22), pattern, '【\\1】', 'gi')
  || CASE WHEN st + 22 <= length(text) THEN '…' ELSE '' END AS snippet FROM b""",
    "notes_prefilter": f"""WITH {sql.NOTES}, {sql.bm25(_NOTE_TEXTS, allowed="x.status = 'kept'")}, {sql.ranked(k=10)},
{sql.encoded("eq", "SELECT item_id AS query_id, text AS t FROM benchmark", "query_id")},
{sql.encoded("ed", "SELECT note_id AS chunk_id, title || chr(10) || content AS t FROM notes", "chunk_id")},
{sql.nearest("eq", "ed", 10, 1.25)}, {sql.fused()}
SELECT query_id, rn AS rank, chunk_id AS note_id, vec_rank, fts_rank, round(score, 6) AS score, kind FROM (
  SELECT f.*, n.kind, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn
  FROM fused f JOIN notes n ON n.note_id = f.chunk_id WHERE n.status = 'kept') WHERE rn <= 5""",
    "trace": f"""{_H} SELECT query_id, rn AS label, chunk_id, CASE WHEN title = '' THEN '(未命名)' ELSE title END AS title, '0:00' AS timestamp, vec_rank,
  round(vec_distance, 3) AS vec_distance, fts_rank, round(score, 4) AS rrf_score,
  CAST(CASE WHEN rn = query_id % 6 + 1 THEN 1 ELSE 0 END AS BIGINT) AS cited FROM hits WHERE rn <= 6""",
    "context_frames": f"""{_H}, parts AS (SELECT query_id, rn, '<source label="S' || rn || '" title="'
  || replace(replace({_ESC.format(c="title")}, '"', '&quot;'), '''', '&#x27;') || '" platform="manual" timestamp="0:00-0:00" published="'
  || strftime(ingested_at, '%Y-%m-%d') || '">' || chr(10) || {_ESC.format(c="text")} || chr(10) || '</source>' AS b FROM hits WHERE rn <= 6),
c AS (SELECT query_id, '<retrieved_sources>' || chr(10) || string_agg(b, chr(10) ORDER BY rn) || chr(10) || '</retrieved_sources>' AS context FROM parts GROUP BY 1)
SELECT query_id, length(context) AS n_chars, md5(context) AS digest FROM c""",
    "context_window": """WITH c AS (SELECT conv_id, conv_id * 1000 + turn AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
h AS (SELECT conv_id, conv_id * 1000 + max(turn) + 1 AS chunk_id FROM conversations WHERE role = 'user' GROUP BY 1),
a AS (SELECT h.*, c.pos AS hp FROM h LEFT JOIN c USING (conv_id, chunk_id))
SELECT a.conv_id AS query_id, c.chunk_id, c.pos, CAST(CASE WHEN c.chunk_id = a.chunk_id THEN 1 ELSE 0 END AS BIGINT) AS is_hit,
  CAST(CASE WHEN hp IS NULL THEN 1 ELSE 0 END AS BIGINT) AS missing
FROM a JOIN c USING (conv_id) WHERE (hp IS NULL AND c.pos IN (0, 1)) OR c.pos BETWEEN hp - 1 AND hp + 1""",
}
