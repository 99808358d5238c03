"""Evaluation queries over a golden set made of the benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import evaluate as E
from kbspark.operators import retrieve as R
from kbspark.operators import vectors as V
from kbspark.plans import retrieval as Q
from kbspark.plans import sql
from kbspark.session import cut_lineage
from kbspark.sources import tables as S

K = 6


def _b(c, name=None):
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("long").alias(name or c)


def _found(spark, sf):
    """(doc_id, passage): benchmark passages that documents contain word for word."""
    docs = S.given(spark, sf, "documents").select("doc_id", "text")
    return E.passage_hits(docs, S.given(spark, sf, "benchmark").select(F.col("text").alias("passage")), "doc_id")


def golden(spark, sf):
    """Every benchmark passage as a question for itself; those in no document are negatives."""
    hits = _found(spark, sf).groupBy("passage").agg(F.min("doc_id").alias("doc"))
    items = S.given(spark, sf, "benchmark")
    expect = F.when(F.col("doc").isNotNull(), F.array(F.struct(F.col("doc").cast("string").alias("doc"), F.col("text").alias("text")))).otherwise(
        F.array().cast("array<struct<doc:string,text:string>>"))
    return items.join(hits, items["text"] == hits["passage"], "left").select(
        F.col("item_id").alias("query_id"), F.when(F.length("text") > 200, "long").otherwise("short").alias("category"),
        F.col("text").alias("query"), expect.alias("expect"))


def passages(spark, sf):
    ids = S.given(spark, sf, "benchmark")
    return _found(spark, sf).join(ids, F.col("passage") == F.col("text")).select("item_id", "doc_id")


def fixture_check(spark, sf):
    """The golden set as if every passage had to be in the document with its own number."""
    docs = S.given(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")
    own = S.given(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.array(F.struct((F.col("item_id") * 20).cast("string").alias("doc"), F.col("text").alias("text")),
                                                  F.struct(F.lit("nowhere").alias("doc"), F.col("text").alias("text"))).alias("expect"))
    return E.fixture_problems(own, docs).select("query_id", _b("pos"), "doc", "problem")


def ambiguous(spark, sf):
    """Problems of the golden set itself: passages that several documents contain."""
    docs = S.given(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")
    return E.fixture_problems(golden(spark, sf), docs).select("query_id", "doc", "problem")


def _scores(spark, sf):
    return E.query_scores(Q.hybrid_results(spark, sf), golden(spark, sf))


def recall_mrr(spark, sf):
    return E.recall_mrr(_scores(spark, sf))


def query_scores(spark, sf):
    return _scores(spark, sf).select("query_id", "category", _b("first_rank"), "gold_chunk", "hit", F.round("rr", 6).alias("rr"), "coverage")


def attribution(spark, sf):
    return E.attribution(_scores(spark, sf), K)


def attribution_counts(spark, sf):
    """Route counts told by the arms' own results; each arm is searched once, for these and for fusion."""
    questions, chunks, vectors, sources = Q.embedded(spark, sf)
    vec, fts = (cut_lineage(arm) for arm in R.arms(questions, chunks, vectors, 2 * K, Q.MAX_DIST))
    results = R.retrieve(questions, chunks, vectors, sources, K, Q.MAX_DIST, searched=(vec, fts))
    return E.attribution_counts(E.attribution_by_search(E.query_scores(results, golden(spark, sf)), *E.arm_tops(vec, fts, K)))


def false_hits(spark, sf):
    return E.false_hits(Q.hybrid_results(spark, sf, ), golden(spark, sf))


def threshold_sweep(spark, sf):
    out = E.threshold_sweep(Q.label_queries(spark, sf), S.given(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_id"),
                            [0.8, 1.0, 1.15, 1.25])
    return out.select("query_id", "threshold", "hits")


CUTS = (1.0, 1.1, 1.15, 1.25)


def cutoff_scores(spark, sf):
    """Recall, MRR, coverage and false hits per distance cut-off."""
    out = E.cutoff_scores(*Q.embedded(spark, sf), golden(spark, sf), CUTS, K)
    return out.select("threshold", _b("n"), "recall", "mrr", "coverage", _b("negatives"), _b("false_hits"))


def ab_hits(spark, sf):
    """Two encoders on the label means: is the vector nearest to a mean of its own label?"""
    vecs = S.given(spark, sf, "embeddings")
    ranks = None
    for name, dims in (("full", 64), ("half", 32)):
        cut = vecs.withColumn("embedding", F.slice("embedding", 1, dims))
        queries = Q.label_queries(spark, sf).withColumn("qvec", F.slice("qvec", 1, dims))
        top = V.knn(queries, cut, 3, None, id_col="vec_id", cosine=True).join(vecs.select("vec_id", "label"), "vec_id")
        best = top.filter(F.col("label") == F.col("query_id")).groupBy("query_id").agg(F.min("vec_rank").alias("relevant_rank"))
        rows = queries.select("query_id").join(best, "query_id", "left").withColumn("model", F.lit(name))
        ranks = rows if ranks is None else ranks.unionByName(rows)
    return E.ab_hits(ranks)


def ab_winner(spark, sf):
    return E.best_model(ab_hits(spark, sf))


def rubric(spark, sf):
    """Labels as verdicts: quality and harmlessness as criteria, unlabelled documents as errors."""
    v = S.given(spark, sf, "documents").join(S.given(spark, sf, "labels"), "doc_id", "left").select(
        F.when(F.col("lang") == "fr", "refuse").otherwise("single").alias("kind"), F.when(F.col("quality").isNull(), "unjudged").alias("error"),
        (F.col("quality") == 1).alias("faithful"), (F.col("toxic") == 0).alias("clean"), (F.col("toxic") == 1).alias("refusal_ok"))
    return E.rubric(v, ["faithful", "clean"])


def history_regression(spark, sf):
    """Daily means of the events as a run history per event type."""
    runs = S.given(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("run")).agg(
        F.round(F.avg("value"), 6).alias("recall"), F.count(F.lit(1)).alias("mrr"))
    out = E.history_regression(runs, ["recall", "mrr"], ["event_type"], "run")
    return out.select("event_type", "run", "recall", _b("mrr"), F.round("recall_change", 6).alias("recall_change"), _b("mrr_change"))


QUERIES = {f.__name__: f for f in (
    passages, fixture_check, ambiguous, recall_mrr, query_scores, attribution, attribution_counts, false_hits, threshold_sweep, cutoff_scores, ab_hits, ab_winner,
    rubric, history_regression)}

_HIT = "hit AS (SELECT b.item_id, b.text, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_GOLD = f"{_HIT}, gold AS (SELECT item_id, text, min(doc_id) AS doc FROM hit GROUP BY 1, 2)"
_TOPS = f"""{_GOLD}, res AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM fused),
top AS (SELECT * FROM res WHERE rn <= {K}),
m AS (SELECT g.item_id AS query_id, length(g.text) AS n, min(t.rn) AS first_rank, arg_min(t.chunk_id, t.rn) AS gold_chunk FROM gold g
  LEFT JOIN top t ON t.query_id = g.item_id AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = t.chunk_id AND contains(d.text, g.text)) GROUP BY 1, 2),
sc AS (SELECT query_id, CASE WHEN n > 200 THEN 'long' ELSE 'short' END AS category, first_rank, gold_chunk, CASE WHEN first_rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit,
  coalesce(1.0::DOUBLE / first_rank, 0) AS rr, CASE WHEN first_rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS coverage FROM m)"""
_S = "WITH " + sql.hybrid() + "," + _TOPS
_ROUTES = f""", routes AS (SELECT s.query_id, s.gold_chunk AS chunk_id, v.vec_rank < {K} AS v, f.fts_rank < {K} AS f FROM sc s
 LEFT JOIN vec v ON v.query_id = s.query_id AND v.chunk_id = s.gold_chunk LEFT JOIN fts f ON f.query_id = s.query_id AND f.chunk_id = s.gold_chunk WHERE s.gold_chunk IS NOT NULL),
rt AS (SELECT query_id, chunk_id, CASE WHEN coalesce(v, false) AND coalesce(f, false) THEN 'both' WHEN v THEN 'vector_only' WHEN f THEN 'fts_only' ELSE 'neither' END AS route FROM routes)"""
_AB = f"""e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
q AS (SELECT CAST(label AS BIGINT) AS query_id, i, avg(x) AS m FROM e GROUP BY 1, 2), md AS (SELECT unnest(['full', 'half']) AS model, unnest([64, 32]) AS dims),
d AS (SELECT model, q.query_id, e.vec_id, any_value(e.label) AS label, round(sum(x * m) / sqrt(sum(x * x)) / sqrt(sum(m * m)), 6) AS c FROM md JOIN e ON e.i < md.dims JOIN q USING (i) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY c DESC, vec_id) - 1 AS rk FROM d),
b AS (SELECT model, query_id, min(rk) FILTER (WHERE label = query_id AND rk < 3) AS rr FROM r GROUP BY 1, 2),
ab AS (SELECT model, count(*) FILTER (WHERE rr < 1) AS hit_1, count(*) FILTER (WHERE rr < 3) AS hit_3, count(*) AS n FROM b GROUP BY 1)"""

ORACLES = {
    "passages": f"WITH {_HIT} SELECT item_id, doc_id FROM hit",
    "fixture_check": f"""WITH {_HIT}, w AS (SELECT item_id, text, 0 AS pos, CAST(item_id * 20 AS VARCHAR) AS doc FROM benchmark UNION ALL SELECT item_id, text, 1, 'nowhere' FROM benchmark),
p AS (SELECT item_id AS query_id, CAST(pos AS BIGINT) AS pos, doc, CASE WHEN doc NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) THEN 'unknown_doc'
 WHEN NOT EXISTS (SELECT 1 FROM hit h WHERE h.text = w.text AND CAST(h.doc_id AS VARCHAR) = w.doc) THEN 'missing'
 WHEN (SELECT count(DISTINCT doc_id) FROM hit h WHERE h.text = w.text) > 1 THEN 'ambiguous' END AS problem FROM w) SELECT * FROM p WHERE problem IS NOT NULL""",
    "ambiguous": f"WITH {_HIT} SELECT item_id AS query_id, CAST(min(doc_id) AS VARCHAR) AS doc, 'ambiguous' AS problem FROM hit GROUP BY item_id HAVING count(*) > 1",
    "recall_mrr": f"""{_S} SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(*) AS n, round(avg(hit), 4) AS recall, round(avg(rr), 4) AS mrr, round(avg(coverage), 4) AS coverage FROM sc GROUP BY ROLLUP (category)""",
    "query_scores": f"{_S} SELECT query_id, category, first_rank, gold_chunk, hit, round(rr, 6) AS rr, coverage FROM sc",
    "attribution": f"{_S}{_ROUTES} SELECT query_id, chunk_id, route FROM rt",
    "attribution_counts": f"""{_S}{_ROUTES} SELECT count(*) FILTER (WHERE route = 'both') AS both, count(*) FILTER (WHERE route = 'vector_only') AS vector_only,
 count(*) FILTER (WHERE route = 'fts_only') AS fts_only, count(*) FILTER (WHERE route = 'neither') AS neither FROM rt""",
    "false_hits": f"{_S} SELECT count(*) AS negatives, count(*) FILTER (WHERE item_id IN (SELECT query_id FROM top)) AS false_hits FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM gold)",
    "threshold_sweep": f"""WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
q AS (SELECT CAST(label AS BIGINT) AS query_id, i, avg(x) AS m FROM e GROUP BY 1, 2),
d AS (SELECT q.query_id, e.vec_id, round(sqrt(sum((x - m) * (x - m))), 6) AS distance FROM e JOIN q USING (i) GROUP BY 1, 2),
t AS (SELECT unnest([0.8::DOUBLE, 1.0::DOUBLE, 1.15::DOUBLE, 1.25::DOUBLE]) AS threshold)
SELECT query_id, threshold, count(*) AS hits FROM d JOIN t ON distance <= threshold GROUP BY 1, 2""",
    "cutoff_scores": " UNION ALL ".join(f"""SELECT * FROM (WITH {sql.hybrid(max_dist=c)},{_TOPS}
SELECT {c}::DOUBLE AS threshold, (SELECT count(*) FROM sc) AS n, (SELECT round(avg(hit), 4) FROM sc) AS recall, (SELECT round(avg(rr), 4) FROM sc) AS mrr,
 (SELECT round(avg(coverage), 4) FROM sc) AS coverage, count(*) AS negatives, count(*) FILTER (WHERE item_id IN (SELECT query_id FROM top)) AS false_hits
FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM gold))""" for c in CUTS),
    "ab_hits": f"WITH {_AB} SELECT * FROM ab",
    "ab_winner": f"WITH {_AB} SELECT model AS winner FROM ab ORDER BY hit_1 DESC, hit_3 DESC LIMIT 1",
    "rubric": """WITH v AS (SELECT lang = 'fr' AS refuse, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT count(*) FILTER (WHERE NOT refuse AND quality IS NOT NULL) AS n, count(*) FILTER (WHERE NOT refuse AND quality = 1) AS faithful,
 count(*) FILTER (WHERE NOT refuse AND quality IS NOT NULL AND toxic = 0) AS clean, count(*) FILTER (WHERE refuse) AS refuse_n, count(*) FILTER (WHERE refuse AND toxic = 1) AS refuse_ok FROM v""",
    "history_regression": """WITH r AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS run, round(avg(value), 6) AS recall, count(*) AS mrr FROM events GROUP BY 1, 2)
SELECT event_type, run, recall, mrr, round(recall - lag(recall) OVER w, 6) AS recall_change, mrr - lag(mrr) OVER w AS mrr_change FROM r WINDOW w AS (PARTITION BY event_type ORDER BY run)""",
}
