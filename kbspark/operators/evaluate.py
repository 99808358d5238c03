"""Retrieval quality: fixture checks, recall, MRR, coverage, attribution, A/B, rubrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.operators.blocks import top_k
from kbspark.operators.fulltext import bm25, occurrences
from kbspark.operators.retrieve import rrf
from kbspark.operators.vectors import MAX_DISTANCE, knn, within
from kbspark.session import NARROW_ROWS, at_most, bounded_values, small_side

PASSAGE_GRAM = 12
# Characters of passages that are sent to every task (an automaton takes about 80 bytes for each).
SENT_CHARS = 1_000_000


def passages(golden: DataFrame) -> DataFrame:
    """(query_id, pos, doc, passage) of every expected passage."""
    extra = [c for c in ("category",) if c in golden.columns]
    return golden.select("query_id", *extra, F.posexplode("expect").alias("pos", "_e")).select(
        "query_id", *extra, "pos", F.col("_e.doc").alias("doc"), F.col("_e.text").alias("passage"))


def passage_hits(texts: DataFrame, wanted: DataFrame, id_col: str, n: int = PASSAGE_GRAM) -> DataFrame:
    """(id, passage) for every text containing a passage (case-sensitive).

    Passages proven few and short are sent to the texts, which are read once where they lie. Others
    are found by a shared n-gram, those shorter than ``n`` by a shorter one.
    """
    needle = wanted.select(F.col("passage").alias("needle")).distinct()
    known = bounded_values(needle, F.col("needle"))
    if known is not None and sum(len(x or "") for x in known) <= SENT_CHARS:
        return occurrences(texts, needle, id_col, n=1, fold=False, count_hits=False, known=known).withColumnRenamed("needle", "passage")
    out = occurrences(texts, needle.filter(F.length("needle") >= n), id_col, n=n, fold=False, count_hits=False)
    short = needle.filter((F.length("needle") < n) & (F.length("needle") > 0))
    if not short.isEmpty():
        out = out.unionByName(occurrences(texts, short, id_col, n=1, fold=False, count_hits=False))
    return out.withColumnRenamed("needle", "passage")


def fixture_problems(golden: DataFrame, docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(query_id, pos, problem): unknown doc, passage missing from it, or ambiguous."""
    want = passages(golden)
    hits = passage_hits(docs, want, doc).withColumnRenamed(doc, "_hit")
    where = hits.groupBy("passage").agg(F.count(F.lit(1)).alias("_n"))
    known = docs.select(F.col(doc).alias("doc"), F.lit(True).alias("_known")).distinct()
    named = want.join(hits, (want["passage"] == hits["passage"]) & (want["doc"] == hits["_hit"]), "left_semi").select(
        "query_id", "pos", F.lit(True).alias("_named"))
    rows = want.join(known, "doc", "left").join(named, ["query_id", "pos"], "left").join(where, "passage", "left")
    problem = (
        F.when(F.col("_known").isNull(), "unknown_doc").when(F.col("_named").isNull(), "missing")
        .when(F.col("_n") > 1, "ambiguous")
    )
    return rows.select("query_id", "pos", "doc", problem.alias("problem")).filter(F.col("problem").isNotNull())


def first_ranks(results: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, pos, exp_rank, gold): best-ranked result holding each passage, or null.

    Only top-k rows are compared with the passages of their own query. ``gold`` is that
    result's chunk_id with its rank in each arm, as far as the results carry them.
    """
    arms = [c if c in results.columns else F.lit(None).cast("int").alias(c) for c in ("vec_rank", "fts_rank")]
    top = results.select("query_id", "rank", "chunk_id", *arms, F.col(text).alias("_t"))
    hit = wanted.join(top, "query_id").filter(F.col("_t").contains(F.col("passage")))
    best = hit.groupBy("query_id", "pos").agg(
        F.min("rank").alias("exp_rank"), F.min_by(F.struct("chunk_id", "vec_rank", "fts_rank"), "rank").alias("gold"))
    return wanted.join(best, ["query_id", "pos"], "left")


def query_scores(results: DataFrame, golden: DataFrame) -> DataFrame:
    """Per positive query: hit, reciprocal rank, coverage, first matched chunk and its arm ranks."""
    ranks = first_ranks(results, passages(golden))
    per = ranks.groupBy("query_id", "category").agg(
        F.min("exp_rank").alias("first_rank"), F.count_if(F.col("exp_rank").isNotNull()).alias("covered"),
        F.count(F.lit(1)).alias("expected"),
        # the passage listed first decides, not the best-ranked one
        F.min_by("gold", F.when(F.col("exp_rank").isNotNull(), F.col("pos"))).alias("gold"),
    )
    return per.select(
        "query_id", "category", "first_rank", F.col("gold.chunk_id").alias("gold_chunk"),
        F.col("gold.vec_rank").alias("gold_vec_rank"), F.col("gold.fts_rank").alias("gold_fts_rank"),
        F.when(F.col("first_rank").isNotNull(), 1.0).otherwise(0.0).alias("hit"),
        F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)).alias("rr"),
        (F.col("covered") / F.col("expected")).alias("coverage"),
    )


def recall_mrr(scores: DataFrame) -> DataFrame:
    """Recall, MRR, coverage per category and overall (category ``ALL``)."""
    return scores.rollup("category").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 4).alias("recall"), F.round(F.avg("rr"), 4).alias("mrr"),
        F.round(F.avg("coverage"), 4).alias("coverage"),
        F.grouping("category").alias("_g"),
    ).withColumn("category", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("category"))).drop("_g")


def _route(v, f):
    return F.when(v & f, "both").when(v, "vector_only").when(f, "fts_only").otherwise("neither").alias("route")


def attribution(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, route) for hits: both, vector_only, fts_only, neither.

    A result carries its rank in each arm, and each arm's own top k are its ranks below k,
    so the arms need not be searched again.
    """
    inside = lambda c: F.coalesce(F.col(c) < k, F.lit(False))
    return scores.filter(F.col("gold_chunk").isNotNull()).select(
        "query_id", F.col("gold_chunk").alias("chunk_id"), _route(inside("gold_vec_rank"), inside("gold_fts_rank")))


def attribution_by_search(scores: DataFrame, vec_top: DataFrame, fts_top: DataFrame) -> DataFrame:
    """The same from separately searched arms, for results without provenance."""
    hits = scores.filter(F.col("gold_chunk").isNotNull()).select("query_id", F.col("gold_chunk").alias("chunk_id"))
    flag = lambda df, n: df.select("query_id", "chunk_id", F.lit(True).alias(n)).distinct()
    rows = hits.join(flag(vec_top, "_v"), ["query_id", "chunk_id"], "left").join(
        flag(fts_top, "_f"), ["query_id", "chunk_id"], "left")
    return rows.select("query_id", "chunk_id", _route(F.col("_v").isNotNull(), F.col("_f").isNotNull()))


def attribution_counts(routes: DataFrame) -> DataFrame:
    return routes.agg(*[
        F.count_if(F.col("route") == r).alias(r) for r in ("both", "vector_only", "fts_only", "neither")])


def arm_tops(vec: DataFrame, fts: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Each arm's own top-k: (query_id, chunk_id) of arms that were searched at least that deep.

    The first ``k`` of an arm's best are its best ``k``, so a shallower search is not run again.
    """
    return (vec.filter(F.col("vec_rank") < k).select("query_id", "chunk_id"),
            fts.filter(F.col("fts_rank") < k).select("query_id", "chunk_id"))


def false_hits(results: DataFrame, golden: DataFrame) -> DataFrame:
    """One row: negative queries, and how many of them returned anything."""
    negative = golden.filter(F.size("expect") == 0).select("query_id")
    got = results.select("query_id").distinct().withColumn("_got", F.lit(True))
    return negative.join(got, "query_id", "left").agg(
        F.count(F.lit(1)).alias("negatives"), F.count_if(F.col("_got")).alias("false_hits"))


def threshold_sweep(queries: DataFrame, vectors: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Hits per query and cut-off: all vectors within it, counted in one scan."""
    return within(queries, vectors, thresholds)


def cutoff_results(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, thresholds: Sequence[float], k: int) -> DataFrame:
    """(threshold, query_id, rank, chunk_id, vec_rank, fts_rank): fused results for every cut-off.

    A cut-off only shortens a vector arm, it never changes ranks. So the arm is searched
    once, at the widest cut-off, and the keyword arm once; both are then read for each cut-off.
    """
    cuts = sorted({float(c) for c in thresholds})
    every = F.array(*[F.lit(c) for c in cuts])
    fetch = 2 * k
    # one key for both, so that fusion and ranking work per cut-off and query
    keyed = lambda df, list_: df.withColumn("_cut", F.explode(list_)).withColumn("query_id", F.struct("_cut", "query_id"))
    vec = keyed(knn(queries.select("query_id", "qvec"), vectors, fetch, cuts[-1]), F.filter(every, lambda c: F.col("distance") <= c))
    fts = keyed(bm25(queries.select("query_id", "query"), chunks, fetch), every)
    top = top_k(rrf(vec, fts), ["query_id"], [F.desc("score"), F.asc("chunk_id")], fetch * 2, "rank")
    return top.select(F.col("query_id._cut").alias("threshold"), F.col("query_id.query_id").alias("query_id"), "rank", "chunk_id", "vec_rank", "fts_rank")


def cutoff_scores(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame, sources: DataFrame, golden: DataFrame, thresholds: Sequence[float], k: int,
) -> DataFrame:
    """One row per cut-off: n, recall, mrr, coverage of the positive queries; negatives, false_hits.

    Equal to one evaluation per cut-off. Whether a chunk holds a passage does not depend on
    the cut-off, so chunk texts meet the passages once per query and chunk.
    """
    found = cutoff_results(queries, chunks, vectors, thresholds, k)
    ids = found.select("chunk_id").distinct()
    texts = chunks.join(small_side(ids, at_most(ids, NARROW_ROWS)), "chunk_id", "left_semi").join(
        sources.select("source_id"), "source_id", "left_semi").select("chunk_id", "text")
    stored = texts.select("chunk_id")
    # chunks of no source are no results: the ranks behind them move up
    top = top_k(found.join(stored, "chunk_id").withColumnRenamed("rank", "_place"), ["threshold", "query_id"], [F.asc("_place")], k, "rank")
    want = passages(golden)
    holds = top.select("query_id", "chunk_id").distinct().join(texts, "chunk_id").join(want.select("query_id", "pos", "passage"), "query_id").filter(
        F.col("text").contains(F.col("passage"))).select("query_id", "pos", "chunk_id")
    ranks = top.join(holds, ["query_id", "chunk_id"]).groupBy("threshold", "query_id", "pos").agg(F.min("rank").alias("exp_rank"))
    cuts = F.explode(F.array(*[F.lit(c) for c in sorted({float(c) for c in thresholds})])).alias("threshold")
    per = want.select("query_id", "pos", cuts).join(ranks, ["threshold", "query_id", "pos"], "left").groupBy("threshold", "query_id").agg(
        F.min("exp_rank").alias("r"), (F.count("exp_rank") / F.count(F.lit(1))).alias("c"))
    hit = F.when(F.col("r").isNotNull(), 1.0).otherwise(0.0)
    scores = per.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 4).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 4).alias("mrr"),
        F.round(F.avg("c"), 4).alias("coverage"))
    negative = golden.filter(F.size("expect") == 0).select("query_id", cuts)
    got = top.select("threshold", "query_id").distinct().withColumn("_got", F.lit(True))
    wrong = negative.join(got, ["threshold", "query_id"], "left").groupBy("threshold").agg(
        F.count(F.lit(1)).alias("negatives"), F.count_if(F.col("_got")).alias("false_hits"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return scores.join(wrong, "threshold", "full").select("threshold", zero("n"), "recall", "mrr", "coverage", zero("negatives"), zero("false_hits"))


def ab_hits(rankings: DataFrame) -> DataFrame:
    """Per model: hit@1 and hit@3 from (model, query_id, relevant_rank 0-based or null)."""
    return rankings.groupBy("model").agg(
        F.count_if(F.col("relevant_rank") < 1).alias("hit_1"), F.count_if(F.col("relevant_rank") < 3).alias("hit_3"),
        F.count(F.lit(1)).alias("n"))


def best_model(hits: DataFrame) -> DataFrame:
    return hits.agg(F.max_by("model", F.struct("hit_1", "hit_3")).alias("winner"))


def relevant_ranks(queries: DataFrame, vectors: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """0-based cosine rank of each query's relevant vector, null beyond the first ``k``."""
    top = knn(queries, vectors, k, None, id_col="id", cosine=True)
    return relevant.join(top, ["query_id", "id"], "left").select(
        "query_id", F.col("vec_rank").alias("relevant_rank"))


def rubric(verdicts: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """One row: judged answers, passes per criterion, refusals and correct ones.

    Verdicts are (kind, error, one boolean per criterion, refusal_ok); rows with an error
    are left out of the judged count.
    """
    refuse = F.col("kind") == "refuse"
    judged = ~refuse & F.col("error").isNull()
    return verdicts.agg(
        F.count_if(judged).alias("n"),
        *[F.count_if(judged & F.coalesce(F.col(c), F.lit(False))).alias(c) for c in criteria],
        F.count_if(refuse).alias("refuse_n"),
        F.count_if(refuse & F.coalesce(F.col("refusal_ok"), F.lit(False))).alias("refuse_ok"),
    )


def history_regression(history: DataFrame, metrics: Sequence[str], series: Sequence[str] = (), order: str = "ts") -> DataFrame:
    """Each run with the change of every metric against the run before it."""
    w = W.partitionBy(*series).orderBy(order)
    return history.select("*", *[(F.col(m) - F.lag(m).over(w)).alias(f"{m}_change") for m in metrics])


def run_record(scores: DataFrame, routes: DataFrame, negatives: DataFrame, **facts) -> DataFrame:
    """One history row of a run, ready to append."""
    overall = scores.agg(F.round(F.avg("hit"), 4).alias("recall"), F.round(F.avg("rr"), 4).alias("mrr"),
                         F.round(F.avg("coverage"), 4).alias("coverage"))
    routes_, negative = attribution_counts(routes), negatives
    extra = [routes_.select(c).scalar().alias(c) for c in routes_.columns]
    extra += [negative.select(c).scalar().alias(c) for c in negative.columns]
    return overall.select(*[F.lit(v).alias(k) for k, v in facts.items()], "*", *extra)
