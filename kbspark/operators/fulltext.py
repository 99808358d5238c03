"""Substring search through shared n-grams, and BM25 ranking.

Needles (query terms, gold passages) are matched to texts by an equi-join on one n-gram
of the needle, then verified. No text is paired with a needle it shares no n-gram with
and nothing is a cross join. A needle list proven small is shipped to the tasks and the
texts are scanned in place; otherwise (id, gram) pairs are joined to the needles, grams
being salted because a common gram may occur in every text.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from kbspark.functions import text as T
from kbspark.operators.blocks import best_k, text_tiles, top_k
from kbspark.session import NARROW_ROWS, at_most, bounded_values, small_side, stored

# BM25 constants, shortest term a trigram index can match, idf floor.
BM25_K1 = 1.2
BM25_B = 0.75
GRAM = 3
IDF_FLOOR = 1e-6
SALTS = 32
TILE_CELLS = 2_000_000
SCAN_BYTES = 4 * 1024 * 1024
TALLY_BYTES = 1024 * 1024


def grams(text, n: int = GRAM):
    """Overlapping n-grams of a text as an array, extracted in one linear pass."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % n), F.lit(1))


def explode_terms(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, term, needle): distinct terms per query; needle is the folded form."""
    return queries.select(query_id, F.explode(T.query_terms(query)).alias("term")).withColumn(
        "needle", F.lower("term")
    )


def gram_index(texts: DataFrame, id_col: str, text: str = "text", n: int = GRAM) -> DataFrame:
    """Posting table (gram, id): each distinct gram of each folded text once."""
    # the outer form keeps Spark from adding a filter that extracts the grams a second time
    return texts.select(
        F.explode_outer(F.array_distinct(grams(F.lower(F.col(text)), n))).alias("gram"), id_col
    ).filter(F.col("gram").isNotNull())


def extend_gram_index(
    index: DataFrame, texts: DataFrame, id_col: str, text: str = "text", registry: DataFrame | None = None,
) -> DataFrame:
    """Incremental build: index only texts whose id the index does not hold yet.

    ``registry`` lists the indexed ids, one row each. It is kept beside the postings
    (:func:`kbspark.sources.sinks.write_index`), so that growth reads no posting; without it the
    ids are taken from the postings themselves.
    """
    known = registry.select(id_col) if registry is not None else index.select(id_col).distinct()
    return index.unionByName(gram_index(texts.join(known, id_col, "left_anti"), id_col, text))


def _needle_keys(needles: DataFrame, n: int) -> DataFrame:
    """Give each distinct needle one gram to be found by (its last one)."""
    return (
        needles.select("needle").distinct()
        .filter(F.length("needle") >= n)
        .select("needle", F.right(F.col("needle"), F.lit(n)).alias("gram"))
    )


def _walker(needles: list[str]):
    """Function text -> needle positions, one for every overlapping hit, for use inside a task.

    All needles are searched for together in one walk over the text. Measured, this is some
    twenty times faster than testing needles one by one as expressions. Without the
    automaton package needles are searched for singly.
    """
    if not needles:
        return lambda text: iter(())
    try:
        import ahocorasick
    except ImportError:
        def slow(text: str) -> Iterator[int]:
            for i, needle in enumerate(needles):
                at = text.find(needle)
                while at >= 0:
                    yield i
                    at = text.find(needle, at + 1)

        return slow
    machine = ahocorasick.Automaton()
    for i, needle in enumerate(needles):
        machine.add_word(needle, i)
    machine.make_automaton()
    return lambda text: map(itemgetter(1), machine.iter(text))


def _finder(needles: list[str]):
    """Function text -> {needle position: overlapping hits}, for use inside a task."""
    walk = _walker(needles)
    return lambda text: Counter(walk(text))


def _tiled(batches: Iterator[pa.RecordBatch], text: str, size: int = SCAN_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut by the bytes of their texts: hits held at a time grow with these, not with rows."""
    for b in batches:
        lo = 0
        for part in text_tiles(b.column(text), max(b.num_rows, 1), size):
            yield b.slice(lo, len(part))
            lo += len(part)


def _scan_needles(body: DataFrame, needles: list[str], id_col: str, n: int, count_hits: bool) -> DataFrame:
    """Find a bounded needle list in every text of a batch (one pass, no shuffle)."""
    fields = [body.schema[id_col], t.StructField("needle", t.StringType())]
    if count_hits:
        fields += [t.StructField("tf", t.LongType()), t.StructField("n_grams", t.DoubleType())]

    # ids are numbers or strings
    kinds = [pa.string() if isinstance(fields[0].dataType, t.StringType) else pa.int64(), pa.string()]
    if count_hits:
        kinds += [pa.int64(), pa.float64()]
    names = [f.name for f in fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(needles)
        for b in _tiled(batches, "_body"):
            ids, which, tfs, lens = [], [], [], []
            columns = (b.column(c).to_pylist() for c in (id_col, "_body", "_grams"))
            for key, text, size in zip(*columns):
                for i, hits in find(text or "").items():
                    ids.append(key)
                    which.append(needles[i])
                    tfs.append(hits)
                    lens.append(size)
            data = [ids, which, tfs, lens][: len(names)]
            yield pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(data, kinds)], names)

    key_type = fields[0].dataType
    cast = body if isinstance(key_type, (t.LongType, t.StringType)) else body.withColumn(id_col, F.col(id_col).cast("long"))
    return cast.mapInArrow(scan, t.StructType([t.StructField(id_col, t.StringType() if isinstance(key_type, t.StringType) else t.LongType())] + fields[1:]))


def _candidates(texts: DataFrame, index: DataFrame, keys: DataFrame, id_col: str) -> DataFrame:
    """Texts with a posting of any needle's gram; only ids are shuffled out of the index.

    A common gram pairs most texts with many needles. Such texts are taken once here and walked
    once for all needles, where a row per pair would carry and search the text for each of them.
    """
    grams_ = F.broadcast(keys.select("gram").distinct())
    return texts.join(index.join(grams_, "gram", "left_semi").select(id_col).distinct(), id_col, "left_semi")


def occurrences(
    texts: DataFrame,
    needles: DataFrame,
    id_col: str,
    text: str = "text",
    n: int = GRAM,
    fold: bool = True,
    count_hits: bool = True,
    index: DataFrame | None = None,
    length: str | None = None,
    known: list[str] | None = None,
) -> DataFrame:
    """(id, needle[, tf, n_grams]) for every text containing a needle of >= ``n`` characters.

    tf counts overlapping hits; n_grams is the text's length in n-grams. ``index`` is an
    optional :func:`gram_index` table; with it only texts with a posting of a needle's gram
    are searched, or, when needles are many, joined; ``length`` names a stored n-gram count,
    ``known`` passes needles that were already read by :func:`bounded_values`.
    """
    keys = _needle_keys(needles, n)
    size = F.col(length) if length else F.greatest(F.length(text) - (n - 1), F.lit(0))
    small = known is not None
    if index is not None and small:
        texts = _candidates(texts, index, keys, id_col)
    body = texts.select(
        id_col, (F.lower(text) if fold else F.col(text)).alias("_body"), size.cast("double").alias("_grams"))
    if small:
        found = sorted({x for x in known if x is not None and len(x) >= n})
        return _scan_needles(body, found, id_col, n, count_hits)
    if index is None:
        index = gram_index(texts, id_col, text, n) if fold else body.select(
            F.explode_outer(F.array_distinct(grams(F.col("_body"), n))).alias("gram"), id_col
        ).filter(F.col("gram").isNotNull())
    spread = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = index.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(
        spread, ["gram", "_salt"]
    )
    hits = pairs.select(id_col, "needle").join(body, id_col)
    found, needle = F.col("_body"), F.col("needle")
    hits = hits.filter(found.contains(needle))
    if not count_hits:
        return hits.select(id_col, "needle")
    tf = F.regexp_count(found, F.concat(F.lit("(?=\\Q"), needle, F.lit("\\E)")))
    return hits.select(
        id_col, "needle", tf.cast("long").alias("tf"),
        F.col("_grams").alias("n_grams"),
    )


def _join_terms(occ: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """Join hits to per-term rows: broadcast when proven small, else salted.

    A common term can own a third of all hits; the salt splits it over many tasks.
    """
    if small:
        return occ.join(F.broadcast(terms), "needle")
    salted = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    key = F.pmod(F.xxhash64(*[c for c in occ.columns if c != "needle"]), F.lit(SALTS)).cast("int")
    return occ.withColumn("_salt", key).join(salted, ["needle", "_salt"]).drop("_salt")


def fts_match(
    queries: DataFrame, chunks: DataFrame, id_col: str = "chunk_id", text: str = "text",
    index: DataFrame | None = None,
) -> DataFrame:
    """(query_id, id, term, tf): OR of the query's terms against every text."""
    terms = explode_terms(queries)
    known = bounded_values(terms, F.col("needle"))
    occ = occurrences(chunks, terms, id_col, text, index=index, known=known)
    return _join_terms(occ, terms, known is not None).select("query_id", id_col, "term", "tf")


def corpus_stats(chunks: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """One row: number of texts and mean length in trigrams."""
    size = F.col(length) if length else F.greatest(F.length(text) - (GRAM - 1), F.lit(0))
    return chunks.agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg(size.cast("double")).alias("avg_len"))


def _sized(chunks: DataFrame, text: str, length: str | None):
    """Folded text and its length in trigrams."""
    size = F.col(length) if length else F.greatest(F.length(text) - (GRAM - 1), F.lit(0))
    return F.lower(text).alias("_body"), size.cast("double").alias("_grams")


def _tally(walk, needles: int, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hits per text, needle positions, counts): what every text holds, one text after the other."""
    if len(texts) == 1:  # a tile of its own, of any length: only counts are held
        found = sorted(Counter(walk(texts[0])).items())
        return np.array([len(found)]), np.array([i for i, _ in found], np.int64), np.array([c for _, c in found], np.int64)
    walks = [np.fromiter(walk(text), np.int64) for text in texts]
    rows = np.repeat(np.arange(len(texts)), [len(w) for w in walks])
    cells, counts = np.unique(rows * needles + np.concatenate(walks), return_counts=True)
    return np.bincount(cells // max(needles, 1), minlength=len(texts)), cells % max(needles, 1), counts


def term_hits(texts: DataFrame, needles: list[str], id_col: str, text: str = "text", length: str | None = None, allowed: Column | None = None) -> DataFrame:
    """(id, _grams, _kept, _terms, _tf) of every text: the needles it holds by position, and how often.

    One walk over the texts, written to the shared folder: statistics and scores both come from
    these short rows, and the texts are neither computed nor walked a second time.
    """
    kept = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))
    body = texts.select(id_col, *_sized(texts, text, length), kept.alias("_kept"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _walker(needles)
        for b in _tiled(batches, "_body", TALLY_BYTES):
            per, terms, counts = _tally(walk, len(needles), [x or "" for x in b.column("_body").to_pylist()])
            ends = pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), b.column("_grams"), b.column("_kept"), *lists], [id_col, "_grams", "_kept", "_terms", "_tf"])

    many = t.ArrayType(t.LongType())
    schema = t.StructType([body.schema[id_col], body.schema["_grams"], body.schema["_kept"]]).add("_terms", many).add("_tf", many)
    return stored(body.mapInArrow(scan, schema), "hits")


def term_statistics(hits: DataFrame, needles: list[str]):
    """(number of texts, mean length, {needle: texts containing it}) of :func:`term_hits`.

    Each task adds up its own counts, so what is shuffled and read back is at most one row
    per needle and task, and needles are bounded.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, total = np.zeros(len(needles), np.int64), 0, 0.0
        for b in batches:
            n, total = n + b.num_rows, total + (pc.sum(b.column(0)).as_py() or 0.0)
            seen += np.bincount(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64), minlength=len(needles))
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *there], pa.int64()), pa.array([n, *seen[there]], pa.int64()), pa.array([total] + [0.0] * len(there), pa.float64())],
            ["needle", "n", "size"])

    counts = hits.select("_grams", "_terms").mapInArrow(count, "needle long, n long, size double")
    rows = counts.groupBy("needle").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()
    whole = next(((r["n"], r["size"]) for r in rows if r["needle"] == -1), (0, 0.0))
    freq = {needles[r["needle"]]: r["n"] for r in rows if r["needle"] >= 0}
    return whole[0], (whole[1] / whole[0] if whole[0] else 0.0), freq


def _scan_scores(hits: DataFrame, needles: list[str], id_col: str, pairs: list[tuple[int, str]], statistics, k: int) -> DataFrame:
    """(query_id, id, score): the ``k`` best texts per query of every tile of :func:`term_hits`.

    A text is scored for all queries where its hits are read; only top-k rows leave the task.
    ``pairs`` are (query_id, needle) once per distinct term, so a needle that a query uses
    in two spellings counts twice.
    """
    n_docs, avg_len, freq = statistics
    place = {x: i for i, x in enumerate(needles)}
    idf = np.array([max(np.log((n_docs - freq.get(x, 0) + 0.5) / (freq.get(x, 0) + 0.5)), IDF_FLOOR) for x in needles])
    qids = sorted({q for q, _ in pairs})
    column = {q: i for i, q in enumerate(qids)}
    uses = Counter((place[x], column[q]) for q, x in pairs)
    links = sorted(uses)
    owner = np.array([q for _, q in links], dtype=np.int64)
    weight = np.array([uses[x] * idf[x[0]] for x in links])
    per_needle = np.bincount([i for i, _ in links], minlength=len(needles)) if links else np.zeros(0, dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(per_needle)[:-1]]) if len(needles) else np.zeros(0, dtype=np.int64)
    qids, width = np.array(qids, dtype=np.int64), len(qids)
    per_tile = max(1, TILE_CELLS // max(width, 1))

    def best(ids, docs, terms, tf, size) -> pa.RecordBatch:
        """Score one tile: docs, terms and tf are parallel arrays of hits."""
        x = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * size[docs] / avg_len))
        reps = per_needle[terms]
        flat = np.repeat(begin[terms] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
        cells = np.repeat(docs, reps) * width + owner[flat]
        score = np.bincount(cells, np.repeat(x, reps) * weight[flat], minlength=len(ids) * width)
        score = np.round(score.reshape(len(ids), width), 9)
        # ids of any type are compared by their place in order and travel as they are
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        out = [], [], []
        for q in range(width):
            rows = best_k(-score[:, q], place, k, score[:, q] > 0)
            out[0].append(np.full(rows.size, qids[q]))
            out[1].append(rows)
            out[2].append(score[rows, q])
        query, rows, score = map(np.concatenate, out)
        return pa.RecordBatch.from_arrays([pa.array(query), ids.take(pa.array(rows)), pa.array(score)], ["query_id", id_col, "score"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            per = b.column("_terms").value_lengths().to_numpy(zero_copy_only=False)
            terms, tf = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("_terms", "_tf"))
            size, at = b.column("_grams").to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(per)])
            # tiles are bounded by texts and by (text, query, needle) triples
            upto, lo = np.concatenate([[0], np.cumsum(per_needle[terms])])[at], 0
            while lo < b.num_rows:
                hi = int(np.searchsorted(upto, upto[lo] + TILE_CELLS, "right")) - 1
                hi = min(max(hi, lo + 1), lo + per_tile, b.num_rows)
                here = slice(at[lo], at[hi])
                if at[hi] > at[lo]:
                    yield best(b.column(id_col).slice(lo, hi - lo), np.repeat(np.arange(hi - lo), per[lo:hi]), terms[here],
                               tf[here].astype(np.float64), size[lo:hi])
                lo = hi

    schema = t.StructType().add("query_id", t.LongType()).add(id_col, hits.schema[id_col].dataType).add("score", t.DoubleType())
    return hits.filter(F.size("_terms") > 0).select(id_col, "_grams", "_terms", "_tf").mapInArrow(scan, schema)


def bm25(
    queries: DataFrame,
    chunks: DataFrame,
    k: int | None = None,
    id_col: str = "chunk_id",
    text: str = "text",
    allowed: Column | None = None,
    index: DataFrame | None = None,
    length: str | None = None,
) -> DataFrame:
    """(query_id, id, score[, fts_rank]): BM25 over trigram lengths, best ``k`` per query.

    Corpus statistics always cover every row of ``chunks``; ``allowed`` (a condition on
    chunks) filters before the limit, so other rows influence the statistics but take no
    place. ``length`` names a stored trigram count.

    With a term list proven small every text is walked once, and its hits are kept. Statistics
    and scores are fitted from the hits; only the best ``k`` per query and tile are shuffled. A
    posting table narrows the walk to the texts that hold a gram of a term; every text with a
    hit is among them, so the counts stay those of the whole corpus.
    Otherwise, or without ``k``, hits are shuffled once by text id.
    """
    terms = explode_terms(queries).select(F.col("query_id").cast("long").alias("query_id"), "term", "needle")
    pairs = bounded_values(terms, F.to_json(F.struct("query_id", "needle"))) if k is not None else None
    best = [F.desc("score"), F.asc(id_col)]
    if pairs is not None:
        read = [(r["query_id"], r["needle"]) for r in map(json.loads, pairs)]
        read = [x for x in read if len(x[1]) >= GRAM]
        rows, needles = chunks, sorted({x for _, x in read})
        if index is not None:
            near = _candidates(chunks.select(id_col), index, _needle_keys(terms, GRAM), id_col)
            rows = chunks.join(near, id_col, "left_semi")
        hits = term_hits(rows, needles, id_col, text, length, allowed)
        found = term_statistics(hits, needles)
        if index is not None:
            whole = corpus_stats(chunks, text, length).first()
            found = whole["n_docs"], whole["avg_len"] or 0.0, found[2]
        scored = _scan_scores(hits.filter("_kept"), needles, id_col, read, found, k)
        return top_k(scored, ["query_id"], best, k).withColumn("fts_rank", (F.col("rn") - 1).cast("int")).drop("rn")

    known = bounded_values(terms, F.col("needle"))
    # one shuffle by text id serves both uses below: the document frequencies and the
    # per-(query, text) sums; every column is named in both so that Spark reuses it
    occ = occurrences(chunks, terms, id_col, text, index=index, length=length, known=known).repartition(id_col)
    seen = F.col(id_col).isNotNull() & (F.col("tf") > 0) & (F.col("n_grams") >= 0)
    df_ = occ.groupBy("needle").agg(F.count_if(seen).alias("_df"))
    # corpus statistics enter as scalar subqueries, so no join is spent on them
    facts = corpus_stats(chunks, text, length)
    n_docs, avg_len = facts.select("n_docs").scalar(), facts.select("avg_len").scalar()
    idf = df_.select(
        "needle", F.greatest(
            F.log((n_docs - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(IDF_FLOOR)
        ).alias("idf"),
    )
    # terms that differ only in case share a needle and each count once
    weighted = terms.join(idf, "needle").groupBy("query_id", "needle").agg(F.sum("idf").alias("idf"))
    if allowed is not None:
        occ = occ.join(chunks.filter(allowed).select(id_col), id_col, "left_semi")
    norm = F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("n_grams") / avg_len)
    scored = (
        _join_terms(occ, weighted, known is not None)
        .groupBy("query_id", id_col)
        .agg(F.sum(F.col("idf") * F.col("tf") * (BM25_K1 + 1) / norm).alias("score"))
        .withColumn("score", F.round("score", 9))
    )
    if k is None:
        return scored
    return top_k(scored, ["query_id"], best, k).withColumn("fts_rank", (F.col("rn") - 1).cast("int")).drop("rn")


def mark_pattern(terms):
    """Alternation of the searchable terms, longest first, as a regular expression."""
    fit = F.filter(terms, lambda t: F.length(t) >= GRAM)
    longest = F.array_sort(fit, lambda a, b: F.length(b) - F.length(a))
    return F.concat(F.lit("(?i)("), F.array_join(longest, "|"), F.lit(")"))


def snippet(text, pattern, width: int = 22, mark: tuple[str, str] = ("【", "】")):
    """Excerpt of ``width`` characters from just before the first hit, every hit marked.

    ``pattern`` is :func:`mark_pattern` of the folded terms.
    """
    first = F.regexp_instr(text, pattern)
    begin = F.greatest(F.when(first > 0, first).otherwise(F.lit(1)) - 4, F.lit(1))
    marked = F.regexp_replace(F.substring(text, begin, F.lit(width)), pattern, F.lit(mark[0] + "$1" + mark[1]))
    return F.concat(
        F.when(begin > 1, F.lit("…")).otherwise(F.lit("")), marked,
        F.when(begin + width <= F.length(text), F.lit("…")).otherwise(F.lit("")),
    )


def keyword_search(
    queries: DataFrame, chunks: DataFrame, sources: DataFrame, k: int = 20
) -> DataFrame:
    """Best ``k`` keyword hits per query with source columns and a marked excerpt."""
    ranked = bm25(queries, chunks, k)
    folded = queries.select(
        "query_id", F.array_distinct(F.transform(T.query_terms("query"), F.lower)).alias("_terms")
    ).withColumn("_pattern", mark_pattern(F.col("_terms")))
    few = at_most(queries.select("query_id"), NARROW_ROWS // k)
    return (
        small_side(ranked, few).join(chunks, "chunk_id").join(sources, "source_id").join(folded, "query_id")
        .withColumn("snippet", snippet(F.col("text"), F.col("_pattern")))
        .drop("_terms", "_pattern")
    )
