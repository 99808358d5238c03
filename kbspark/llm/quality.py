"""Quality rules with thresholds that adapt to each language and source.

Every document gets whole-number measures. Their distributions are kept as mergeable
quantile sketches: counts in log-linear buckets (16 to each doubling, so a quantile is right to 1/16),
which sum over tasks, over sources to a language, and over all. A group's limit lies ``REACH``
times the way from its median to its 90 % quantile beyond that quantile; for word lengths
there is one below, from the 10 % quantile, as well. No value is fixed: where nine in ten
documents have none of something, the limit is none.

The limits of a source are drawn towards those of its language, and these towards those of all
documents, by row counts: n rows weigh n / (n + ``PRIOR``), without a step at any size. Ratios of
short texts are coarse, so one event (a symbol, a line, a window found again) is let through.

Defined results: null and empty texts have no words and fail the base rules; null languages
and sources are values of their own; repeated rows count as often as they come; no rows give
no rows. Columns other than doc_id, text, lang and source are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.llm.common import SPACE, let, staged, words

REACH = 3
PRIOR = 50
# Measure -> (count, size, scale, what one event adds to the count, limited below too).
MEASURES = {
    "symbols": ("n_symbols", "word_chars", 1000, 1, False),
    "capitals": ("n_capitals", "word_chars", 1000, 1, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 1, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 10, False),
    "word_length": ("word_chars", "n_words", 100, 0, True),
}


def repeat_words(tokens: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that the text has twice or more.

    Windows are hashed; only a text in which some hash repeats is sorted to find where.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(tokens) - width), lambda i: F.xxhash64(
        *[F.get(tokens, i + k) for k in range(width)]))

    def covered(sorted_windows: Column) -> Column:
        same = F.filter(sorted_windows, lambda x, j: F.coalesce(
            F.when(j > 0, F.get(sorted_windows, j - 1)["h"]) == x["h"], F.lit(False)
        ) | F.coalesce(F.get(sorted_windows, j + 1)["h"] == x["h"], F.lit(False)))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(F.array_sort(F.transform(same, lambda x: x["i"])), start, lambda a, i: F.struct(
            (i + width).alias("end"), (a["n"] + F.least(F.lit(width), i + width - a["end"])).alias("n")))["n"]

    def count(found: Column) -> Column:
        pairs = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    return F.when(F.size(tokens) < width, F.lit(0).cast("long")).otherwise(let(hashes, count))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""
    text = F.coalesce("text", F.lit(""))
    measured = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    lined = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    only = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")
    return docs.select(
        "doc_id", "lang", "source", measured.alias("_w"), lined.alias("_l"), only("#*$%&|<>").alias("n_symbols"),
        only("A-Z").alias("n_capitals"),
    ).select("doc_id", "lang", "source", "_w.*", "_l.*", "n_symbols", "n_capitals")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def _ratio(name: str, less: int = 0) -> Column:
    count, size, scale, _, _ = MEASURES[name]
    counted = F.greatest(F.col(count) - less, F.lit(0))
    return F.floor(F.lit(scale) * counted / F.greatest(F.col(size), F.lit(1))).cast("long")


def measures() -> dict[str, Column]:
    """What the sketches are made of."""
    return {name: _ratio(name) for name in MEASURES}


def judged() -> dict[str, Column]:
    """What the limits are held against: the measures without one event."""
    return {name: _ratio(name, MEASURES[name][3]) for name in MEASURES}


def bucket(value: Column) -> Column:
    """Log-linear bucket of a whole number: exact below 16, then 16 buckets to a doubling."""
    power = F.length(F.bin(value)) - 1
    return F.when(value < 16, value).otherwise(
        (power - 3) * 16 + F.floor(value / F.pow(F.lit(2.0), power - 4)).cast("long") - 16).cast("long")


def bucket_floor(b: Column) -> Column:
    """Least number in a bucket."""
    power = F.floor(b / 16) + 3
    return F.when(b < 16, b).otherwise(((b % 16 + 16) * F.pow(F.lit(2.0), power - 4)).cast("long")).cast("long")


def sketches(counts: DataFrame) -> DataFrame:
    """(level, lang, source, measure, bucket, n): the sketches of every group, merged upwards.

    Bucket counts of a task are summed before the shuffle, so a hot source sends one row per
    bucket and task. Languages and the whole are sums of their sources' sketches.
    """
    named = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(v).alias("bucket")) for m, v in measures().items()])
    own = counts.select("lang", "source", F.explode(named).alias("m")).groupBy(
        "lang", "source", F.col("m.measure").alias("measure"), F.col("m.bucket").alias("bucket")).agg(F.count("*").alias("n"))
    levels = F.array(*[
        F.struct(F.lit(i).alias("level"), lang.alias("lang"), source.alias("source"))
        for i, (lang, source) in enumerate((
            (F.col("lang"), F.col("source")), (F.col("lang"), F.lit(None).cast("string")),
            (F.lit(None).cast("string"), F.lit(None).cast("string"))))])
    return own.select(F.explode(levels).alias("g"), "measure", "bucket", "n").groupBy(
        "g.level", "g.lang", "g.source", "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame) -> DataFrame:
    """Buckets of the 10 %, 50 % and 90 % quantile per group and measure, from the accumulated counts."""
    key = ["level", "lang", "source", "measure"]
    up = W.partitionBy(*key).orderBy("bucket")
    cum = sketch.select(*key, "bucket", F.sum("n").over(up).alias("c"), F.sum("n").over(W.partitionBy(*key)).alias("rows"))
    at = lambda tenths: F.min(F.when(F.col("c") * 10 >= F.col("rows") * tenths, F.col("bucket")))
    return cum.groupBy(*key).agg(F.max("rows").alias("rows"), at(1).alias("b1"), at(5).alias("b5"), at(9).alias("b9"))


def limits(sketch: DataFrame) -> DataFrame:
    """low and high per group and measure; a quantile is taken at the far end of its bucket."""
    top = lambda b: bucket_floor(b + 1) - 1
    below = [m for m, rule in MEASURES.items() if rule[4]]
    b1, b5, b9 = F.col("b1"), F.col("b5"), F.col("b9")
    low = bucket_floor(b1) - F.lit(REACH) * (top(b5) - bucket_floor(b1))
    high = top(b9) + F.lit(REACH) * (top(b9) - bucket_floor(b5))
    return quantiles(sketch).select(
        "level", "lang", "source", "measure", "rows", F.when(F.col("measure").isin(below), low).otherwise(F.lit(0)).cast("double").alias("low"),
        high.cast("double").alias("high"))


def fences(counts: DataFrame) -> DataFrame:
    """_lang, _source and the lowest and highest accepted value of every measure (``fence``)."""
    per = staged(limits(sketches(counts)), "limits")
    own, lang, every = (per.filter(F.col("level") == i).select(
        "measure", *([F.col("lang").alias(f"g{i}")] if i < 2 else []), *([F.col("source").alias("s0")] if i == 0 else []),
        F.col("rows").alias(f"n{i}"), F.col("low").alias(f"low{i}"), F.col("high").alias(f"high{i}")) for i in range(3))

    def drawn(side: str) -> Column:
        wide = (F.col("n1") * F.col(f"{side}1") + PRIOR * F.col(f"{side}2")) / (F.col("n1") + PRIOR)
        return ((F.col("n0") * F.col(f"{side}0") + PRIOR * wide) / (F.col("n0") + PRIOR)).alias(side)

    joined = own.alias("o").join(lang.alias("l"), F.col("g0").eqNullSafe(F.col("g1")) & (F.col("o.measure") == F.col("l.measure"))).join(
        every.alias("e"), F.col("o.measure") == F.col("e.measure"))
    entry = F.struct(F.col("o.measure").alias("measure"), F.struct(drawn("low"), drawn("high")).alias("f"))
    # as many entries as there are measures
    return joined.select(F.col("g0").alias("_lang"), F.col("s0").alias("_source"), entry.alias("m")).groupBy("_lang", "_source").agg(
        F.map_from_entries(F.collect_list("m")).alias("fence"))


def verdicts(docs: DataFrame) -> DataFrame:
    """Counts, base_failed and a flag per measure (``out``: outside its limits) of every document.

    Texts are read once; the counts are staged and used for the sketches and the verdicts.
    The sketches leave out what the base rules fail.
    """
    counts = staged(text_counts(docs), "quality").withColumn("base_failed", base_failed())
    found = fences(counts.filter(~F.col("base_failed")))
    joined = counts.join(found, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    fence = F.col("fence")
    out = F.struct(*[F.coalesce(~v.cast("double").between(fence[m]["low"], fence[m]["high"]), F.lit(True)).alias(m) for m, v in judged().items()])
    return joined.withColumn("out", out)


def rejections(docs: DataFrame) -> DataFrame:
    """(measure, n): how many documents each measure rejects that pass the base rules."""
    rows = verdicts(docs).filter(~F.col("base_failed"))
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col("out")[m].cast("int").alias("n")) for m in MEASURES])
    return rows.select(F.explode(each).alias("r")).groupBy("r.measure").agg(F.sum("r.n").alias("n"))


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base_failed and kept of every document."""
    held = ~F.col("base_failed")
    for name in MEASURES:
        held = held & ~F.col("out")[name]
    return verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", held.alias("kept"))
