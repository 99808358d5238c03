"""Mix sources to target weights by repetition rates.

Tokens are summed per source, the token budget is dealt out by weight up to a cap per
source, and the rate of a source is its target over its size. A document is taken
floor(rate) times, and once more when a number hashed from the seed and its id is below
the fraction of the rate, so that reruns agree. Rows that share an id are told apart by a
digest of the whole row; n equal rows together get n times the fraction, rounded by one draw.

Defined results: a null text has size 0; documents without a source are a source of their
own, the last; a null doc_id is hashed as an empty one; sources without words get the
rate 0; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.llm.common import n_words, staged
from kbspark.session import NARROW_ROWS, at_most, small_side

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = "mix"
BLOCK = 4096  # equal rows that one task writes out together


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size and target from (source, size) rows.

    Sources in code-point order (null last) get the repeating weights and share
    ``share`` times all sizes; a target stops at ``cap`` times the source's size and what is
    above is shared again by weight. All sources that stop are those with the least cap for
    their weight, so one pass over the sources in that order finds the final level. Sizes are
    combined on the map side; the windows see one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = W.orderBy(F.col("source").isNull(), "source")
    given = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(given, ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = W.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - (F.sum("cap").over(fill) - F.col("cap"))) / (
        F.sum("weight").over(every) - (F.sum("weight").over(fill) - F.col("weight")))
    per = per.withColumn("level", level)
    # The first source (in this order) whose cap is not reached sets the level for all after
    # it; levels fall from there on, so it is the highest of those.
    open_level = F.max(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))).over(every)
    return per.select("source", "source_size", F.least(
        F.col("cap"), F.coalesce(open_level * F.col("weight"), F.col("cap"))).alias("target"))


def id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def row_digest(docs: DataFrame) -> Column:
    """Hash of all columns of a row; nulls count by their place."""
    own = [docs[c] for c in sorted(docs.columns)]
    return F.xxhash64(*[c.isNull() for c in own], *own)


def hashed_fraction(doc_id: Column, seed: str = SEED, digest: Column | None = None) -> Column:
    """A number in [0, 1) from the seed, the id and, where given, the digest of the row."""
    more = [] if digest is None else [F.lit(":"), digest.cast("string")]
    key = F.concat(F.lit(f"{seed}:"), id_text(doc_id), *more)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def dealt(rows: DataFrame, ids: DataFrame, seed: str) -> DataFrame:
    """``rows`` (with doc_id, _digest, _rate) plus copies; ``ids`` has the doc_id of every row.

    Equal rows under a repeated id are counted (combined on the map side) and written out
    again in blocks, so no task holds all rows of an id.
    """
    whole, part = F.floor("_rate").cast("long"), F.col("_rate") - F.floor("_rate")
    once = whole + (hashed_fraction(F.col("doc_id"), seed) < part).cast("long")
    again = staged(ids.groupBy(id_text(F.col("doc_id")).alias("_again")).agg(F.count("*").alias("n")).filter("n > 1").select("_again"), "again")
    if at_most(again, 0):
        return rows.withColumn("copies", once)
    known = rows.join(small_side(again, at_most(again, NARROW_ROWS)), id_text(F.col("doc_id")) == F.col("_again"), "left")
    due = F.col("_n") * part
    extra = F.floor(due) + (hashed_fraction(F.col("doc_id"), seed, F.col("_digest")) < due - F.floor(due)).cast("long")
    equal = known.filter("_again is not null").groupBy(*rows.columns).agg(F.count("*").alias("_n")).withColumn("_extra", extra)
    blocks = equal.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(BLOCK).cast("long")))).repartition("_digest", "_from")
    each = blocks.withColumn("_at", F.explode(F.sequence("_from", F.least(F.col("_from") + BLOCK, F.col("_n")) - 1)))
    return known.filter("_again is null").select(*rows.columns, once.alias("copies")).unionByName(
        each.select(*rows.columns, (whole + (F.col("_at") < F.col("_extra")).cast("long")).alias("copies")))


def copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every document.

    Texts are read once; ids, digests and sizes are staged. The table of targets has one row
    per source, and Spark broadcasts it only if its measured size is small.
    """
    sizes = staged(docs.select("doc_id", "source", n_words("text").alias("size"), row_digest(docs).alias("_digest")), "sizes")
    return with_copies(sizes, source_targets(sizes, weights, share, cap), seed)


def with_copies(docs: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` (with source, doc_id, _digest) plus source_size, target and copies."""
    goal = targets.select(F.col("source").alias("_source"), "source_size", "target")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    rows = docs.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_rate", rate)
    return dealt(rows, docs, seed).drop("_digest", "_rate")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns."""
    own = docs.columns
    sizes = staged(docs.select("source", n_words("text").alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    goal = source_targets(sizes, weights, share, cap).select(
        F.col("source").alias("_mix_source"), F.try_divide("target", "source_size").alias("_rate"))
    # the row travels as one column, so its names are free
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("row"), docs["doc_id"], docs["source"], row_digest(docs).alias("_digest")).join(
        goal, F.col("source").eqNullSafe(F.col("_mix_source"))).select(
        "row", "doc_id", "_digest", F.coalesce("_rate", F.lit(0.0)).alias("_rate"))
    taken = dealt(rows, docs.select("doc_id"), seed).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return taken.select(*[F.col("row")[c].alias(c) for c in own])


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words taken from every document."""
    return copies(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
