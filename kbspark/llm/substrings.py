"""Exact removal of repeated passages of ``WINDOW`` words, inside and across documents.

A window of words is repeated when its words also start anywhere else. Every window has an
anchor, the least-hashed 16-gram in it, which equal windows share; consecutive windows with
one anchor are a run. Most work is done on runs, of which there is one for about ten words:

1. anchors are counted, and only runs whose anchor occurs twice go on;
2. runs are counted by all the words they span: all windows of a run that comes twice are
   repeated, which settles what lies inside copied passages;
3. what is left are runs that are the only ones of their kind, at the edges of passages. For their anchors
   one run of each kind is expanded into windows, and these are counted.

Counts are combined before each shuffle, so a passage in any share of the documents is a few
rows for every task. Windows are compared by two 64-bit hashes, that of the anchor and their own.

The method asked for, suffix automata of reference shards sent to all tasks, is not used for
this: when the corpus is its own reference, the automata grow with it, and every shard must
be run against every document (README).

Defined results: null and empty texts have no words, and nothing is removed; texts of fewer
words than a window stay whole; rows that come twice lose every window to each other; a null
doc_id is an id like others; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm.common import staged
from kbspark.llm.tokens import (
    Piece, byte_values, find_words, mix, pieces, rolled, separators, window_hashes, window_starts, word_hashes,
)
from kbspark.session import NARROW_ROWS, at_most, small_side

WINDOW = 35
GRAM = 16
SPAN_BASE = 0xC2B2AE3D27D4EB4F
# An anchor is hot from a share of 1 / HOTTEST of all runs on; there are at most HOTTEST such anchors.
HOTTEST, SALTS = 1000, 64


def row_key() -> Column:
    """Identity of a row: rows with the same doc_id and text are alike in every result."""
    return F.xxhash64("doc_id", "text")


def window_anchors(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, start of every window, its anchor's place and hash, and first word of its row."""
    words = find_words(piece, separators("space"))
    hashes = word_hashes(piece, words, byte_values(False))
    starts = window_starts(words, WINDOW)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return hashes, none, none, np.zeros(0, np.uint64), none
    grams = window_hashes(hashes, np.arange(len(hashes) - GRAM + 1), GRAM)
    reach = WINDOW - GRAM + 1
    around = np.lib.stride_tricks.sliding_window_view(grams, reach)
    place = starts + np.concatenate([around[starts[i : i + 65536]].argmin(1) for i in range(0, len(starts), 65536)])
    return hashes, starts, place, grams[place], words.row[starts]


def runs(piece: Piece) -> dict[str, np.ndarray]:
    """Runs of consecutive windows with one anchor: row, first word in the row, windows, anchor, and span."""
    hashes, starts, place, anchor, row = window_anchors(piece)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    count = np.diff(np.append(at, len(starts)))
    begin = starts[at]
    inside = (place[at] - begin).astype(np.uint64) * np.uint64(64) + count.astype(np.uint64)
    span = mix(rolled(hashes, begin, begin + count + WINDOW - 1, SPAN_BASE) + inside)
    words = find_words(piece, separators("space"))
    return {"row": row[at], "first": begin - words.first[row[at]], "count": count, "anchor": anchor[at], "span": span}


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column(0)):
            anchor, n = np.unique(runs(piece)["anchor"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], ["anchor", "n"])


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.asarray(batch.column(0))
        for piece in pieces(batch.column(1)):
            r = runs(piece)
            yield pa.RecordBatch.from_arrays([
                pa.array(r["anchor"].view(np.int64)), pa.array(r["span"].view(np.int64)), pa.array(keys[piece.first + r["row"]]),
                pa.array(r["first"] * 32 + r["count"])], ["anchor", "span", "key", "place"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, window, key, first, alone) of the windows of the wanted runs of each text."""
    for batch in batches:
        keys, wanted = np.asarray(batch.column(0)), batch.column(2)
        offsets = np.asarray(wanted.offsets) - wanted.offsets[0].as_py()
        places, alone = np.asarray(wanted.flatten().field("place")), np.asarray(wanted.flatten().field("alone"))
        for piece in pieces(batch.column(1)):
            words = find_words(piece, separators("space"))
            hashes, starts, _, anchor, _ = window_anchors(piece)
            lo, hi = offsets[piece.first], offsets[piece.first + piece.rows]
            row = np.repeat(np.arange(piece.rows), np.diff(offsets[piece.first : piece.first + piece.rows + 1]))
            first, count = places[lo:hi] // 32, places[lo:hi] % 32
            of = np.repeat(np.arange(len(first)), count)
            inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            begin = words.first[row[of]] + first[of] + inside
            which = np.searchsorted(starts, begin)
            window = window_hashes(hashes, begin, WINDOW)
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor[which].view(np.int64)), pa.array(window.view(np.int64)), pa.array(keys[piece.first + row[of]]),
                pa.array((first[of] + inside).astype(np.int64)), pa.array(alone[lo:hi][of])],
                ["anchor", "window", "key", "first", "alone"])


def merged(spans: Column) -> Column:
    """Ranges joined where they touch, in order."""
    kind = "array<struct<start: bigint, end: bigint>>"
    start = F.struct(F.lit(None).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("end"), F.array().cast(kind).alias("done"))
    last = lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"))

    def step(a: Column, s: Column) -> Column:
        done = F.when(a["start"].isNull(), a["done"]).otherwise(F.array_append(a["done"], last(a)))
        return F.when(s["start"] <= a["end"], F.struct(
            a["start"].alias("start"), F.greatest(a["end"], s["end"]).alias("end"), a["done"].alias("done"))).otherwise(
            F.struct(s["start"].alias("start"), s["end"].alias("end"), done.alias("done")))

    return F.aggregate(F.array_sort(spans), start, step, lambda a: F.array_append(a["done"], last(a)))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, spans): the word ranges (start, end) of every row that lie in repeated windows.

    ``docs`` has key and text.
    """
    twice = staged(docs.select("text").mapInArrow(_anchor_counts, "anchor long, n long").groupBy("anchor").agg(
        F.sum("n").alias("n")).filter("n > 1"), "anchors")
    # Anchors with more than a share of all runs are few, whatever the input: their runs are dealt
    # out by a salt, which is 0 elsewhere.
    total = twice.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(twice.filter(F.col("n") * HOTTEST > total).select(F.col("anchor").alias("hot")))
    deal = lambda df, salt: df.join(hot, F.col("anchor") == F.col("hot"), "left").withColumn(
        "salt", F.when(F.col("hot").isNotNull(), salt).otherwise(0).cast("int")).drop("hot")
    named = deal(twice.select("anchor"), F.lit(-1)).withColumn(
        "salt", F.explode(F.when(F.col("salt") < 0, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    found = staged(deal(docs.select("key", "text").mapInArrow(_run_rows, "anchor long, span long, key long, place long"),
                        F.pmod(F.xxhash64("key"), F.lit(SALTS))).join(named, ["anchor", "salt"], "left_semi"), "runs")
    kinds = staged(found.groupBy("anchor", "span").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "place", "salt")).alias("one")), "kinds")
    range_of = F.struct(F.floor(F.col("place") / 32).alias("start"), (F.floor(F.col("place") / 32) + F.col("place") % 32 + WINDOW - 1).alias("end"))
    # a run that is the only one of its kind has one salt, that of its key
    whole = found.join(kinds.filter("n = 1").select("anchor", "span", F.col("one.salt").alias("salt")), ["anchor", "span", "salt"], "left_anti").select(
        "key", range_of.alias("span"))
    edges = kinds.groupBy("anchor").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).filter("least = 1 and kinds > 1")
    wanted = kinds.join(edges, "anchor", "left_semi").groupBy(F.col("one.key").alias("key")).agg(
        F.collect_list(F.struct(F.col("one.place").alias("place"), (F.col("n") == 1).alias("alone"))).alias("wanted"))
    wanted = staged(wanted, "wanted")
    texts = docs.select("key", "text")
    if at_most(wanted, NARROW_ROWS):  # leaves the other texts where they are; the join below is the same
        texts = texts.join(F.broadcast(wanted.select("key")), "key", "left_semi")
    windows = staged(texts.dropDuplicates(["key"]).join(wanted, "key").select("key", "text", "wanted").mapInArrow(
        _window_rows, "anchor long, window long, key long, first long, alone boolean"), "windows")
    again = windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "window")
    single = windows.filter("alone").join(again, ["anchor", "window"], "left_semi").select(
        "key", F.struct(F.col("first").alias("start"), (F.col("first") + WINDOW).alias("end")).alias("span"))
    return whole.unionByName(single).groupBy("key").agg(merged(F.collect_set("span")).alias("spans"))


@F.arrow_udf(T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Words, words removed, and the words kept, of every text and its ranges."""
    n_words, n_removed, kept = [], [], []
    for text, ranges in zip(texts.cast(pa.large_binary()), spans):
        words = (text.as_py() or b"").split()
        gone = np.zeros(len(words) + 1, np.int64)
        if ranges.is_valid:
            at = ranges.values
            np.add.at(gone, np.asarray(at.field("start")), 1)
            np.add.at(gone, np.asarray(at.field("end")), -1)
        hit = np.cumsum(gone[:-1]) > 0
        n_words.append(len(words))
        n_removed.append(int(hit.sum()))
        kept.append(b" ".join(words if not n_removed[-1] else [w for w, x in zip(words, hit) if not x]).decode())
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``result`` (n_words, n_removed, kept text) of every row."""
    keyed = docs.select("doc_id", "text").withColumn("key", row_key())
    spans = staged(repeated_spans(keyed), "spans")
    small = at_most(spans.select(F.explode("spans")), NARROW_ROWS)
    return keyed.join(small_side(spans, small), "key", "left").select(
        "doc_id", _without("text", "spans").alias("result"))


def report(docs: DataFrame) -> DataFrame:
    r = F.col("result")
    return without_repeats(docs).select(
        "doc_id", r["n_words"].alias("n_words"), r["n_removed"].alias("n_removed"), F.sha2(r["kept"], 256).alias("kept_sha256"))
