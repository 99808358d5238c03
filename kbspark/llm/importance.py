"""Target-distribution importance resampling by bit-sliced aggregation.

Features are runs of one and two words; each falls into one of ``BUCKETS`` buckets by the
checksum of its bytes. A bucket's gain is the scaled log ratio of its shares in the target
texts and in all documents. A document's bucket counts become bit planes, one bit a bucket:
plane j holds bit j of every count. Gains become planes of their two's complement. The exact
sum of gains is then a sum over pairs of planes: the number of bits set in both, times a power
of two, taken away where the gain's plane is that of the sign.

Scores add noise drawn from the document's id, so the highest scores are a weighted draw
without replacement. Ranks are counted: rows by score first (scores are integers of a few
thousand values), then only the rows of drawn scores by id.

Defined results: null and empty texts have no features and weight 0; a null doc_id reads as an
empty one and comes before others among equal scores; rows that share score and doc_id are
ranked one after the other; an empty target leaves all gains to the documents' counts; no
rows give no rows. Columns of ``docs`` other than doc_id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.llm.common import staged
from kbspark.llm.tokens import Piece, Words, find_words, pieces, separators

BUCKETS = 10_000
SCALE = 1000
SHARE, LEAST_WORDS, SEED = 25, 20, 7
# Longest span of bytes that is hashed with tables; longer words, which are rare, go one by one.
TABLED = 64
FULL = np.uint32(0xFFFFFFFF)
SCORED = "doc_id {id}, n_features bigint, weight bigint"


def crc_table() -> np.ndarray:
    """CRC-32 of every single byte, from a start of 0 and without the final inversion."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


def shift_tables(step: np.ndarray, longest: int = TABLED) -> np.ndarray:
    """[n, k, b]: what byte b at place k of a checksum becomes when n zero bytes follow it."""
    out = np.empty((longest + 1, 4, 256), dtype=np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(longest):
        out[n + 1] = step[out[n] & 255] ^ (out[n] >> np.uint32(8))
    return out


STEP = crc_table()
SHIFTS = shift_tables(STEP)


def folded(piece: Piece) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    upper = (piece.data >= 65) & (piece.data <= 90)
    return piece.data + (upper * np.uint8(32)).astype(np.uint8)


def word_checksums(data: np.ndarray, words: Words) -> np.ndarray:
    """CRC-32 of every word, all words one byte further at each step."""
    size = words.ends - words.starts
    state = np.full(len(size), FULL)
    order = np.argsort(size, kind="stable")
    at = np.searchsorted(size[order], np.arange(1, TABLED + 1))
    for i in range(min(TABLED, int(size.max(initial=0)))):
        left = order[at[i] :]  # words with a byte i
        s = state[left]
        state[left] = STEP[(s ^ data[words.starts[left] + i]) & 255] ^ (s >> np.uint32(8))
    state ^= FULL
    for i in np.flatnonzero(size > TABLED):
        state[i] = zlib.crc32(data[words.starts[i] : words.ends[i]])
    return state


def features(piece: Piece, spec: str = "nonword") -> tuple[np.ndarray, np.ndarray, Words]:
    """(row, bucket) of every feature of a piece's texts, and their words."""
    data = folded(piece)
    words = find_words(piece, separators(spec))
    one, row = word_checksums(data, words), words.row
    first = np.flatnonzero(row[1:] == row[:-1])
    second = first + 1
    # The checksum of "a b" is that of "a " moved on by the bytes of b, and that of b.
    raw = one[first] ^ FULL
    front = (STEP[(raw ^ np.uint32(32)) & 255] ^ (raw >> np.uint32(8))) ^ FULL
    size = (words.ends - words.starts)[second]
    near = np.minimum(size, TABLED)
    two = one[second].copy()
    for k in range(4):
        two ^= SHIFTS[near, k, (front >> np.uint32(8 * k)) & 255]
    for i in np.flatnonzero(size > TABLED):
        two[i] = zlib.crc32(data[words.starts[second[i]] : words.ends[second[i]]], int(front[i]))
    return (np.concatenate([row, row[first]]),
            np.concatenate([one, two]).astype(np.int64) % BUCKETS, words)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per bucket of all texts of a task: at most ``BUCKETS`` rows."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for b in batches:
        for piece in pieces(b.column(0)):
            total += np.bincount(features(piece)[1], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) over the features of all whole texts, added up within tasks first."""
    return texts.select("text").mapInArrow(_count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Gain of every bucket. Two tables of ``BUCKETS`` rows at most come to the driver."""
    s, t = (np.zeros(BUCKETS) for _ in range(2))
    for into, texts in ((s, docs), (t, target)):
        for r in bucket_counts(texts).collect():
            into[r.bucket] = r.n
    ratio = ((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as rows of 64-bit words."""
    spare = -bits.shape[-1] % 64
    out = np.packbits(np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, spare)]), axis=-1)
    return out.view(np.uint64)


def gain_planes(gain: np.ndarray) -> np.ndarray:
    """Planes of the two's complement of gains, the last one for the sign."""
    width = max(int(abs(v)).bit_length() for v in (gain.min(initial=0), gain.max(initial=0))) + 1
    return packed(((gain[None, :] >> np.arange(width)[:, None]) & 1).astype(np.uint8))


def plane_sums(row: np.ndarray, bucket: np.ndarray, n_rows: int, planes: np.ndarray, at_once: int = 512) -> np.ndarray:
    """Exact sum of gains over the features of every row, by planes of counts and of gains."""
    out = np.zeros(n_rows, dtype=np.int64)
    cell, n = np.unique(row * BUCKETS + bucket, return_counts=True)
    if not len(cell):
        return out
    row, bucket = cell // BUCKETS, cell % BUCKETS
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    # Planes a row needs: bits of its largest count. They follow each other, row after row.
    depth = np.frexp(np.maximum.reduceat(n, first).astype(float))[1].astype(np.int64)
    base = np.cumsum(depth) - depth
    owner, level = np.repeat(row[first], depth), np.arange(depth.sum()) - np.repeat(base, depth)
    place = np.repeat(base, np.diff(np.r_[first, len(row)]))
    power = np.int64(1) << np.arange(len(planes), dtype=np.int64)
    power[-1] *= -1
    lo = 0
    while lo < len(owner):
        hi = min(lo + at_once, len(owner))
        bits = np.zeros((hi - lo, BUCKETS), dtype=np.uint8)
        a, b = np.searchsorted(place + depth.max(), lo), np.searchsorted(place, hi)
        for j in range(int(depth.max())):
            plane = place[a:b] + j
            mine = (plane >= lo) & (plane < hi) & ((n[a:b] >> j) & 1 == 1)
            bits[plane[mine] - lo, bucket[a:b][mine]] = 1
        doc = packed(bits)
        both = np.stack([np.bitwise_count(doc & g).sum(axis=1, dtype=np.int64) for g in planes], axis=1)
        np.add.at(out, owner[lo:hi], (both @ power) << level[lo:hi])
        lo = hi
    return out


def weigher(planes: np.ndarray, names: list[str]):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for piece in pieces(b.column(1)):
                row, bucket, words = features(piece)
                counts.append(words.counts + np.maximum(words.counts - 1, 0))
                sums.append(plane_sums(row, bucket, piece.rows, planes))
            n, total = np.concatenate(counts), np.concatenate(sums)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(total // np.maximum(n, 1))], names)

    return weigh


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight): the floored mean gain of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        weigher(gain_planes(gain), ["doc_id", "n_features", "weight"]), SCORED.format(id=kind))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise from the id, as a floored integer."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, n: int, order: Column | None = None) -> DataFrame:
    """``scored`` (a stored table) with ``rank`` 1 to ``n`` by falling score and rising doc_id.

    Only rows ``eligible`` are ranked. Their number per score is counted first; rows whose
    score cannot be drawn stay where they are. The others are numbered within their score from
    counts per id and part of the table, so neither a hot score nor a hot id fills a task.
    """
    own = [c for c in scored.columns if c not in ("eligible", "_part", "_at")]
    levels = scored.filter("eligible").groupBy("score").agg(F.count("*").alias("n"))
    # A row per distinct integer score, which are thousands whatever the number of rows.
    tops = levels.withColumn("_before", F.sum("n").over(W.orderBy(F.desc("score"))) - F.col("n")).filter(
        F.col("_before") < n).select(F.col("score").alias("_score"), "_before")
    cut = tops.agg(F.min("_score")).first()[0] if n > 0 else None
    if cut is None:
        return scored.select(*own, F.lit(None).cast("long").alias("rank"))
    inside = F.col("eligible") & (F.col("score") >= cut)
    rest = scored.filter(~inside).select(*own, F.lit(None).cast("long").alias("rank"))
    drawn = scored.filter(inside)
    # doc_id in a struct: a missing one joins and sorts like any other
    drawn = drawn.withColumn("_id", F.struct("doc_id"))
    places = drawn.groupBy("score", "_id", "_part").agg(F.count("*").alias("_n")).withColumn(
        "_off", F.sum("_n").over(W.partitionBy("score").orderBy("_id", "_part").rowsBetween(W.unboundedPreceding, -1)))
    numbered = drawn.join(places, ["score", "_id", "_part"]).withColumn(
        "_no", F.row_number().over(W.partitionBy("score", "_id", "_part").orderBy("_at")))
    rank = F.col("_before") + F.coalesce("_off", F.lit(0)) + F.col("_no")
    placed = numbered.join(tops, F.col("score") == F.col("_score")).withColumn("_rank", rank)
    return placed.select(*own, F.when(F.col("_rank") <= n, F.col("_rank")).cast("long").alias("rank")).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; undrawn ones have no rank.

    Texts are read twice, for the counts and for the weights. The weights are written to the
    shared folder; ranking works on these few numbers per document.
    """
    table = weights(docs, gains(docs, target)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    eligible = (F.col("n_features") + 1) / 2 >= least_words
    table = staged(table.select(
        "*", (eligible & (F.col("n_features") > 0)).alias("eligible"), F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_at")), "weights")
    n = table.filter("eligible").count()
    return ranked(table, share * n // 100)
