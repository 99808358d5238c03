"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct word shingles. Sets are dealt into bands of sizes up
to R. A similarity of 80 % bounds the number of elements in which two sets of a band differ,
H <= (|a| + |b|) / 9. The feature domain of a band is cut into n1 groups of n2 parts, and a
signature is the projection of a set on a subset of n2 - k2 parts of a group:

* small bands (R <= 15) have one group of k + 2 parts, and all subsets of 2 parts are
  enumerated: two sets that differ in k elements agree on one of them;
* larger bands have groups of two parts of which subsets of one are enumerated, n parts in
  all. Two sets that differ in H elements agree on at least n - H of the n signatures, so it
  is enough that each set gives its first k + 1 signatures in an order common to all sets;
  the order puts those with most elements first, which are the most selective.

Shingles of very common lines and passages are found first, and the order puts signatures
made of these alone last, so that documents that share just a passage rarely meet. The order
stays common to all sets, and so the guarantee holds whatever is on the list.

A set whose size reaches 80 % of the next band gives signatures there as well. Every pair of
sets that are similar enough therefore shares a signature; all candidates are verified on
the sets themselves.

Defined results: null and empty texts have empty sets and are linked with nothing; texts of
fewer words than a shingle are one shingle; equal sets are linked by definition; a null
doc_id never becomes a component's id while another is there; repeated rows are linked;
other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kbspark.llm.common import release, staged
from kbspark.llm.graph import components
from kbspark.llm.tokens import (
    WORD_BASE, Piece, byte_values, find_words, mix, pieces, rolled, separators, window_hashes, window_starts, word_hashes,
)
from kbspark.session import NARROW_ROWS, at_most, small_side

WIDTH = 5
SIMILAR = 80  # per cent; the bounds in this module follow from it
SMALL = 15
SPACING = 0.3  # parts of a larger band, as a share of its largest size
# A shingle counts as common from this share of all sets, seen in pieces where it comes OFTEN.
COMMON, OFTEN, MOST_COMMON = 0.002, 3, 500_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(piece: Piece, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of a piece, sorted by row and hash."""
    words = find_words(piece, separators("space"))
    hashes, counts = word_hashes(piece, words, byte_values(True)), words.counts
    starts = window_starts(words, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    whole = mix(rolled(hashes, words.first[short], words.first[short + 1], WORD_BASE) + counts[short].astype(np.uint64))
    row = np.concatenate([words.row[starts], short])
    found = np.concatenate([window_hashes(hashes, starts, width), whole])
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    return row[fresh], found[fresh]


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum (mod 2^64) of consecutive groups of the given sizes, empty groups included."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def set_keys(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit key for every set."""
    return mix(sums(mix(found ^ GOLD), sizes) + sizes.astype(np.uint64) * GOLD)


def signatures(
    row: np.ndarray, found: np.ndarray, sizes: np.ndarray, common: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Row and signature of the sets of a piece (rows without signatures have equal partners only).

    ``common`` are the sorted hashes of very common shingles.
    """
    power = np.frexp(np.maximum(sizes, 1))[1] - 1
    next_floor = np.left_shift(1, power + 1)
    upper = np.flatnonzero((sizes * 100 >= SIMILAR * next_floor) & (sizes > 0))
    own = np.flatnonzero(sizes > 0)
    of = np.concatenate([own, upper])  # the row of every (set, band)
    band = np.concatenate([power[own], power[upper] + 1])
    largest = np.left_shift(2, band) - 1
    s = sizes[of]
    bound = (s + np.minimum(largest, s * 100 // SIMILAR)) // 9
    most = 2 * largest // 9
    keep = most > 0
    of, band, largest, s, bound, most = (x[keep] for x in (of, band, largest, s, bound, most))
    small = largest <= SMALL
    parts = np.where(small, most + 2, 2 * np.ceil(SPACING * largest / 2).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(parts)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    entity = np.repeat(np.arange(len(of)), s)
    at = np.arange(len(entity)) - np.repeat(np.cumsum(s) - s, s) + first[of][entity]
    element = found[at]
    spread = mix(element + band[entity].astype(np.uint64) * GOLD)
    part = base[entity] + ((spread >> np.uint64(16)) % parts[entity].astype(np.uint64)).astype(np.int64)
    weight = np.bincount(part, minlength=base[-1])
    rare = np.bincount(part[~among(element, common)], minlength=base[-1])
    total = sums(mix(element * GOLD)[np.argsort(part, kind="stable")], weight)
    holder = np.repeat(np.arange(len(of)), parts)
    index = (np.arange(base[-1]) - base[holder]).astype(np.uint64)
    token = mix(total + mix(index + (band[holder].astype(np.uint64) << np.uint64(32)) + np.uint64(1)))
    out_row, out_sig = [], []
    big = ~small[holder]
    h, t = holder[big], token[big]
    order = np.lexsort((t, -weight[big], -rare[big], h))
    h, t = h[order], t[order]
    place = np.arange(len(h)) - np.searchsorted(h, h)
    chosen = place <= bound[h]
    out_row.append(of[h[chosen]])
    out_sig.append(t[chosen])
    for k in np.unique(most[small]):
        these = np.flatnonzero(small & (most == k))
        grid = token[base[these][:, None] + np.arange(k + 2)]
        for a, b in combinations(range(k + 2), 2):
            out_row.append(of[these])
            out_sig.append(mix(grid[:, a] * GOLD + grid[:, b]))
    return np.concatenate(out_row), np.concatenate(out_sig)


def _sizes(row: np.ndarray, piece: Piece) -> np.ndarray:
    return np.bincount(row, minlength=piece.rows).astype(np.int64)


@F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("key", T.LongType())]))
def _set_facts(texts: pa.Array) -> pa.Array:
    ns, keys = [], []
    for piece in pieces(texts):
        row, found = shingle_sets(piece)
        sizes = _sizes(row, piece)
        ns.append(sizes)
        keys.append(set_keys(found, sizes).view(np.int64))
    n = np.concatenate(ns) if ns else np.zeros(0, np.int64)
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    return pa.StructArray.from_arrays([pa.array(n), pa.array(key, mask=n == 0)], ["n", "key"])


def _frequent_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, n) of the shingles that several sets of one piece have."""
    for batch in batches:
        for piece in pieces(batch.column(0)):
            shingle, n = np.unique(shingle_sets(piece)[1], return_counts=True)
            often = n >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(shingle[often].view(np.int64)), pa.array(n[often])], ["shingle", "n"])


def common_shingles(docs: DataFrame, facts: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles of at least ``COMMON`` of all sets, as far as pieces show it.

    At most ``MOST_COMMON`` shingles can reach the share that is asked for, so the list is bounded.
    """
    rows, total = facts.agg(F.count("*"), F.sum("n")).first()
    least = max(COMMON * rows, (total or 0) / MOST_COMMON, 2 * OFTEN)
    found = docs.select("text").mapInArrow(_frequent_rows, "shingle long, n long").groupBy("shingle").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= least).select("shingle").toArrow()
    return np.sort(np.asarray(found.column(0), dtype=np.int64).view(np.uint64))


def _signature_rows(common):
    """Function to (sig, key) of every set; a set that came before in the task is passed over."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in pieces(batch.column(0)):
                row, found = shingle_sets(piece)
                sizes = _sizes(row, piece)
                keys = set_keys(found, sizes).view(np.int64)
                fresh = np.zeros(piece.rows, bool)
                for i in np.flatnonzero(sizes > 0):
                    if keys[i] not in seen:
                        seen.add(keys[i])
                        fresh[i] = True
                kept = fresh[row]
                at, sig = signatures(row[kept], found[kept], np.where(fresh, sizes, 0), common.value)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(keys[at])], ["sig", "key"])
        del seen
        release()

    return rows


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, members) of every set that is not empty."""
    for batch in batches:
        for piece in pieces(batch.column(0)):
            row, found = shingle_sets(piece)
            sizes = _sizes(row, piece)
            some = sizes > 0
            ends = np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32)
            members = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(set_keys(found, sizes).view(np.int64)[some]), members], ["key", "members"])
    release()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that are similar enough, by intersecting their sets."""
    if at_most(pairs, NARROW_ROWS):  # leaves sets in no pair where they are; the joins below are the same
        either = pairs.select(F.explode(F.array("a", "b")).alias("key"))
        sets = sets.join(F.broadcast(either), "key", "left_semi")
    one = sets.select(F.col("key").alias("a"), F.col("members").alias("x"))
    two = sets.select(F.col("key").alias("b"), F.col("members").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").filter(
        both * 100 >= (F.size("x") + F.size("y") - both) * SIMILAR).select("a", "b")


def rare_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) with different labels among ``nodes`` (key, n, label), by rarest shingles.

    In any common order, similar sets share one of their first n - ceil(0.8 n) + 1 shingles.
    The order is by how many of these nodes have a shingle, rarest first: what two texts
    share only as a passage of many others comes last. The first shingle in common, at
    places i and j, leaves at most 1 + min(|a| - i, |b| - j) shared ones, which must be enough.
    Shingles of a single node come first of all, so their number is all that the order needs of them.
    """
    each = sets.join(small_side(nodes.select("key"), at_most(nodes, NARROW_ROWS)), "key", "left_semi").select(
        "key", F.explode("members").alias("e"))
    held = each.groupBy("e").agg(F.count("*").alias("df")).filter("df > 1")
    of = W.partitionBy("key")
    place = F.row_number().over(of.orderBy("df", "e")) + F.col("n") - F.count("*").over(of)
    prefix = F.col("n") - F.floor((F.col("n") * SIMILAR + 99) / 100) + 1
    first = staged(each.join(held, "e").join(nodes, "key").withColumn("place", place).filter(
        F.col("place") <= prefix).select("e", "key", "n", "label", "place"), "prefixes")
    # Sizes and places decide before rows meet: of a shingle, the few (size, place) groups are
    # compared first, and only groups that can hold similar sets pair their rows.
    group = first.groupBy("e", "n", "place").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    left = group.select("e", F.col("n").alias("na"), F.col("place").alias("i"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
    right = group.select("e", F.col("n").alias("nb"), F.col("place").alias("j"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    able = staged(left.join(right, "e").filter(
        ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("i") <= F.col("j"))))
        & (F.least("la", "lb") < F.greatest("ha", "hb"))
        & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * SIMILAR)
        & ((F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) + 1) * (100 + SIMILAR) >= (F.col("na") + F.col("nb")) * SIMILAR)
    ).select("e", "na", "i", "nb", "j"), "groups")
    one = first.select("e", F.col("key").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("place").alias("i"))
    two = first.select("e", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("place").alias("j"))
    return able.join(one, ["e", "na", "i"]).join(two, ["e", "nb", "j"]).filter(
        (F.col("a") != F.col("b")) & (F.col("la") != F.col("lb"))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def set_links(docs: DataFrame, facts: DataFrame) -> DataFrame | None:
    """(node, label) of the sets that are linked to others; None when no signature is shared.

    Sets that share a signature form a bucket. First one pivot of each bucket (the set in
    most buckets) is verified with the others, a number of pairs that is linear in the
    members. Where all sets of a bucket then are in one component, no further pair is needed.
    The sets of all other buckets are compared across components by their rarest shingles.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, facts))
    sigs = docs.select("text").mapInArrow(_signature_rows(common), "sig long, key long")
    group = W.partitionBy("sig")
    shared = sigs.select("sig", "key", (F.min("key").over(group) < F.max("key").over(group)).alias("several"))
    buckets = staged(shared.filter("several").select("sig", "key").distinct(), "buckets")
    degree = buckets.groupBy("key").agg(F.count("*").alias("degree"))
    nodes = facts.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    known = staged(degree.join(nodes, "key"), "nodes")
    if at_most(known, 0):
        return None
    small = at_most(known, NARROW_ROWS)
    wanted = known.select("doc_id").distinct()
    texts = docs.join(small_side(wanted, small), docs["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
    sets = texts.select("text").mapInArrow(_set_rows, "key long, members array<long>").join(
        small_side(known.select("key"), small), "key", "left_semi")
    heads = facts.join(small_side(wanted, small), facts["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
    again = heads.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1")
    sets = staged(sets if at_most(again, 0) else sets.dropDuplicates(["key"]), "sets")
    sized = buckets.join(known.select("key", "degree", "n"), "key")
    pivots = sized.groupBy("sig").agg(F.max(F.struct("degree", "key", "n")).alias("p")).select(
        "sig", F.col("p.key").alias("pivot"), F.col("p.n").alias("size"))
    pairs = staged(sized.join(pivots, "sig").filter(
        (F.col("key") != F.col("pivot")) & (F.least("n", "size") * 100 >= F.greatest("n", "size") * SIMILAR)
    ).select(F.least("pivot", "key").alias("a"), F.greatest("pivot", "key").alias("b")).distinct(), "pairs")
    links = staged(verified(pairs, sets), "links")
    labels = staged(components(links), "labels")
    named = sized.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = named.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("sig")
    undecided = staged(named.join(mixed, "sig", "left_semi").select("key", "n", "label").distinct(), "undecided")
    further = staged(rare_pairs(undecided, sets).join(pairs, ["a", "b"], "left_anti"), "pairs")
    new = staged(verified(further, sets), "links")
    if at_most(new, 0):
        return labels
    return staged(components(new.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))), "labels")


def similarity_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    The component of a set is found per distinct set; documents only look it up.
    """
    docs = docs.select("doc_id", "text")
    facts = staged(docs.select("doc_id", _set_facts("text").alias("f")).select("doc_id", "f.n", "f.key"), "facts")
    some = facts.filter("n > 0")
    own = some.groupBy("key").agg(F.min("doc_id").alias("least"))
    labels = set_links(docs, some)
    if labels is not None:
        named = own.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        least = named.groupBy("label").agg(F.min("least").alias("least"))
        own = named.select("key", "label").join(least, "label").select("key", "least")
    return facts.join(own, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for every component of sets, that with the smallest doc_id; columns unchanged.

    A row is known by its doc_id and the hash of its text, so different texts without an id, or
    under one id, are judged apart. Null ids come last; ties go to the smallest hash. Texts
    without words are linked with nothing and stay. Of rows with equal id and text one is kept.
    """
    texts = docs.select("doc_id", "text")
    hashed = F.xxhash64(F.col("text").isNull(), "text")
    facts = staged(texts.select("doc_id", hashed.alias("hash"), _set_facts("text").alias("f")).select(
        "doc_id", "hash", "f.n", "f.key"), "facts")
    rows = facts.groupBy("key", "doc_id", "hash").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash", "rows")).alias("head")
    own = rows.filter("key is not null").groupBy("key").agg(first)
    labels = set_links(texts, facts.filter("n > 0"))
    if labels is not None:
        own = own.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").groupBy(
            F.coalesce("label", "key").alias("key")).agg(F.min("head").alias("head"))
    heads = staged(own.select("head.doc_id", "head.hash", "head.rows").unionByName(
        rows.filter("key is null").select("doc_id", "hash", "rows")).select(
        F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "rows"), "heads")
    own = docs.columns
    carried = docs.select(F.struct(*[docs[c] for c in own]).alias("row"), docs["doc_id"], hashed.alias("hash"))
    kept = carried.join(
        small_side(heads.select("_id", "_hash"), at_most(heads, NARROW_ROWS)),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_semi")
    if not at_most(heads.filter("rows > 1"), 0):
        kept = kept.dropDuplicates(["doc_id", "hash"])
    return kept.select(*[F.col("row")[c].alias(c) for c in own])
