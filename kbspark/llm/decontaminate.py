"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of ``n`` consecutive words of a test item is one pattern of the automaton (an item
of fewer words is one window). Letters of the automaton are words, numbered over the words of
the items: a window is a path of at most ``n`` nodes, and a document word that no item has ends
every match. Documents are read once, word by word, in pieces of bounded bytes; only runs of
item words that are long enough for a pattern go through the automaton. The words where a
pattern ends give the words hit, and these the characters of the original text.

The nodes of an automaton are bounded: items come in blocks of bytes, and the windows of a
block are dealt to as many automata as ``MAX_NODES`` asks for, each with a scan of its own. Words
are compared by 64-bit hashes.

Defined results: null and empty texts have no words and no hits; items without words are no
items; a null item_id reads as an empty one; equal windows of several items count for each;
repeated rows are scanned alike; an empty benchmark hits nothing; columns of the documents
are carried in one struct, so their names are free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import release, staged
from kbspark.llm.tokens import Piece, Words, byte_values, find_words, pieces, separators, word_hashes

WINDOW = 10
# Bytes of item text that are on the driver at a time, and nodes of one automaton (about 100 bytes each).
BLOCK_BYTES = 1 << 20
MAX_NODES = 2_000_000
SPANS = "array<struct<word_start: int, word_end: int, char_start: int, char_end: int>>"
FOUND = f"struct<n_words: bigint, n_hit: bigint, spans: {SPANS}, items: array<string>>"
_SEPS, _VALUES = separators("nonword"), byte_values(True)


def words_of(piece: Piece) -> tuple[Words, np.ndarray]:
    """Words of a piece (A-Z in lower case, split at other ASCII than letters and digits), and their hashes."""
    words = find_words(piece, _SEPS)
    return words, word_hashes(piece, words, _VALUES)


@dataclass
class Patterns:
    """Distinct windows as rows of word numbers, the items of each, and the hash of every number."""

    vocabulary: np.ndarray
    words: np.ndarray
    size: np.ndarray
    at: np.ndarray
    owner: np.ndarray
    items: list[str]

    def part(self, lo: int, hi: int) -> Patterns:
        return Patterns(self.vocabulary, self.words[lo:hi], self.size[lo:hi], self.at[lo : hi + 1] - self.at[lo],
                        self.owner[self.at[lo] : self.at[hi]], self.items)

    def parts(self, nodes: int) -> Iterator[Patterns]:
        """Pieces whose windows have at most ``nodes`` words in all, one window at least."""
        upto, lo = np.cumsum(self.size), 0
        while lo < len(self.size):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + nodes, side="right")))
            yield self.part(lo, hi)
            lo = hi


def windows(items: list[tuple[str, str]], n: int) -> Patterns:
    """Patterns of a list of (id, text)."""
    names = sorted({i for i, _ in items})
    number = {name: k for k, name in enumerate(names)}
    rows, owner = [np.zeros((0, n), np.uint64)], [np.zeros(0, np.int64)]
    sizes = [np.zeros(0, np.int64)]
    ids = np.array([number[i] for i, _ in items], dtype=np.int64)
    for piece in pieces(pa.array([t for _, t in items], pa.string())):
        words, hashes = words_of(piece)
        size = np.minimum(n, words.counts)
        first = np.repeat(words.first[:-1], np.maximum(words.counts - size + 1, 0) * (words.counts > 0))
        row = np.repeat(np.arange(piece.rows), np.maximum(words.counts - size + 1, 0) * (words.counts > 0))
        start = first + np.arange(len(row)) - np.searchsorted(row, row)
        at = start[:, None] + np.arange(n)[None, :]
        inside = np.arange(n)[None, :] < size[row][:, None]
        rows.append(np.where(inside, hashes[np.minimum(at, max(len(hashes) - 1, 0))] if len(hashes) else 0, 0))
        sizes.append(size[row])
        owner.append(ids[piece.first + row])
    grid, size, owner = np.concatenate(rows), np.concatenate(sizes), np.concatenate(owner)
    real = np.arange(n)[None, :] < size[:, None]
    vocabulary = np.unique(grid[real])
    number = np.where(real, np.searchsorted(vocabulary, grid), -1).astype(np.int64)
    full = np.unique(np.column_stack([number, owner]), axis=0) if len(number) else np.zeros((0, n + 1), np.int64)
    fresh = np.ones(len(full), bool)
    fresh[1:] = (full[1:, :n] != full[:-1, :n]).any(axis=1)
    first = np.flatnonzero(fresh)
    words = full[first, :n].astype(np.int32)
    return Patterns(vocabulary, words, (words >= 0).sum(axis=1), np.r_[first, len(full)], full[:, n], names)


def automaton(state: dict):
    """The automaton of broadcast patterns; built once in every worker that uses them."""
    if "automaton" not in state:
        import ahocorasick

        found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        patterns = state["patterns"]
        for i, (row, size) in enumerate(zip(patterns.words.tolist(), patterns.size.tolist())):
            found.add_word(tuple(row[:size]), i)
        if len(patterns.size):
            found.make_automaton()
        state["automaton"] = found
    return state["automaton"]


def matches(piece: Piece, patterns: Patterns, search) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a piece, the word where each match ends, and its pattern."""
    words, hashes = words_of(piece)
    none = np.zeros(0, np.int64)
    if not len(hashes) or not len(patterns.size):
        return words, none, none
    place = np.minimum(np.searchsorted(patterns.vocabulary, hashes), len(patterns.vocabulary) - 1)
    known = patterns.vocabulary[place] == hashes
    # Runs of known words within a text, as long as the shortest pattern.
    row = words.row
    joined = known[1:] & known[:-1] & (row[1:] == row[:-1])
    lo = np.flatnonzero(known & ~np.r_[False, joined])
    hi = np.flatnonzero(known & ~np.r_[joined, False]) + 1
    far = hi - lo >= patterns.size.min()
    ends, which = [], []
    for a, b in zip(lo[far].tolist(), hi[far].tolist()):
        for end, i in search.iter(tuple(place[a:b].tolist())):
            ends.append(a + end)
            which.append(i)
    return words, np.array(ends, dtype=np.int64), np.array(which, dtype=np.int64)


def covered(words: Words, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Flag of every word that lies inside a match."""
    edge = np.zeros(int(words.first[-1]) + 1, dtype=np.int64)
    np.add.at(edge, ends + 1 - size, 1)
    np.add.at(edge, ends + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def spans_of(piece: Piece, words: Words, hit: np.ndarray, row: int) -> list[dict]:
    """Runs of hit words of one text, with the characters they take in it."""
    a, b = words.first[row], words.first[row + 1]
    flag = np.r_[False, hit[a:b], False]
    turn = np.flatnonzero(flag[1:] != flag[:-1])
    data = piece.data[piece.offsets[row] : piece.offsets[row + 1]]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    begin, end = words.starts[a:b] - piece.offsets[row], words.ends[a:b] - piece.offsets[row]
    return [{"word_start": int(x), "word_end": int(y), "char_start": int(chars[begin[x]]), "char_end": int(chars[end[y - 1]])}
            for x, y in zip(turn[::2], turn[1::2])]


def finder(spark, patterns: Patterns):
    """Arrow function text -> (n_words, n_hit, spans, items) for the windows of one automaton."""
    shared = spark.sparkContext.broadcast({"patterns": patterns})

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        patterns, search = shared.value["patterns"], automaton(shared.value)
        n_words, n_hit, spans, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], []
        for piece in pieces(texts):
            words, ends, which = matches(piece, patterns, search)
            hit = covered(words, ends, patterns.size[which])
            row = words.row
            n_words.append(words.counts)
            n_hit.append(np.bincount(row[hit], minlength=piece.rows))
            found: dict[int, set[int]] = {}
            for r, i in set(zip(row[ends].tolist(), which.tolist())):
                found.setdefault(r, set()).update(patterns.owner[patterns.at[i] : patterns.at[i + 1]].tolist())
            for r in range(piece.rows):
                spans.append(spans_of(piece, words, hit, r) if r in found else [])
                items.append(sorted(patterns.items[k] for k in found.get(r, ())))
        kind = pa.list_(pa.struct([(k, pa.int32()) for k in ("word_start", "word_end", "char_start", "char_end")]))
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_hit)), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))],
            ["n_words", "n_hit", "spans", "items"])

    return find


def flagger(spark, patterns: Patterns):
    """Arrow function text -> whether any window of one automaton is in it."""
    shared = spark.sparkContext.broadcast({"patterns": patterns})

    @F.arrow_udf("boolean")
    def flag(texts: pa.Array) -> pa.Array:
        patterns, search = shared.value["patterns"], automaton(shared.value)
        out = [np.zeros(0, bool)]
        for piece in pieces(texts):
            words, ends, _ = matches(piece, patterns, search)
            out.append(np.bincount(words.row[ends], minlength=piece.rows) > 0)
        release()
        return pa.array(np.concatenate(out))

    return flag


def item_blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """Distinct items in lists of about ``limit`` bytes; only one list is on the driver at a time."""
    rows = staged(items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct(), "items")
    total = rows.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    blocks = int(total // limit) + 1
    for b in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r.item_id, r.text) for r in part.toLocalIterator()]


def automata(items: DataFrame, n: int, limit: int) -> Iterator[Patterns]:
    """Windows of all items in parts for one automaton each; one block of items at a time."""
    for block in item_blocks(items, limit):
        yield from windows(block, n).parts(MAX_NODES)


def _covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), start, lambda a, s: F.struct(
        F.greatest(a["end"], s["word_end"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["word_end"] - F.greatest(a["end"], s["word_start"]))).alias("n")))["n"]


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``contamination``: n_words, n_hit, spans and items.

    With one automaton the text goes through one scan beside its row, without a shuffle. Every
    further one of a larger benchmark adds another scan, before which the rows found so far
    are staged: a worker has one automaton at a time.
    """
    own = docs.columns
    docs, found = docs.select(F.struct(*own).alias("doc")), None
    for patterns in automata(items, n, limit):
        if found is not None:
            docs = staged(docs, "scanned")
        docs = docs.withColumn("next", finder(docs.sparkSession, patterns)("doc.text"))
        new = F.col("next")
        merged = new if found is None else F.struct(
            new["n_words"].alias("n_words"), F.lit(None).cast("long").alias("n_hit"), F.concat(found["spans"], new["spans"]).alias("spans"),
            F.concat(found["items"], new["items"]).alias("items"))
        docs = docs.select("doc", merged.alias("found"))
        found = F.col("found")
    if found is None:  # no item has words
        empty = windows([], n)
        docs = docs.select("doc", finder(docs.sparkSession, empty)("doc.text").alias("found"))
        found = F.col("found")
    ids = F.array_sort(F.array_distinct(found["items"]))
    out = F.struct(found["n_words"].alias("n_words"), F.coalesce(found["n_hit"], _covered(found["spans"])).alias("n_hit"),
                   found["spans"].alias("spans"), ids.alias("items"))
    return docs.select(*[F.col("doc")[c].alias(c) for c in own if c != "contamination"], out.alias("contamination"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Counts of hit words and a digest of the items found, for every document."""
    c = F.col("contamination")
    return contamination(docs.select("doc_id", "text"), items).select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, n: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any word in a test window, columns unchanged.

    Asks only whether there is a hit; every automaton sees what those before it left.
    """
    for i, patterns in enumerate(automata(items, n, limit)):
        if i:
            docs = staged(docs, "clean")
        docs = docs.filter(~flagger(docs.sparkSession, patterns)("text"))
    return docs
