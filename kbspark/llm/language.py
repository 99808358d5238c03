"""Language identification: words first, then shorter and shorter character n-grams.

Each language has relative frequencies of words and of character n-grams of words, with a
blank at both ends. A word that any language knows scores by its log frequency in each of
them. A word that none knows scores by its longest n-grams that are known, as the mean of
their log frequencies; if no n-gram of that length is known, the next shorter length is tried.
A text's scores are the sums over its words, and the language with the highest sum is taken.

The model is fitted on a sample of at most about ``PER_LANGUAGE`` documents a language, drawn by
a hash of the id; whole texts of those documents are counted in Spark. Its entries are checked
against ``MAX_ENTRIES`` before they are sent to the tasks: beyond that, the most frequent stay.

Words are runs of letters in lower case; ASCII other than letters, and the punctuation blocks
of two and three bytes, part them.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every
text when nothing could be learned; a text with letters but no known n-gram has the same score
for all languages, and the first by code point is taken; of several texts under one id and
language the smallest is learned from; rows without lang are not learned from; repeated rows
are predicted alike; no rows give no rows. The score is the posterior of the language taken,
with equal priors. Columns other than doc_id, text and lang are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.classifier import held_out
from kbspark.llm.common import staged
from kbspark.llm.tokens import BYTE_BASE, Piece, Words, byte_values, mix, pieces, rolled, word_hashes
from kbspark.session import NARROW_ROWS, at_most, small_side

PER_LANGUAGE = 2000
MAX_ENTRIES = 2_000_000
GRAMS = 4
SMOOTH = 0.5
UNKNOWN = "und"
_VALUES = byte_values(False)


def _letters() -> np.ndarray:
    code = np.arange(256)
    return ((code >= 97) & (code <= 122)) | ((code >= 65) & (code <= 90)) | (code >= 128)


_LETTER = _letters()


def find_letter_words(piece: Piece) -> Words:
    """Runs of letters. Bytes C2 xx, E2 80 xx and E3 80 xx are punctuation and part words."""
    data = piece.data
    inside = _LETTER[data]
    for lead, width in ((data == 0xC2, 2), ((data == 0xE2) | (data == 0xE3), 3)):
        at = np.flatnonzero(lead)
        at = at[at + width <= len(data)]
        if width == 3:
            at = at[data[at + 1] == 0x80]
        for k in range(width):
            inside[at + k] = False
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(piece.rows + 1, np.int64))
    edge = np.zeros(n + 1, bool)
    edge[piece.offsets] = True
    before, after = np.r_[False, inside[:-1]] & ~edge[:-1], np.r_[inside[1:], False] & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, piece.offsets).astype(np.int64))


def padded(piece: Piece, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of some words with a blank at both ends, first byte of every character, and the
    number of the first character of every word."""
    size = words.ends[which] - words.starts[which] + 2
    first = np.cumsum(size) - size
    at = np.repeat(words.starts[which] - 1 - first, size) + np.arange(size.sum())
    data = piece.data[np.clip(at, 0, max(len(piece.data) - 1, 0))] if len(at) else np.zeros(0, np.uint8)
    data[first] = 32
    data[first + size - 1] = 32
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    return data, np.r_[chars, len(data)], np.r_[np.searchsorted(chars, first), len(chars)]


def grams(data: np.ndarray, chars: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of every run of ``n`` characters within one word."""
    word = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.arange(len(word))
    fits = start + n <= first[1:][word]
    start, word = start[fits], word[fits]
    lo, hi = chars[start], chars[start + n]
    return word, mix(rolled(_VALUES[data], lo, hi, BYTE_BASE) + np.uint64(n))


def _observed(texts: pa.Array, langs: list[str]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """(lang, order, hashes, counts) of words (order 0) and n-grams, piece by piece."""
    for piece in pieces(texts):
        words = find_letter_words(piece)
        hashes = word_hashes(piece, words, _VALUES)
        data, chars, first = padded(piece, words, np.arange(len(hashes)))
        every = [(0, words.row, hashes)]
        for n in range(1, GRAMS + 1):
            word, h = grams(data, chars, first, n)
            every.append((n, words.row[word], h))
        names = np.array(langs[piece.first : piece.first + piece.rows], dtype=object)
        for lang in sorted(set(names)):
            mine = names == lang
            for order, row, h in every:
                key, count = np.unique(h[mine[row]], return_counts=True)
                yield lang, order, key, count


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, order, key, count in _observed(b.column(0), b.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(key), pa.string()), pa.array(np.full(len(key), order), pa.int32()),
                 pa.array(key.view(np.int64)), pa.array(count, pa.int64())], ["lang", "n", "key", "times"])


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(text, lang) of about ``per_language`` documents of every language, by a hash of the id."""
    key = F.concat(F.lit("language:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rate = staged(known.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("_rate")), "rates")
    # one row a language: sent to the texts, which then need no shuffle before they are drawn
    rate = small_side(rate, at_most(rate, NARROW_ROWS))
    drawn = known.select("doc_id", "lang", "text", draw.alias("_draw")).join(rate, "lang").filter("_draw < _rate")
    return drawn.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select(F.lower("text").alias("text"), "lang")


@dataclass
class Order:
    """Known keys of one order, and for each its languages with the gain over an unseen key."""

    keys: np.ndarray
    at: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    unseen: np.ndarray

    def add(self, scores: np.ndarray, row: np.ndarray, hashes: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
        """Add the log frequencies of known keys to the scores of their rows.

        With ``group`` (the word of every n-gram) each group counts once, by the mean over its
        known keys. Returns a flag for every hash, or for every group.
        """
        n_groups = len(hashes) if group is None else int(group.max(initial=-1)) + 1
        if not len(self.keys) or not len(hashes):
            return np.zeros(n_groups, bool)
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[place] == hashes
        place, row = place[known], row[known]
        share = np.ones(len(place))
        if group is not None:
            group = group[known]
            share = 1.0 / np.bincount(group, minlength=n_groups)[group]
        size = self.at[place + 1] - self.at[place]
        pair = np.repeat(self.at[place] - np.cumsum(size) + size, size) + np.arange(size.sum())
        n, width = scores.shape
        scores += np.bincount(np.repeat(row, size) * width + self.lang[pair],
                              weights=self.gain[pair] * np.repeat(share, size), minlength=n * width).reshape(n, width)
        scores += np.bincount(row, weights=share, minlength=n)[:, None] * self.unseen[None, :]
        if group is None:
            return known
        return np.bincount(group, minlength=n_groups) > 0


@dataclass
class Model:
    langs: list[str]
    orders: list[Order]

    def scores(self, piece: Piece) -> np.ndarray:
        """Sum of log frequencies of every text (row) in every language (column)."""
        out = np.zeros((piece.rows, len(self.langs)))
        words = find_letter_words(piece)
        row = words.row
        left = np.flatnonzero(~self.orders[0].add(out, row, word_hashes(piece, words, _VALUES)))
        for n in range(len(self.orders) - 1, 0, -1):
            if not len(left):
                break
            word, h = grams(*padded(piece, words, left), n)
            found = np.zeros(len(left), bool)
            hit = self.orders[n].add(out, row[left][word], h, word)
            found[: len(hit)] = hit
            left = left[~found]
        return out


def order_of(lang: np.ndarray, key: np.ndarray, times: np.ndarray, n_langs: int) -> Order:
    by = np.lexsort((lang, key))
    lang, key, times = lang[by], key[by], times[by].astype(float)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    total = np.bincount(lang, weights=times, minlength=n_langs) + SMOOTH * len(first)
    unseen = np.log(SMOOTH / np.maximum(total, SMOOTH))
    gain = np.log((times + SMOOTH) / total[lang]) - unseen[lang]
    return Order(key[first], np.r_[first, len(key)], lang, gain.astype(np.float32), unseen)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, max_entries: int = MAX_ENTRIES) -> Model:
    """Model of the languages of the rows that are not held out."""
    found = sample(docs, per_language).mapInArrow(_count, "lang string, n int, key bigint, times bigint")
    counts = staged(found.groupBy("n", "key", "lang").agg(F.sum("times").alias("times")), "entries")
    if not at_most(counts, max_entries):
        counts = counts.orderBy(F.desc("times"), "n", "key", "lang").limit(max_entries)
    table = counts.toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    code = {name: i for i, name in enumerate(names)}
    lang = np.array([code[v] for v in table.column("lang").to_pylist()], dtype=np.int64)
    n, key, times = (table.column(c).to_numpy() for c in ("n", "key", "times"))
    key = key.astype(np.int64).view(np.uint64)
    return Model(names, [order_of(lang[n == o], key[n == o], times[n == o], len(names)) for o in range(GRAMS + 1)])


def has_letter(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, UNKNOWN], dtype=object)
        for b in batches:
            best, sure = [np.zeros(0, np.int64)], [np.zeros(0)]
            for piece in pieces(b.column(1)):
                if not model.langs:
                    best.append(np.zeros(piece.rows, np.int64))
                    sure.append(np.zeros(piece.rows))
                    continue
                s = model.scores(piece)
                best.append(s.argmax(axis=1))
                sure.append(1.0 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1))
            letters = b.column(2).to_numpy(zero_copy_only=False)
            pick = np.where(letters, np.concatenate(best), len(model.langs))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names[pick].tolist(), pa.string()), pa.array(np.where(letters, np.concatenate(sure), 0.0))],
                ["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", F.lower("text").alias("t"), has_letter("text").alias("letters"))
    return rows.mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = fit(docs, per_language)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
