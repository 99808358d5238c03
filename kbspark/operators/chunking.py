"""Packing timed segments into overlapping chunks, and budgeted vocabulary prefixes.

Greedy packing with a carried tail is sequential: where a chunk starts depends on where
the one before it ended. A source is therefore cut into blocks of segments with a halo
on both sides, and packing runs in three steps when a source has more than one block:

1. for every block, every state in which packing could enter it is followed to the state
   in which it leaves (a block is a function from entry to exit states);
2. these functions are composed along the source, 64 blocks at a time, level by level,
   which yields the one true entry state of every block;
3. every block packs its own segments from that state.

Each task handles one bounded block, so a source may hold any share of the data. Sources
that fit one block, the usual case, skip steps 1 and 2. Blocks and halos count the segments
that hold text, numbered without gaps, so blank or missing segments do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cached_property, partial
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators.blocks import row_index, running_sum
from kbspark.session import NARROW_ROWS, at_most, small_side, stored

# Chunk size limits, overlap share, vocabulary budget.
MIN_TOKENS = 300
MAX_TOKENS = 500
OVERLAP = 0.15
VOCAB_TOKENS = 224

BLOCK = 8192
HALO = 1024  # a chunk of 500 tokens holds at most 1002 segments with text (each >= 1 character + joint)
FAN = 64

_ENTRY = ["s_seq", "s_piece", "j_seq", "j_piece", "n_before"]

_SOLID = r"(?U)[^\s\x1c-\x1f]"
_CJK = re.compile(T.CHUNK_CJK)
_BREAK = re.compile(r"(?<=[。!?;.])\s*")

CHUNK_SCHEMA = (
    "source_id long, first_seq long, first_piece long, chunk_seq long, text string,"
    " start_sec double, end_sec double, n_tokens long, n_segments long"
)
CHUNK_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
MAP_SCHEMA = (
    "source_id long, blk long, in_s_seq long, in_s_piece long, in_j_seq long, in_j_piece long,"
    " out_s_seq long, out_s_piece long, out_j_seq long, out_j_piece long, n long"
)
ENTRY_SCHEMA = (
    "source_id long, blk long, s_seq long, s_piece long, j_seq long, j_piece long, n_before long"
)
LEDGER_SCHEMA = (
    "source_id long, chunk_seq long, n_pieces long, lost long, disordered long, repeated boolean,"
    " n_rows long, max_tokens long, min_tokens long, over_limit long, bad_times long, blank_chunks long,"
    " overlapping long, overlap_chars long, late_starts long"
)
LEDGER_TYPES = [pa.bool_() if c == "repeated" else pa.int64() for c in re.findall(r"(\w+) (?:long|boolean)", LEDGER_SCHEMA)]


def _count(text: str) -> tuple[int, int]:
    if text.isascii():
        return 0, len(text)
    cjk = len(_CJK.findall(text))
    return cjk, len(text) - cjk


class _Pieces:
    """Prepared pieces of one block: positions, token prefix sums, packing steps."""

    def __init__(self, segments: list[tuple[int, str, float, float, int]]):
        self.pos: list[tuple[int, int]] = []
        self.given: list[int] = []
        self.text: list[str] = []
        self.start: list[float] = []
        self.end: list[float] = []
        counts: list[tuple[int, int]] = []
        for seq, text, start, end, given in segments:
            cjk, other = _count(text)
            if cjk + other // 4 > MAX_TOKENS:
                parts = self._split(text, start, end)
            elif text.strip():
                parts = [(text, start, end)]
            else:
                parts = []
            for i, (body, a, b) in enumerate(parts):
                self.pos.append((int(seq), i))
                self.text.append(body)
                self.start.append(a)
                self.end.append(b)
                # a segment without such characters has no piece with them
                counts.append(_count(body) if cjk else (0, len(body)))
            self.given += [int(given)] * len(parts)
        self.cjk = np.concatenate([[0], np.cumsum([c for c, _ in counts], dtype=np.int64)]).tolist()
        self.other = np.concatenate([[0], np.cumsum([o for _, o in counts], dtype=np.int64)]).tolist()

    @cached_property
    def at(self) -> dict[tuple[int, int], int]:
        return {p: i for i, p in enumerate(self.pos)}

    @staticmethod
    def _split(text: str, start: float, end: float):
        """Sentences of an oversized segment, or fixed windows when there is only one."""
        cuts = [x for x in _BREAK.split(text) if x.strip()]
        if len(cuts) <= 1:
            cuts = [text[i:i + MAX_TOKENS] for i in range(0, len(text), MAX_TOKENS)]
        total, done, out = sum(map(len, cuts)), 0, []
        for x in cuts:
            a = start + (end - start) * (done / total)
            done += len(x)
            out.append((x.strip(), a, start + (end - start) * (done / total)))
        return out

    def tokens(self, a: int, b: int) -> int:
        """Tokens of pieces a..b-1 joined by single blanks."""
        other = self.other[b] - self.other[a] + max(b - a - 1, 0)
        return self.cjk[b] - self.cjk[a] + other // 4

    def step(self, s: int, j: int) -> tuple[int, int]:
        """Close the chunk that starts at s with first new piece j: next (s, j)."""
        lo, hi = j + 1, len(self.pos)
        while lo < hi:  # largest end with at most MAX_TOKENS, never before j + 1
            mid = (lo + hi + 1) // 2
            if self.tokens(s, mid) <= MAX_TOKENS:
                lo = mid
            else:
                hi = mid - 1
        return self.tail(s, lo), lo

    def tail(self, s: int, stop: int) -> int:
        """First piece of chunk s..stop-1 that the next chunk repeats; ``stop`` when none is."""
        budget = int(self.tokens(s, stop) * OVERLAP)
        tail = stop
        while tail > s and self.tokens(tail - 1, stop) <= budget:
            tail -= 1
        if tail == stop and self.tokens(stop - 1, stop) < MIN_TOKENS:
            tail = stop - 1
        return tail

    def entries(self, first: int, last: int) -> list[tuple[int, int]]:
        """Every state (s, j) in which packing can reach piece ``first`` or one behind it, j < last.

        A chunk ends before j because piece j did not fit, so few starts end there and each leaves
        one tail. Only a chunk of a single new piece, which may be overfull, is not told that way:
        behind it any tail counts.
        """
        if first == 0:
            return [(0, 0)]
        found: dict[tuple[int, int], None] = {}
        back = first - 1
        while back > 0 and (back > first - 2 or self.tokens(back - 1, first - 1) <= 120):
            back -= 1
        if self.tokens(back, first) > MAX_TOKENS:
            s = first
            found[(s, first)] = None
            # a tail is at most 15 % of an overfull chunk (<= 800 tokens), or one piece
            while s > 0 and (s == first or self.tokens(s - 1, first) <= 120):
                s -= 1
                found[(s, first)] = None
        j, low = first, 0
        while j < last and (j == first or self.tokens(first, j) <= MAX_TOKENS):
            while low < first and self.tokens(low, j) > MAX_TOKENS:
                low += 1
            s = low
            while s < first and self.tokens(s, j + 1) > MAX_TOKENS:
                found[(self.tail(s, j), j)] = None
                s += 1
            j += 1
        return list(found)

    def first_at(self, seq: int) -> int:
        """Index of the first piece at or after a segment position."""
        lo, hi = 0, len(self.pos)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.pos[mid][0] < seq:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def label(self, i: int) -> tuple[int, int]:
        """Position of piece i; just past the last piece when i is the end."""
        return self.pos[i] if i < len(self.pos) else (self.pos[-1][0] + 1, 0)

    def index(self, seq: int, piece: int) -> int:
        at = self.at.get((seq, piece), len(self.pos))
        if at == len(self.pos) and self.first_at(seq) < at:
            raise ValueError(f"packing state ({seq}, {piece}) lies outside its block")
        return at


def _with_halo(segments: DataFrame, width: int) -> DataFrame:
    """Copy each segment into its block and, near an edge, into the neighbour block."""
    off = F.col("seq") % width
    own = F.floor(F.col("seq") / width).cast("long")
    blocks = F.array_compact(F.array(
        own, F.when((off < HALO) & (own > 0), own - 1), F.when(off >= width - HALO, own + 1)))
    return segments.select(*segments.columns, F.explode(blocks).alias("blk"))


_SEGMENT = ["seq", "text", "start_sec", "end_sec", "given"]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _block_map(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    """Every possible entry state of a block with the exit it leads to."""
    blk, sid = int(pdf["blk"].iloc[0]), int(pdf["source_id"].iloc[0])
    cols = _names(MAP_SCHEMA)
    p = _Pieces(list(pdf.sort_values("seq")[_SEGMENT].itertuples(index=False, name=None)))
    if not p.pos:
        return pd.DataFrame(columns=cols)
    first, last = p.first_at(blk * width), p.first_at((blk + 1) * width)
    if first >= last:
        return pd.DataFrame(columns=cols)
    entries = p.entries(first, last)
    memo: dict[tuple[int, int], tuple[int, int, int]] = {}
    rows = []
    for entry in entries:
        path, state = [], entry
        while state[1] < last and state not in memo:
            path.append(state)
            state = p.step(*state)
        s, j, n = memo.get(state, (state[0], state[1], 0))
        for st in reversed(path):
            n += 1
            memo[st] = (s, j, n)
        rows.append((sid, blk, *p.label(entry[0]), *p.label(entry[1]), *p.label(s), *p.label(j), n))
    return pd.DataFrame(rows, columns=cols)


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chain the maps of FAN neighbouring blocks into one map."""
    cols = _names(MAP_SCHEMA)
    maps = {b: {(r.in_s_seq, r.in_s_piece, r.in_j_seq, r.in_j_piece): r for r in g.itertuples()}
            for b, g in pdf.groupby("blk")}
    sid, first = int(pdf["source_id"].iloc[0]), min(maps)
    rows = []
    for key in maps[first]:
        state, n = key, 0
        for b in sorted(maps):
            r = maps[b].get(state)
            if r is None:
                continue
            state, n = (r.out_s_seq, r.out_s_piece, r.out_j_seq, r.out_j_piece), n + r.n
        rows.append((sid, first // FAN, *key, *state, n))
    return pd.DataFrame(rows, columns=cols)


def _descend(entries: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
    """Entry states of the FAN child blocks, from the entry state of their parent."""
    cols = _names(ENTRY_SCHEMA)
    if entries.empty or maps.empty:
        return pd.DataFrame(columns=cols)
    e = entries.iloc[0]
    state, n = (e.s_seq, e.s_piece, e.j_seq, e.j_piece), int(e.n_before)
    rows = []
    for b, g in maps.sort_values("blk").groupby("blk"):
        rows.append((int(e.source_id), int(b), *map(int, state), n))
        hit = g[(g.in_s_seq == state[0]) & (g.in_s_piece == state[1])
                & (g.in_j_seq == state[2]) & (g.in_j_piece == state[3])]
        if len(hit):
            r = hit.iloc[0]
            state, n = (r.out_s_seq, r.out_s_piece, r.out_j_seq, r.out_j_piece), n + int(r.n)
    return pd.DataFrame(rows, columns=cols)


def _entries(blocks: DataFrame, top: int, width: int) -> DataFrame:
    """True entry state of every block of sources longer than one block."""
    long_sources = blocks.filter(F.col("seq") >= width).select("source_id").distinct()
    maps = blocks.join(long_sources, "source_id", "left_semi").groupBy("source_id", "blk").applyInPandas(
        lambda pdf: _block_map(pdf, width), MAP_SCHEMA)
    levels, count = [maps], top + 1
    while count > 1:
        up = F.floor(F.col("blk") / FAN)
        levels.append(levels[-1].groupBy("source_id", up.alias("_up")).applyInPandas(_compose, MAP_SCHEMA))
        count = -(-count // FAN)
    state = levels.pop().select(
        "source_id", "blk", *[F.lit(0).cast("long").alias(c) for c in ("s_seq", "s_piece", "j_seq", "j_piece", "n_before")]
    ).distinct()
    # the top map starts in block 0, whose only real entry is the first piece
    for level in reversed(levels):
        child = level.withColumn("_up", F.floor(F.col("blk") / FAN).cast("long"))
        parent = state.withColumn("_up", F.col("blk"))
        state = parent.groupBy("source_id", "_up").cogroup(child.groupBy("source_id", "_up")).applyInPandas(
            lambda a, b: _descend(a.drop(columns="_up"), b.drop(columns="_up")), ENTRY_SCHEMA)
    return state


def _pack(sid: int, blk: int, segments: list[tuple], entry: tuple[int, ...] | None, width: int) -> list[tuple]:
    """Chunk rows whose first new piece lies in this block."""
    p = _Pieces(segments)
    if not p.pos or (entry is None and blk > 0):
        return []
    last = p.first_at((blk + 1) * width)
    s, j, n = 0, 0, 0
    if entry is not None:
        s, j, n = p.index(entry[0], entry[1]), p.index(entry[2], entry[3]), entry[4]
    rows = []
    while j < last:
        tail, stop = p.step(s, j)
        rows.append((sid, p.given[j], p.pos[j][1], n, " ".join(p.text[s:stop]), p.start[s], p.end[stop - 1],
                     p.tokens(s, stop), stop - s))
        s, j, n = tail, stop, n + 1
    return rows


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(CHUNK_TYPES)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(cols, CHUNK_TYPES)], _names(CHUNK_SCHEMA))


def _pack_sorted(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Pack block after block of rows that arrive sorted by (source, block, seq).

    Only the rows of the block at hand are held; a block may span Arrow batches.
    """
    key, held, entry = None, [], None
    for b in batches:
        out: list[tuple] = []
        take = lambda names: zip(*(b.column(c).to_pylist() for c in names))
        state = take(_ENTRY) if "s_seq" in b.schema.names else repeat(None)
        for sid, blk, seg, st in zip(*(b.column(c).to_pylist() for c in ("source_id", "blk")), take(_SEGMENT), state):
            if (sid, blk) != key:
                if held:
                    out += _pack(*key, held, entry, width)
                key, held = (sid, blk), []
                entry = None if st is None or st[0] is None else st
            held.append(seg)
        yield _chunk_batch(out)
    if held:
        yield _chunk_batch(_pack(*key, held, entry, width))


def chunk(segments: DataFrame, max_seq: int | None = None, width: int = BLOCK) -> DataFrame:
    """Chunks of every source; segments are (source_id, seq, text, start_sec, end_sec).

    ``seq`` is the position of a segment in its source, from 0 and unique; it may have gaps.
    The largest one is looked up unless given: when every source is one segment (pasted
    texts, articles) nothing is shuffled, and beyond one block of ``width`` segments the
    segments with text are numbered anew and packed block by block.
    """
    if width < HALO:
        raise ValueError(f"a block must hold at least {HALO} segments")
    segs = segments.select(
        F.col("source_id").cast("long").alias("source_id"), F.col("seq").cast("long").alias("seq"), "text",
        F.coalesce("start_sec", F.lit(0.0)).alias("start_sec"), F.coalesce("end_sec", F.lit(0.0)).alias("end_sec"),
        F.col("seq").cast("long").alias("given"),
    ).filter(F.col("text").isNotNull())
    if max_seq is None:
        max_seq = segs.agg(F.max("seq")).first()[0] or 0
    pack = partial(_pack_sorted, width=width)
    if max_seq == 0:
        return segs.withColumn("blk", F.lit(0).cast("long")).mapInArrow(pack, CHUNK_SCHEMA)
    if max_seq >= width:
        # blank segments hold no token: only without them do HALO segments span a chunk
        solid = segs.filter(F.col("text").rlike(_SOLID) | (T.chunk_tokens("text") > MAX_TOKENS)).drop("seq")
        segs = row_index(solid, ["source_id"], "given", "seq")
    blocks = _with_halo(segs, width)
    if max_seq >= width:
        blocks = blocks.join(_entries(blocks, max_seq // width, width), ["source_id", "blk"], "left")
    placed = blocks.repartition("source_id", "blk").sortWithinPartitions("source_id", "blk", "seq")
    return placed.mapInArrow(pack, CHUNK_SCHEMA)


def chunk_id(source_id: str, n: str, visual: bool = False) -> "F.Column":
    """Id of chunk ``n`` of a source, stable without a global counter.

    Source id and position are packed while both fit (2^19 chunks of a kind, source ids from
    0 to below 2^43). Beyond that the id is a 63-bit hash below zero, where no packed id lies.
    """
    src, pos, kind = F.col(source_id), F.col(n), F.lit(int(visual))
    fits = src.between(0, (1 << 43) - 1) & pos.between(0, (1 << 19) - 1)
    hashed = F.xxhash64(src.cast("long"), pos.cast("long"), kind).bitwiseOR(F.lit(-(1 << 63)))
    return F.when(fits, src * F.lit(1 << 20) + kind * F.lit(1 << 19) + pos).otherwise(hashed)


def modality_of(source_type) -> "F.Column":
    """Spoken sources give audio chunks; articles, texts and captions give article chunks."""
    col = F.col(source_type) if isinstance(source_type, str) else source_type
    return F.when(col.isin("video", "podcast"), F.lit("audio")).otherwise(F.lit("article"))


def build_chunks(
    segments: DataFrame, sources: DataFrame, visual: DataFrame | None = None, max_seq: int | None = None, carry: Sequence[str] = (),
) -> DataFrame:
    """Stored chunk rows of all sources; visual rows are appended as they are.

    ``carry`` names columns of the source that every row gets, so that texts meet their sources
    once; ``max_seq`` is that of :func:`chunk`.
    """
    body = chunk(segments, max_seq).join(sources.select("source_id", "type", *carry), "source_id").select(
        chunk_id("source_id", "chunk_seq").alias("chunk_id"), "source_id",
        modality_of("type").alias("modality"), "text", "start_sec", "end_sec", *carry,
    )
    if visual is None:
        return body
    if carry:
        visual = visual.join(sources.select("source_id", *carry), "source_id", "left")
    rows = visual.select(
        chunk_id("source_id", "pos", visual=True).alias("chunk_id"), "source_id",
        F.lit("visual").alias("modality"), "text", "start_sec", "end_sec", *carry,
    )
    return body.unionByName(rows)


def sentence_pieces(segments: DataFrame) -> DataFrame:
    """(source_id, seq, piece, sentence): sentences of every segment over the size limit."""
    # the size test sits inside the generator: as a filter it would run below a rebalancing
    big = F.when(T.chunk_tokens("text") > MAX_TOKENS, T.sentences("text"))
    return segments.select(
        "source_id", "seq", F.posexplode_outer(big).alias("piece", "sentence")).filter(F.col("piece").isNotNull())


def vocabulary_prefix(lines: DataFrame, keys: Sequence[str] = ("vocab_id",), line_no: str = "line_no") -> DataFrame:
    """Per vocabulary: kept lines joined by ", " within the token budget, and counts.

    Blank and comment lines are skipped. The prefix ends at the first line that would
    overflow; running totals of both character classes decide, worked on in blocks.
    """
    keys = list(keys)
    usable = lines.filter(T.non_blank("line") & ~F.col("line").startswith("#")).withColumn("line", T.strip("line"))
    cjk = T.cjk_count("line", T.HAN_CJK).cast("long")
    summed = running_sum(usable, keys, line_no, {
        "_cjk": cjk, "_len": F.length("line").cast("long"), "_n": F.lit(1).cast("long")})
    other = F.col("_len") - F.col("_cjk") + 2 * (F.col("_n") - 1)
    marked = summed.withColumn("_fits", F.ceil(F.col("_cjk") * 1.5 + other / 3) <= VOCAB_TOKENS)
    # totals never fall, so the lines that fit are exactly the prefix; it is bounded
    kept = F.filter(
        F.sort_array(F.collect_list(F.when(F.col("_fits"), F.struct(F.col(line_no).alias("o"), F.col("line").alias("t"))))),
        lambda x: x.isNotNull())
    return marked.groupBy(*keys).agg(
        F.array_join(F.transform(kept, lambda x: x["t"]), ", ").alias("prompt"),
        F.count_if(F.col("_fits")).alias("kept"), F.count(F.lit(1)).alias("total"),
    )


def _parts() -> "F.Column":
    """What the segment ``text`` contributes to chunks, in order; null when that is nothing."""
    n = F.length("text")
    windows = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / MAX_TOKENS).cast("int")),
                          lambda i: T.strip(F.substr(F.col("text"), i * MAX_TOKENS + 1, F.lit(MAX_TOKENS))))
    cut = T.sentences("text")
    big = F.when(F.size(cut) > 1, F.transform(cut, lambda x: T.strip(x))).otherwise(windows)
    return F.when(T.chunk_tokens("text") > MAX_TOKENS, big).when(T.non_blank("text"), F.array("text"))


def segment_pieces(segments: DataFrame) -> DataFrame:
    """(source_id, seq, piece, text): what a segment contributes to chunks, as expressions.

    Blank segments contribute nothing, those over the size limit their sentences or, when
    there is only one, windows of ``MAX_TOKENS`` characters.
    """
    return segments.select("source_id", F.col("seq").cast("long").alias("seq"), F.posexplode_outer(_parts()).alias("piece", "text")).filter(
        F.col("piece").isNotNull())


def _after(chunks: DataFrame, *columns: str) -> DataFrame:
    """Every chunk with ``_prev_`` columns of the chunk before it, by an equi-join on its number."""
    before = chunks.select("source_id", (F.col("chunk_seq") + 1).alias("chunk_seq"), *[F.col(c).alias(f"_prev_{c}") for c in columns])
    return chunks.join(before, ["source_id", "chunk_seq"], "left")


def chunk_overlap(chunks: DataFrame) -> DataFrame:
    """(source_id, chunk_seq, overlap): characters a chunk shares with the end of the one before.

    The longest end of a chunk that is a beginning of the next. Only ends whose first two
    characters fit are compared, so most lengths cost two look-ups.
    """
    pair = _after(chunks.select("source_id", "chunk_seq", "text"), "text").filter(F.col("_prev_text").isNotNull())
    pair = pair.select("source_id", "chunk_seq", "text", "_prev_text", F.split("_prev_text", "").alias("_p"), F.split(F.left("text", F.lit(2)), "").alias("_t"))
    size = F.least(F.length("text"), F.length("_prev_text"))
    ends = F.expr("""filter(sequence(1, _n), k -> _p[_m - k] = _t[0] and (k = 1 or _p[_m - k + 1] = _t[1])
        and startswith(text, right(_prev_text, k)))""")
    sized = pair.withColumn("_n", size).withColumn("_m", F.length("_prev_text"))
    longest = F.when(F.col("_n") > 0, F.array_max(ends))
    return sized.select("source_id", "chunk_seq", F.coalesce(longest, F.lit(0)).cast("long").alias("overlap"))


def _ledger_in_blocks(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """:func:`chunk_ledger` of sources of any length: places come from running totals in blocks,
    so no source and no chunk is gathered, but texts are shuffled several times.
    """
    starts = chunks.groupBy("source_id", "chunk_seq").agg(
        F.min("first_seq").alias("seq"), F.min("first_piece").cast("int").alias("piece"), F.min("text").alias("text"), F.count(F.lit(1)).alias("_times"))
    pieces = segment_pieces(segments)
    zero = F.lit(0).cast("long")
    marks = pieces.select("source_id", "seq", "piece", F.lit(1).alias("_kind"), "text", zero.alias("_start"),
                          (F.length("text") + 1).cast("long").alias("_size"), F.lit(None).cast("long").alias("chunk_seq")).unionByName(
        starts.select("source_id", "seq", "piece", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("text"),
                      F.lit(1).cast("long").alias("_start"), zero.alias("_size"), "chunk_seq"))
    order = ["seq", "piece", "_kind"]
    placed = running_sum(marks, ["source_id"], order, {"_nth": F.col("_start"), "_upto": F.col("_size")})
    at = placed.filter("_kind = 0").select("source_id", "_nth", "chunk_seq", F.col("_upto").alias("_base"))
    own = placed.filter("_kind = 1").select("source_id", "_nth", "seq", "piece", F.col("text").alias("_piece"), "_upto", "_size").join(
        at, ["source_id", "_nth"], "left")
    room = own.groupBy("source_id", "chunk_seq").agg((F.sum("_size") - 1).alias("_room"))
    whole = _after(starts.select("source_id", "chunk_seq", "text", "_times"), "text").join(room, ["source_id", "chunk_seq"], "left")
    told = own.join(whole.select("source_id", "chunk_seq", "text", "_room"), ["source_id", "chunk_seq"], "left")
    first = F.length("text") - F.col("_room") + (F.col("_upto") - F.col("_size") - F.col("_base")) + 1
    there = F.coalesce((first > 0) & (F.substr("text", F.greatest(first, F.lit(1)).cast("int"), F.length("_piece")) == F.col("_piece")), F.lit(False))
    has = F.coalesce(F.col("text").contains(F.col("_piece")), F.lit(False))
    none = F.lit(-1).cast("long")
    counted = told.groupBy(F.coalesce("chunk_seq", none).alias("chunk_seq"), "source_id").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.count_if(~has).alias("lost"), F.count_if(~there).alias("_off"))
    # the tail is what stands before the pieces; without all pieces it cannot be told
    head = F.col("text").substr(F.lit(1), F.greatest(F.length("text") - F.coalesce("_room", F.lit(-1)) - 1, F.lit(0)).cast("int"))
    foreign = ~F.endswith(F.coalesce("_prev_text", F.lit("")), head)
    rows = whole.select("source_id", "chunk_seq", "_times", foreign.alias("_foreign")).join(counted, ["source_id", "chunk_seq"], "full")
    lost = F.coalesce("lost", F.lit(0))
    return rows.select(
        "source_id", "chunk_seq", F.coalesce("n_pieces", F.lit(0)).alias("n_pieces"), lost.alias("lost"),
        F.when(lost == 0, F.coalesce("_off", F.lit(0))).otherwise(0).alias("disordered"),
        (F.coalesce(F.col("_times") > 1, F.lit(False)) | (F.coalesce("_foreign", F.lit(False)) & (lost == 0))).alias("repeated"))


def _shared_end(before: str, text: str) -> int:
    """Length of the longest end of ``before`` that is a beginning of ``text``."""
    end = before[max(len(before) - len(text), 0):]
    at = end.find(text[:2])
    while at >= 0 and not text.startswith(end[at:]):
        at = end.find(text[:2], at + 1)
    return len(end) - at if at >= 0 else int(end.endswith(text[:1]))


class _Copies:
    """All rows of one chunk: its first place, its smallest text, and its distinct rows with their counts."""

    def __init__(self):
        self.seq: list[int] = []
        self.piece: list[int] = []
        self.rows: Counter[tuple] = Counter()

    def add(self, seq: int | None, piece: int | None, *row) -> None:
        for held, x in ((self.seq, seq), (self.piece, piece)):
            if x is not None:
                held[:] = [min([x, *held])]
        self.rows[row] += 1

    @cached_property
    def text(self) -> str | None:
        return min((r[0] for r in self.rows if r[0] is not None), default=None)

    def against(self, before: _Copies) -> tuple[int, int, int]:
        """Pairs of a row and one of the chunk before it: those that share characters, these, late starts."""
        sharing = chars = late = 0
        for (text, start, end, *_), n in self.rows.items():
            for (old, old_start, *_), m in before.rows.items():
                shared = 0 if text is None or old is None else _shared_end(old, text)
                sharing, chars = sharing + n * m * (shared > 0), chars + n * m * shared
                late += n * m * (None not in (start, end, old_start) and start <= old_start and end > 0)
        return sharing, chars, late

    def counts(self) -> tuple:
        """Rows, most and fewest tokens, rows over the limit, with bad times, blank."""
        tokens = [r[3] for r in self.rows if r[3] is not None]
        times = lambda test: sum(n for r, n in self.rows.items() if test(r))
        return (self.rows.total(), max(tokens, default=None), min(tokens, default=None), times(lambda r: r[3] is not None and r[3] > MAX_TOKENS),
                times(lambda r: None not in r[1:3] and r[1] > r[2]), times(lambda r: r[4]))


def _reconcile(sid: int, kept: dict[int, _Copies], pieces: list[tuple[int, int, str]]) -> list[tuple]:
    """Rows of ``LEDGER_SCHEMA`` of one source."""
    starts = sorted((*c.seq, *c.piece, n) for n, c in kept.items() if c.seq and c.piece)
    own: dict[int, list[str]] = {n: [] for n in kept}
    nth = 0
    for seq, i, text in pieces:
        while nth < len(starts) and starts[nth][:2] <= (seq, i):
            nth += 1
        own.setdefault(starts[nth - 1][2] if nth else -1, []).append(text)
    rows = []
    for n, texts in own.items():
        if n not in kept:
            rows.append((sid, n, len(texts), len(texts), 0, False, 0, None, None, 0, 0, 0, 0, 0, 0))
            continue
        c, before, joined = kept[n], kept.get(n - 1), " ".join(texts)
        lost = off = 0
        if c.text is None or not c.text.endswith(joined):
            lost, at = sum(c.text is None or x not in c.text for x in texts), len(c.text or "") - len(joined)
            for x in texts if not lost else ():
                off += at < 0 or not c.text.startswith(x, at)
                at += len(x) + 1
        # the tail is what stands before the pieces; without all pieces it cannot be told
        head = (c.text or "")[:max(len(c.text or "") - len(joined) - bool(texts), 0)]
        foreign = not lost and not (before and before.text or "").endswith(head)
        rows.append((sid, n, len(texts), lost, off, c.rows.total() > 1 or foreign, *c.counts(), *(c.against(before) if before else (0, 0, 0))))
    return rows


def _reconcile_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reconcile source after source of rows that arrive sorted by (source, chunks before segments, seq)."""
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * len(LEDGER_TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, LEDGER_TYPES)], _names(LEDGER_SCHEMA))

    sid, kept, pieces = None, {}, []
    for b in batches:
        out: list[tuple] = []
        for source, n, seq, parts, *row in zip(*(c.to_pylist() for c in b.columns)):
            if source != sid:
                out += _reconcile(sid, kept, pieces)
                sid, kept, pieces = source, {}, []
            if n is not None:
                kept.setdefault(n, _Copies()).add(seq, *row)
            else:
                pieces += [(seq, i, x) for i, x in enumerate(parts or ())]
        yield batch(out)
    yield batch(_reconcile(sid, kept, pieces))


def _reconciled(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of ``LEDGER_SCHEMA``; every segment and every chunk is shuffled once, to its source."""
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    given = lambda c, kind: (F.col(c) if c in chunks.columns else F.lit(None)).cast(kind).alias(c)
    long = lambda c: F.col(c).cast("long")
    rows = chunks.select(
        long("source_id").alias("source_id"), long("chunk_seq").alias("chunk_seq"), long("first_seq").alias("seq"), long("first_piece").alias("piece"),
        "text", given("start_sec", "double"), given("end_sec", "double"), given("n_tokens", "long"),
    ).filter(F.col("chunk_seq").isNotNull()).unionByName(segments.select(
        long("source_id").alias("source_id"), *none("long", "chunk_seq"), long("seq").alias("seq"), *none("long", "piece"),
        "text", *none("double", "start_sec", "end_sec"), *none("long", "n_tokens")))
    placed = rows.repartition("source_id").sortWithinPartitions("source_id", F.col("chunk_seq").isNull(), "seq")
    # pieces are cut behind the shuffle, so that their text travels once
    whole = F.col("chunk_seq").isNotNull()
    return placed.select(
        "source_id", "chunk_seq", "seq", F.when(~whole, _parts()).alias("parts"), "piece", F.when(whole, F.col("text")).alias("text"),
        "start_sec", "end_sec", "n_tokens", (whole & ~T.non_blank("text")).alias("blank"),
    ).mapInArrow(_reconcile_sorted, LEDGER_SCHEMA)


def _long_sources(segments: DataFrame, width: int) -> DataFrame | None:
    """Ids of the sources that are longer than one block, None when there are none."""
    if (segments.agg(F.max(F.col("seq").cast("long"))).first()[0] or 0) < width:
        return None
    ids = segments.filter(F.col("seq") >= width).select("source_id").distinct()
    return small_side(ids, at_most(ids, NARROW_ROWS))


def chunk_ledger(segments: DataFrame, chunks: DataFrame, width: int = BLOCK) -> DataFrame:
    """Reconcile chunks with the segments they were made of, piece by piece.

    (source_id, chunk_seq, n_pieces, lost, disordered, repeated): a chunk owns the pieces from
    its first new one to that of the next chunk. Behind the tail that it repeats they must
    stand one after the other. ``lost`` pieces are not in their chunk at all; ``disordered``
    ones are, though not at their place; ``repeated`` tells that the text before them is not the
    end of the chunk before, or that the chunk is there more than once. Pieces before any
    chunk, or of a source without chunks, are lost under chunk_seq -1.

    Sources of less than ``width`` segments are reconciled where one shuffle brings their
    segments and chunks together, longer ones in blocks.
    """
    columns = ["source_id", "chunk_seq", "n_pieces", "lost", "disordered", "repeated"]
    ids = _long_sources(segments, width)
    if ids is None:
        return _reconciled(segments, chunks).select(*columns)
    far = [d.join(ids, "source_id", "left_semi") for d in (segments, chunks)]
    near = [d.join(ids, "source_id", "left_anti") for d in (segments, chunks)]
    return _reconciled(*near).select(*columns).unionByName(_ledger_in_blocks(*far).select(*columns))


def _audited_in_blocks(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows with the columns of ``LEDGER_SCHEMA``, null where a row does not tell, of sources of any length."""
    one = lambda test: test.cast("long")
    overlap = chunk_overlap(chunks).select("source_id", one(F.col("overlap") > 0).alias("overlapping"), F.col("overlap").alias("overlap_chars"))
    late = _after(chunks.select("source_id", "chunk_seq", "start_sec", "end_sec"), "start_sec").select(
        "source_id", one((F.col("start_sec") <= F.col("_prev_start_sec")) & (F.col("end_sec") > 0)).alias("late_starts"))
    rows = chunks.select(
        "source_id", F.lit(1).cast("long").alias("n_rows"), F.col("n_tokens").alias("max_tokens"), F.col("n_tokens").alias("min_tokens"),
        one(F.col("n_tokens") > MAX_TOKENS).alias("over_limit"), one(F.col("start_sec") > F.col("end_sec")).alias("bad_times"),
        one(~T.non_blank("text")).alias("blank_chunks"))
    out = _ledger_in_blocks(segments, chunks)
    for d in (overlap, late, rows):
        out = out.unionByName(d, allowMissingColumns=True)
    return out.select(*_names(LEDGER_SCHEMA))


def chunk_audit(segments: DataFrame, chunks: DataFrame, width: int = BLOCK) -> DataFrame:
    """One row: counts, size limits, blanks and times of all chunks, and what the ledger, the
    overlaps and the order say.

    ``lost`` and ``disordered`` count pieces, ``repeated`` chunks, ``late_starts`` chunks that do not
    start after the one before them (untimed sources aside), ``overlap_chars`` shared characters.
    Chunks are read once, unless a source is longer than ``width`` segments: then they are written
    to the shared folder first.
    """
    ids = _long_sources(segments, width)
    if ids is None:
        rows = _reconciled(segments, chunks)
    else:
        chunks = stored(chunks, "chunks")
        far = [d.join(ids, "source_id", "left_semi") for d in (segments, chunks)]
        near = [d.join(ids, "source_id", "left_anti") for d in (segments, chunks)]
        rows = _reconciled(*near).unionByName(_audited_in_blocks(*far))
    total = lambda c, name=None: F.coalesce(F.sum(c), F.lit(0)).alias(name or c)
    return rows.agg(
        total("n_rows", "n_chunks"), F.count_distinct(F.when(F.col("n_rows") > 0, F.col("source_id"))).alias("n_sources"),
        F.max("max_tokens").alias("max_tokens"), F.min("min_tokens").alias("min_tokens"),
        *[total(c) for c in ("over_limit", "bad_times", "blank_chunks", "n_pieces", "lost", "disordered")], F.count_if("repeated").alias("repeated"),
        *[total(c) for c in ("overlapping", "overlap_chars", "late_starts")])
