"""Rate admission over seconds: which rows of a key are let in, and how many came before.

A row is let in while fewer than ``limit`` rows of its key were let in less than ``span``
seconds ago, so every admission depends on the ones before it. What depends is little, though:
the state is at most ``limit`` admissions, and a full state can be skipped to the second in
which its oldest admission ends. The work is therefore cut three times:

1. the seconds of a key are packed into blocks, many tasks at a time;
2. blocks without an idle ``span`` between them form a stretch (the state is empty elsewhere). A
   stretch is walked block by block to find the state in which each block is entered. One step
   is one admission or one skip, at most ``2 * limit`` for every ``span`` seconds, however many
   rows or seconds there are; only packed blocks are read, and only states are returned;
3. every block then judges its own seconds from its entry state, many tasks at a time.

A block cannot be tabulated for all its entry states, as a chunk packer's can: there are as many
as ways to spread ``limit`` admissions over ``span`` seconds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 32_768  # seconds in a block
STATE = pa.list_(pa.struct([("sec", pa.int64()), ("n", pa.int64())]))


def same(left: str, right: str, names: Sequence[str]) -> list[Column]:
    """Join condition on columns of two aliased tables; missing values equal each other."""
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names]


def second_blocks(per_sec: DataFrame, keys: Sequence[str], limit: int, width: int = WIDTH) -> DataFrame:
    """(keys, _blk, _secs): the seconds of a block in order with their rows, ``limit`` at most.

    A block has at most ``width`` seconds, which bounds its list.
    """
    pair = F.struct(F.col("_sec").alias("sec"), F.least("_n", F.lit(limit)).alias("n"))
    return per_sec.groupBy(*keys, F.floor(F.col("_sec") / width).cast("long").alias("_blk")).agg(
        F.sort_array(F.collect_list(pair)).alias("_secs"))


def stretches(per_sec: DataFrame, keys: Sequence[str], span: int, width: int = WIDTH) -> DataFrame:
    """(keys, _blk, _stretch): blocks without ``span`` idle seconds between them share a stretch.

    Two numbers a block are looked at: the window has a row per block of time, not per second.
    """
    ends = per_sec.groupBy(*keys, F.floor(F.col("_sec") / width).cast("long").alias("_blk")).agg(
        F.min("_sec").alias("_first"), F.max("_sec").alias("_last"))
    order = W.partitionBy(*keys).orderBy("_blk")
    cut = F.coalesce(F.col("_first") - F.lag("_last").over(order) >= span, F.lit(True))
    return ends.withColumn("_cut", cut.cast("long")).select(*keys, "_blk", F.sum("_cut").over(order).alias("_stretch"))


def walk(secs: list[int], rows: list[int], held: deque, limit: int, span: int) -> list[tuple[int, int]]:
    """Admissions (second, rows) of one block; ``held`` is the state before it and after it."""
    out, i, total = [], 0, sum(n for _, n in held)
    while i < len(secs):
        now = secs[i]
        while held and held[0][0] <= now - span:
            total -= held.popleft()[1]
        if total < limit:
            n = min(rows[i], limit - total)
            held.append((now, n))
            out.append((now, n))
            total += n
            i += 1
        else:
            i = bisect_left(secs, held[0][0] + span, i + 1)
    return out


def _plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seconds and rows of all lists one after the other, and where each list begins."""
    pairs = column.flatten()
    at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
    return at, pairs.field(0).to_numpy(zero_copy_only=False), pairs.field(1).to_numpy(zero_copy_only=False).astype(np.int64)


def _entries(batches: Iterator[pa.RecordBatch], keys: int, limit: int, span: int) -> Iterator[pa.RecordBatch]:
    """State before every block; blocks arrive sorted by (keys, stretch, block)."""
    stretch, held = None, deque()
    for b in batches:
        names, states, upto = b.schema.names, [], [0]
        which = [c.to_pylist() for c in b.columns[:keys]] + [b.column("_stretch").to_pylist()]
        at, secs, rows = _plain(b.column("_secs"))
        for row, now in enumerate(zip(*which)):
            if now != stretch:
                stretch, held = now, deque()
            states += held
            upto.append(len(states))
            here = slice(at[row], at[row + 1])
            walk(secs[here].tolist(), rows[here].tolist(), held, limit, span)
        pairs = np.array(states, dtype=np.int64).reshape(-1, 2)
        state = pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], fields=list(STATE.value_type))
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:keys], b.column("_blk"), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), state)], [*names[:keys], "_blk", "_held"])


def _judge(batches: Iterator[pa.RecordBatch], keys: int, limit: int, span: int) -> Iterator[pa.RecordBatch]:
    """Every second of a block with the rows let in before it and in it.

    Blocks of one or two seconds are the rule where keys are many, so blocks are counted
    together, up to ``WIDTH`` seconds at a time (a longer block alone).
    """
    for b in batches:
        at, secs, rows = _plain(b.column("_secs"))
        held_at, held_secs, held_rows = _plain(b.column("_held"))
        lo = 0
        while lo < b.num_rows:
            hi = max(int(np.searchsorted(at, at[lo] + WIDTH, side="right")) - 1, lo + 1)
            let, sizes = [], []
            for row in range(lo, hi):
                own, old = slice(at[row], at[row + 1]), slice(held_at[row], held_at[row + 1])
                held = list(zip(held_secs[old].tolist(), held_rows[old].tolist()))
                new = walk(secs[own].tolist(), rows[own].tolist(), deque(held), limit, span)
                let += held
                let += new
                sizes.append(len(held) + len(new))
            when, many = np.array(let, dtype=np.int64).reshape(-1, 2).T
            s, upto = secs[at[lo] : at[hi]], np.concatenate([[0], np.cumsum(many)])
            # a stretch of numbers for every block, so that one search serves all of them
            first = min(int(s.min()), int(when.min())) - span
            width = max(int(s.max()), int(when.max())) - first + 1
            block = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
            when = when - first + width * np.repeat(np.arange(hi - lo), sizes)
            place = s - first + width * block
            left, right = np.searchsorted(when, place), np.searchsorted(when, place, side="right")
            before = upto[left] - upto[np.searchsorted(when, place - span, side="right")]
            each = pa.array(block + lo)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(each) for c in b.columns[:keys]), pa.array(s), pa.array(before), pa.array(upto[right] - upto[left])],
                [*b.schema.names[:keys], "_sec", "_before", "_admit"])
            lo = hi


def admitted_seconds(per_sec: DataFrame, keys: Sequence[str], limit: int, span: int, width: int = WIDTH) -> DataFrame:
    """(keys, _sec, _before, _admit) for (keys, _sec, _n): rows let in less than ``span`` seconds
    before a second, and rows of that second let in."""
    keys, k = list(keys), len(keys)
    given = "".join(f"{c} {per_sec.schema[c].dataType.simpleString()}, " for c in keys)
    blocks = second_blocks(per_sec, keys, limit, width)
    cuts = stretches(per_sec, keys, span, width)
    named = blocks.alias("b").join(cuts.alias("c"), same("b", "c", [*keys, "_blk"])).select(
        *[F.col(f"b.{c}").alias(c) for c in keys], F.col("c._stretch").alias("_stretch"), F.col("b._blk").alias("_blk"), F.col("b._secs").alias("_secs"))
    placed = named.repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", "_blk")
    entered = placed.mapInArrow(lambda x: _entries(x, k, limit, span), f"{given}_blk bigint, _held array<struct<sec:bigint,n:bigint>>")
    met = blocks.alias("b").join(entered.alias("e"), same("b", "e", [*keys, "_blk"])).select(
        *[F.col(f"b.{c}").alias(c) for c in keys], F.col("b._secs").alias("_secs"), F.col("e._held").alias("_held"))
    return met.mapInArrow(lambda x: _judge(x, k, limit, span), f"{given}_sec bigint, _before bigint, _admit bigint")
