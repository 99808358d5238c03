"""Running computations over ordered groups of any size.

A plain window partitioned by a key runs each key in one task. Here every key is cut
into blocks of ``width`` consecutive sequence values, so a block holds a bounded number
of rows however hot its key is. Block totals are pre-aggregated (map side first), the
small table of totals gets the running window, and the rows only need a window inside
their own block. The sequence column must be a number that is unique within its key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 65_536
TILE_BYTES = 512 * 1024


def _blocked(df: DataFrame, order: Sequence[str], block: Column | None, width: int) -> DataFrame:
    if block is None:
        block = F.floor(F.col(order[0]) / F.lit(width)).cast("long")
    return df.withColumn("_blk", block)


def time_block(secs: str, span: float = 600.0) -> Column:
    """Block id for rows ordered by a start time: ten-minute stretches of one medium.

    Untimed chunks (start 0) of one source come from one text cell, which bounds them.
    """
    return F.floor(F.coalesce(F.col(secs), F.lit(0.0)) / F.lit(span)).cast("long")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    values: dict[str, Column],
    include_current: bool = True,
    width: int = WIDTH,
    block: Column | None = None,
) -> DataFrame:
    """Add one running total per entry of ``values`` (name -> expression).

    ``block`` must be non-decreasing along ``order``; by default it is the first order
    column divided by ``width``.
    """
    keys, order = list(keys), [order] if isinstance(order, str) else list(order)
    base = _blocked(df, order, block, width)
    tmp = {f"_v{i}": (n, e) for i, (n, e) in enumerate(values.items())}
    base = base.select("*", *[e.alias(t) for t, (_, e) in tmp.items()])
    totals = base.groupBy(*keys, "_blk").agg(*[F.sum(t).alias(t) for t in tmp])
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_blk").alias("_kb"),
        *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"{t}_off") for t in tmp],
    )
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_blk") == F.col("_kb")]
    inner = W.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(
        W.unboundedPreceding, 0 if include_current else -1
    )
    out = base.join(offsets, cond, "inner")
    for t, (name, _) in tmp.items():
        out = out.withColumn(
            name, F.col(f"{t}_off") + F.coalesce(F.sum(t).over(inner), F.lit(0))
        )
    return out.drop("_blk", "_kb", *tmp, *[f"{t}_off" for t in tmp], *[f"_k_{k}" for k in keys])


def row_index(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], name: str = "idx",
    width: int = WIDTH, block: Column | None = None,
) -> DataFrame:
    """Dense 0-based position of each row within its key."""
    one = {name: F.lit(1).cast("long")}
    return running_sum(df, keys, order, one, include_current=False, width=width, block=block)


def lag_pair(
    df: DataFrame, keys: Sequence[str], seq: str, value: str, width: int = WIDTH
) -> DataFrame:
    """Add ``prev1`` and ``prev2``: the value one and two rows earlier in the same key.

    Only the last two values of each block travel to the next blocks. Every block that
    exists holds at least one row, so two block summaries are enough.
    """
    keys = list(keys)
    base = _blocked(df, [seq], None, width)
    pair = F.struct(F.col(seq).alias("s"), F.col(value).alias("v"))
    last = base.groupBy(*keys, "_blk").agg(
        F.max_by(pair, F.col(seq)).alias("last"), F.count(F.lit(1)).alias("n")
    )
    second = (
        base.join(
            last.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_blk").alias("_kb"), "last"),
            [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_blk") == F.col("_kb")],
        )
        .filter(F.col(seq) < F.col("last.s"))
        .groupBy(*keys, "_blk")
        .agg(F.max_by(pair, F.col(seq)).alias("second"))
    )
    tails = last.join(second, keys + ["_blk"], "left") if keys else last.join(second, "_blk", "left")
    order = W.partitionBy(*keys).orderBy("_blk")
    tails = tails.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_blk").alias("_kb"),
        F.lag("last").over(order).alias("_t1"),
        F.coalesce(F.lag("second").over(order), F.lag("last", 2).over(order)).alias("_t2"),
    )
    inner = W.partitionBy(*keys, "_blk").orderBy(seq)
    out = base.join(
        tails, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_blk") == F.col("_kb")]
    )
    rn = F.row_number().over(inner)
    out = out.withColumn("_rn", rn).withColumn(
        "prev1", F.when(F.col("_rn") == 1, F.col("_t1.v")).otherwise(F.lag(value, 1).over(inner))
    ).withColumn(
        "prev2",
        F.when(F.col("_rn") == 1, F.col("_t2.v"))
        .when(F.col("_rn") == 2, F.col("_t1.v"))
        .otherwise(F.lag(value, 2).over(inner)),
    )
    return out.drop("_blk", "_rn", "_t1", "_t2", "_kb", *[f"_k_{k}" for k in keys])


def best_k(values: np.ndarray, ids: np.ndarray, k: int, keep: np.ndarray | None = None) -> np.ndarray:
    """Positions of the ``k`` smallest values, ties by id; used inside tasks."""
    sel = np.arange(values.size) if keep is None else np.flatnonzero(keep)
    if sel.size > k:
        cut = np.partition(values[sel], k - 1)[k - 1]
        sel = sel[values[sel] <= cut]
        sel = sel[np.lexsort((ids[sel], values[sel]))][:k]
    return sel


def text_tiles(texts: pa.Array, rows: int, size: int = TILE_BYTES) -> Iterator[pa.Array]:
    """Slices of at most ``rows`` texts and ``size`` bytes; a longer text is one of its own."""
    upto = np.concatenate([[0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(upto, upto[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, len(texts))
        yield texts.slice(lo, hi - lo)
        lo = hi


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rn"
) -> DataFrame:
    """First ``k`` rows per key with their 1-based rank.

    The bare ``row_number() <= k`` filter lets Spark keep only ``k`` rows per key and
    task before the shuffle, so a hot key never travels whole.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
