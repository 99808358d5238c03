"""Shards by jump consistent hashing.

The key alone decides the shard: a linear congruential sequence seeded by the key jumps
ahead through the shard numbers, and the last number below the shard count is the shard.
With one more shard a row stays where it is or moves into the new one.

Defined results: a null doc_id hashes as 0, a null text has size 1 and checksum 0, repeated
rows get slots of their own; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.llm.common import staged, utf8_bytes

# Multiplier of the published algorithm, and the two powers of two it divides by.
MULTIPLIER = "2862933555777941757"
TWO_64 = "18446744073709551616"
TWO_31 = float(2**31)
TWO_33 = "8589934592"
SHARDS = 16
# Slots are counted in this many slices of a shard, so that no task counts a whole shard.
SLICES = 4096
# A part of a slice has the texts of an id whose checksums agree above these bits.
PART_BITS = 20
BLOCK = 4096  # equal rows that one task writes out together


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a whole-number key, 0 to ``shards - 1``.

    Every jump goes ahead by one shard at least, so ``shards`` steps are enough; after the
    last jump the state no longer changes. Unsigned 64-bit arithmetic is done in decimals.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    whole = "decimal(20,0)"
    seed = F.pmod(F.coalesce(key, F.lit(0)).cast("decimal(38,0)"), F.expr(f"{TWO_64}BD")).cast(whole)

    def step(at: Column, _: Column) -> Column:
        state = F.pmod(
            at["state"] * F.expr(f"{MULTIPLIER}BD") + F.expr("1BD"), F.expr(f"{TWO_64}BD")).cast(whole)
        top = F.floor(state.cast("decimal(30,0)") / F.expr(f"{TWO_33}BD")).cast("double")
        ahead = F.floor((at["next"] + 1).cast("double") * (F.lit(TWO_31) / (top + 1.0))).cast("long")
        moved = F.transform(F.array(F.struct(state.alias("state"))), lambda s: F.struct(
            s["state"].alias("state"), at["next"].alias("shard"), ahead.alias("next")))
        return F.when(at["next"] >= shards, at).otherwise(F.element_at(moved, 1))

    start = F.struct(seed.alias("state"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)["shard"].cast("int")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    ``size`` is the UTF-8 bytes of the text plus 1. ``slot`` numbers the rows of a shard from
    0 without gaps: by slice of the document's checksum, then doc_id, then text checksum.
    Equal rows are counted, and the counts accumulate in three steps: slices of a shard, parts
    of a slice (an id and the upper bits of the text checksum), rows of a part. So no task
    gets all rows of an id, and equal rows are written out again in blocks.
    """
    payload = utf8_bytes("text")
    rows = docs.select(
        "doc_id", (F.octet_length(payload) + F.lit(1)).cast("long").alias("size"),
        F.crc32(payload).alias("text_crc32"), jump_hash(F.col("doc_id"), shards).alias("shard"),
        jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
        F.substring(F.md5(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string").cast("binary")), 1, 3).alias("slice"))
    equal = staged(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn(
        "part", F.shiftright("text_crc32", PART_BITS)), "equal")

    def offsets(counts: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
        before = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return counts.withColumn(name, F.coalesce(F.sum("n").over(before), F.lit(0)))

    parts = equal.groupBy("shard", "slice", "doc_id", "part").agg(F.sum("n").alias("n"))
    slices = offsets(parts.groupBy("shard", "slice").agg(F.sum("n").alias("n")), ["shard"], ["slice"], "of_slice")
    parts = offsets(parts, ["shard", "slice"], ["doc_id", "part"], "of_part").drop("n").join(slices.drop("n"), ["shard", "slice"])
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in ("shard", "slice", "doc_id", "part")], (F.col("of_slice") + F.col("of_part")).alias("offset"))
    placed = offsets(equal, ["shard", "slice", "doc_id", "part"], ["text_crc32", "size"], "of_row").join(parts, (
        F.col("shard") == F.col("_shard")) & (F.col("slice") == F.col("_slice")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("part") == F.col("_part")))
    blocks = placed.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))))
    each = blocks.repartition("shard", "slice", "doc_id", "text_crc32", "from").withColumn(
        "at", F.explode(F.sequence("from", F.least(F.col("from") + BLOCK, F.col("n")) - 1)))
    return each.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("of_row") + F.col("at")).alias("slot"), "grown_shard")
