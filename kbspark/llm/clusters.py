"""Centroid clustering: Lloyd's rounds over column blocks of the vectors.

Vectors are scaled to integers and cut twice: rows into chunks of bounded size, dimensions into
blocks. A task that holds some chunks of one block needs only the slice of the centroids that
belongs to it and gives exact partial distances. These are added per chunk over the blocks, and
the smallest sum names the cluster. Each block then adds up its own dimensions per cluster, and
gets its own next slice; no task ever has whole vectors or whole centroids.

All arithmetic is on integers, so results do not depend on partitions or on the order of work.
Chunks, assignments and slices are written to the shared folder, so rounds share no lineage.

Defined results: vectors with another number of components, or with a missing or non-finite
one, are left out; scaled components beyond 2^27 in size count as that, which keeps every
distance within a long; a null vec_id is hashed as an empty one; vectors with one vec_id are
vectors of their own (the first centroids take them by id, then by their components); fewer
vectors than clusters give as many centroids as there are vectors; an inertia beyond a long is
null; no vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.llm.common import new_path, staged

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
WIDTH = 16  # dimensions in a block
ROWS = 256  # vectors in a chunk
LARGEST = 1 << 27


def shrunk(values: np.ndarray) -> bytes:
    """Integers as bytes of the narrowest signed type that holds them all."""
    least, most = int(values.min(initial=0)), int(values.max(initial=0))
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
    return values.astype(kind).tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    """``n`` integers written by :func:`shrunk`."""
    return np.frombuffer(data, dtype=f"i{len(data) // max(n, 1)}" if n else "i8").astype(np.int64)


def kept(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, x): vectors of ``dim`` finite components, as doubles."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter((F.size("embedding") == dim) & finite).select("vec_id", x.alias("x"))


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -LARGEST, LARGEST).astype(np.int64)


def column_blocks(vectors: DataFrame, dim: int, scale: int, width: int, rows: int) -> DataFrame:
    """(chunk, block, n, data, ids): every chunk once a block, its ids with block -1."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    names = ["chunk", "block", "n", "data", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                n = part.num_rows
                q = scaled(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dim), scale)
                data = [None] + [shrunk(q[:, at : at + width]) for at in range(0, dim, width)]
                ids = part.column(0)
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk] * len(data), pa.int64()), pa.array(range(-1, len(data) - 1), pa.int32()),
                    pa.array([n] * len(data), pa.int64()), pa.array(data, pa.binary()),
                    pa.array([ids.to_pylist()] + [None] * (len(data) - 1), pa.list_(ids.type))], names)
                chunk += 1

    return vectors.mapInArrow(cut, f"chunk bigint, block int, n bigint, data binary, ids array<{kind}>")


def first_centroids(vectors: DataFrame, k: int, scale: int, width: int, seed: int) -> DataFrame:
    """(block, cluster, dim, value) of the ``k`` vectors whose ids have the smallest digests."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(key.alias("_key"), "x").orderBy("_key", "x").limit(k)
    top = first.agg(F.sort_array(F.collect_list(F.struct("_key", "x"))).alias("c"))  # k rows
    flat = top.select(F.posexplode("c").alias("cluster", "_c")).select("cluster", F.posexplode("_c.x").alias("i", "v"))
    limit = float(LARGEST)
    value = F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), F.lit(float(scale)) * F.col("v"))))
    return flat.select((F.col("i") / width).cast("int").alias("block"), "cluster", (F.col("i") % width).alias("dim"),
                       value.cast("long").alias("value"))


def slices(cells: DataFrame) -> DataFrame:
    """(block, centres): one row a block, with its dimensions of every centroid."""
    one = cells.groupBy("block", "cluster").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("c"))
    return one.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("cluster", F.col("c.value").alias("v")))).alias("c")).select(
        "block", F.col("c.v").alias("centres"))


def partial_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Squared distances within one block: n x k numbers for every (chunk, n, data, centres)."""
    for batch in batches:
        chunks, sizes, out = batch.column("chunk"), batch.column("n").to_pylist(), []
        for i, n in enumerate(sizes):
            c = np.array(batch.column("centres")[i].as_py(), dtype=np.int64)
            data = batch.column("data")[i].as_py()
            x = widened(data, n * c.shape[1]).reshape(n, -1)
            # Doubles are exact, and faster, as long as no sum can reach 2^53.
            most = max(int(abs(v)) for v in (x.min(initial=0), x.max(initial=0), c.min(), c.max()))
            kind = np.float64 if 4 * most * most * c.shape[1] < 1 << 53 else np.int64
            xf, cf = x.astype(kind), c.astype(kind)
            d = (xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)[None, :]
            out.append(shrunk(d.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([chunks, batch.column("n"), pa.array(out, pa.binary())], ["chunk", "n", "part"])


def adder(k: int):
    """Adds the partial distances of a chunk over its blocks and takes the nearest cluster."""

    def add(table: pa.Table) -> pa.Table:
        n, total = table.column("n")[0].as_py(), 0
        for part in table.column("part"):
            total = total + widened(part.as_py(), n * k).reshape(n, k)
        near = total.argmin(axis=1)  # the first of equal ones
        least = total[np.arange(n), near]
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "nearest": pa.array([shrunk(near)], pa.binary()),
                         "distances": pa.array([shrunk(least)], pa.binary())})

    return add


def assign(blocks: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """(chunk, nearest, distances) with a number for every vector of the chunk."""
    parts = blocks.filter("block >= 0").select("chunk", "block", "n", "data").join(slices(cells), "block").mapInArrow(
        partial_distances, "chunk bigint, n bigint, part binary")
    return parts.groupBy("chunk").applyInArrow(adder(k), "chunk bigint, nearest binary, distances binary")


def adding(k: int, width: int):
    names = ["block", "cluster", "dim", "s", "n"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums per block, cluster and dimension over all chunks of a task."""
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n, data, nearest in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "data", "nearest"))):
                near = widened(nearest, n)
                x = widened(data, n * width(block)).reshape(n, -1)
                if block not in sums:
                    sums[block], counts[block] = np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)
                np.add.at(sums[block], near, x)
                counts[block] += np.bincount(near, minlength=k)
        for block, s in sums.items():
            d = s.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(k * d, block), pa.int32()), pa.array(np.repeat(np.arange(k), d), pa.int32()),
                pa.array(np.tile(np.arange(d), k), pa.int32()), pa.array(s.ravel()), pa.array(np.repeat(counts[block], d))], names)

    return add


def update(blocks: DataFrame, assigned: DataFrame, cells: DataFrame, k: int, dim: int, width: int) -> DataFrame:
    """The next centroids: exact floored means, and the old value where a cluster is empty."""
    size = lambda block: min(width, dim - block * width)
    new = blocks.filter("block >= 0").select("chunk", "block", "n", "data").join(
        assigned.select("chunk", "nearest"), "chunk").select("block", "n", "data", "nearest").mapInArrow(
        adding(k, size), "block int, cluster int, dim int, s bigint, n bigint").groupBy("block", "cluster", "dim").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")).filter("n > 0")
    floor = F.expr("(s - pmod(s, n)) div n")
    at = ["block", "cluster", "dim"]
    return cells.join(new.select(*at, floor.alias("_new")), at, "left").select(*at, F.coalesce("_new", "value").alias("value"))


def members(blocks: DataFrame, assigned: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    ids = blocks.filter("block = -1").select("chunk", "n", "ids")
    kind = ids.schema["ids"].dataType.elementType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n in enumerate(batch.column("n").to_pylist()):
                near, far = (widened(batch.column(c)[i].as_py(), n) for c in ("nearest", "distances"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, pa.array(near, pa.int32()), pa.array(far)], ["vec_id", "cluster", "distance"])

    return ids.join(assigned, "chunk").select("n", "ids", "nearest", "distances").mapInArrow(
        spread, f"vec_id {kind}, cluster int, distance bigint")


def digest(cells: DataFrame, width: int) -> DataFrame:
    """(cluster, centroid_sha256) over all dimensions of each centroid, in decimal."""
    place = (F.col("block") * width + F.col("dim")).alias("i")
    rows = cells.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct(place, F.col("value").cast("string").alias("v")))).alias("c"))
    return rows.select("cluster", F.sha2(F.array_join(F.col("c.v"), ","), 256).alias("centroid_sha256"))


def lloyd(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, width: int = WIDTH,
          rows: int = ROWS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Members (vec_id, cluster, distance) and final centroids (block, cluster, dim, value)."""
    x = kept(vectors, dim)
    blocks = column_blocks(x, dim, scale, width, rows)
    path = new_path(x.sparkSession, "blocks")
    blocks.write.partitionBy("block").parquet(path)  # files of one block each
    blocks = x.sparkSession.read.schema(blocks.schema).parquet(path).select(*blocks.columns)
    cells = staged(first_centroids(x, k, scale, width, seed), "centroids")
    k = cells.select("cluster").distinct().count()
    for _ in range(rounds):
        assigned = staged(assign(blocks, cells, k), "assigned")
        cells = staged(update(blocks, assigned, cells, k, dim, width), "centroids")
    return members(blocks, assign(blocks, cells, k)), cells


def cluster(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector."""
    found, cells = lloyd(vectors, **options)
    found = staged(found, "members")
    # k rows at most
    own = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    own = own.withColumn("inertia", F.try_sum("cluster_inertia").over(W.partitionBy()))
    facts = own.join(digest(cells, options.get("width", WIDTH)), "cluster")
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
