"""Encoding, vector checks and exact nearest-neighbour search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from kbspark.operators.blocks import best_k, text_tiles, top_k
from kbspark.session import cut_lineage

# Default cut-off on L2 distance and default encoder width.
MAX_DISTANCE = 1.0
DIM = 512
BLOCK_ROWS = 16_384
TILE = 64
QUERY_BYTES = 128 * 1024 * 1024


def hash_trigram_vector(text: str | None, dim: int = DIM) -> np.ndarray:
    """Unit vector of square-rooted counts of hashed character trigrams."""
    codes = np.frombuffer((text or "").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    if codes.size < 3:
        return np.zeros(dim, dtype=np.float32)
    slots = (codes[:-2] * 961 + codes[1:-1] * 31 + codes[2:]) % dim
    v = np.sqrt(np.bincount(slots, minlength=dim).astype(np.float64))
    return (v / np.sqrt((v * v).sum())).astype(np.float32)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and where each text begins (null: empty)."""
    column = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]]
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    try:
        code = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        return code.astype(np.int64), np.searchsorted(first, at - at[0])
    except UnicodeDecodeError:  # broken bytes are read as far as they tell
        pass
    lead = raw[first].astype(np.int64)
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    code = np.where(size == 1, lead, lead & (0xFF >> (size + 1)))
    for k in (1, 2, 3):
        more = size > k
        code[more] = (code[more] << 6) | (raw[first[more] + k] & 0x3F)
    return code, np.searchsorted(first, at - at[0])


def hash_trigram_matrix(texts: pa.Array, dim: int = DIM, rows: int = 2048) -> Iterator[np.ndarray]:
    """:func:`hash_trigram_vector` of many texts, one matrix for every ``rows`` of them at most.

    The work arrays take some hundred bytes for every byte of text, so tiles are bounded by bytes.
    """
    for part in text_tiles(texts, rows):
        code, at = code_points(part)
        n, row = len(part), np.repeat(np.arange(len(part)), np.diff(at))
        if len(code) > 2:
            inside = row[2:] == row[:-2]
            slot = (code[:-2] * 961 + code[1:-1] * 31 + code[2:])[inside].astype(np.uint32) % np.uint32(dim)  # below 2^31
            v = np.sqrt(np.bincount(row[2:][inside] * dim + slot, minlength=n * dim).reshape(n, dim).astype(np.float64))
        else:
            v = np.zeros((n, dim))
        length = np.sqrt((v * v).sum(axis=1, keepdims=True))
        yield (v / np.where(length > 0, length, 1.0)).astype(np.float32)


def embed(df: DataFrame, text: str, out: str = "embedding", encoder: Callable[[str], np.ndarray] | None = None, dim: int = DIM) -> DataFrame:
    """Add a float vector of ``text``.

    By default hashed trigrams, whole batches at a time; ``encoder`` maps one string to one vector.
    """

    @F.arrow_udf(t.ArrayType(t.FloatType()))
    def encode(batch: pa.Array) -> pa.Array:
        flat, at = np.empty(len(batch) * dim, np.float32), 0
        for m in hash_trigram_matrix(batch, dim):
            flat[at : at + m.size] = m.ravel()
            at += m.size
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, dim), pa.int32()), pa.array(flat))

    @F.pandas_udf(t.ArrayType(t.FloatType()))
    def encode_each(batch: pd.Series) -> pd.Series:
        return batch.map(encoder)

    return df.withColumn(out, (encode if encoder is None else encode_each)(F.col(text)))


def embed_chunks(chunks: DataFrame, title: str = "title", text: str = "text", **kw) -> DataFrame:
    """Vectors of ``title`` newline ``text``: the stored text itself keeps no title."""
    joined = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.col(text))
    return embed(chunks.withColumn("_input", joined), "_input", **kw).drop("_input")


def vector_report(vectors: DataFrame, embedding: str = "embedding", model: str | None = None) -> DataFrame:
    """One row of store facts: rows, smallest and largest dimension, number of models."""
    models = F.count_distinct(model) if model else F.lit(1).cast("long")
    return vectors.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.min(F.size(embedding)).cast("long").alias("min_dim"),
        F.max(F.size(embedding)).cast("long").alias("max_dim"),
        models.alias("n_models"),
    )


def check_vectors(vectors: DataFrame, dim: int, embedding: str = "embedding", model: str | None = None,
                  expected_model: str | None = None) -> None:
    """Refuse a store whose vectors differ in dimension or model."""
    row = vector_report(vectors, embedding, model).first()
    if row["n_vectors"] and (row["min_dim"] != dim or row["max_dim"] != dim):
        raise ValueError(f"vector dimension {row['min_dim']}..{row['max_dim']}, expected {dim}")
    if row["n_models"] > 1:
        raise ValueError("vectors of more than one model in one store")
    if model and expected_model and row["n_vectors"]:
        found = vectors.select(model).first()[0]
        if found != expected_model:
            raise ValueError(f"store holds model {found!r}, expected {expected_model!r}")


def _tiles(q: np.ndarray, v: np.ndarray, cosine: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Rounded distances of one tile of queries after another to all vectors of a block.

    Queries are taken in tiles, so the distance matrix stays a few megabytes.
    """
    v = v.astype(np.float64)
    if cosine:
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    v_sq = (v * v).sum(1)
    for lo in range(0, len(q), TILE):
        tile = q[lo:lo + TILE].astype(np.float64)
        if cosine:
            tile = tile / np.maximum(np.linalg.norm(tile, axis=1, keepdims=True), 1e-300)
            dist = -(tile @ v.T)
        else:
            sq = (tile * tile).sum(1)[:, None] + v_sq[None, :] - 2.0 * (tile @ v.T)
            dist = np.sqrt(np.maximum(sq, 0.0))
        yield lo, np.round(dist, 6)


def _best_per_query(qids, q, ids, v, k, max_dist, cosine) -> pd.DataFrame:
    """k best (query, vector) rows of one block, ranked on rounded distance then id."""
    out_q, out_id, out_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for lo, dist in _tiles(q, v, cosine):
        for i, d in enumerate(dist):
            sel = best_k(d, ids, k, None if max_dist is None else d <= max_dist)
            out_q.append(np.full(sel.size, qids[lo + i], dtype=np.int64))
            out_id.append(ids[sel].astype(np.int64))
            out_d.append(d[sel])
    return pd.DataFrame({
        "query_id": np.concatenate(out_q), "id": np.concatenate(out_id), "distance": np.concatenate(out_d),
    })


def _counts_per_query(qids, q, v, cuts, cosine) -> pd.DataFrame:
    """Vectors of one block within each cut-off of each query."""
    found = [np.zeros((0, len(cuts)), np.int64)]
    for _, dist in _tiles(q, v, cosine):
        found.append(np.stack([(dist <= c).sum(1) for c in cuts], 1))
    hits = np.concatenate(found)
    i, c = np.nonzero(hits)
    return pd.DataFrame({"query_id": qids[i], "threshold": np.array(cuts, np.float64)[c], "hits": hits[i, c]})


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()) if len(col) else np.zeros((0, 1))


def _same_width(sizes, width: int) -> None:
    """Refuse vectors of another length than the queries, whichever way they are searched."""
    other = [x for x in np.unique(np.asarray(sizes)) if x != width]
    if other:
        raise ValueError(f"vectors of {other} values, queries of {width}")


def _per_block(
    queries: DataFrame, vectors: DataFrame, id_col: str, embedding: str, work: Callable, schema: str, finish: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``finish`` over the rows of ``work(query ids, queries, ids, vectors)``, for all queries and vectors.

    A query set proven small is shipped to the executors once and the vectors are scanned in
    place, without a shuffle. A larger one is shipped block by block over vectors that are
    written once and stay where they are: the driver holds one block of queries, the result of
    a block is written before the next is read, and nothing but results is shuffled.
    """
    qs = queries.select(F.col("query_id").cast("long"), "qvec").filter(F.col("qvec").isNotNull())
    # missing vectors are skipped inside the tasks: as a filter the test would move below a
    # rebalancing and run an encoder a second time
    vs = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(embedding).alias("vec"))

    def scan_for(rows: pd.DataFrame, vs: DataFrame) -> DataFrame:
        qids, q = rows["query_id"].to_numpy(), _matrix(rows["qvec"])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                b = b.filter(b.column(1).is_valid())
                if b.num_rows and len(qids):
                    _same_width(b.column(1).value_lengths(), q.shape[1])
                    # the list column is one flat buffer, so the matrix needs no per-row work
                    v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    best = work(qids, q, b.column(0).to_numpy(), v)
                    yield pa.RecordBatch.from_arrays([pa.array(best[c].to_numpy()) for c in best], list(best))

        return finish(vs.mapInArrow(scan, schema))

    # bounded probe: reads at most BLOCK_ROWS + 1 queries, enough to know which way to go
    rows = qs.limit(BLOCK_ROWS + 1).toPandas()
    if len(rows) <= BLOCK_ROWS and sum(map(len, rows["qvec"])) * 8 <= QUERY_BYTES:
        return scan_for(rows, vs)
    n, size = qs.agg(F.count(F.lit(1)), F.sum(F.size("qvec")) * 8).first()
    blocks = max(1, -(-n // BLOCK_ROWS), -(-size // QUERY_BYTES))
    qs = cut_lineage(qs.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks))))
    vs, out = cut_lineage(vs), None
    for b in range(blocks):
        part = cut_lineage(scan_for(qs.filter(F.col("qb") == b).drop("qb").toPandas(), vs))
        out = part if out is None else out.unionByName(part)
    return out


def knn(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    max_dist: float | None = MAX_DISTANCE,
    id_col: str = "chunk_id",
    embedding: str = "embedding",
    cosine: bool = False,
) -> DataFrame:
    """(query_id, id, vec_rank, distance): exact ``k`` nearest vectors of every query.

    Queries are (query_id long, qvec array<float>). Each block of vectors gives at most ``k``
    rows per query. With ``cosine`` the distance is the negated cosine, so ascending order
    still means best first. Vectors of another length than the queries are refused.
    """
    best = _per_block(
        queries, vectors, id_col, embedding,
        lambda qids, q, ids, v: _best_per_query(qids, q, ids, v, k, max_dist, cosine),
        "query_id long, id long, distance double",
        lambda rows: top_k(rows, ["query_id"], [F.asc("distance"), F.asc("id")], k))
    return best.select(
        "query_id", F.col("id").alias(id_col), (F.col("rn") - 1).cast("int").alias("vec_rank"),
        (-F.col("distance") if cosine else F.col("distance")).alias("distance"),
    )


def within(queries: DataFrame, vectors: DataFrame, cuts: Sequence[float], id_col: str = "chunk_id",
           embedding: str = "embedding", cosine: bool = False) -> DataFrame:
    """(query_id, threshold, hits): all vectors within each cut-off, counted where they lie."""
    cuts = [float(c) for c in cuts]
    return _per_block(
        queries, vectors, id_col, embedding,
        lambda qids, q, ids, v: _counts_per_query(qids, q, v, cuts, cosine),
        "query_id long, threshold double, hits long",
        lambda rows: rows.groupBy("query_id", "threshold").agg(F.sum("hits").alias("hits")))
