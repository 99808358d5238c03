"""Table changes as set operations, audits, staged publishing and snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as t

from kbspark.functions import text as T
from kbspark.operators.clean import MAX_COLLECTION_NAME, MAX_COLLECTIONS

# Ids per delete call, display title length, kept snapshots.
MAX_DELETES = 20
MAX_DISPLAY_TITLE = 40
KEEP_SNAPSHOTS = 7


def cascade_delete(tables: Mapping[str, DataFrame], ids: DataFrame, limit: int = MAX_DELETES) -> dict[str, DataFrame]:
    """Tables without the given sources, their chunks, vectors and jobs, and a report.

    More ids than ``limit`` in one call are refused. Messages keep their citations.
    """
    doomed = ids.select("source_id").distinct()
    if doomed.limit(limit + 1).count() > limit:
        raise ValueError(f"at most {limit} sources per delete")
    return remove_sources(tables, doomed)


def remove_sources(tables: Mapping[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """The set form of the delete, for any number of ids."""
    out = dict(tables)
    gone = tables["chunks"].join(doomed, "source_id", "left_semi").select("chunk_id")
    for name in ("sources", "chunks", "jobs"):
        if name in tables:
            out[name] = tables[name].join(doomed, "source_id", "left_anti")
    for name in ("chunk_vectors", "postings"):
        if name in tables:
            out[name] = tables[name].join(gone, "chunk_id", "left_anti")
    known = tables["sources"].select("source_id", F.lit(True).alias("_k"))
    out["report"] = doomed.join(known, "source_id", "left").select(
        "source_id", F.when(F.col("_k"), "deleted").otherwise("missing").alias("outcome"))
    return out


def set_null(df: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Null references to deleted ids; also (id, released) counts."""
    gone = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
    hit = df.join(gone, F.col(column) == F.col("_gone"), "left")
    released = hit.filter(F.col("_gone").isNotNull()).groupBy(F.col("_gone").alias(column)).agg(
        F.count(F.lit(1)).alias("released"))
    cleared = F.when(F.col("_gone").isNull(), F.col(column)).alias(column)
    return hit.select(*[cleared if c == column else F.col(c) for c in df.columns]), released


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key. A pre-aggregated maximum: no key's rows are gathered."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert or replace by key; the last of several new rows per key wins."""
    fresh = latest(new, keys, order).select(*base.columns)
    return base.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def apply_changes(table: DataFrame, feed: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Overwrite ``columns`` with the latest change per key; null changes keep the value."""
    last = feed.groupBy(key).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_n_{c}") for c in columns])
    out = table.join(last, key, "left")
    return out.select(*[
        F.coalesce(f"_n_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def rename_sources(sources: DataFrame, feed: DataFrame, order: Sequence[str]) -> DataFrame:
    """Apply display-title changes: blanks collapsed, 1 to 40 characters, others ignored."""
    clean = feed.withColumn("display_title", T.collapse("display_title"))
    ok = clean.filter(F.length("display_title").between(1, MAX_DISPLAY_TITLE))
    return apply_changes(sources, ok, "source_id", order, ["display_title"])


def assign_collections(
    sources: DataFrame, collections: DataFrame, feed: DataFrame, order: Sequence[str], now: Column
) -> tuple[DataFrame, DataFrame]:
    """Move sources to named collections (null clears); unknown names are created.

    Returns new sources and collections. New names are created in order of first use until
    the library holds its maximum of collections; moves to names beyond that do nothing.
    """
    last = latest(feed.join(sources.select("source_id"), "source_id", "left_semi"), ["source_id"], order).withColumn(
        "name", T.collapse("name"))
    valid = last.filter(F.col("name").isNull() | F.length("name").between(1, MAX_COLLECTION_NAME))
    wanted = valid.filter(F.col("name").isNotNull()).groupBy("name").agg(F.min(F.struct(*order)).alias("_o")).join(
        collections.select("name"), "name", "left_anti")
    top = collections.agg(F.coalesce(F.max("collection_id"), F.lit(0)).alias("v")).scalar()
    total = collections.agg(F.count(F.lit(1)).alias("v")).scalar()
    # at most MAX_COLLECTIONS rows are left before they are numbered
    few = wanted.orderBy("_o", "name").limit(MAX_COLLECTIONS)
    ranked = few.withColumn("_rn", F.row_number().over(W.orderBy("_o", "name"))).filter(
        F.col("_rn") + total <= MAX_COLLECTIONS)
    created = ranked.select((top + F.col("_rn")).cast("long").alias("collection_id"), "name", now.alias("created_at"))
    every = collections.unionByName(created.select(*collections.columns))
    target = valid.join(every.select("name", F.col("collection_id").alias("_cid")), "name", "left").filter(
        F.col("name").isNull() | F.col("_cid").isNotNull()).select("source_id", "_cid", F.lit(True).alias("_moved"))
    moved = sources.join(target, "source_id", "left").select(*[
        F.when(F.col("_moved"), F.col("_cid")).otherwise(F.col(c)).alias(c) if c == "collection_id" else F.col(c)
        for c in sources.columns])
    return moved, every


def decide_notes(notes: DataFrame, decisions: DataFrame, order: Sequence[str], now: Column) -> DataFrame:
    """Apply verdicts (note_id, keep): kept or dropped whatever the current status."""
    last = latest(decisions, ["note_id"], order).select("note_id", "keep")
    decided = F.col("keep").isNotNull()
    return notes.join(last, "note_id", "left").withColumn(
        "status", F.when(decided, F.when(F.col("keep"), "kept").otherwise("dropped")).otherwise(F.col("status"))
    ).withColumn("decided_at", F.when(decided, now).otherwise(F.col("decided_at"))).select(*notes.columns)


def attach_summaries(sources: DataFrame, summaries: DataFrame, now: Column) -> DataFrame:
    """Ready sources take the summary and become enriched; others only fill an empty one."""
    new = summaries.select("source_id", F.col("summary").alias("_new"))
    take = F.col("_new").isNotNull() & ((F.col("status") == "ready") | F.col("summary").isNull())
    rows = sources.join(new, "source_id", "left").withColumn("_take", take)
    return rows.select(*[
        F.when(F.col("_take"), F.col("_new")).otherwise(F.col(c)).alias(c) if c == "summary"
        else F.when(F.col("_take"), now).otherwise(F.col(c)).alias(c) if c == "summary_generated_at"
        else F.when(F.col("_take") & (F.col(c) == "ready"), "enriched").otherwise(F.col(c)).alias(c) if c == "status"
        else F.col(c) for c in sources.columns])


def replace_visual(chunks: DataFrame, vectors: DataFrame, new_rows: DataFrame, new_vectors: DataFrame):
    """Swap the visual chunks of exactly those sources that have new visual rows."""
    redone = new_rows.select("source_id").distinct()
    old = chunks.filter(F.col("modality") == "visual").join(redone, "source_id", "left_semi").select("chunk_id")
    return (
        chunks.join(old, "chunk_id", "left_anti").unionByName(new_rows),
        vectors.join(old, "chunk_id", "left_anti").unionByName(new_vectors),
    )


def delete_sessions(messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages without the given sessions, and (session_id, removed) counts."""
    gone = ids.select("session_id").distinct()
    removed = messages.join(gone, "session_id", "left_semi").groupBy("session_id").agg(F.count(F.lit(1)).alias("removed"))
    return messages.join(gone, "session_id", "left_anti"), removed


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    return messages.unionByName(new, allowMissingColumns=True)


def evolve(df: DataFrame, schema: str) -> DataFrame:
    """Add the columns of ``schema`` that an older table lacks, as nulls."""
    want = t._parse_datatype_string(schema) if isinstance(schema, str) else schema
    for f in want.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(*[f.name for f in want.fields])


def _orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def _repeats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def audit(tables: Mapping[str, DataFrame], dim: int | None = None) -> DataFrame:
    """One row per integrity check: (check_name, violations); zero means clean."""
    s, c, v = tables["sources"], tables["chunks"], tables["chunk_vectors"]
    checks = {
        "chunks_without_source": _orphans(c, s, "source_id"),
        "vectors_without_chunk": _orphans(v, c, "chunk_id"),
        "chunks_without_vector": _orphans(c, v, "chunk_id"),
        "source_id_repeated": _repeats(s, ["source_id"]),
        "identity_repeated": _repeats(s, ["platform", "video_id"]),
        "chunk_id_repeated": _repeats(c, ["chunk_id"]),
    }
    if "jobs" in tables:
        checks["jobs_without_source"] = _orphans(tables["jobs"], s, "source_id")
    if "postings" in tables:
        checks["postings_without_chunk"] = _orphans(tables["postings"], c, "chunk_id")
    if dim is not None:
        checks["vector_dimension"] = v.filter(F.size("embedding") != dim)
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def publish(tables: Mapping[str, DataFrame], root: str, version: str, checks=None, repair=None) -> str:
    """All or nothing: write every table to a staging folder, check it, then rename it.

    ``checks`` gets the staged tables and raises to refuse. ``repair`` gets the tables as first
    written and returns those to publish, so that a source with a fault fails by itself
    (:func:`kbspark.operators.ingest.settle`) and the version is published without it. Readers
    use the newest ``version=`` folder, so they never see a partial write. A version is
    published once.
    """
    spark = next(iter(tables.values())).sparkSession
    staged, final = f"{root}/_staging/{version}", f"{root}/version={version}"
    fs, path, _ = _fs(spark, final)
    if fs.exists(path):
        raise FileExistsError(final)
    if repair is not None:
        raw = f"{root}/_staging/{version}-raw"
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{raw}/{name}")
        tables = repair({n: spark.read.parquet(f"{raw}/{n}") for n in tables})
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{staged}/{name}")
    read = {n: spark.read.parquet(f"{staged}/{n}") for n in tables}
    fs, path, mk = _fs(spark, staged)
    if repair is not None:
        fs.delete(mk(raw), True)
    try:
        if checks is not None:
            checks(read)
    except Exception:
        fs.delete(path, True)
        raise
    if not fs.rename(path, mk(final)):
        raise OSError(f"could not publish {final}")
    return final


def require_clean(read: Mapping[str, DataFrame], dim: int | None = None) -> None:
    """Audit used by :func:`publish`: raise when any check has violations."""
    bad = [r for r in audit(read, dim).filter("violations > 0").collect()]  # one row per check
    if bad:
        raise ValueError("integrity: " + ", ".join(f"{r['check_name']}={r['violations']}" for r in bad))


def snapshots(spark: SparkSession, root: str) -> list[str]:
    """Snapshot names, newest first."""
    fs, path, _ = _fs(spark, root)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted((n for n in names if n.startswith("snap=")), reverse=True)


def snapshot(tables: Mapping[str, DataFrame], root: str, stamp: str, keep: int = KEEP_SNAPSHOTS) -> str:
    """Full copy under ``snap=<stamp>``; a taken stamp gets a suffix; only the newest stay.

    The copy is staged and renamed when whole, so a broken run leaves no snapshot behind and
    replaces no older one.
    """
    spark = next(iter(tables.values())).sparkSession
    have, name, n = set(snapshots(spark, root)), f"snap={stamp}", 1
    while name in have:
        name, n = f"snap={stamp}-{n}", n + 1
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/_staging/{name}/{table}")
    fs, path, mk = _fs(spark, f"{root}/_staging/{name}")
    if not fs.rename(path, mk(f"{root}/{name}")):
        raise OSError(f"could not keep {name}")
    for old in snapshots(spark, root)[keep:]:
        fs, path, _ = _fs(spark, f"{root}/{old}")
        fs.delete(path, True)
    return f"{root}/{name}"
