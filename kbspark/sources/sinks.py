"""Sinks: Markdown files per source, append-only metrics, plain table writes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.fulltext import gram_index
from kbspark.operators.views import export_lines


def write_markdown(sources: DataFrame, chunks: DataFrame, path: str, source_id: int | None = None) -> None:
    """One ``source_id=`` folder per source, lines in document order.

    Rows are range-partitioned on the document order, so a long source is written as
    several consecutive part files instead of passing through one task.
    """
    order = ["source_id", "part", F.coalesce("start_sec", F.lit(-1.0)), F.coalesce("chunk_id", F.lit(-1))]
    lines = export_lines(sources, chunks, source_id)
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("source_id", "line").write.mode(
        "overwrite").partitionBy("source_id").text(path)


def write_text_lines(texts: DataFrame, path: str, text: str = "text") -> None:
    """Texts as lines of text files, as many files as tasks; a text with a line break is refused."""
    broken = F.col(text).rlike("[\r\n]")
    line = F.when(broken, F.raise_error(F.lit("a text with a line break is no line"))).otherwise(F.col(text))
    texts.select(line.cast("string").alias("value")).write.text(path)


def append_jsonl(record: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    record.write.mode("append").json(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", sort: str | None = None) -> None:
    """Parquet table; ``sort`` clusters rows so that scans can skip row groups."""
    (df.sortWithinPartitions(sort) if sort else df).write.mode(mode).parquet(path)


def write_postings(index: DataFrame, table: str, buckets: int = 256) -> None:
    """Posting table bucketed by gram: later candidate joins need no shuffle of the index."""
    index.write.mode("overwrite").bucketBy(buckets, "gram").sortBy("gram").saveAsTable(table)


def write_index(texts: DataFrame, path: str, id_col: str = "chunk_id", text: str = "text", batch: str = "0") -> None:
    """Add the texts that ``path`` does not hold yet: their postings, then their ids.

    The registry of ids decides what is new, so growth never reads the postings. It is written
    last: a batch that broke off is done again, over its own folder.
    """
    spark = texts.sparkSession
    known = stored_ids(spark, path, texts.select(id_col).schema, batch)
    fresh = texts.join(known, id_col, "left_anti")
    gram_index(fresh, id_col, text).write.mode("overwrite").parquet(f"{path}/postings/batch={batch}")
    fresh.select(id_col).write.mode("overwrite").parquet(f"{path}/registry/batch={batch}")


def stored_ids(spark: SparkSession, path: str, schema, but: str | None = None) -> DataFrame:
    """Ids in the registry of ``path``, without those of batch ``but``; none when there is no index."""
    try:
        rows = spark.read.parquet(f"{path}/registry")
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)
    return rows.filter(F.col("batch").cast("string") != F.lit(but)).select(*schema.names) if but is not None else rows.select(*schema.names)


def read_index(spark: SparkSession, path: str, id_col: str = "chunk_id") -> DataFrame:
    """The stored posting table (gram, id), as searches take it for ``index``.

    Only postings of batches whose ids are registered count.
    """
    whole = spark.read.parquet(f"{path}/registry").select("batch").distinct()
    return spark.read.parquet(f"{path}/postings").join(F.broadcast(whole), "batch", "left_semi").select("gram", id_col)
