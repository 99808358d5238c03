"""Session set-up, size checks and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ceiling for anything that is sent whole to every executor: 16 384 values of 4 KiB.
BROADCAST_ROWS = 16_384
VALUE_BYTES = 4096
# Ceiling for broadcast rows of a few numbers each (about 60 bytes a row).
NARROW_ROWS = 500_000


def build_session(cpus: str = "*", app: str = "kbspark", partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KBSPARK_DRIVER_MEMORY", "12g"))
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")  # one core per task
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def bounded_values(df: DataFrame, column: Column, max_rows: int = BROADCAST_ROWS) -> list[str] | None:
    """Values of a text column, or None when they are not proven small.

    One job that reads at most ``max_rows + 1`` values of at most ``VALUE_BYTES`` bytes, so
    it moves 64 MiB at the very most. More or longer values give None, and the caller
    takes its distributed way.
    """
    size = F.octet_length(column)
    head = df.select(
        F.when(size <= VALUE_BYTES, column).alias("v"), (size > VALUE_BYTES).alias("big")
    ).limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows or True in head.column("big").to_pylist():
        return None
    return head.column("v").to_pylist()


def at_most(df: DataFrame, n: int) -> bool:
    """True when ``df`` has at most ``n`` rows; reads no more than ``n + 1`` of them."""
    return df.limit(n + 1).count() <= n


def small_side(df: DataFrame, proven: bool) -> DataFrame:
    """``df`` with a broadcast hint when its size has been proven small."""
    return F.broadcast(df) if proven else df


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt_on: str, salts: int = 32) -> DataFrame:
    """Inner join of many rows per key with one row per key, hot keys split ``salts`` ways.

    The small side is copied to every salt. An aggregation by ``keys`` afterwards first
    combines within each salt, so no task ever sees all rows of a hot key.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` is read from the session; only when neither it nor the
    context has a folder (single-machine tests) a temporary one is set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: several readers share one computation,
    and each reads only the columns that it needs."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a scan that has fewer partitions than there are cores.

    Large inputs have many splits and pass through untouched; only a few-file input
    (one row group cannot be split) is dealt out to all cores before heavy text work.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
