"""Session set-up and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
FREE_SHUFFLES_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# A side is broadcast by hint only when it was measured and stays within both bounds.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 8 * 1024 * 1024


def shuffle_partitions_for(shuffled_bytes: int, partition_bytes: int = 256 * 1024 * 1024) -> int:
    """Partitions for the largest shuffle of a run, so that one partition fits well into a task's memory."""
    return max(200, -(-shuffled_bytes // partition_bytes))


def build_session(
    app: str = "stratalake", master: str | None = None, largest_shuffle_bytes: int | None = None, **conf: str,
) -> SparkSession:
    """A UTC session with adaptive execution.

    ``largest_shuffle_bytes`` is the expected volume of the largest shuffle. Adaptive execution
    starts every shuffle with enough partitions for it and merges them where there is less; it
    never makes more, so the default of 200 would be too few for a large lake.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.checkpoint.compress", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if largest_shuffle_bytes:
        builder = builder.config(
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
            str(shuffle_partitions_for(largest_shuffle_bytes)))
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    own = tempfile.mkdtemp(prefix="stratalake-")
    context.setCheckpointDir(own)
    return own


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder now and go on from the written rows.

    Used where a plan must see one fixed copy of rows twice (range placement, small lookup
    tables). The copy is on shared storage, so it outlives the executors that made it.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go when the query that made them has ended, not when the driver collects its garbage.

    For steps whose rows are written and read again, so that no query that has ended is asked again.
    """
    before = spark.conf.get(FREE_SHUFFLES_KEY, None)
    if before == "true":  # set by whoever called this, or by a thread beside it
        yield
        return
    spark.conf.set(FREE_SHUFFLES_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES_KEY)
        else:
            spark.conf.set(FREE_SHUFFLES_KEY, before)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """The rows of ``df``, written to the checkpoint folder for as long as the block runs."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES,
) -> tuple[DataFrame, bool]:
    """Mark a pinned lookup table for broadcast if its rows and bytes are measured to be few.

    Returns the frame and whether it was marked. Measuring reads at most ``max_rows + 1`` rows.
    """
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    small = rows <= max_rows and size <= max_bytes
    return (F.broadcast(df) if small else df), small
