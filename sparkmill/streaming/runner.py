"""Running a streaming query to completion and reading its result as a table.

Registered queries must return DataFrames, so streams run with the
``availableNow`` trigger (every input file, split into micro-batches by
``maxFilesPerTrigger``) into files under the shared checkpoint folder.  Nothing
goes through driver memory (no ``memory`` sink).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


# A micro-batch reads this many files, so its tasks run in parallel.
FILES_PER_BATCH = 8


def parallel_files(spark: SparkSession) -> int:
    """Files of a micro-batch that keep all cores busy: a file of one row group is read by one task."""
    try:
        return max(FILES_PER_BATCH, 2 * spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - no RDD API (e.g. a Spark Connect session)
        return FILES_PER_BATCH


def write_stream_files(df: DataFrame, name: str, *, batches: int = 5, order_col: str | None = None,
                       in_order: bool = False, files_per_batch: int = FILES_PER_BATCH,
                       key: list[str] | None = None, made: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Spark writes ``df`` as the stream's input: ``batches`` x ``files_per_batch`` Parquet files.

    The file source replays files by modification time.  With ``in_order`` one job writes
    the files as ranges of ``order_col``, whose rows never go back from one file
    to the next, and the files' times are then set in the order of their names;
    otherwise rows are spread by the hash of ``key`` or, without one, round-robin.  ``made``
    makes the stream's rows of the spread ones, so that long rows are not shuffled.
    """
    spark, path, n = df.sparkSession, scratch_path(df.sparkSession, name), batches * files_per_batch
    if not in_order or order_col is None:
        spread = df.repartition(n, *(key or []))
        (made(spread) if made else spread).write.parquet(path)
        return path
    df.repartitionByRange(n, order_col).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f.getPath().getName(), f) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))  # n at most
    for k, (_, f) in enumerate(found):
        fs.setTimes(f.getPath(), f.getModificationTime() - 1000 * (len(found) - k), -1)
    return path


def read_stream(spark: SparkSession, path: str, schema, *, files_per_trigger: int = FILES_PER_BATCH) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _start_with(spark: SparkSession, conf: dict | None, start: Callable):
    """Start a query with ``conf`` applied to it alone: a streaming query keeps
    the session settings it starts with, so they are restored right after."""
    old = {k: spark.conf.get(k, None) for k in (conf or {})}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        return start()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def run_append(stream: DataFrame, name: str, conf: dict | None = None) -> DataFrame:
    """Append-mode stream → Parquet files; returns the files as a batch DataFrame."""
    spark = stream.sparkSession
    out, ckpt = scratch_path(spark, name), scratch_path(spark, name + "-ckpt")
    writer = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
              .outputMode("append").trigger(availableNow=True))
    q = _start_with(spark, conf, writer.start)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, name: str, handler: Callable[[DataFrame, int, str], None],
                output_mode: str = "append") -> str:
    """``foreachBatch(handler(batch_df, batch_id, out_path))``; returns ``out_path``."""
    spark = stream.sparkSession
    out, ckpt = scratch_path(spark, name), scratch_path(spark, name + "-ckpt")
    q = (stream.writeStream.foreachBatch(lambda df, bid: handler(df, bid, out))
         .option("checkpointLocation", ckpt).outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def write_batch_partition(df: DataFrame, batch_id: int, out: str) -> None:
    """Idempotent batch write: each batch owns ``batch_id=N``; a replay overwrites only it."""
    (df.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write
     .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))


def latest_per_key(updates: DataFrame, key: list[str]) -> DataFrame:
    """Fold update-mode output: for each key, the row of the latest batch."""
    cols = [c for c in updates.columns if c not in key and c != "batch_id"]
    last = updates.groupBy(*key).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("__r"))
    return last.select(*key, "__r.*")
