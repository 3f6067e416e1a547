"""Parquet tables of a scale-factor folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str, *, narrow_work: bool = False) -> DataFrame:
    """Read one table; ``TIMESTAMP_NTZ`` columns become UTC ``TIMESTAMP``.

    The cast is a projection over the scan, so filters and column pruning
    still reach the Parquet reader.  ``narrow_work`` marks a caller whose next
    steps are CPU-bound per-row work with no shuffle (regex, parsing,
    chunking, BPE on long text): it gets a parallelism floor (``spread``).
    A caller that shuffles first gets its parallelism from the shuffle.
    """
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, TimestampNTZType)]
    if ntz:
        df = df.select(*[F.col(c).cast("timestamp").alias(c) if c in ntz else F.col(c) for c in df.columns])
    return spread(df) if narrow_work else df


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a scan that yields fewer input splits than the cluster has cores.

    A small file with one row group is one split, so narrow per-row work on
    it would use one core.  Counting splits only plans the scan (no data is
    read).  On large inputs (many more splits than cores) this is a no-op, so
    it never adds a shuffle at scale.
    """
    try:
        want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD API (e.g. a Spark Connect session): leave the scan as is
        return df
    return df.repartition(want) if splits < want else df
