"""Registry tables stored for point lookups: sorted by id, with small row groups and bloom filters.

A lookup's ids reach the Parquet reader as a pushed filter.  Files and row groups whose
id range does not hold one are skipped by their statistics, the rest by the bloom filter,
so a lookup reads a few row groups, however large the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group, and ids that a lookup pushes down; more ids are joined.
ROW_GROUP_BYTES, MAX_PUSHED = 1 << 20, 1000


def write_table(df: DataFrame, path: str, id_col: str = "id", partitions: int | None = None) -> None:
    """Write ``df`` in id order (ranges of ids by file, sorted inside); null ids come first."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    (df.repartitionByRange(n, id_col).sortWithinPartitions(id_col).write
     .option(f"parquet.bloom.filter.enabled#{id_col}", "true").option("parquet.block.size", ROW_GROUP_BYTES)
     .option("parquet.page.row.count.limit", 2000).parquet(path))


def lookup(spark: SparkSession, path: str, ids: list, id_col: str = "id") -> DataFrame:
    """The rows of ``ids`` (each id once, unknown and null ids have none), by a filter that the reader gets."""
    wanted = sorted({i for i in ids if i is not None})
    if len(wanted) > MAX_PUSHED:
        raise ValueError(f"more than {MAX_PUSHED} ids: use lookup_all")
    df = spark.read.parquet(path)
    return df.filter(F.col(id_col).isin(wanted)) if wanted else df.limit(0)


def lookup_all(spark: SparkSession, path: str, keys: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows whose id is among ``keys`` (a column of the same name), any number of them, by a semi-join."""
    return spark.read.parquet(path).join(keys.select(id_col).distinct(), id_col, "left_semi")


def status_allowed(status: Column, allowed: list[str]) -> Column:
    """Whether a status value may be stored: null or one of the enumeration's."""
    return status.isNull() | status.isin(allowed)
