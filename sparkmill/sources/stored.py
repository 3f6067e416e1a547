"""Stored JSONL datasets: rows and rejects written in one pass, and pages of rows by a position index.

A stored dataset is a folder of JSON lines.  Beside it stands an index (file, rows,
first): how many rows each file has and the position of its first one.  A page opens
the files it overlaps and no other; inside them, the rows of each split are counted and
only the splits of the page are sorted and cut.  No row is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..operators.ordinal import running_total
from .readers import read_lines

#: Rows of a file that this module writes.
FILE_ROWS = 100_000


def index_path(path: str) -> str:
    return path.rstrip("/") + ".index"


def _rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, pos, line) of the lines that hold JSON; pos counts them inside a split."""
    lines = read_lines(spark, path).select(F.col("ord.file").alias("file"), F.col("ord.block").alias("block"), py_strip(F.col("line")).alias("line"))
    valid = lines.filter((F.col("line") != "") & F.try_parse_json("line").isNotNull())
    return valid.select("file", "block", F.monotonically_increasing_id().alias("pos"), "line")


def write_index(spark: SparkSession, path: str) -> str:
    """Count the rows of every file of the dataset at ``path`` and write the index beside it, sorted by position."""
    counts = _rows(spark, path).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    placed = running_total(counts, "file", "rows", before="first", after="end")
    placed.select("file", "rows", "first").sort("first").write.mode("overwrite").parquet(index_path(path))
    return index_path(path)


def write_dataset(records: DataFrame, path: str, line_col: str = "line", rejects: str | None = None, reason_col: str = "reason") -> None:
    """Write ``line_col`` as a dataset of bounded files, and its index.

    With ``rejects``, rows whose ``reason_col`` is set go there, as JSON lines {reason, line},
    by the same job.
    """
    spark = records.sparkSession
    if rejects is None:
        records.select(F.col(line_col).alias("value")).write.option("maxRecordsPerFile", FILE_ROWS).option("lineSep", "\n").text(path)
    else:
        both = records.select(F.when(F.col(reason_col).isNull(), F.col(line_col)).otherwise(
            F.to_json(F.struct(F.col(reason_col).alias("reason"), F.col(line_col).alias("line")))).alias("value"),
            F.when(F.col(reason_col).isNull(), "rows").otherwise("rejects").alias("kind"))
        both.write.option("maxRecordsPerFile", FILE_ROWS).option("lineSep", "\n").partitionBy("kind").text(path + ".both")
        _move(spark, path + ".both/kind=rows", path)
        _move(spark, path + ".both/kind=rejects", rejects)
    write_index(spark, path)


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; one that was not written (no such rows) becomes an empty one."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    if not (fs.rename(a, b) if fs.exists(a) else fs.mkdirs(b)):
        raise OSError(f"cannot write {target}")


def total_rows(spark: SparkSession, path: str) -> int:
    return int(spark.read.parquet(index_path(path)).agg(F.sum("rows")).first()[0] or 0)


def preview_page(spark: SparkSession, path: str, page: int = 1, page_size: int = 50) -> DataFrame:
    """(row_ord, line, total): whole rows of page ``page`` (from 1) in file order, as stored.

    Lines that are no JSON are no rows.  A page behind the end, and every page of an
    empty dataset, has no rows.  What comes to the driver: the files and the
    splits of the page, ``page_size`` each at most, since none of them is empty.
    """
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size must be positive")
    lo, hi = (page - 1) * page_size, page * page_size
    index = spark.read.parquet(index_path(path))
    total = total_rows(spark, path)
    files = index.filter((F.col("first") < hi) & (F.col("first") + F.col("rows") > lo)).sort("first").collect()
    if not files:
        return spark.range(0).select(F.lit(0).cast("bigint").alias("row_ord"), F.lit("").alias("line"), F.lit(total).cast("bigint").alias("total"))
    rows = _rows(spark, [f["file"] for f in files])
    # splits of these files, with the position of their first row: one row of counts for each split
    first = F.create_map(*[F.lit(x) for f in files for x in (f["file"], f["first"])])[F.col("file")]
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("pos"))
    splits = splits.withColumn("at", first + F.coalesce(F.sum("rows").over(before), F.lit(0)))
    splits = splits.filter((F.col("at") < hi) & (F.col("at") + F.col("rows") > lo)).collect()
    base = F.create_map(*[F.lit(x) for s in splits for x in (f"{s['block']} {s['file']}", s["at"] - s["pos"])])
    placed = rows.withColumn("row_ord", F.try_element_at(base, F.concat_ws(" ", "block", "file")) + F.col("pos"))
    return placed.filter((F.col("row_ord") >= lo) & (F.col("row_ord") < hi)).select("row_ord", "line", F.lit(total).cast("bigint").alias("total"))
