"""Ordered prefix sums without a global window: dense ordinals, packing, paging.

A running total over the whole table would need one task to see every row.
Instead the rows are cut into groups of consecutive keys, each group is
totalled (a partial aggregate), a cumulative sum over the group totals gives
every group its offset, the offsets are broadcast back (one row per group) and
a window partitioned by group adds the running sum inside it.  How the groups
are cut depends on the key:
* dense integral keys (row ordinals, document ids): ``(key - min) div
  bucket_rows`` — at most ``bucket_rows`` rows per group, no sampling pass;
* anything else (sparse or clustered ids, strings, structs):
  ``repartitionByRange`` — sampled, equal-depth ranges, written once to the
  checkpoint folder, so totals and rows see the same groups.
The choice costs one aggregate over the key column alone (three scalars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ..session import cut_lineage

DEFAULT_BUCKET_ROWS = 1 << 20
# Integral keys with at most this many key values per row are "dense".
DENSE_FACTOR = 4


def _ranges(df: DataFrame, ranges: int | None) -> int:
    if ranges:
        return int(ranges)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 1)


def _running_in_groups(staged: DataFrame, order_col: str, value_col: str, offsets: DataFrame,
                       before: str, after: str) -> DataFrame:
    # ``offsets`` has one row per group, bounded as the caller explains: broadcast.
    joined = staged.join(F.broadcast(offsets), "__grp")
    w = Window.partitionBy("__grp").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    v = F.coalesce(F.col(value_col), F.lit(0))
    out = joined.withColumn(after, (F.col("__off") + F.sum(v).over(w)).cast("bigint"))
    return out.withColumn(before, (F.col(after) - v).cast("bigint")).drop("__grp", "__off")


def _offsets(staged: DataFrame, value_col: str) -> DataFrame:
    totals = staged.groupBy("__grp").agg(F.sum(value_col).cast("bigint").alias("__tot"))
    prior = F.sum("__tot").over(Window.orderBy("__grp").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("__grp", F.coalesce(prior, F.lit(0)).cast("bigint").alias("__off"))


def _is_dense(df: DataFrame, order_col: str) -> tuple[bool, int]:
    """Integral keys spanning at most DENSE_FACTOR values per row (three scalars, key column only)."""
    if not isinstance(df.schema[order_col].dataType, (ByteType, ShortType, IntegerType, LongType)):
        return False, 0
    st = df.agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi"), F.count(order_col).alias("n")).first()
    if not st["n"]:
        return True, 0
    return (st["hi"] - st["lo"] + 1) <= DENSE_FACTOR * st["n"], int(st["lo"])


def running_total(df: DataFrame, order_col: str, value_col: str, *, ranges: int | None = None,
                  bucket_rows: int = DEFAULT_BUCKET_ROWS, before: str = "cum_before",
                  after: str = "cum_after") -> DataFrame:
    """Add exclusive/inclusive running sums of ``value_col`` in ``order_col`` order.

    ``order_col`` must be unique.  Dense integral keys (row ordinals, document
    ids) are grouped by ``(key - min) div bucket_rows``: each group holds at
    most ``bucket_rows`` rows and there are at most ``DENSE_FACTOR × rows /
    bucket_rows`` groups, with no sampling pass.  Any other key (sparse,
    clustered, or not integral) is cut by ``repartitionByRange(ranges)`` into
    sampled, equal-depth ranges, so no group can be hot and there are exactly
    ``ranges`` groups.
    """
    dense, lo = _is_dense(df, order_col)
    if dense:
        group = F.floor((F.col(order_col) - F.lit(lo)) / F.lit(bucket_rows)).cast("bigint")
        staged = df.withColumn("__grp", F.coalesce(group, F.lit(-1)))  # null keys come first
    else:
        # Range bounds are sampled each time the plan runs, so the cut is written once:
        # offsets and rows must come from the same groups.
        staged = cut_lineage(df.repartitionByRange(_ranges(df, ranges), F.col(order_col))
                             .withColumn("__grp", F.spark_partition_id()))
    return _running_in_groups(staged, order_col, value_col, _offsets(staged, value_col), before, after)


def dense_ordinal(df: DataFrame, order_col: str, *, out: str = "row_ord", ranges: int | None = None,
                  bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """0-based position of each row in ``order_col`` order (two-pass count)."""
    staged = df.withColumn("__one", F.lit(1).cast("bigint"))
    r = running_total(staged, order_col, "__one", ranges=ranges, bucket_rows=bucket_rows, before=out, after="__incl")
    return r.drop("__one", "__incl")


def sequence_packing(df: DataFrame, order_col: str, tokens_col: str, *, context_length: int = 2048,
                     ranges: int | None = None, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Concatenate every row's tokens in order and cut into ``context_length`` packs.

    Adds ``token_start``/``token_end`` (half-open range in the stream) and
    ``first_pack``/``last_pack`` (inclusive; a row with no tokens reports the
    pack its position falls in).
    """
    r = running_total(df, order_col, tokens_col, ranges=ranges, bucket_rows=bucket_rows,
                      before="token_start", after="token_end")
    L = F.lit(context_length)
    return (r.withColumn("first_pack", F.floor(F.col("token_start") / L).cast("bigint"))
            .withColumn("last_pack", F.when(F.col(tokens_col) > 0, F.floor((F.col("token_end") - 1) / L))
                        .otherwise(F.floor(F.col("token_start") / L)).cast("bigint")))


def pack_summary(packed: DataFrame, tokens_col: str, *, context_length: int = 2048) -> DataFrame:
    """Per pack: tokens it holds and how many row segments fill it.

    Each row explodes into the packs it touches (bounded by its own length),
    then a partial aggregate per pack.
    """
    L = context_length
    seg = packed.filter(F.col(tokens_col) > 0).select(
        "token_start", "token_end", F.explode(F.sequence("first_pack", "last_pack")).alias("pack_id"))
    lo = F.greatest(F.col("token_start"), F.col("pack_id") * L)
    hi = F.least(F.col("token_end"), (F.col("pack_id") + 1) * L)
    return (seg.groupBy("pack_id").agg(F.sum(hi - lo).cast("bigint").alias("n_tokens"),
                                       F.count(F.lit(1)).alias("n_segments")))


def preview_page(df: DataFrame, order_col: str, *, page: int = 1, page_size: int = 50,
                 ranges: int | None = None, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Page ``page`` (1-based) of ``page_size`` rows in ``order_col`` order, with the total.

    Dense row positions come from the range-partitioned prefix count; the page
    is a filter on them and the total is the last position plus one.
    """
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size must be positive")
    lo, hi = (page - 1) * page_size, page * page_size
    staged = df.withColumn("__one", F.lit(1).cast("bigint"))
    rows = running_total(staged, order_col, "__one", ranges=ranges, bucket_rows=bucket_rows,
                         before="row_ord", after="__incl")
    page_rows = rows.filter((F.col("row_ord") >= lo) & (F.col("row_ord") < hi)).drop("__one", "__incl")
    total = staged.agg(F.count(F.lit(1)).alias("total")).withColumn("__k", F.lit(1))
    # ``total`` is one row: broadcasting it is bounded by construction.
    return page_rows.withColumn("__k", F.lit(1)).join(F.broadcast(total), "__k").drop("__k")
