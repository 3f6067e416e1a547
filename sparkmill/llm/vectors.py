"""What the vector searches share: valid rows, classes of equal vectors, results per query row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.llm.common import join_by_key, stage


def valid(rows: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, v array<double>): vectors without null or non-finite components, of the table's usual dimension.

    The usual dimension is the most frequent one (the larger of equals): vectors of
    another one are comparable with nothing usual and take no part.  So do empty
    vectors, rows without id and, with ``nonzero``, zero vectors.
    """
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine).select("vec_id", v.alias("v"))
    if nonzero:
        out = out.filter(F.exists("v", lambda x: x != 0))
    top = out.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return out.filter(F.size("v") == (top["d"] if top else 0))


def classes(rows: DataFrame, is_query: Column, members: int) -> tuple[DataFrame, DataFrame]:
    """(classes, query rows) of (vec_id, v) rows.

    A class is one distinct vector: ``cid`` (its smallest vec_id), ``v``, ``ids`` (its
    ``members`` smallest ids, sorted), ``n`` rows, ``n_query`` query rows.  However many copies a
    vector has, ``members`` of a task's rows at most are shuffled for it.  Query
    rows are (vec_id, cid).
    """
    smallest = rows.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("_r") <= members)
    ids = smallest.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    sums = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum(is_query.cast("bigint")).alias("n_query"))
    found = stage(ids.join(sums, "v").select(F.col("ids")[0].alias("cid"), "v", "ids", "n", "n_query"), "vector-classes")
    asked = join_by_key(rows.filter(is_query), found.filter("n_query > 0").select("v", "cid", F.col("n_query")), "v", "n_query", F.col("vec_id"))
    return found, stage(asked.select("vec_id", "cid"), "vector-queries")


def answers(asked: DataFrame, found: DataFrame, best: DataFrame, k: int, descending: bool) -> DataFrame:
    """(query_id, rank, vec_id, score) from the best classes of each query class.

    ``best`` is (q, cid, score): the k + 1 first classes of a query class, by score
    and then smallest id, hold the k first rows, its own not counted.
    """
    sign = -1 if descending else 1
    order = F.col("score").desc() if descending else F.col("score")
    first = best.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(order, "cid"))).filter(F.col("_r") <= k + 1).drop("_r")
    rows = first.join(found.select("cid", "ids"), "cid").select("q", F.explode("ids").alias("id"), "score")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(order, "id"))).filter(F.col("_r") <= k + 1)
    lists = rows.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((F.col("score") * sign).alias("s"), "id"))).alias("list"))
    lists = stage(lists.join(found.select(F.col("cid").alias("q"), "n_query"), "q").withColumnRenamed("q", "cid"), "vector-lists")
    out = join_by_key(asked, lists, "cid", "n_query", F.col("vec_id")).withColumnRenamed("vec_id", "query_id")
    kept = F.slice(F.filter("list", lambda e: e["id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(kept).alias("at", "e")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), (F.col("e.s") * sign).alias("score"))
