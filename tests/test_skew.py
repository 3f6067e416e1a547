"""One key holding a third of all rows: results stay whole and exact."""

from pyspark.sql import functions as F

from sparkmill.operators import cleaning, registry

from .conftest import rows

N = 30_000


def skewed(spark):
    # key 0 holds a third of the rows; the rest are spread over 1000 keys
    return spark.range(N).select(
        F.col("id").alias("ord"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000 + 1).alias("k"),
        (F.col("id") % 7).cast("string").alias("text"))


def test_dedup_hot_key(spark):
    df = skewed(spark)
    by_key = {r["k"]: r["ord"] for r in cleaning.dedup(df, key="k").collect()}
    assert by_key[0] == 0 and len(by_key) == 1001
    full = cleaning.dedup(df.select("ord", "k"))
    assert full.count() == 1001


def test_state_fold_hot_run(spark):
    ev = skewed(spark).select(F.col("k").alias("run_id"), "ord", F.timestamp_seconds("ord").alias("ts"),
                              F.when(F.col("ord") % 2 == 0, "training").otherwise("paused").alias("status"),
                              F.lit(None).cast("string").alias("error_message"),
                              F.col("ord").cast("int").alias("current_step"), F.lit(None).cast("int").alias("total_steps"))
    hot = registry.run_current_state(ev).filter("run_id = 0").first()
    last = (N - 1) // 3 * 3
    assert hot["current_step"] == last and hot["status"] == ("training" if last % 2 == 0 else "paused")


def test_run_detail_hot_run_keeps_every_row(spark):
    runs = spark.range(0, 1002).select(F.col("id").alias("id"), F.lit("x").alias("status"))
    ck = skewed(spark).select(F.col("ord").alias("id"), F.col("k").alias("run_id"), F.col("ord").alias("step"))
    out = registry.run_detail(runs, ck)
    assert out.count() == N + 1  # every checkpoint once, plus run 1001 with none
    assert out.filter("id = 0").count() == N // 3


def test_top_k_per_hot_group(spark):
    df = skewed(spark).withColumn("created_at", F.timestamp_seconds("ord")).withColumnRenamed("ord", "id")
    page = registry.page_by_group(df, "k", offset=0, limit=3)
    assert rows(page.filter("k = 0"), "id") == [(N - 9,), (N - 6,), (N - 3,)]
