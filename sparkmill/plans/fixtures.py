"""Registry-shaped tables derived from the driver's tables by Spark expressions.

The reference keeps datasets, runs, checkpoints, metrics, models, endpoints
and keys in a relational store; the test data has none of them, so each is a
deterministic projection/aggregate of a TPC-H-like table (FIXTURES.md §C).
Every derivation is lazy and grows with the input tables.  The oracle module
spells the same derivations in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from ..operators.formatting import conversation_pairs

EPOCH_2024 = 1_704_067_200  # 2024-01-01T00:00:00Z

# The base-model catalogue ids (static dimension data).
BASE_MODEL_IDS = ["llama-3-8b", "mistral-7b", "phi-3-mini", "qwen-2-7b", "gemma-2-9b", "tinyllama-1.1b"]

# Fixture choices (ours): how test columns map onto registry values.
SEGMENT_STATUS = {"MACHINERY": "uploading", "BUILDING": "processing", "AUTOMOBILE": "cleaning",
                  "FURNITURE": "ready", "HOUSEHOLD": "failed"}
FILE_EXTENSIONS = [".csv", ".jsonl", ".txt", ".md", ".JSON", ""]
ORDER_STATUS_BASE = {"F": 0, "O": 3, "P": 6}
RUN_STATUS_GRID = ["queued", "provisioning", "downloading", "training", "saving", "paused", "completed",
                   "failed", "cancelled"]
PRIORITY_GPU = {"1-URGENT": "A100_80GB", "2-HIGH": "A100_40GB", "3-MEDIUM": "A10G", "4-NOT SPECIFIED": "H100",
                "5-LOW": "T4"}
ENDPOINT_STATUS_CYCLE = ["running", "running", "starting", "stopped", "failed"]
LINE_STATUS = ["provisioning", "downloading", "training", "paused", "training", "saving", "completed"]
DATASET_LINE_STATUS = ["processing", "cleaning", "ready", "failed", "ready", "cleaning", "ready"]


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def _pick(values: list, idx0: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), idx0.cast("int"))


def _ts_after_2024(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH_2024) + seconds)


def datasets(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("project_id"),
        F.col("c_name").alias("name"),
        F.concat(F.col("c_name"), _pick(FILE_EXTENSIONS, F.col("c_custkey") % 6)).alias("original_filename"),
        (F.lit(1024) * (1 + F.col("c_custkey") % 100)).cast("bigint").alias("file_size_bytes"),
        F.try_element_at(_map(SEGMENT_STATUS), F.col("c_mktsegment")).alias("status"),
        _ts_after_2024(F.col("c_custkey") * 60).alias("created_at"))


def training_runs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    status_idx = F.try_element_at(_map(ORDER_STATUS_BASE), F.col("o_orderstatus")) + k % 3
    return o.select(
        k.alias("id"),
        (F.col("o_custkey") % 25).alias("project_id"),
        # Every seventh run points at a dataset that does not exist (the gate's not_found case).
        F.when(k % 7 == 0, F.col("o_custkey") + 100_000_000).otherwise(F.col("o_custkey")).alias("dataset_id"),
        _pick(RUN_STATUS_GRID, status_idx).alias("status"),
        F.try_element_at(_map(PRIORITY_GPU), F.col("o_orderpriority")).alias("gpu_type"),
        (1 + k % 4).cast("int").alias("gpu_count"),
        F.when(k % 2 == 0, F.lit(-1)).otherwise(k % 5000).cast("int").alias("max_steps"),
        (1 + k % 3).cast("int").alias("num_epochs"),
        (1 + k % 8).cast("int").alias("batch_size"),
        (1 + F.col("o_custkey") % 4).cast("int").alias("gradient_accumulation_steps"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("exp"), (F.col("o_custkey") % 10).cast("string")))
        .alias("experiment_name"),
        _pick(BASE_MODEL_IDS, F.col("o_custkey") % 6).alias("base_model"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "qlora").when(k % 5 == 2, "sft")
        .otherwise("lora").alias("method"),
        F.col("o_orderdate").alias("created_at"))


def _line_groups(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    # "min(l_returnflag) = 'R'" as two boolean aggregates (every flag >= 'R' and
    # one equal to it): fixed-width buffers keep this a hash aggregate.
    min_is_r = (F.every(F.col("l_returnflag") >= "R") & F.some(F.col("l_returnflag") == "R"))
    return li.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_discount").alias("min_discount"), F.min("l_tax").alias("min_tax"),
        F.min("l_quantity").alias("min_quantity"), min_is_r.alias("min_flag_is_r"),
        F.min("l_shipdate").alias("first_ship"))


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    g = _line_groups(spark, sf)
    return g.select(
        F.col("l_orderkey").alias("run_id"),
        (F.col("l_linenumber") * 10).alias("step"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double")).otherwise(F.col("min_discount")).alias("loss"),
        F.col("min_tax").alias("val_loss"),
        F.col("min_quantity").alias("throughput"),
        F.col("first_ship").alias("recorded_at"))


def checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    g = _line_groups(spark, sf)
    # At most one row per (run, line number) here, so a window per run is small
    # whatever the run's size, and later per-run windows reuse its partitioning.
    best = F.min(F.when(F.col("min_flag_is_r"), F.col("l_linenumber"))).over(Window.partitionBy("l_orderkey"))
    j = g.withColumn("best_line", best)
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("run_id"),
        (F.col("l_linenumber") * 500).alias("step"),
        F.coalesce(F.col("l_linenumber") == F.col("best_line"), F.lit(False)).alias("is_best"),
        F.concat(F.lit("checkpoints/"), F.col("l_orderkey").cast("string"), F.lit("/checkpoint-"),
                 (F.col("l_linenumber") * 500).cast("string")).alias("s3_path"),
        F.col("first_ship").alias("created_at"))


def _event_ord() -> Column:
    return F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def run_status_events(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    failed = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") > 3)
    progress_only = (F.col("l_linenumber") == 2) & (F.col("l_returnflag") == "A")
    status = (F.when(failed, F.lit("failed")).when(progress_only, F.lit(None).cast("string"))
              .otherwise(_pick(LINE_STATUS, F.col("l_linenumber") - 1)))
    return li.select(
        F.col("l_orderkey").alias("run_id"), _event_ord().alias("ord"), F.col("l_shipdate").alias("ts"),
        status.alias("status"),
        F.when(failed, F.concat(F.lit("error at part "), F.col("l_partkey").cast("string"))).alias("error_message"),
        F.when(status.isNull() | (status == "training"), F.col("l_linenumber") * 100).alias("current_step"),
        F.when(F.col("l_linenumber") == 3, F.lit(700)).alias("total_steps"))


def dataset_updates(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    is_status = F.col("l_linenumber") % 2 == 1
    return j.select(
        F.col("o_custkey").alias("dataset_id"), _event_ord().alias("ord"), F.col("l_shipdate").alias("ts"),
        F.when(is_status, F.lit("status")).otherwise(F.lit("update")).alias("kind"),
        F.when(is_status, _pick(DATASET_LINE_STATUS, F.col("l_linenumber") - 1)).alias("status"),
        F.when(~is_status, F.col("l_quantity").cast("bigint")).alias("row_count"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("bad rows "), F.col("l_partkey").cast("string")))
        .alias("error_message"))


def models(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("id"), (F.col("p_size") % 25).alias("project_id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("base_model"), F.col("p_partkey").alias("run_id"),
        _ts_after_2024(F.col("p_partkey") * 60).alias("created_at"))


def endpoints(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 20).alias("model_id"),
        _pick(ENDPOINT_STATUS_CYCLE, F.col("s_suppkey") % 5).alias("status"),
        _ts_after_2024(F.col("s_suppkey") * 3600).alias("created_at"))


def api_keys(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("endpoint_id"), F.sha2(F.col("s_name"), 256).alias("key_hash"),
        F.when(F.col("s_suppkey") % 4 == 0, _ts_after_2024(F.col("s_suppkey") * 3600)).alias("revoked_at"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    et = F.col("event_type")
    uid = F.col("user_id").cast("string")
    return e.select(
        F.col("event_id"), F.col("user_id").alias("client"), F.unix_micros(F.col("ts")).alias("us"),
        F.col("ts"), et,
        F.when(et == "click", F.concat(F.lit("Bearer sk-"), F.lpad(uid, 16, "0"))).alias("auth_header"),
        F.when(et.isin("view", "purchase"), F.concat(F.lit(" 10.0."), uid, F.lit("."),
                                                     (F.col("event_id") % 256).cast("string"),
                                                     F.lit(" , 192.168.0.1"))).alias("forwarded_for"),
        F.when(et != "error", F.concat(F.lit("172.16.0."), uid)).alias("host"))


def instruction_rows(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_pairs(table(spark, sf, "conversations"))
