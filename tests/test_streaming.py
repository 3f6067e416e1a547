"""Streams over several micro-batches give the batch answer."""

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparkmill.operators import limits
from sparkmill.plans import catalog
from sparkmill.plans import fixtures as FX
from sparkmill.streaming import limiter
from sparkmill.streaming.runner import read_stream, run_append, write_stream_files

from .conftest import SF001, SF01, rows


def test_limiter_stream_with_late_requests_equals_batch(spark):
    req = FX.requests(spark, SF01).select("event_id", F.nullif(F.col("client") % 30, F.lit(7)).alias("client"), (F.col("us") - F.col("us") % 600_000_000).alias("us"))
    w1, w2 = 6 * 3600 * 1_000_000, 48 * 3600 * 1_000_000
    batch = limits.rate_limit_two_tier(req, minute_us=w1, per_minute=2, hour_us=w2, per_hour=4)
    schema = StructType([StructField(c, LongType()) for c in ("event_id", "client", "us")])
    late = limiter.with_heartbeat(req, lateness_us=3 * 3600 * 1_000_000).withColumn(
        "arrived", F.when(F.col("event_id").isNull(), F.col("us")).otherwise(F.col("us") + F.pmod(F.xxhash64("event_id"), F.lit(7200)) * 1_000_000))
    path = write_stream_files(late, "t-req", batches=7, order_col="arrived", in_order=True, files_per_batch=3)
    s = limiter.rate_limit_stream(read_stream(spark, path, schema, files_per_trigger=3), minute_us=w1, per_minute=2, hour_us=w2, per_hour=4, lateness="3 hours")
    got = run_append(s, "t-limiter", conf=limiter.QUERY_CONF)
    assert rows(got, "event_id", "client", "verdict", "retry_after") == rows(batch, "event_id", "client", "verdict", "retry_after")


def test_stream_files_keep_their_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    path = write_stream_files(df, "t-order", batches=4, order_col="k", in_order=True, files_per_batch=2)
    stream = read_stream(spark, path, "k long", files_per_trigger=2)
    seen = []
    q = stream.writeStream.foreachBatch(lambda d, _: seen.append(d.agg(F.min("k"), F.max("k"), F.count("k")).first())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 4 and sum(x[2] for x in seen) == 1000
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:], strict=False))


def test_metric_sink_keeps_log_messages_only(spark):
    out = catalog.QUERIES["metric_sink"](spark, SF001)
    metrics = FX.run_metrics(spark, SF001)
    assert rows(out, "run_id", "step") == rows(metrics.select("run_id", F.col("step").cast("bigint")), "run_id", "step")


def test_stream_messages_text_forwarded(spark):
    msgs = catalog.QUERIES["metric_stream"](spark, SF001)
    kinds = dict(rows(msgs.groupBy("kind").count(), "kind", "count"))
    assert set(kinds) == {"log", "evaluation", "text"}


def test_cleaning_stream_equals_batch_texts(spark):
    stream_texts = rows(catalog.QUERIES["cleaning_stream"](spark, SF001), "text")
    batch_texts = rows(catalog.QUERIES["run_pipeline"](spark, SF001), "text")
    assert stream_texts == batch_texts


def test_control_fold_and_per_run_routing(spark):
    state = dict(rows(catalog.QUERIES["control_events"](spark, SF001), "run_id", "status"))
    runs = {r["id"]: r["status"] for r in FX.training_runs(spark, SF001).collect()}
    want = {k: v for k, v in runs.items() if v in ("training", "paused", "cancelled")}
    assert state == want
    routed = catalog.QUERIES["metric_stream_per_run"](spark, SF001)
    assert {r["subscriber"] for r in routed.select("subscriber").distinct().collect()} <= set(runs)
    assert routed.count() == catalog.QUERIES["metric_stream"](spark, SF001).count()


def test_stream_dedup_keyless_rows_use_full_row_identity(spark):
    from pyspark.sql.types import StringType, StructField, StructType

    from sparkmill.streaming.cleaning import run_stream_pipeline
    rows_in = [(0, None, "a"), (1, None, "a"), (2, None, "b"), (3, "k", "x"), (4, "k", "y")]
    df = spark.createDataFrame(rows_in, "ord long, id string, text string")
    path = write_stream_files(df, "t-dedup", batches=2, order_col="ord", in_order=True, files_per_batch=1)
    schema = StructType([StructField("ord", LongType()), StructField("id", StringType()), StructField("text", StringType())])
    out = run_append(run_stream_pipeline(read_stream(spark, path, schema, files_per_trigger=1),
                                         [{"node_type": "dedup", "params": {"key": "id"}}]), "t-dedup-out")
    got = rows(out, "id", "text")
    assert got == [(None, "a"), (None, "b"), ("k", "x")]


def test_first_copy_wins_in_any_order_and_state_expires(spark):
    from sparkmill.streaming.cleaning import run_stream_pipeline
    # (ord, text, second): copies arrive out of order; "a" comes again long after its run has ended; the last record ends all runs.
    arrival = [(5, "a", 50), (2, "a", 20), (3, "x", 30), (9, "b", 90), (8, "b", 80), (1, "a", 10), (60, "a", 5000), (70, "z", 90_000)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(arrival)], "k long, ord long, text string, t long").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000)).drop("t")
    path = write_stream_files(df, "t-first", batches=8, order_col="k", in_order=True, files_per_batch=1)
    stream = read_stream(spark, path, df.schema, files_per_trigger=1).drop("k")
    nodes = [{"node_type": "dedup", "params": {"key": "text"}}, {"node_type": "regex_filter", "params": {"pattern": "[xz]", "mode": "exclude"}}]
    out = run_stream_pipeline(stream, nodes, event_time="ts", within="100 seconds", lateness="100 seconds")
    assert rows(run_append(out, "t-first-out", conf=limiter.QUERY_CONF), "ord", "text") == [(1, "a"), (8, "b"), (60, "a")]


def test_stream_dedup_within_watermark(spark):
    from pyspark.sql.types import StringType, StructField, StructType, TimestampType

    from sparkmill.streaming.cleaning import stream_dedup
    # One record per micro-batch; the watermark moves between batches.
    rows_in = [(0, "a", 0), (1, "a", 60), (2, "b", 120), (3, "c", 100_000), (4, "d", 100_030), (5, "a", 100_060)]
    df = (spark.createDataFrame(rows_in, "ord long, text string, t long")
          .withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000)).drop("t"))
    path = write_stream_files(df, "t-wm", batches=6, order_col="ord", in_order=True, files_per_batch=1)
    schema = StructType([StructField("ord", LongType()), StructField("text", StringType()),
                         StructField("ts", TimestampType())])
    s = stream_dedup(read_stream(spark, path, schema, files_per_trigger=1), key="text", event_time="ts",
                     within="1 hour")
    got = rows(run_append(s, "t-wm-out"), "ord", "text")
    # The copy one minute later is dropped.  "c" moves the watermark a day on;
    # expired state is evicted at the end of the following batch, after which a
    # new "a" is kept (copies are recognised at least within the horizon).
    assert got == [(0, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "a")]


def test_metric_rows_are_aggregated_once_and_messages_not_shuffled(spark, tmp_path):
    from sparkmill.streaming import metrics

    # (run, line, discount, tax): a repeated line is one step, a seventh line has no loss, a null tax no evaluation.
    lines = [(1, 1, 0.5, 0.1), (1, 1, 0.25, 0.2), (1, 7, 0.5, 0.0), (2, 2, 0.75, None), (None, 3, 0.5, 0.1)]
    df = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_discount double, l_tax double").select(
        "*", F.lit(3.0).alias("l_quantity"), F.lit("A").alias("l_returnflag"), F.lit("2024-01-01").cast("date").alias("l_shipdate"))
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    sent = catalog._envelopes(FX.run_metrics(spark, str(tmp_path)))
    plan = sent._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    one, two = "training:1:metrics", "training:2:metrics"
    got = catalog.QUERIES["metric_stream"](spark, str(tmp_path))
    assert rows(got, "channel", "seq", "kind", "step", "loss", "val_loss") == rows(spark.createDataFrame([
        (one, 20, "log", 10, 0.25, None), (one, 21, "evaluation", 10, None, 0.1), (one, 140, "log", 70, None, None),
        (one, 141, "evaluation", 70, None, 0.0), (one, 1140, "text", None, None, None), (two, 40, "log", 20, 0.75, None),
        (None, 60, "log", 30, 0.5, None), (None, 61, "evaluation", 30, None, 0.1)],
        "channel string, seq long, kind string, step long, loss double, val_loss double"))
    names = spark.createDataFrame([(one,), ("training:-5:metrics",), ("training:01:metrics",), ("training:1:metrics\n",), ("training::metrics",),
                                   ("training:9999999999999999999:metrics",), ("x",), (None,)], "channel string")
    assert [r[0] for r in names.select(metrics.run_of(F.col("channel"))).collect()] == [1, -5, *[None] * 6]


def test_clients_of_a_bucket_are_judged_each_by_itself():
    import numpy as np

    rng = np.random.default_rng(5)
    client, us = rng.integers(0, 40, 3000) * 3, rng.integers(0, 2000, 3000)
    order = np.lexsort((us, client))
    client, us = client[order], us[order]
    before = sorted({(int(c), int(t)) for c, t in zip(rng.integers(0, 150, 500), rng.integers(-300, 0, 500), strict=True)})
    of, members = (np.array([m[k] for m in before], np.int64) for k in (0, 1))
    prior, oldest, (who, times) = limiter.Limiter._tier(client, us, of, members, 250)
    assert list(zip(who.tolist(), times.tolist(), strict=True)) == sorted({*before, *zip(client.tolist(), us.tolist(), strict=True)})
    for k in range(0, 3000, 37):
        same = client == client[k]
        inside = sorted({t for c, t in before if c == client[k] and t > us[k] - 250} | {int(t) for t in us[same & (us > us[k] - 250) & (us <= us[k])]})
        again = int(k > 0 and client[k - 1] == client[k] and us[k - 1] == us[k])
        assert (prior[k], oldest[k]) == (len(inside) - 1 + again, inside[0])
