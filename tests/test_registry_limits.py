"""Registry operators and sliding-window limits (vs an event-by-event simulation)."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkmill.operators import limits, registry
from sparkmill.plans import fixtures as FX

from .conftest import SF01, rows

HOUR = 3600 * 1_000_000


def simulate(events, w1, m1, w2, m2):
    """Sorted-set limiter, request by request: the verdict and Retry-After per event."""
    sets1, sets2 = defaultdict(set), defaultdict(set)
    out = {}
    for ev, client, us in sorted(events, key=lambda e: (e[2], e[0])):
        s1 = {t for t in sets1[client] if t > us - w1}
        n1 = len(s1)
        s1.add(us)
        sets1[client] = s1
        if n1 >= m1:
            out[ev] = ("minute", max((w1 - (us - min(s1))) // 1_000_000, 1))
            continue
        s2 = {t for t in sets2[client] if t > us - w2}
        n2 = len(s2)
        s2.add(us)
        sets2[client] = s2
        out[ev] = ("hour", max((w2 - (us - min(s2))) // 1_000_000, 1)) if n2 >= m2 else ("ok", None)
    return out


def test_two_tier_matches_simulation(spark):
    req = FX.requests(spark, SF01).select("event_id", "client", "us")
    events = [(r["event_id"], r["client"], r["us"]) for r in req.collect()]
    want = simulate(events, 6 * HOUR, 2, 48 * HOUR, 4)
    got = limits.rate_limit_two_tier(req, minute_us=6 * HOUR, per_minute=2, hour_us=48 * HOUR, per_hour=4)
    got = {r["event_id"]: (r["verdict"], r["retry_after"]) for r in got.collect()}
    assert got == want
    verdicts = [v for v, _ in want.values()]
    assert (verdicts.count("minute"), verdicts.count("hour")) == (1077, 4758)


def test_one_hot_client_exact(spark):
    # One client holding every request: the time ranges split it, results stay exact.
    base = [(i, 7, i * 13 * 60 * 1_000_000 // 7) for i in range(3000)]
    df = spark.createDataFrame(base, "event_id long, client long, us long")
    want = simulate(base, HOUR, 5, 6 * HOUR, 20)
    got = limits.rate_limit_two_tier(df, minute_us=HOUR, per_minute=5, hour_us=6 * HOUR, per_hour=20)
    assert {r["event_id"]: (r["verdict"], r["retry_after"]) for r in got.collect()} == want


def test_single_window(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 1, 10), (3, 1, 20), (4, 1, 100), (5, 2, 5)],
                               "event_id long, client long, us long")
    got = rows(limits.rate_limit_window(df, window_us=100, max_requests=2), "event_id", "prior_count", "allowed")
    # window (t-100, t]: at t=100 the request at 0 has left.
    assert got == [(1, 0, True), (2, 1, True), (3, 2, False), (4, 2, False), (5, 0, True)]


@pytest.mark.parametrize("ranges", [1, 3, 11])
def test_ties_and_cuts_anywhere(spark, ranges):
    # Many requests at few instants of few clients: members are distinct times, judged by id; ranges cut inside instants.
    r = random.Random(ranges)
    base = [(i, r.choice([1, 2, -5]), r.choice([0, 10, 20, 21, 30, 95, 100, 101, 200]) + 300 * r.randrange(3)) for i in range(400)]
    df = spark.createDataFrame(base, "event_id long, client long, us long")
    for w1, m1, w2, m2 in ((100, 2, 400, 3), (15, 1, 30, 2), (1000, 5, 2000, 4)):
        got = limits.rate_limit_two_tier(df, minute_us=w1, per_minute=m1, hour_us=w2, per_hour=m2, ranges=ranges).collect()
        assert {x["event_id"]: (x["verdict"], x["retry_after"]) for x in got} == simulate(base, w1, m1, w2, m2)
    three = spark.createDataFrame([(1, 1, 0), (2, 1, 10), (3, 1, 10)], "event_id long, client long, us long")
    assert rows(limits.rate_limit_window(three, window_us=100, max_requests=2), "event_id", "prior_count", "allowed") == [
        (1, 0, True), (2, 1, True), (3, 2, False)]


def test_null_times_clients_and_empty_logs(spark):
    df = spark.createDataFrame([(1, None, 0, "a"), (2, None, 5, "b"), (3, 1, None, "c"), (4, 1, 5, None), (None, 1, 6, "e")],
                               "event_id long, client long, us long, `q.x` string")
    got = rows(limits.rate_limit_window(df, window_us=100, max_requests=1), "event_id", "prior_count", "allowed")
    assert got == [(None, 1, False), (1, 0, True), (2, 1, False), (3, None, None), (4, 0, True)]
    two = limits.rate_limit_two_tier(df, minute_us=100, per_minute=1, hour_us=100, per_hour=1).collect()
    assert {(x["event_id"], x["verdict"]) for x in two} == {(None, "minute"), (1, "ok"), (2, "minute"), (3, None), (4, "ok")}
    assert limits.rate_limit_two_tier(df.limit(0)).count() == 0


def test_one_window_of_one_client_is_linear(spark):
    # 200,000 requests of one client in one window: each sees the time's count before it.
    n = 200_000
    df = spark.range(n, numPartitions=4).select(F.col("id").alias("event_id"), F.lit(1).cast("bigint").alias("client"), (F.col("id") * 3).alias("us"))
    began = time.monotonic()
    got = limits.rate_limit_window(df, window_us=HOUR, max_requests=1000, ranges=4)
    wrong = got.filter((F.col("prior_count") != F.col("event_id")) | (F.col("allowed") != (F.col("event_id") < 1000))).count()
    assert wrong == 0 and got.count() == n
    assert time.monotonic() - began < 60  # a frame per request took minutes


def test_estimate_cost(spark):
    df = spark.createDataFrame([("T4", 1, -1, 3), ("A100_80GB", 2, 1000, 1), ("H100", 1, 250, 1)],
                               "gpu_type string, gpu_count int, max_steps int, num_epochs int")
    got = [r["estimated_cost"] for r in registry.estimate_cost(df).collect()]
    assert got == [30.0, 140.0, 10.0]


def test_log_lines(spark):
    df = spark.createDataFrame([(1, 10, 0.5, 0.0), (1, 20, 0.123456, 0.25), (1, 30, None, 0.1)],
                               "run_id long, step long, loss double, val_loss double")
    got = rows(registry.run_log_lines(df), "step", "message")
    assert got == [(10, "Step 10 — loss: 0.5000"), (20, "Step 20 — loss: 0.1235, val_loss: 0.2500")]


def test_client_key(spark):
    df = spark.createDataFrame([("Bearer abcdefghijklmnopq", "1.1.1.1", "h"), (None, " 2.2.2.2 , 3.3.3.3", "h"),
                                ("Basic x", "", "h"), (None, None, None)], "a string, f string, h string")
    got = [r["k"] for r in df.select(registry.client_key(F.col("a"), F.col("f"), F.col("h")).alias("k")).collect()]
    assert got == ["abcdefghijklm", "2.2.2.2", "h", "unknown"]


def test_run_state_fold(spark):
    ev = spark.createDataFrame([
        (1, 1, 100, "queued", None, None), (1, 2, 200, "training", None, 10), (1, 3, 300, None, "boom", 20),
        (1, 4, 400, "training", None, None), (1, 5, 500, "failed", None, None)],
        "run_id long, ord long, t long, status string, error_message string, current_step int")
    ev = ev.withColumn("ts", F.timestamp_seconds("t")).withColumn("total_steps", F.lit(None).cast("int"))
    r = registry.run_current_state(ev).first()
    assert (r["status"], r["error_message"], r["current_step"]) == ("failed", "boom", 20)
    assert r["started_at"].timestamp() == 200 and r["finished_at"].timestamp() == 500


def test_dataset_state_status_clears_error(spark):
    up = spark.createDataFrame([(1, 1, "update", None, 5, "bad"), (1, 2, "status", "ready", None, None)],
                               "dataset_id long, ord long, kind string, status string, row_count long, error_message string")
    up = up.withColumn("ts", F.timestamp_seconds("ord"))
    r = registry.dataset_current_state(up).first()
    assert (r["status"], r["row_count"], r["error_message"]) == ("ready", 5, None)


def test_guards_and_gate(spark):
    req = spark.createDataFrame([(1, "pause"), (2, "resume"), (3, "cancel"), (4, "cancel"), (9, "pause")],
                                "id long, action string")
    cur = spark.createDataFrame([(1, "training"), (2, "training"), (3, "queued"), (4, "completed")],
                                "id long, status string")
    got = rows(registry.status_transition_guard(req, cur), "id", "allowed", "verdict")
    assert got == [(1, True, "ok"), (2, False, "bad_status"), (3, True, "ok"), (4, False, "bad_status"),
                   (9, False, "not_found")]
    runs = spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "id long, dataset_id long")
    ds = spark.createDataFrame([(10, "ready"), (11, "failed"), (12, None)], "id long, status string")
    assert rows(registry.dataset_ready_gate(runs, ds), "run_id", "verdict") == [(1, "ok"), (2, "not_ready"), (3, "ok")]


def test_upsert_and_deletes(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    ch = spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string")
    assert rows(registry.upsert_registry(cur, ch)) == [(1, "a"), (2, "B"), (3, "c")]
    twice = spark.createDataFrame([(2, "z", 1), (2, "m", 2)], [*cur.columns, "at"])
    assert rows(registry.upsert_registry(cur, twice, order="at")) == [(1, "a"), (2, "m")]
    kids = spark.createDataFrame([(1, 1), (2, 2)], "id long, run_id long")
    assert rows(registry.cascade_delete(kids, cur.filter("id = 1"), fk="run_id"), "id") == [(2,)]
    assert rows(registry.delete_restrict(cur, kids, fk="run_id"), "id") == [(1,), (2,)]


def test_api_key_verification(spark):
    keys = spark.createDataFrame([(1, "k1", None), (1, "k1", None), (2, "k2", "x")],
                                 "endpoint_id long, raw string, revoked_at string")
    keys = keys.withColumn("key_hash", F.sha2("raw", 256))
    req = spark.createDataFrame([(1, 1, "k1"), (2, 2, "k2"), (3, 1, "nope")], "request_id long, endpoint_id long, api_key string")
    assert rows(registry.verify_api_key(req, keys), "request_id", "valid") == [(1, True), (2, False), (3, False)]


def test_iso_timestamps(spark):
    from sparkmill.functions.fmt import iso_timestamp
    df = spark.createDataFrame([(0,), (1_500_000,), (None,)], "us long").select(
        iso_timestamp(F.timestamp_micros("us")).alias("iso"))
    assert [r["iso"] for r in df.collect()] == ["1970-01-01T00:00:00", "1970-01-01T00:00:01.500000", None]


def test_model_register_and_config_merge(spark):
    runs = spark.createDataFrame([(123456789012, 3, "completed", "", "m", None, 10, 2),
                                  (5, 1, "completed", "exp", "m", "qlora", -1, 1),
                                  (6, 1, "failed", "exp", "m", "sft", 7, 1)],
                                 "id long, project_id long, status string, experiment_name string, base_model string, "
                                 "method string, max_steps int, num_epochs int")
    got = rows(registry.model_register(runs), "run_id", "name", "training_method", "s3_path")
    assert got == [(5, "exp-5", "qlora", "models/1/5/final"), (123456789012, "model-12345678", "lora",
                                                               "models/3/123456789012/final")]
    split = registry.run_config_split(runs)
    r = split.filter("id = 5").first()
    assert r["model_config"]["method"] == "qlora" and r["training_config"]["max_steps"] == -1
    assert r["training_config"]["learning_rate"] is None
    merged = registry.resume_config(split.withColumn("checkpoint_path", F.lit("ck/5")))
    c = merged.filter("id = 5").first()["config"]
    assert (c["base_model"], c["max_steps"], c["resume_checkpoint_path"]) == ("m", -1, "ck/5")


def test_global_listing_needs_a_limit(spark):
    df = spark.createDataFrame([(1, 1)], "id bigint, created_at bigint")
    with pytest.raises(ValueError):
        registry.page_by_group(df, None, limit=None)
    assert registry.page_by_group(df, None, limit=1).count() == 1


def test_endpoints_beyond_the_newest_are_found(spark):
    models = spark.createDataFrame([(1, "one", "base"), (2, "two", "base"), (3, "three", None)], "id long, name string, base_model string")
    eps = [(1, 1, "running", 1), (2, 2, "running", 2), (3, 2, "running", 2)] + [(k, 3, "stopped", k) for k in range(10, 80)]
    eps = spark.createDataFrame(eps, "id long, model_id long, status string, created_at long")
    req = spark.createDataFrame([(1, "one"), (2, "2"), (3, "base"), (4, "three"), (5, None)], "request_id long, model string")
    got = rows(registry.resolve_endpoint(req, eps, models), "request_id", "endpoint_id", "model_id")
    assert got == [(1, 1, 1), (2, 3, 2), (3, 3, 2), (4, None, None), (5, None, None)]
    assert rows(registry.model_endpoint_lookup(eps), "model_id", "endpoint_id") == [(1, 1), (2, 3), (3, 79)]
    assert rows(registry.model_endpoint_lookup(eps, search_limit=50), "model_id", "endpoint_id") == [(3, 79)]
