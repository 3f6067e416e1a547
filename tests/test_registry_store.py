"""Point lookups of stored registry tables, listings of whole groups, headers."""

import os

import pytest
from pyspark.sql import functions as F

from sparkmill.operators import registry
from sparkmill.sources import registry_store

from .conftest import rows


def test_lookup_reads_few_row_groups(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "t")
    df = spark.range(0, 400_000, 2).select("id", F.sha2(F.col("id").cast("string"), 256).alias("name"))
    registry_store.write_table(df, path, partitions=4)
    found = registry_store.lookup(spark, path, [10, 10, 200_000, 7, None])
    assert rows(found, "id") == [(10,), (200_000,)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id, [" in plan
    import pyarrow.parquet as pq
    files = [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")]
    groups = [g for f in files for g in [pq.ParquetFile(f).metadata.row_group(k) for k in range(pq.ParquetFile(f).num_row_groups)]]
    assert len(groups) > 8  # several in each file, each with its own narrow id range
    assert sum(any(g.column(0).statistics.min <= i <= g.column(0).statistics.max for i in (10, 200_000, 7)) for g in groups) <= 3


def test_lookup_of_nothing_and_of_many(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "t")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id bigint, name string")
    registry_store.write_table(df, path)
    assert registry_store.lookup(spark, path, []).count() == 0
    assert registry_store.lookup(spark, path, [None]).count() == 0
    with pytest.raises(ValueError):
        registry_store.lookup(spark, path, list(range(5000)))
    keys = spark.createDataFrame([(2,), (2,), (9,), (None,)], "id bigint")
    assert rows(registry_store.lookup_all(spark, path, keys), "id", "name") == [(2, "b")]


@pytest.mark.parametrize("newest", [False, True])
def test_whole_groups_are_ranked_without_one_task_each(spark, newest):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(1)).when(F.col("id") < 2900, F.col("id") % 5).alias("g"), (F.col("id") * 7919 % 300).alias("t"), "id")
    got = registry.page_by_group(df, "g", ts="t", limit=None, newest_first=newest)
    want = {}
    for r in df.collect():
        want.setdefault(r["g"], []).append((r["t"], r["id"]))
    expected = {(g, i): k + 1 for g, xs in want.items() for k, (_, i) in enumerate(sorted(xs, reverse=newest))}
    assert {(r["g"], r["id"]): r["rank"] for r in got.collect()} == expected
    assert got.columns == ["g", "t", "id", "rank"]


def test_headers(spark):
    keys = spark.createDataFrame([(1, "k1", None), (1, "old", "2024-01-01")], "endpoint_id int, k string, revoked_at string").withColumn("key_hash", F.sha2("k", 256)).drop("k")
    req = spark.createDataFrame([(1, 1, "Bearer k1"), (2, 1, "Bearer  k1\t"), (3, 1, "bearer k1"), (4, 1, None), (5, 1, "Bearer \n"), (6, 1, "Bearer old"), (7, 2, "Bearer k1")],
                                "request_id int, endpoint_id int, auth_header string")
    assert rows(registry.verify_header(req, keys), "request_id", "verdict") == [
        (1, "ok"), (2, "ok"), (3, "missing_header"), (4, "missing_header"), (5, "missing_key"), (6, "invalid"), (7, "invalid")]
