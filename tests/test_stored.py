"""Stored datasets: pages by the position index, rejects, flows, retried counts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkmill.plans import lifecycle
from sparkmill.plans.pipeline import cleaning_report, marked_report, register_node, run_marked, run_pipeline, NODE_REGISTRY
from sparkmill.sources import readers, stored

from .conftest import rows


def ordered_lines(path):
    out = []
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            with open(os.path.join(path, name), encoding="utf-8") as fh:
                out += [x.strip() for x in fh.read().split("\n")]
    return [x for x in out if x and valid(x)]


def valid(x):
    try:
        json.loads(x, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return False
    return True


@pytest.mark.parametrize("split", [300, 100_000])
def test_every_page_of_a_stored_dataset(spark, tmpdir_fresh, split, monkeypatch):
    monkeypatch.setattr(stored, "FILE_ROWS", 60)
    path = os.path.join(tmpdir_fresh, "d")
    line = F.when(F.col("id") % 7 == 3, "not json").when(F.col("id") % 11 == 5, "").otherwise(F.to_json(F.struct("id", F.repeat(F.lit("x"), (F.col("id") % 30).cast("int")).alias("t"))))
    df = spark.range(500, numPartitions=3).select(line.alias("line"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        stored.write_dataset(df, path)
        want = ordered_lines(path)
        assert stored.total_rows(spark, path) == len(want)
        got = []
        for page in range(1, len(want) // 37 + 3):
            found = stored.preview_page(spark, path, page, 37)
            part = rows(found, "row_ord", "line", "total")
            assert all(t == len(want) for *_, t in part)
            got += [(k, x) for k, x, _ in part]
        assert got == list(enumerate(want))
        plan = stored.preview_page(spark, path, 2, 37)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    with pytest.raises(ValueError):
        stored.preview_page(spark, path, 0)


def test_empty_and_all_rejected_uploads(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "in.jsonl")
    for text, rejected in (("", 0), ("\n\n", 0), ("nope\n[1]\n5\n{\"a\":NaN}\n", 4)):
        with open(src, "w", encoding="utf-8") as fh:
            fh.write(text)
        dest = os.path.join(tmpdir_fresh, f"out{rejected}{len(text)}")
        got = lifecycle.ingest(spark, src, "jsonl", dest).first()
        assert (got["row_count"], got["rejected_lines"], got["schema_json"]) == (0, rejected, "{}")
        assert stored.preview_page(spark, dest).count() == 0


def test_records_are_stored_as_they_stood(spark, tmpdir_fresh):
    src, dest = os.path.join(tmpdir_fresh, "in.jsonl"), os.path.join(tmpdir_fresh, "out")
    texts = ['{"b": 1.50, "a":12345678901234567890123456789}', '{"a":1,"a":2}', ' {"x y":{"k":[1, 2]}} ', "bad", '"text"']
    with open(src, "w", encoding="utf-8") as fh:
        fh.write("\n".join(texts))
    got = lifecycle.ingest(spark, src, "json", dest).first()
    assert (got["row_count"], got["rejected_lines"], json.loads(got["schema_json"])) == (3, 2, {"a": "int", "b": "float"})
    assert sorted(ordered_lines(dest)) == sorted(t.strip() for t in texts[:3])
    rejects = [json.loads(r["value"]) for r in spark.read.text(dest + ".rejects").collect()]
    assert sorted((r["reason"], r["line"]) for r in rejects) == [("malformed", "bad"), ("not_object", '"text"')]
    # of repeated keys the last counts; keys may hold dots
    recs = readers.records_as_columns(readers.parse_json_lines(spark.createDataFrame([('{"a":1,"a":2,"q.r":"dot"}',)], "line string")), {"a": "bigint", "q.r": "string"})
    assert recs.first().asDict() == {"a": 2, "q.r": "dot"}


def test_array_elements_and_their_rejects(spark):
    df = spark.createDataFrame([('[{"a":1}, 5, {"b": 2}]',)], "line string")
    got = rows(readers.json_records(df, flatten_arrays=True), "elem", "raw", "reason")
    assert got == [(0, '{"a":1}', None), (1, "5", "not_object"), (2, '{"b":2}', None)]


def test_csv_cells_beyond_the_header_are_kept(spark, tmpdir_fresh):
    src, dest = os.path.join(tmpdir_fresh, "in.csv"), os.path.join(tmpdir_fresh, "out")
    with open(src, "w", encoding="utf-8") as fh:
        fh.write("a,b\n1,2,3,4\n5\n")
    got = lifecycle.ingest(spark, src, "csv", dest).first()
    assert (got["row_count"], got["rejected_lines"]) == (2, 1)
    assert sorted(ordered_lines(dest)) == ['{"a":"1","b":"2","null":["3","4"]}', '{"a":"5","b":""}']


NODES = [{"node_type": "dedup", "params": {"key": "t"}}, {"node_type": "length_filter", "params": {"field": "t", "min_length": 2}},
         {"node_type": "every_other"}, {"node_type": "pii_redact", "params": {"fields": ["t"]}}, {"node_type": "dedup", "params": {}},
         {"node_type": "regex_filter", "params": {"field": "t", "pattern": "z", "mode": "exclude"}}]


def test_marks_equal_the_stages(spark, monkeypatch):
    monkeypatch.setitem(NODE_REGISTRY, "every_other", None)
    register_node("every_other", lambda df, order_col="ord", **_: df.filter(F.col(order_col) % 2 == 0))
    words = ["aa", "b", "a@b.co", "c@d.co", "zz", None, "mm", "aa", "q"]
    df = spark.createDataFrame([(i, words[i % 9], "same") for i in range(60)], "ord bigint, t string, u string")
    marked = run_marked(df, NODES)
    assert marked.count() == 60
    kept = rows(marked.filter("dropped is null"), "ord", "t", "u")
    assert kept == rows(run_pipeline(df, NODES, optimize=False), "ord", "t", "u")
    assert rows(marked_report(marked, NODES), "stage", "node_type", "rows") == rows(cleaning_report(df, NODES), "stage", "node_type", "rows")


def test_keyed_dedup_has_no_sort_aggregate(spark):
    from sparkmill.operators import cleaning
    df = spark.range(1000).select(F.col("id").alias("ord"), (F.col("id") % 10).cast("string").alias("t"), F.lit("x").alias("u"))
    out = cleaning.dedup(df, key="t")
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out, "ord") == [(i,) for i in range(10)]
    twice = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "a", "z"), (1, "b", "w"), (3, None, "n"), (4, None, "n"), (5, None, "m")], "ord bigint, t string, u string")
    assert rows(cleaning.dedup(twice, key="t"), "ord", "t") == [(1, "a"), (1, "b"), (3, None), (5, None)]
