"""Python patterns in Java's spelling, chunk cuts, folds of any field, full details."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sparkmill.functions.text import java_pattern, py_search
from sparkmill.operators import registry, sections

from .conftest import rows

PATTERNS = [r"[^[]b", r"a{,2}c", r"(?P<first_name>a+)b(?P=first_name)", r"[a&&b]", r"(?<=a)b", r"(?<!a)b", r"(?=ab)a", r"(?!ab)a", r"a|b|", r"[]a]", r"[^]a]",
            r"x*?y", r"a++b", r"(?>a+)b", r"\Aab", r"ab\Z", r"^a$", r"(?m:^b$)", r"(?s:a.b)", r"(?i:AB)", r"(a)|(b)\2", r"\d+\s\D", r"[\w.-]+@", r"[\W\d]c", r"\bab\b", r"\Bb",
            r"[a-c\-x]+", r"\x41|é", r"\.\*\$\^\{\}", r"(?x) a b # comment", r"a(?#note)b", r"[\]\\\[]", r"é+", r"(?-i:A)b", r"\s\S\s"]


def test_patterns_agree_with_python(spark):
    r = random.Random(11)
    bits = ["a", "b", "c", "A", "B", "x", "y", "ab", "é", "É", " ", "\n", "[", "]", "&", ".", "*", "$", "^", "{", "}", "\\", "-", "@", "1", "_", "\x1c", "{,2}"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 9))) for _ in range(1500)] + [""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    got = df.select("i", *[py_search("t", p).alias(f"p{k}") for k, p in enumerate(PATTERNS)]).orderBy("i").collect()
    for k, p in enumerate(PATTERNS):
        wrong = [t for t, row in zip(texts, got, strict=True) if row[f"p{k}"] != (re.search(p, t, re.IGNORECASE) is not None)]
        assert not wrong, (p, java_pattern(p), wrong[:5])


@pytest.mark.parametrize("pattern,error", [("(", re.error), ("[", re.error), ("a**", re.error), (r"(?P<1>a)", re.error), (r"(a)?(?(1)b|c)", ValueError), ("(?a)x", ValueError)])
def test_what_cannot_be_said_is_refused_with_the_plan(spark, pattern, error):
    with pytest.raises(error):
        py_search("t", pattern)


def test_cuts_are_greedy_and_linear(spark):
    def brute(sizes, limit):
        out, held = [], 0
        for i, n in enumerate(sizes):
            if i and held + n > limit:
                out.append(i)
                held = 0
            held += n
        return out

    import numpy as np
    r = random.Random(2)
    for _ in range(300):
        sizes = [r.randrange(1, 30) for _ in range(r.randrange(0, 40))]
        assert sections._cuts(np.array(sizes, np.int64), 25) == brute(sizes, 25)
    many = "\n\n".join(f"p{i}" for i in range(100_000))
    df = spark.createDataFrame([(1, "s", many, "x"), (2, None, None, "y"), (3, "t", "", "z"), (4, "u", "one", None)], "doc_id int, source string, text string, metadata string")
    began = time.monotonic()
    out = sections.parse_text(df, chunk_size=1000)
    assert out.columns == ["text", "source", "metadata"]
    got = out.groupBy("source").agg(F.count("text").alias("n"), F.max("metadata.chunk").alias("last"), F.sum(F.size(F.split("text", "\n\n"))).alias("paragraphs")).collect()
    assert {(x["source"], x["n"] - 1 == x["last"], x["paragraphs"]) for x in got} == {("s", True, 100_000), ("u", True, 1)}
    assert time.monotonic() - began < 30


def test_any_field_can_be_set_back_to_null(spark):
    df = spark.createDataFrame([("a", 1, {"x": "1", "y": "2"}), ("a", 2, {"x": None}), ("a", 3, {"z": "9"}), ("b", 1, {"x": None}), ("b", 2, {}), ("c", 5, None), (None, 1, {"y": "0"})],
                               "k string, ord int, changes map<string,string>")
    folded = registry.open_fold(df, key="k", ord_col="ord")
    assert rows(folded, "k", "field", "value") == [(None, "y", "0"), ("a", "x", None), ("a", "y", "2"), ("a", "z", "9"), ("b", "x", None)]
    wide = registry.pivot_fields(folded, {"x": "int", "y": "int", "q": "string"}, key="k")
    assert rows(wide, "k", "x", "y", "q") == [(None, None, 0, None), ("a", None, 2, None), ("b", None, None, None)]


def test_run_state_folds_all_fields_it_has(spark):
    df = spark.createDataFrame([(1, 1, "queued", None, None, 1.5, 10), (1, 2, "training", 5, "w1", None, None), (1, 3, None, None, "w2", 2.5, None)],
                               "run_id int, ord int, status string, current_step int, worker_id string, cost_credits double, gpu_seconds int").withColumn("ts", F.timestamp_seconds("ord"))
    got = registry.run_current_state(df).first()
    assert (got["status"], got["current_step"], got["worker_id"], got["cost_credits"], got["gpu_seconds"]) == ("training", 5, "w2", 2.5, 10)


def test_run_detail_has_all_checkpoint_fields(spark):
    runs = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    ckpt = spark.createDataFrame([(10, 1, 5, 0.5, True), (11, 1, 6, 0.4, False)], "id int, run_id int, step int, val_loss double, is_best boolean")
    got = rows(registry.run_detail(runs, ckpt), "id", "checkpoint_id", "checkpoint_step", "checkpoint_val_loss", "checkpoint_is_best")
    assert got == [(1, 10, 5, 0.5, True), (1, 11, 6, 0.4, False), (2, None, None, None, None)]
