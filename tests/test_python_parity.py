"""Spark column expressions vs plain Python ``re`` / ``str`` on the real documents."""

import re

from pyspark.sql import functions as F

from sparkmill.functions.pii import DEFAULT_REPLACEMENT, PII_PATTERNS, redact
from sparkmill.functions.text import ascii_ratio, py_strip
from sparkmill.sources.tables import table

from .conftest import SF01


def test_redaction_matches_python_re(spark):
    d = table(spark, SF01, "documents").select("doc_id", "text", redact("text").alias("red"))
    compiled = [re.compile(p) for _, p in PII_PATTERNS]
    changed = 0
    for r in d.collect():
        want = r["text"]
        for pat in compiled:
            want = pat.sub(DEFAULT_REPLACEMENT, want)
        assert r["red"] == want, r["doc_id"]
        changed += want != r["text"]
    assert changed > 0


def test_ascii_ratio_and_strip_match_python(spark):
    d = table(spark, SF01, "documents").select(
        "text", ascii_ratio("text").alias("ratio"),
        F.transform(F.split("text", "\n", -1), lambda l: py_strip(l)).alias("stripped"))
    for r in d.collect():
        t = r["text"]
        want = (sum(1 for c in t if ord(c) < 128) / len(t)) if t else 0.0
        assert r["ratio"] == want
        assert r["stripped"] == [x.strip() for x in t.split("\n")]


def test_strip_unicode_whitespace(spark):
    s = "　 \x1c x  \x85"
    got = spark.createDataFrame([(s,)], "t string").select(py_strip("t").alias("s")).first()["s"]
    assert got == s.strip() == "x"
