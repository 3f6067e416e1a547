"""Ingest → clean → format, end to end on files."""

import json
import os

from sparkmill.plans import lifecycle

from .conftest import rows


def lines(path):
    out = []
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            with open(os.path.join(path, name), encoding="utf-8") as fh:
                out += [json.loads(x) for x in fh if x.strip()]
    return out


def test_ingest_clean_format(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "up.csv")
    with open(src, "w", encoding="utf-8") as fh:
        fh.write("question,answer,n\n")
        fh.write("What is 2+2? mail me at a@b.co,It is four.,1\n")
        fh.write("What is 2+2? mail me at a@b.co,Duplicate question.,2\n")
        fh.write("hi,,3\n")
        fh.write("Où est la bibliothèque?,À gauche.,4\n")
    raw = os.path.join(tmpdir_fresh, "up.jsonl")
    stats = lifecycle.ingest(spark, src, "csv", raw).first()
    assert stats["row_count"] == 4
    assert json.loads(stats["schema_json"]) == {"question": "str", "answer": "str", "n": "str"}

    cleaned = os.path.join(tmpdir_fresh, "up_cleaned.jsonl")
    nodes = [{"node_type": "dedup", "params": {"key": "question"}},
             {"node_type": "pii_redact", "params": {"fields": ["question"]}},
             {"node_type": "length_filter", "params": {"field": "answer", "min_length": 1}}]
    report = rows(lifecycle.clean(spark, raw, nodes, cleaned), "stage", "rows")
    assert report == [(0, 4), (1, 3), (2, 3), (3, 2)]
    recs = lines(cleaned)
    assert sorted(r["n"] for r in recs) == ["1", "4"]
    assert any(r["question"] == "What is 2+2? mail me at [REDACTED]" for r in recs)

    out = os.path.join(tmpdir_fresh, "up_formatted.jsonl")
    res = lifecycle.format_dataset(spark, cleaned, out, user_column="question", assistant_column="answer").first()
    assert res["formatted_rows"] == 2
    want = sum(len(r["question"]) // 4 + len(r["answer"]) // 4 for r in recs)
    assert res["total_tokens"] == want
    assert sorted(lines(out), key=lambda r: r["user"])[0].keys() == {"user", "assistant"}
    bpe = lifecycle.format_dataset(spark, cleaned, os.path.join(tmpdir_fresh, "b.jsonl"), user_column="question",
                                   assistant_column="answer", tokenizer="byte_bpe_50k").first()
    assert bpe["formatted_rows"] == 2 and bpe["total_tokens"] > 0


def test_format_omits_absent_system(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "in.jsonl")
    with open(src, "w", encoding="utf-8") as fh:
        fh.write('{"s": "be brief", "q": "hi", "a": "hello"}\n{"q": "yo", "a": "hey"}\n{"q": "", "a": "x"}\n')
    out = os.path.join(tmpdir_fresh, "out.jsonl")
    res = lifecycle.format_dataset(spark, src, out, user_column="q", assistant_column="a", system_column="s").first()
    assert res["formatted_rows"] == 2
    recs = sorted(lines(out), key=lambda r: r["user"])
    assert recs == [{"system": "be brief", "user": "hi", "assistant": "hello"}, {"user": "yo", "assistant": "hey"}]


def test_ingest_jsonl_counts_rejected(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "in.jsonl")
    with open(src, "w", encoding="utf-8") as fh:
        fh.write('{"a": 1}\n[{"a": 2}, {"a": 3}]\nbad\n5\n\n{"a": NaN}\n')
    r = lifecycle.ingest(spark, src, "jsonl", os.path.join(tmpdir_fresh, "out.jsonl")).first()
    assert (r["row_count"], r["rejected_lines"]) == (3, 3)
    assert json.loads(r["schema_json"]) == {"a": "int"}


def test_ingest_csv_counts_rows_with_extra_cells(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "in.csv")
    with open(src, "w", encoding="utf-8") as fh:
        fh.write('a,b\n1,2\n3,4,5\n"x\ny",6,7,8\n9\n')
    r = lifecycle.ingest(spark, src, "csv", os.path.join(tmpdir_fresh, "out.jsonl")).first()
    assert (r["row_count"], r["rejected_lines"]) == (4, 2)
