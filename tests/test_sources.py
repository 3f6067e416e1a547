"""Readers and writers on files each test writes into its own fresh folder."""

import csv
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkmill.sources import readers, sinks

from .conftest import rows

JSONL_LINES = ['{"a":1,"b":null}', '[{"a":2},{"a":3}]', "bad", '{"a":NaN}', '  {"a":{"x":[1,2]}}  ', "", "5"]


def write(path, name, text, mode="w"):
    p = os.path.join(path, name)
    with open(p, mode, encoding="utf-8", newline="") as fh:
        fh.write(text)
    return p


def test_read_jsonl_skips_malformed(spark, tmpdir_fresh):
    p = write(tmpdir_fresh, "d.jsonl", "\n".join(JSONL_LINES) + "\n")
    recs = readers.read_jsonl(spark, p)
    got = sorted(r["j"] for r in recs.select(F.to_json("record").alias("j")).collect())
    assert got == ['{"a":1,"b":null}', '{"a":{"x":[1,2]}}']


def test_read_json_array_lines_flattens(spark, tmpdir_fresh):
    p = write(tmpdir_fresh, "d.jsonl", "\n".join(JSONL_LINES) + "\n")
    recs = readers.read_json_array_lines(spark, p)
    got = sorted(r["j"] for r in recs.select(F.to_json("record").alias("j")).collect())
    assert got == ['{"a":1,"b":null}', '{"a":2}', '{"a":3}', '{"a":{"x":[1,2]}}']


def test_jsonl_order_follows_file(spark, tmpdir_fresh):
    p = write(tmpdir_fresh, "d.jsonl", "\n".join(json.dumps({"i": i}) for i in range(2000)))
    recs = readers.records_as_columns(readers.read_jsonl(spark, p), {"i": "bigint"})
    ordered = [r["i"] for r in recs.orderBy("ord").collect()]
    assert ordered == list(range(2000))


def test_first_record_schema(spark, tmpdir_fresh):
    p = write(tmpdir_fresh, "d.jsonl",
              '{"s":"x","i":1,"f":1.5,"e":1e3,"b":true,"l":[1],"d":{"k":1},"n":null,'
              '"big":123456789012345678901234}\n{"other":1}\n')
    got = dict(rows(readers.first_record_schema(readers.read_jsonl(spark, p)), "key", "type_name"))
    assert got == {"s": "str", "i": "int", "f": "float", "e": "float", "b": "bool", "l": "list", "d": "dict",
                   "n": "NoneType", "big": "int"}


def test_read_csv_quotes_newlines_and_blank_rows(spark, tmpdir_fresh):
    p = write(tmpdir_fresh, "d.csv", 'a,b\n1,\n"x, ""y""\nz",2,3\n\n4\n')
    got = rows(readers.read_csv(spark, p), "a", "b")
    assert got == [("1", ""), ("4", ""), ('x, "y"\nz', "2")]


CSV_BITS = ['a', '"', '""', ',', '\n', '"x\ny"', ',"', '",', 'b c', '\r\n', '\n"', '"\n', "'"]


def csv_rows(text):
    out = []
    for cells in csv.reader(io.StringIO(text, newline="")):
        if cells:
            out.append(cells)
    return out


@pytest.mark.parametrize("split", [7, 40, 100_000])
def test_csv_ranges_cut_anywhere_equal_the_library(spark, tmpdir_fresh, split):
    # Byte ranges of 7 bytes: records begin, go on and end in different ranges, some ranges hold no record's end.
    r = random.Random(split)
    texts = ["h1,h2\n" + "".join(r.choice(CSV_BITS) for _ in range(r.randrange(0, 80))).replace("\r", "" if k % 2 else "\r") for k in range(40)]
    texts += ['h1,h2\n"' + "long\n" * 200 + 'end",x\n1,2\n', 'h1,h2\n"never closed\n1,2\n', 'h1,h2', 'h1,h2\n5" pipe,6"\n"a"b"c,"d\ne"f\n']
    want = []
    for k, text in enumerate(texts):
        try:
            rows_ = csv_rows(text.removesuffix("\n"))  # the break that ends a file is no text, even inside an open quote
        except csv.Error:
            continue
        write(tmpdir_fresh, f"{k:03}.csv", text)
        want += [(f"{k:03}.csv", [*x[:2], *[""] * (2 - len(x))], x[2:] or None) for x in rows_[1:]]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        df = readers.read_csv(spark, tmpdir_fresh, keep_extra=True)
        got = [(x["ord"]["file"].rsplit("/", 1)[1], [x["h1"], x["h2"]], x["_extra"]) for x in df.orderBy("ord").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want


def test_csv_rejects_and_tasks(spark, tmpdir_fresh):
    p = write(tmpdir_fresh, "d.csv", 'a,b\nx\ry,1\n2,3\n')
    assert rows(readers.read_csv(spark, p), "a", "b") == [("2", "3")]
    assert rows(readers.read_csv_rejects(spark, p), "text") == [("x\ry,1",)]
    empty = write(tmpdir_fresh, "e.csv", "a,b\n")
    assert readers.read_csv(spark, empty).count() == 0
    big = write(tmpdir_fresh, "big.csv", "a,b\n" + '"1\n2",3\n' * 200_000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
        df = readers.read_csv(spark, big)
        assert df.filter("a = '1\n2' and b = '3'").count() == 200_000 == df.count()
        assert readers.read_lines(spark, big).rdd.getNumPartitions() > 4  # one file, many tasks
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_round_trip_keeps_whitespace(spark, tmpdir_fresh):
    df = spark.createDataFrame([(1, '  padded "q" , x\nline2  ')], "id long, text string")
    out = os.path.join(tmpdir_fresh, "out")
    sinks.write_csv(df, out)
    assert rows(readers.read_csv(spark, out), "id", "text") == [("1", '  padded "q" , x\nline2  ')]


def test_read_txt_lines(spark, tmpdir_fresh):
    p = write(tmpdir_fresh, "d.txt", "  first  \n\n\t\nsecond\r\n third")
    assert [r["text"] for r in readers.read_txt_lines(spark, p).orderBy("ord").collect()] == ["first", "second", "third"]


def test_read_whole_text_and_document_text(spark, tmpdir_fresh):
    write(tmpdir_fresh, "a.md", "line1\r\nline2\rline3\n")
    write(tmpdir_fresh, "b.txt", "solo")
    whole = dict(rows(readers.read_whole_text(spark, tmpdir_fresh), "source", "text"))
    assert whole == {"a.md": "line1\r\nline2\rline3\n", "b.txt": "solo"}
    doc = dict(rows(readers.read_document_text(spark, tmpdir_fresh), "source", "content"))
    assert doc["a.md"] == "line1\nline2\nline3\n"


def test_convert_format_dispatch(spark, tmpdir_fresh):
    csv = write(tmpdir_fresh, "d.csv", "a,b\n1,2\n")
    txt = write(tmpdir_fresh, "d.txt", "x\n\ny\n")
    other = write(tmpdir_fresh, "d.bin", "raw bytes\nmore")
    js = write(tmpdir_fresh, "d.jsonl", "\n".join(JSONL_LINES))

    def recs(path, fmt):
        return sorted(r["j"] for r in readers.convert_format(spark, path, fmt)
                      .select(F.to_json("record").alias("j")).collect())

    assert recs(csv, "csv") == ['{"a":"1","b":"2"}']
    assert recs(txt, "txt") == ['{"text":"x"}', '{"text":"y"}']
    assert recs(other, "bin") == ['{"text":"raw bytes\\nmore"}']
    assert len(recs(js, "json")) == 4
    stats = readers.conversion_stats(readers.convert_format(spark, csv, "csv")).first()
    assert stats["row_count"] == 1 and stats["first_schema"].startswith("OBJECT")


def test_route_by_extension(spark):
    df = spark.createDataFrame([("data.CSV",), ("archive.tar.gz",), ("noext",)], "filename string")
    got = rows(readers.route_by_extension(df), "filename", "file_format", "base_name")
    assert got == [("archive.tar.gz", "gz", "archive.tar"), ("data.CSV", "csv", "data"), ("noext", "unknown", "noext")]
    parser = df.select(readers.document_parser_for(F.col("filename")).alias("p")).collect()
    assert [r["p"] for r in parser] == [None, None, None]
    md = spark.createDataFrame([("notes.Markdown",), ("r.DOC",)], "filename string")
    assert [r["p"] for r in md.select(readers.document_parser_for(F.col("filename")).alias("p")).collect()] == ["text", "docx"]


def test_write_jsonl_round_trip_with_nulls(spark, tmpdir_fresh):
    df = spark.createDataFrame([(1, None, "é\n\"q\"")], "id long, a string, t string")
    out = os.path.join(tmpdir_fresh, "o")
    sinks.write_jsonl(df, out)
    back = readers.records_as_columns(readers.read_jsonl(spark, out), {"id": "bigint", "a": "string", "t": "string"})
    assert rows(back, "id", "a", "t") == [(1, None, "é\n\"q\"")]
    raw = [r["value"] for r in spark.read.text(out).collect()]
    assert raw == ['{"id":1,"a":null,"t":"é\\n\\"q\\""}']
    assert sinks.derived_key("datasets/p/1/x.csv", "_cleaned") == "datasets/p/1/x_cleaned.jsonl"


def test_artifact_inventory(spark, tmpdir_fresh):
    os.makedirs(os.path.join(tmpdir_fresh, "sub"))
    write(tmpdir_fresh, "a.bin", "12345")
    write(os.path.join(tmpdir_fresh, "sub"), "b.bin", "1")
    got = rows(readers.artifact_inventory(spark, tmpdir_fresh), "relative_path", "size")
    assert got == [("a.bin", 5), ("sub/b.bin", 1)]


def test_dedup_on_variant_records(spark, tmpdir_fresh):
    from sparkmill.operators import cleaning
    p = write(tmpdir_fresh, "d.jsonl", '{"a":1,"t":"x"}\n{"a":2}\n{"t":"x","a":1}\n{"a":2}\n')
    recs = readers.read_jsonl(spark, p)
    out = cleaning.dedup(recs)
    got = sorted(r["j"] for r in out.select(F.to_json("record").alias("j")).collect())
    assert got == ['{"a":1,"t":"x"}', '{"a":2}']
    keyed = readers.records_as_columns(recs, {"a": "bigint"})
    assert cleaning.dedup(keyed.drop("record"), key="a").count() == 2


def test_read_pretty_printed_json(spark, tmpdir_fresh):
    write(tmpdir_fresh, "a.json", json.dumps({"a": 1, "b": [1, 2]}, indent=2))
    write(tmpdir_fresh, "b.json", json.dumps([{"a": 2}, 3, {"a": 4}], indent=2))
    # Line by line (the default, as the reference does) loses pretty-printed records.
    assert readers.read_jsonl(spark, tmpdir_fresh).count() == 0
    recs = readers.records_as_columns(readers.read_jsonl(spark, tmpdir_fresh, multiline=True), {"a": "bigint"})
    assert [r["a"] for r in recs.orderBy("ord").collect()] == [1, 2, 4]


def test_json_line_census(spark, tmpdir_fresh):
    p = write(tmpdir_fresh, "d.jsonl", "\n".join(JSONL_LINES) + "\n")
    r = readers.read_json_line_stats(spark, p).first()
    # '{"a":1,"b":null}', '  {"a":{"x":[1,2]}}  ' are objects; one array; "", trailing "" blank;
    # "bad", '{"a":NaN}' and the scalar "5" are rejected.
    assert (r["lines"], r["blank_lines"], r["object_lines"], r["array_lines"], r["rejected_lines"]) == (7, 1, 2, 1, 3)


@pytest.mark.parametrize(("most", "long"), [(10_000, 100_000), (1_000, 7)])
def test_a_source_is_many_bounded_files(spark, tmp_path, monkeypatch, most, long):
    from sparkmill.plans import catalog

    monkeypatch.setattr(catalog, "DOCS_PER_FILE", most)
    monkeypatch.setattr(catalog, "LONG_DOC", long)
    n = 2 * most + 5
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("hot").alias("source"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    files = readers.read_whole_text(spark, catalog._docs_as_files(spark, str(tmp_path)))
    found = files.select(F.regexp_count("text", F.lit("\n")), F.length("text")).collect()
    assert sum(k for k, _ in found) == n and len(found) >= 3
    assert all(k <= most and size - k <= most * long for k, size in found)
    chars = docs.agg(F.sum(F.length("text") + 1)).first()[0]
    assert [tuple(r) for r in catalog.q_whole_text(spark, str(tmp_path)).collect()] == [("hot", chars)]
    assert [tuple(r) for r in catalog.q_document_text(spark, str(tmp_path)).collect()] == [("hot", chars)]
    assert [tuple(r) for r in catalog.q_inventory(spark, str(tmp_path)).collect()] == [("hot", chars)]


def test_every_supplier_is_a_file_of_one_folder_made_by_many_tasks(spark, tmp_path):
    import glob

    from sparkmill.plans import catalog

    spark.range(3).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("text").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    names = [(1, "a"), (1, "b"), (2, None), (None, "d"), *((k, f"s{k}") for k in range(10, 60))]
    spark.createDataFrame(names, "s_suppkey long, s_name string").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    folder = catalog._convert_inputs(spark, str(tmp_path))["bin"].removeprefix("file:")
    files = [f for f in glob.glob(f"{folder}/part-*") if os.path.getsize(f)]  # a task without rows can leave an empty file, which is not read
    assert len(files) == 53 and len({os.path.basename(f)[:10] for f in files}) > 20  # a part's number is its task's
    got = sorted(r["text"] for r in catalog.q_convert_format(spark, str(tmp_path)).filter("format = 'bin'").collect())
    assert got in (sorted(["a\nb\n", "\n", "d\n", *(f"s{k}\n" for k in range(10, 60))]), sorted(["b\na\n", "\n", "d\n", *(f"s{k}\n" for k in range(10, 60))]))
    assert catalog.q_convert_schema(spark, str(tmp_path)).filter("format = 'bin'").collect() == [("bin", "text", "str")]
