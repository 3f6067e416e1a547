"""Instruction rows, chat rendering, token counts and packing."""

import base64

from pyspark.sql import functions as F

import pytest

from sparkmill.operators import formatting, ordinal, tokens
from sparkmill.plans import fixtures as FX
from sparkmill.sources.tables import table

from .conftest import SF001, SF01, rows


def test_instruction_format_drops_empty(spark):
    df = spark.createDataFrame([("s", "q", "a"), (None, "q2", "a2"), ("s", "", "a"), ("s", "q", None)],
                               "sys string, question string, answer string")
    out = formatting.instruction_format(df, user_column="question", assistant_column="answer", system_column="sys")
    assert rows(out, "system", "user", "assistant") == [(None, "q2", "a2"), ("s", "q", "a")]
    no_sys = formatting.instruction_format(df, user_column="question", assistant_column="answer")
    assert no_sys.filter("system is not null").count() == 0


def test_chat_template(spark):
    df = spark.createDataFrame([("S", "U", "A"), (None, "U2", "A2")], "system string, user string, assistant string")
    got = rows(formatting.chat_template_render(df), "text")
    assert sorted(got) == sorted([("<|system|>\nS\n<|user|>\nU\n<|assistant|>\nA<|end|>",), ("<|user|>\nU2\n<|assistant|>\nA2<|end|>",)])
    lit = rows(formatting.chat_template_render(df, null_system="literal"), "text")
    assert any(t[0].startswith("<|system|>\nNone\n<|user|>\nU2") for t in lit)
    plain = spark.createDataFrame([("just text",)], "text string")
    assert rows(formatting.chat_template_render(plain), "text") == [("just text",)]


def test_conversation_pairs_count(spark):
    pairs = FX.instruction_rows(spark, SF01)
    assert pairs.count() == 233
    assert pairs.filter("system is not null").count() == 47


def test_token_estimates(spark):
    df = spark.createDataFrame([("abcdefg",), ("abc",)], "text string")
    r = tokens.token_estimate_dataset(df).first()
    assert (r["total_chars"], r["est_tokens"]) == (11, 2)
    v = spark.createDataFrame([("abcdefg", None, "abcd")], "a string, b string, c string")
    assert tokens.token_estimate_values(v, ["a", "b", "c"]).first()["est_tokens"] == 2


def test_bpe_matches_direct_encoding(spark):
    import public_tokenizers as P
    import tiktoken
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as fh:
        ranks = {base64.b64decode(a): int(b) for a, b in (ln.split() for ln in fh if ln.strip())}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    d = table(spark, SF001, "documents").select("text")
    want = sum(len(enc.encode_ordinary(t)) for t in (r["text"] for r in d.collect()))
    assert tokens.token_count_bpe(d, ["text"]).first()["bpe_tokens"] == want


def test_unknown_encoder(spark):
    with pytest.raises(ValueError):
        tokens.get_encoder("nope")


def test_sequence_packing_small_buckets(spark):
    d = table(spark, SF01, "documents").select("doc_id", tokens.value_estimate("text").alias("n"))
    # A tiny bucket size forces many ranges: the result must not depend on it.
    a = rows(ordinal.sequence_packing(d, "doc_id", "n"), "doc_id", "token_start", "token_end", "first_pack", "last_pack")
    b = rows(ordinal.sequence_packing(d, "doc_id", "n", bucket_rows=7), "doc_id", "token_start", "token_end",
             "first_pack", "last_pack")
    assert a == b
    total = sum(r[2] - r[1] for r in a)
    assert total == 602_096
    packs = ordinal.pack_summary(ordinal.sequence_packing(d, "doc_id", "n"), "n")
    assert packs.count() == 294
    assert packs.filter("n_tokens < 2048").count() == 1


def test_preview_page(spark):
    d = spark.range(0, 1000, 3).withColumnRenamed("id", "k")  # sparse keys
    got = rows(ordinal.preview_page(d, "k", page=3, page_size=10, bucket_rows=16), "row_ord", "k", "total")
    assert got == [(20 + i, 3 * (20 + i), 334) for i in range(10)]
    with pytest.raises(ValueError):
        ordinal.preview_page(d, "k", page=0)


def test_custom_encoder_registry(spark):
    class Words:
        def encode_ordinary_batch(self, texts):
            return [t.split() for t in texts]

    tokens.register_encoder("words", Words)
    try:
        df = spark.createDataFrame([("a b c", "d"), (None, "e f")], "x string, y string")
        assert tokens.token_count_bpe(df, ["x", "y"], encoder="words").first()["bpe_tokens"] == 6
    finally:
        tokens.ENCODERS.pop("words")


def test_running_total_sparse_and_string_keys(spark):
    import random
    rnd = random.Random(5)
    keys = sorted(rnd.sample(range(1, 2**62), 3000))
    vals = [rnd.randint(0, 9) for _ in keys]
    df = spark.createDataFrame(list(zip(keys, vals)), "k long, v long")
    got = {r["k"]: (r["cum_before"], r["cum_after"]) for r in ordinal.running_total(df, "k", "v", ranges=9).collect()}
    acc = 0
    for k, v in zip(keys, vals):
        assert got[k] == (acc, acc + v)
        acc += v
    names = spark.createDataFrame([(f"doc-{i:05d}",) for i in range(500)], "name string")
    ords = {r["name"]: r["row_ord"] for r in ordinal.dense_ordinal(names, "name", ranges=4).collect()}
    assert ords == {f"doc-{i:05d}": i for i in range(500)}


def test_preview_on_sparse_keys_uses_ranges(spark):
    d = spark.range(0, 300).select((F.col("id") * 1_000_003 + 7).alias("k"))
    got = rows(ordinal.preview_page(d, "k", page=2, page_size=5, ranges=6), "row_ord", "k", "total")
    assert got == [(5 + i, (5 + i) * 1_000_003 + 7, 300) for i in range(5)]


def test_running_total_string_keys_with_payload_read_back(spark, tmp_path):
    """Many rows in several files with a payload column: totals and rows share one cut."""
    n = 300_000
    spark.range(n).select(F.sha1(F.col("id").cast("string")).alias("k"), (F.col("id") % 11).alias("v"),
                          F.concat(F.lit("payload "), F.col("id")).alias("p")).repartition(6).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = ordinal.running_total(df, "k", "v", ranges=9).select("k", "v", "cum_before", "cum_after").toPandas().sort_values("k")
    total = got["v"].cumsum()
    assert len(got) == n and (got["cum_after"] == total).all() and (got["cum_before"] == total - got["v"]).all()


def test_running_total_keeps_the_null_key(spark):
    df = spark.createDataFrame([(None, 5), (1, 1), (2, 2), (3, 4)], "k bigint, v bigint")
    got = sorted(((r["k"], r["cum_before"], r["cum_after"]) for r in ordinal.running_total(df, "k", "v", bucket_rows=2).collect()), key=str)
    assert got == [(1, 5, 6), (2, 6, 8), (3, 8, 12), (None, 0, 5)]
