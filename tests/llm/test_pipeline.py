"""The pipeline's stages, each against a plain version on its own input."""

from collections import Counter

import corpus_pipeline as P
from sparkmill.llm import mixing, quality, secrets
from sparkmill.llm.common import stage, table
from tests.llm.test_jaccard import brute
from tests.llm.test_shard_mix_secrets import brute_secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "tokens"]
    docs = table(spark, SF, "documents")
    first = stage(P.keep_quality(spark, docs, SF), "t")
    scores = {r.doc_id: r.predicted for r in quality.score_documents(docs, table(spark, SF, "labels")).collect()}
    assert sorted(r.doc_id for r in first.collect()) == sorted(i for i, p in scores.items() if p)
    second = stage(P.drop_near_duplicates(spark, first, SF), "t")
    rows = [(r.doc_id, r.text) for r in first.collect()]
    assert sorted(r.doc_id for r in second.collect()) == sorted(i for i, _, c in brute(rows, 5, 80) if i == c)
    third = stage(P.drop_secrets(spark, second, SF), "t")
    texts = {r.doc_id: r.text for r in second.collect()}
    for r in third.collect():
        want, at = "", 0
        for kind, s, e in brute_secrets(texts[r.doc_id]):
            if s >= at:
                want += texts[r.doc_id][at:s] + f"[{kind}]"
            at = max(at, e)
        assert r.text == want + texts[r.doc_id][at:] and r.n_chars == len(r.text)
    fourth = stage(P.mix_sources(spark, third, SF), "t")
    times = Counter(r.doc_id for r in fourth.collect())
    for r in mixing.mix(third)[0].collect():
        assert abs(times[r.doc_id] - r.taken / max(r.size, 1)) < 1
    last = P.tokens(spark, fourth, SF).collect()
    assert Counter(r.doc_id for r in last) == times and all(r.round_trip for r in last)
    for s in (first, second, third, fourth):
        assert s.columns == docs.columns


def test_empty_and_nulls(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([], schema)
    for _, f in P.STAGES[1:]:
        out = f(spark, docs, SF)
        assert out.count() == 0
        docs = stage(out, "t") if out.columns == docs.columns else docs
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, None), (2, "password=abcdefghijkl" + " word" * 300, None, None, 1)], schema)
    assert P.keep_quality(spark, odd.limit(0), SF).count() == 0
    assert P.drop_near_duplicates(spark, odd, SF).count() == 3
    assert sorted(str(r.text) for r in P.drop_secrets(spark, odd, SF).collect()) == ["", "None", "[assign]" + " word" * 300]
    assert secrets.find_secrets(None) == []
    assert {r.doc_id for r in P.mix_sources(spark, odd, SF).collect()} == {2}


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_near_duplicates_are_decided_by_row(spark):
    a, b, c = "one two three four five six", "red green blue white black grey", "un deux trois quatre cinq six"
    rows = [(3, a), (7, a), (7, b), (8, c), (8, c), (7, " "), (7, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA).repartition(3)
    left = [(r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(left, key=str) == sorted([(3, a), (7, b), (8, c), (7, " "), (7, None), (None, a), (None, a)], key=str)


def test_mixing_of_null_and_repeated_ids(spark):
    rows = [(None, "word " * 20 + f"n{k}", "abcd"[k % 4]) for k in range(400)] + [(None, " ", "a"), (None, None, "b")]
    rows += [(5, f"five {k} " * 10, "abcd"[k % 4]) for k in range(400)] + [(6, "", "a"), (6, "six and more", "c")]
    docs = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], SCHEMA).repartition(3)
    words, size, target = Counter(), {}, {}
    for r in mixing.mix(docs)[0].collect():
        size[r.source], target[r.source] = r.source_size, r.target
    times = Counter((r.doc_id, r.text, r.source) for r in P.mix_sources(spark, docs, SF).collect())
    assert set(times) <= set(rows) and all(t and t.strip() for _, t, _ in times)
    for (_, t, s), n in times.items():
        words[s] += n * len(t.split())
    for i in (None, 5):  # each row of one id has its own number of copies, around target / size of its source
        for s in "abcd":
            n = sum(v for (j, _, x), v in times.items() if (j, x) == (i, s)) / 100
            assert abs(n - target[s] / size[s]) < 0.25, (i, s, n)
    assert all(abs(words[s] - target[s]) < 0.15 * target[s] for s in "abcd")


def test_training_texts_are_not_shuffled_for_their_labels(spark, tmp_path, monkeypatch):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('some text ', id) as text", "'en' as lang", "'s' as source", "12L as n_chars")
    spark.range(0, 400, 4).selectExpr("id as doc_id", "cast(id % 8 = 0 as int) as quality").write.parquet(str(tmp_path / "labels.parquet"))
    seen = []
    measure = P.quality.document_statistics
    monkeypatch.setattr(P.quality, "document_statistics", lambda d: seen.append(d) or measure(d))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for many labels
    try:
        P.keep_quality(spark, docs, str(tmp_path))
        assert "SortMergeJoin" not in seen[0]._jdf.queryExecution().executedPlan().toString()
        got = {r[0] for r in seen[0].select("doc_id").collect()}
        assert got >= set(range(0, 400, 4)) and len(got) < 150
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_without_secrets_are_not_shuffled(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "if(id % 100 = 7, concat('password = abcdefghijkl', id), concat('text ', id % 50)) as text",
                                       "'en' as lang", "'s' as source", "12L as n_chars")
    got = P.drop_secrets(spark, docs, "")
    assert "Union" in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["doc_id"]: r["text"] for r in got.collect()}
    assert got.count() == 300 and rows[7] == rows[107] == rows[207] == "[assign]" and rows[8] == "text 8"
