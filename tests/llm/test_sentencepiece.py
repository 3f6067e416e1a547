"""Encoding against the public library on both model types; decoding; exact round trips."""

import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from sparkmill.llm import sentencepiece_viterbi as V

PARTS = ["a", "b", " ", "  ", "é", "日", "Ⅷ", "\n", "the", "ing", "\U0001F600", "\x00", "    ", "tion", " the", "1", "!!"]


def texts(seed=1, n=400):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(0, 60))) for _ in range(n)] + [" " * k + "a" for k in range(70)] + [
        "the" * 3000, "日" * 500 + " " * 300 + "a" * 3000, "ab" * 40, "Ⅷ" * 90, ""]


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same pieces as a unigram model; scores are eighths, so sums are exact and ties occur."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(V.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = V.UNIGRAM
    r = np.random.default_rng(0)
    for p in proto.pieces:
        if p.type == 1:
            p.score = -int(r.integers(32, 120)) / 8
    path = tmp_path_factory.mktemp("m") / "uni.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def test_ids_equal_the_library(unigram):
    for path in (V.MODEL, unigram):
        model, lib = V.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
        some = texts()
        ids = V.encode_batch(model, some)
        assert [list(i) for i in ids] == lib.encode(some)
        assert [V.decode_ids(model, i) for i in ids] == some


def test_merging_by_rank_equals_the_lattice():
    model = V.load()
    for t in texts(2, 60):
        word = V.SPACE + t.replace(" ", V.SPACE)
        ids = [i for p in V.merge(model, word) for i in ([model.known[p]] if p in model.known else [model.bytes_[b] for b in p.encode()])]
        if t:
            assert list(V.encode_batch(model, [t])[0]) == ids


def test_decoding_broken_bytes_and_special_pieces():
    model, lib = V.load(), sentencepiece.SentencePieceProcessor(model_file=V.MODEL)
    for ids in ([3 + 0xE6, 3 + 0x97, 413], [3 + 0xFF, 3 + 0xC3, 3 + 0xA9], [1, 413, 0, 413, 2], []):
        assert V.decode_ids(model, ids) == lib.decode(ids)


def test_rows(spark):
    rows = [(i, t, i, "x") for i, t in enumerate(texts(3, 50))] + [(None, "no id", 1, None), (-1, None, 2, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, decoded string")
    out = V.token_rows(df).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=V.MODEL)
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    want = {i: (None if t is None else lib.encode(t)) for i, t, *_ in rows}
    assert {r.doc_id: r.ids for r in out} == want
    assert all(r.n_tokens == len(want[r.doc_id] or []) for r in out)
    kept = V.encode(df)
    assert kept.columns == ["doc_id", "text", "decoded", "ids"]
    assert V.token_rows(df.limit(0)).count() == 0


def test_pairs_of_pieces_stay_apart_by_undone_merges():
    model, r = V.load(), np.random.default_rng(4)
    ids = np.concatenate(model.ids)
    short = np.array([i for i in ids if len(model.pieces[i]) < 4])
    spaces = np.array([i for i in ids if set(model.pieces[i]) == {V.SPACE}])
    a, b = (np.r_[r.choice(ids, 3000), r.choice(short, 6000), r.choice(spaces, 300), r.choice(short, 300)] for _ in range(2))
    want = [V.merge(model, model.pieces[x] + model.pieces[y]) == [model.pieces[x], model.pieces[y]] for x, y in zip(a, b, strict=True)]
    assert V._apart(model, a, b).tolist() == want and {True, False} == set(want)


def test_words_of_equal_length_are_cut_together():
    model = V.load()
    words = ["\u2581the", "\u2581\u65e5\u672c\u4e9c", "abcd", "zzzz", "\u2581\U0001f600ab"[:4]]
    ids, used = V._advance(model, words)
    parts = np.split(ids, np.cumsum(used)[:-1])
    assert [x.tolist() for x in parts] == [V._walk(model, w) for w in words]
