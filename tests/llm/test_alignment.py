"""Alignment against a brute-force version over the public libraries; merging against a counter; spilling in small pieces."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkmill.llm import alignment as A

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
PARTS = ["the ", "of ", "a", "é", "日本", "\n", " ing", "<s>", "<|endoftext|>", "<0x41>", "\t", "  ", "1999", "!?", "\U0001F600", "ﬁ", "the ", "and "]


def brute(rows):
    lib_a, lib_b = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    lib_a.encode_special_tokens = True
    alphabet = A.byte_alphabet()
    found, pairs = [], Counter()
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(alphabet[c] for c in lib_a.id_to_token(i))) for i in lib_a.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(p[3:5], 16)]) if lib_b.is_byte(i) else p.replace("▁", " ").encode()) for i in (lib_b.encode(text) if text else []) for p in [lib_b.id_to_piece(i)]]
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        ends = [dict(zip(np.cumsum([len(x) for _, x in side]).tolist(), range(len(side)), strict=True)) for side in (a, b)]
        both, groups, links, at = sorted(set(ends[0]) & set(ends[1])), [], [], [0, 0]
        for e in both:
            i, j = ends[0][e], ends[1][e]
            groups.append(",".join(str(x) for x, _ in a[at[0]: i + 1]) + "|" + ",".join(str(x) for x, _ in b[at[1]: j + 1]))
            links.append((a[i][0], b[j][0]))
            at = [i + 1, j + 1]
        pairs.update(links)
        found.append((len(a), len(b), ";".join(groups), links))
    top = {}
    for (_, b), n in pairs.items():
        top[b] = max(top.get(b, 0), n)
    return pairs, [(d, n_a, n_b, len(links), len(links), sum(pairs[p] == top[p[1]] for p in links), sum(pairs[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
                   for (d, _), (n_a, n_b, g, links) in zip(rows, found, strict=True)]


def some_rows(n=160):
    r = random.Random(4)
    rows = [(i, "".join(r.choice(PARTS) for _ in range(r.randrange(0, 50)))) for i in range(n)]
    return rows + [(5, "the of the of"), (None, "no id at all"), (None, None), (1001, None), (1002, ""), (1003, "a▁b"), (1004, " " * 9000 + "x"), (1005, "ab" * 30000), (1006, "\x00\n"), (5, "the of the of")]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many spills, several merge passes, several postings groups
        for name, value in (("SPILL_LINKS", 60), ("SPILL_DOCS", 40), ("FAN_IN", 2), ("BATCH_BYTES", 200), ("SPILLS_A_TASK", 2), ("BLOCK", 3)):
            monkeypatch.setattr(A, name, value)
        monkeypatch.setattr(A, "heap_merge", lambda runs, f=A.heap_merge: f(runs, 3))
    rows = some_rows()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, spill int, groups string").repartition(3)
    pairs, want = brute(rows)
    got = [tuple(r) for r in A.align_documents(df, A_FILE, B_FILE).collect()]
    order = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in x)
    assert sorted(got, key=order) == sorted(want, key=order)
    if not small:
        counts = {(r.a, r.b): r["count"] for r in A.pair_counts(df, A_FILE, B_FILE).collect()}
        assert counts == dict(pairs)
        kept = A.align(df, A_FILE, B_FILE, keep_groups=True).filter("groups != ''").collect()
        assert kept and all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in kept)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert A.align_documents(df, A_FILE, B_FILE).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in A.align_documents(none, A_FILE, B_FILE).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_heap_merge_and_packing():
    r = np.random.default_rng(1)
    runs, want = [], Counter()
    for _ in range(9):
        keys = np.unique(r.integers(0, 500, r.integers(0, 200)))
        counts = r.integers(1, 1 << 40, len(keys))
        runs.append((A.unpack_sorted(A.pack_sorted(keys)), A.unpack(A.pack(A.narrow(counts)))))
        want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    for block in (1, 7, 10_000):
        got = [(int(k), int(n)) for keys, totals in A.heap_merge(runs, block) for k, n in zip(keys, totals, strict=True)]
        assert got == sorted(want.items())
    assert A.highest(np.array([3, 5, 5, 2]), np.array([1, 1, 2, 3])).tolist() == [5, 5, 5, 2]
