"""Repeated strings against brute force over all 50-byte windows."""

import hashlib
import random

import pytest

from sparkmill.llm import pfp


def brute(rows):
    least = {}
    order = lambda i: (i is None, i)
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - 49):
            w = b[s:s + 50]
            if w not in least or order(i) < order(least[w]):
                least[w] = i
    out = []
    for i, b in data:
        mask = [False] * len(b)
        for s in range(len(b) - 49):
            if order(least[b[s:s + 50]]) < order(i):
                mask[s:s + 50] = [True] * 50
        spans = sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask))
        out.append((i, len(b), sum(mask), spans, hashlib.sha256(bytes(c for c, m in zip(b, mask, strict=True) if not m)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "thon", "é", "ing", "日本", "a", "of", "and", "ndre", "st"]
    prose = lambda n: " ".join("".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(n))
    shared = [prose(30) for _ in range(4)]
    rows = []
    for i in range(60):
        t = prose(r.randrange(0, 60))
        for s in r.sample(shared, r.randrange(0, 3)):
            a, b = sorted(r.sample(range(len(s)), 2))
            t = t[:len(t) // 2] + s[a:b] + t[len(t) // 2:] + s[a:]
        rows.append((i * 3, t))
    rows += [(500 + i, rows[i][1]) for i in range(10)]  # exact copies
    rows += [(600 + i, rows[i][1][:80] + "X" + rows[i][1][81:]) for i in range(10)]  # near copies
    rows += [(700, "a" * 300), (701, "a" * 120), (702, "ab" * 100), (703, "b" + "ab" * 60), (704, None), (705, ""), (706, "x" * 49), (707, "x" * 50),
             (708, "y" + "x" * 50 + "z"), (709, "q" * 60 + "x" * 50), (-5, rows[3][1]), (9, rows[3][1]), (9, prose(40)), (None, rows[5][1])]
    return rows


@pytest.mark.parametrize("seed,batch", [(1, 3_000_000), (2, 700)])
def test_equals_brute_force(spark, monkeypatch, seed, batch):
    monkeypatch.setattr(pfp, "BATCH", batch)
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id bigint, text string, id int, to string, blob string").repartition(3)
    assert sorted((tuple(r) for r in pfp.repeat_digest(df).collect()), key=str) == brute(rows)


def test_empty_and_one(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert pfp.repeat_digest(df).count() == 0
    one = spark.createDataFrame([(1, "ab" * 200)], "doc_id bigint, text string")
    assert pfp.repeat_digest(one).first().n_removed == 0
    assert pfp.repeats(one).first().spans == []


def test_long_documents(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefgh ") for _ in range(60_000))
    rows = [(1, long), (2, "head " + long[10_000:40_000] + " tail"), (3, long[39_960:40_020])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(r) for r in pfp.repeat_digest(df).collect()), key=str) == brute(rows)
