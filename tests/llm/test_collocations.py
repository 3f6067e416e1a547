"""Collocations against a brute-force count, with small chunks, tiny filters and odd texts."""

import random
import re
from collections import Counter

import pytest

from sparkmill.llm import collocations as C
from sparkmill.llm.common import table
from tests.conftest import SF01


def brute(rows, top=2000, most=3, least=10, share=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, *w[i: i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longer = Counter()
    for p, a in found.items():
        w = p[1:]
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                part = (p[0], *w[i: i + size])
                longer[part] = max(longer[part], a)
    out = {}
    for p, a in found.items():
        if 100 * longer[p] >= share * a:
            continue
        score, _, l, r = min((1000000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1:])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1:])]) for k in range(1, len(p) - 1))  # noqa: E741
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return sorted((lang, i + 1, w.decode(), -a, l, r, n[lang], -s) for lang, xs in out.items() for i, (s, a, w, l, r) in enumerate(sorted(xs)[:top]))  # noqa: E741


def got(df, **options):
    return sorted(tuple(r) for r in C.collocations(df, **options).collect())


def some_rows(n=300):
    r = random.Random(9)
    vocabulary = ["the", "of", "The", "new", "york", "New", "é", "日本", "\x00", "a\x1c", "ÀB", "x", "|", "'s"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\x0c", " \r ", "; "]
    texts = ["".join(r.choice(vocabulary[: r.randrange(2, 15)]) + r.choice(gaps) for _ in range(r.randrange(0, 60))) for _ in range(n)]
    rows = [(r.choice(["en", "de", None, "und", ""]), t) for t in texts]
    return rows + [("en", None), (None, None), ("fr", ""), ("fr", " .\t"), ("en", "la " * 5000), ("en", "w" * 70_000), ("de", texts[0])] + [("de", texts[3])] * 30


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("TRIGGER", 2), ("MAX_OWN", 3), ("FILTER_BITS", 64), ("PARSE_BYTES", 300), ("RANK_PIECES", 3)):
            monkeypatch.setattr(C, name, value)
    rows = some_rows()
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "lang string, text string, phrase string, n int").repartition(4)
    assert got(df) == brute(rows)
    assert got(df, top=7, least=3, share=80) == brute(rows, 7, 3, least=3, share=80)
    if not small:
        assert got(df, most=5, least=4) == brute(rows, most=5, least=4)


def test_given_documents(spark):
    df = table(spark, SF01, "documents")
    assert got(df) == brute([(r.lang, r.text) for r in df.collect()])


def test_empty_and_overflowing(spark):
    assert got(spark.createDataFrame([], "lang string, text string")) == []
    assert got(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")) == []


def test_scores_beyond_64_bits(spark):
    # a * a * 1000000 passes 64 bits from a = 3.1 million on: long texts hold it
    df = spark.createDataFrame([("en", "a b " * 400_000)] * 8, "lang string, text string")
    a = 8 * 400_000
    low = 1000000 * (a - 8) ** 2 // (a * a)
    found = [(r[0], *r[2:]) for r in got(df, share=1000) if r[2] in ("a b", "b a")]
    assert found == [("en", "a b", a, a, a, 2 * a, 1000000), ("en", "b a", a - 8, a, a, 2 * a, low)]
