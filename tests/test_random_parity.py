"""Seeded random strings: Spark expressions vs plain Python, thousands at once."""

import random
import re

from pyspark.sql import functions as F

from sparkmill.functions.pii import DEFAULT_REPLACEMENT, PII_PATTERNS, redact
from sparkmill.functions.text import py_search, py_strip
from sparkmill.operators import sections

from .test_sections import check_chunks, check_sections

# Characters chosen to hit the edge cases: blank lines holding spaces/tabs,
# digits-only lines, hyphens at line ends, Unicode letters, digits and spaces.
ALPHABET = list("ab xy\t\n\n\n-12 9.@") + ["é", "Ж", "٣", " ", "　", "\r", "\x1c", "_"]
WORDS = ["555-123-4567", "a@b.co", "10.0.0.1", "4111-1111-1111-1111", "word-\nwrap", "  42  \n"]


def random_texts(n, seed=7):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [rnd.choice(WORDS) if rnd.random() < 0.08 else rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 120))]
        out.append("".join(parts))
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_cleanup_strip_redact_random(spark):
    texts = random_texts(3000)
    df = frame(spark, texts).select(
        "doc_id", sections.page_text_cleanup("text").alias("clean"), py_strip("text").alias("strip"),
        redact("text").alias("red"))
    pats = [re.compile(p) for _, p in PII_PATTERNS]
    for r in df.collect():
        t = texts[r["doc_id"]]
        clean = r["clean"]
        assert clean == clean.strip() and "\t" not in clean and "  " not in clean, repr(t)
        kept = lambda x: [c for c in x if not c.isspace() and not c.isdigit() and c != "-"]
        assert kept(clean) == kept(t), repr(t)
        assert r["strip"] == t.strip(), repr(t)
        want = t
        for p in pats:
            want = p.sub(DEFAULT_REPLACEMENT, want)
        assert r["red"] == want, repr(t)


def test_chunks_and_sections_random(spark):
    texts = random_texts(2000, seed=11)
    df = frame(spark, texts)
    for sep_py, sep_java, size in [(r"\n\s*\n", sections.PARAGRAPH_BREAK, 15), ("\n", "\n", 7)]:
        got = sorted((r["doc_id"], r["chunk"], r["text"]) for r in
                     sections.paragraph_chunk(df, chunk_size=size, separator=sep_java).collect())
        for i, t in enumerate(texts):
            check_chunks(t, [x for k, _, x in got if k == i], size, sep_py)
    got = sorted((r["doc_id"], r["section"], r["heading"], r["text"]) for r in sections.heading_sections(df).collect())
    for i, t in enumerate(texts):
        check_sections(t, [(h, b) for k, _, h, b in got if k == i])


def test_search_matches_python_re(spark):
    texts = random_texts(1500, seed=3)
    patterns = ["ab", "X.Y", r"\d{2}", r"^\s*\d+\s*$", r"é|Ж", r"(?P<w>a)(?P=w)", r"b\Z", r"\bxy\b"]
    df = frame(spark, texts).select("doc_id", *[py_search("text", p).alias(f"p{i}") for i, p in enumerate(patterns)])
    compiled = [re.compile(p, re.IGNORECASE) for p in patterns]
    for r in df.collect():
        t = texts[r["doc_id"]]
        for i, c in enumerate(compiled):
            assert r[f"p{i}"] == bool(c.search(t)), (patterns[i], repr(t))


def test_word_difference_characters(spark):
    # Combining mark, superscript two, connector punctuation, circled letter, zero-width joiner.
    texts = ["é555-123-4567", "x²555-123-4567", "a‿555-123-4567", "Ⓐ555-123-4567", "q‍555-123-4567",
             "ab́c@d.co", "²a@b.co", "plain 555-123-4567"]
    df = frame(spark, texts).select("doc_id", redact("text").alias("red"),
                                    py_search("text", r"\b555").alias("hit"))
    pats = [re.compile(p) for _, p in PII_PATTERNS]
    for r in df.collect():
        t = texts[r["doc_id"]]
        want = t
        for p in pats:
            want = p.sub(DEFAULT_REPLACEMENT, want)
        assert r["red"] == want, repr(t)
        assert r["hit"] == bool(re.search(r"\b555", t, re.IGNORECASE)), repr(t)
