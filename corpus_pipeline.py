"""Corpus pipeline: quality, near duplicates, secrets, mixing, tokens, each a stage over `documents`.

Every stage takes whole rows with the columns of documents and hands on the same
columns (the last one: tokens); other columns, of any name, are left aside by every
stage.  Rows of null doc_id pass through all stages; empty tables give empty results.
Equal rows are decided row by row: one of them stays among near duplicates, and each
is scored, scanned, mixed and encoded on its own.  Ties go to the smallest doc_id, then
to the first row.  Texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.llm import jaccard, mixing, quality, secrets, sentencepiece_viterbi
from sparkmill.llm.common import sifted, stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The stage on word shingles: five words, similarity 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Words that a worker of the tokens stage remembers: workers of five stages share an executor.
KEPT_WORDS = 100_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects (score below 0.5) go; without labels all stay."""
    docs = docs.select(COLUMNS)
    labels = table(spark, sf_dir, "labels")
    known = sifted(docs, labels, "doc_id").filter("_may").drop("_may")  # training joins the labels themselves, to rows without texts
    stats = stage(quality.document_statistics(known), "pipeline-stats")
    return quality.accepted(docs, quality.train(stats, labels))


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a unique ``_row``, written once so that every reader sees the same keys; a doc_id can repeat or be null."""
    return stage(docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id()), name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one of the smallest doc_id stays; texts without words stay.

    Rows are decided one by one: of equal rows one stays, and a row whose doc_id
    also stands at another text goes only if its own text is a near duplicate.
    """
    docs = with_row_key(docs, "pipeline-near-rows")
    known = docs.filter("doc_id is not null")
    found = jaccard.join(docs.select(F.when(F.col("doc_id").isNotNull(), F.col("_row")).alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT)
    found = found.filter("doc_id is not null and n_shingles > 0").select(F.col("doc_id").alias("_row"), "component_id")
    found = stage(found.join(known.select("_row", "doc_id"), "_row"), "pipeline-near-found")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("first")).select("first._row")
    gone = found.select("_row").join(first, "_row", "left_anti")
    return docs.join(gone, "_row", "left_anti").select(COLUMNS)


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by the name of its kind; documents stay."""
    found, _ = secrets.scan(docs.select(COLUMNS).withColumn("_text", F.col("text")))
    text = secrets.redact(F.col("_text"), F.col("spans"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("bigint").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row occurs taken / size times, a fraction rounded up or down by its seeded hash, so sources keep their targets.

    Each row has its own ``taken`` and its own rounding, also where doc_ids repeat or are null.
    """
    docs = with_row_key(docs, "pipeline-mix-rows")
    mixed, _ = mixing.mix(docs, key="_row")
    part = F.pmod(F.xxhash64("doc_id", "first_word", F.lit(31)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = mixed.filter("size > 0").select("_row", F.floor(F.col("taken") / F.col("size") + part).alias("times"))
    copies = docs.join(times.filter("times > 0"), "_row")
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether the ids decode to the text, of each document."""
    return sentencepiece_viterbi.token_rows(docs, kept_words=KEPT_WORDS)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("secrets", drop_secrets), ("mixing", mix_sources), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs


ORACLE_SQL = None  # learned scores, exact set similarity and seeded choice are beyond SQL; see tests/llm
