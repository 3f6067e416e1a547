"""Secret scanning over an incremental ledger of content-addressed blobs.

Every historical version of a file is addressed by the SHA-256 of its text.  A
ledger holds the findings of each (blob, rule version) pair already scanned; a
run scans only pairs the ledger lacks, each distinct text once however many
paths and versions carry it, and joins the findings back to all of them.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import join_by_key, lean, ship, sifted, stage

RULES_VERSION = "1"
# The rules, in the order kinds are listed.
_KEYWORDS = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = _KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

LEDGER = ("blob string, rules string, spans array<struct<kind:string,start:int,end:int>>")


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; code points, end exclusive.

    Matches of a kind do not overlap and are taken leftmost; a match that is too
    short is dropped but still consumes its text.
    """
    if not text:
        return []
    found = []
    lowered = text.lower()
    if any(h in lowered for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.A) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]  # maximal runs, so the length can be in the pattern
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def _scan(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        blobs, texts, counts = (b.column(i) for i in range(3))
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t.as_py())] for t in texts]
        yield pa.RecordBatch.from_arrays([blobs, counts, pa.array(spans, kind)], ["blob", "n", "spans"])


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """(versions with ``blob`` and ``spans``, new ledger).

    ``versions`` needs a ``text``; its other columns are kept (``blob`` and ``spans`` are
    replaced).  A null text counts as empty and has no findings; rows are answered one by
    one, also where ids repeat or are null; an empty table gives no rows and no entries.
    Pass the ledger of the last run to scan unseen blobs only; a new rule version
    scans all anew.
    """
    spark = versions.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(versions.drop("blob", "spans").withColumn("blob", F.sha2(text.cast("binary"), 256)).drop("text"), "secret-paths")
    blobs = versions.groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("n"))  # copies combine before the shuffle
    blobs = blobs.select(F.sha2(F.col("text").cast("binary"), 256).alias("blob"), "text", "n")
    if ledger is not None:
        # a pair that a ledger holds more than once is one pair
        seen = ledger.filter(F.col("rules") == rules).groupBy("blob").agg(F.any_value("spans").alias("old"))
        known = blobs.select("blob", "n").join(seen, "blob").select("blob", "n", F.col("old").alias("spans"))
        blobs = blobs.join(seen.select("blob"), "blob", "left_anti")
    fresh = blobs.select("blob", "text", "n").mapInArrow(
        lean(_scan), "blob string, n bigint, spans array<struct<kind:string,start:int,end:int>>")
    fresh = stage(fresh, "secret-scans")
    found = fresh if ledger is None else fresh.unionByName(known)
    entries = fresh.select("blob", F.lit(rules).alias("rules"), "spans")
    hits = stage(found.filter(F.size("spans") > 0), "secret-hits")
    # rows that surely have no findings stay where they are
    asked = sifted(rows, hits, "blob")
    out = join_by_key(asked.filter("_may").drop("_may"), hits, "blob", "n", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c != "blob"]))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    out = out.withColumn("spans", F.coalesce("spans", none)).unionByName(asked.filter("not _may").drop("_may").withColumn("spans", none))
    return out, entries if ledger is None else ledger.unionByName(entries)


def redact_text(text: str, spans) -> str:
    """``text`` with every span replaced by ``[kind]``; overlapping spans merge under the first one's kind."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at:s["start"]], "[", s["kind"], "]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(text, spans):
    """Column: `redact_text` of rows with spans (sorted by start, as from `scan`); other texts, nulls too, as they are."""
    found = F.size(spans) > 0

    @F.pandas_udf("string")
    def run(texts: pd.Series, of: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact_text(t, s) for t, s in zip(texts, of, strict=True)], dtype=object)

    return F.when(found, run(F.when(found, text), F.when(found, spans))).otherwise(text)


def secret_digest(documents: DataFrame) -> DataFrame:
    """The digest of the secrets query; the base spans are all the spans there are."""
    found, _ = scan(documents.select("doc_id", "text"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(spans.cast("binary"), 256).alias("base_sha256"),
                        spans.alias("spans"))
