"""Document sectioning: page cleanup, paragraph chunks, heading sections, tables, pages.

A document is one row, so every operator here works inside the row with
higher-order array functions (``split``/``transform``/``filter``/``slice``) and then
explodes: a narrow transformation with no shuffle, and each step is linear in the
document's length.  (Chunk cuts depend on one another and are searched in Python.)
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DIGIT_CLASS, WORD_CLASS, WS_CLASS, col_of, py_regex, py_strip

# ---------------------------------------------------------------- page cleanup


def page_text_cleanup(c: str | Column) -> Column:
    """Ordered cleanup of extracted page text.

    1. join words broken by a hyphen at a line end;
    2. collapse runs of blanks/tabs to one blank;
    3. three or more newlines become two;
    4. lines holding only a number (page headers/footers) become empty;
    5. strip.
    ``(?md)``: multi-line anchors where only ``\\n`` ends a line, as in Python.
    """
    t = col_of(c)
    t = F.regexp_replace(t, f"({WORD_CLASS})-\n({WORD_CLASS})", "$1$2")
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    t = F.regexp_replace(t, f"(?md)^{WS_CLASS}*{DIGIT_CLASS}+{WS_CLASS}*$", "")
    return py_strip(t)


# ---------------------------------------------------------------- paragraph chunks

# Fixed value: paragraphs are separated by a blank line (Python ``re`` syntax).
PARAGRAPH_BREAK = r"\n\s*\n"


def _paragraphs(text: Column, separator: str) -> Column:
    parts = F.split(text, py_regex(separator), -1)
    return F.filter(F.transform(parts, lambda p: py_strip(p)), lambda p: p != "")


def _cuts(lengths: np.ndarray, chunk_size: int) -> list[int]:
    """Positions where a new chunk starts (the first chunk's left out): the next cut is searched in the running lengths."""
    ends = np.cumsum(lengths)
    out, at, n = [], 0, len(lengths)
    while n:
        before = int(ends[at - 1]) if at else 0
        at = max(at + 1, int(np.searchsorted(ends, before + chunk_size, side="right")))
        if at >= n:
            break
        out.append(at)
    return out


def chunk_boundaries(paras: Column, chunk_size: int) -> Column:
    """0-based paragraph positions where a new chunk starts (first chunk excluded).

    Greedy rule: a paragraph opens a new chunk when the current chunk is not
    empty and its length plus the paragraph's would exceed ``chunk_size``.
    Separators do not count toward the limit.  Only lengths leave the JVM; a cut costs
    one binary search, so a document is linear in its paragraphs.
    """
    @F.pandas_udf("array<int>")
    def cuts(lengths: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _cuts(np.asarray(x, np.int64), chunk_size) for x in lengths], dtype=object)

    return cuts(F.transform(paras, lambda p: F.length(p)))


def paragraph_chunk(df: DataFrame, text_col: str = "text", *, chunk_size: int = 1000,
                    separator: str = PARAGRAPH_BREAK, joiner: str = "\n\n",
                    keep: list[str] | None = None) -> DataFrame:
    """Paragraph chunks ``(…keep, chunk, text, char_count)``; chunk index 0-based.

    An oversized paragraph stays whole in its own chunk; a null text has no chunks.
    ``separator`` is a Python ``re`` pattern (default: a blank line, possibly holding
    whitespace).
    """
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    paras = _paragraphs(F.col(text_col), separator)
    staged = df.select(*keep, paras.alias("__p")).withColumn("__b", chunk_boundaries(F.col("__p"), chunk_size))
    n = F.size("__p")
    starts = F.concat(F.array(F.lit(0)), F.col("__b"))
    ends = F.concat(F.col("__b"), F.array(n))
    chunks = F.when(F.coalesce(n, F.lit(0)) <= 0, F.array().cast("array<string>")).otherwise(
        F.transform(starts, lambda s, k: F.array_join(F.slice("__p", s + 1, F.get(ends, k) - s), joiner)))
    return (staged.select(*keep, F.posexplode(chunks).alias("chunk", "text"))
            .withColumn("char_count", F.length("text")))


def parse_text(df: DataFrame, text_col: str = "text", source_col: str = "source", *, chunk_size: int = 1000) -> DataFrame:
    """The records of parsed text documents: ``(text, source, metadata {chunk, char_count, format})`` of each chunk."""
    chunks = paragraph_chunk(df, text_col, chunk_size=chunk_size, keep=[source_col])
    return chunks.select("text", F.col(source_col).alias("source"), F.struct(
        F.col("chunk").cast("bigint").alias("chunk"), F.col("char_count").cast("bigint").alias("char_count"), F.lit("text").alias("format")).alias("metadata"))


# ---------------------------------------------------------------- heading sections


def default_heading(line: Column) -> Column:
    """Our heading rule for plain text: a short line (under 20 characters)."""
    return F.length(line) < 20


def heading_sections(df: DataFrame, text_col: str = "text", *,
                     is_heading: Callable[[Column], Column] = default_heading,
                     initial_heading: str = "Document", keep: list[str] | None = None) -> DataFrame:
    """Group non-blank stripped lines under the latest heading.

    Output ``(…keep, section, heading, text, char_count)``: body lines joined
    by newline; a heading with no body emits nothing and takes no index.
    Heading positions come from one ``filter`` over the line indices; each
    section is a ``slice`` between consecutive headings (linear, no fold).
    """
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n", -1), lambda l: py_strip(l)), lambda l: l != "")
    staged = df.select(*keep, lines.alias("__l"))
    heads = F.filter(F.transform("__l", lambda l, i: F.when(is_heading(l), i).otherwise(F.lit(-1))),
                     lambda i: i >= 0)
    staged = staged.withColumn("__h", heads)
    bounds = F.concat(F.array(F.lit(-1)), F.col("__h"))
    ends = F.concat(F.col("__h"), F.array(F.size("__l")))
    sections = F.transform(bounds, lambda b, k: F.struct(
        F.when(b < 0, F.lit(initial_heading)).otherwise(F.get("__l", b)).alias("heading"),
        F.slice("__l", b + 2, F.get(ends, k) - b - 1).alias("body")))
    non_empty = F.filter(sections, lambda s: F.size(s["body"]) > 0)
    return (staged.select(*keep, F.posexplode(non_empty).alias("section", "__s"))
            .select(*keep, "section", F.col("__s.heading").alias("heading"),
                    F.array_join("__s.body", "\n").alias("text"))
            .withColumn("char_count", F.length("text")))


# ---------------------------------------------------------------- tables


def table_text(rows: Column) -> Column:
    """Rows of cells → text: cells stripped and joined by `` | ``, rows by newline."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: py_strip(c)), " | ")), "\n")


def split_cells(line: Column, delimiter: str = "|") -> Column:
    return F.split(line, "\\Q" + delimiter + "\\E", -1)


def table_rows_to_text(df: DataFrame, text_col: str = "text", *, delimiter: str = "|",
                       keep: list[str] | None = None) -> DataFrame:
    """Tables in plain text: a maximal run of consecutive lines holding ``delimiter``.

    Output ``(…keep, table_index, text, row_count, char_count)``, one record
    per table, 0-based index in document order.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    staged = df.select(*keep, F.split(F.col(text_col), "\n", -1).alias("__l"))
    n = F.size("__l")
    flag = lambda i: F.get("__l", i).contains(delimiter)
    idx = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))
    starts = F.filter(idx, lambda i: flag(i) & ((i == 0) | ~flag(i - 1)))
    ends = F.filter(idx, lambda i: flag(i) & ((i == n - 1) | ~flag(i + 1)))
    staged = staged.withColumn("__s", starts).withColumn("__e", ends)
    tables = F.transform("__s", lambda s, k: F.slice("__l", s + 1, F.get("__e", k) - s + 1))
    return (staged.select(*keep, F.posexplode(tables).alias("table_index", "__rows"))
            .select(*keep, "table_index",
                    table_text(F.transform("__rows", lambda r: split_cells(r, delimiter))).alias("text"),
                    F.size("__rows").alias("row_count"))
            .withColumn("char_count", F.length("text")))


# ---------------------------------------------------------------- pages


def page_records(pages: DataFrame, doc_col: str, page_col: str = "page", text_col: str = "text", *,
                 total_col: str | None = None) -> DataFrame:
    """One record per page with text: ``(doc, page, total_pages, text, char_count)``.

    Pages blank after ``strip`` are dropped *before* cleanup (so a page holding
    only a number survives as empty text); ``total_pages`` counts the dropped
    ones; ``char_count`` is measured after cleanup.  When the page count is not
    given it is a ``groupBy`` count (partial aggregation) joined back; AQE's
    skew-join handling splits a document with very many pages.
    """
    stripped = py_strip(F.col(text_col))
    kept = pages.filter(stripped != "")
    if total_col is None:
        totals = pages.groupBy(doc_col).agg(F.count(F.lit(1)).alias("total_pages"))
        kept = kept.join(totals, doc_col)
        total_col = "total_pages"
    cleaned = page_text_cleanup(py_strip(F.col(text_col)))
    return kept.select(F.col(doc_col), F.col(page_col).alias("page"), F.col(total_col).alias("total_pages"),
                       cleaned.alias("text")).withColumn("char_count", F.length("text"))


def lines_as_pages(df: DataFrame, doc_col: str, text_col: str = "text") -> DataFrame:
    """Each newline-separated line of a document as a page (1-based), with the page total."""
    parts = F.split(F.col(text_col), "\n", -1)
    return df.select(F.col(doc_col), F.size(parts).alias("total_pages"),
                     F.posexplode(parts).alias("__pos", "text")).withColumn("page", F.col("__pos") + 1).drop("__pos")
