"""The five cleaning nodes, each ``DataFrame -> DataFrame``.

Records carry an explicit ordinal column (``order_col``) because Spark has no
implicit row order; "first occurrence" always means the smallest ordinal.
A column that is absent from the frame plays the part of a missing key; a
null value is treated the same as a missing key (documented divergence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, VariantType

from ..functions.pii import DEFAULT_FIELDS, DEFAULT_REPLACEMENT, redact
from ..functions.text import ascii_ratio, py_search

ENGLISH_ASCII_THRESHOLD = 0.85


def dedup(df: DataFrame, *, key: str | None = None, order_col: str = "ord", **_kwargs) -> DataFrame:
    """Drop duplicate records, keeping the first occurrence (smallest ordinal).

    Full-row identity groups by every data column, so the aggregation is a
    plain hash aggregate with a map-side partial step: a hot duplicate group
    (even a third of all rows) collapses to one row per input partition before
    the shuffle.  Keyed identity compares ``str(value)``; rows lacking the key
    fall back to full-row identity, tagged so the two kinds of identity never meet.
    """
    cols = df.columns
    data_cols = [c for c in cols if c != order_col]
    variant = {f.name for f in df.schema.fields if isinstance(f.dataType, VariantType)}
    if (not key or key not in cols) and not variant:
        return (df.groupBy(*data_cols)
                .agg(F.min(order_col).alias(order_col))
                .select(*cols))
    if not key or key not in cols:
        # VARIANT values cannot be grouped: their JSON text is the identity
        # (keys sorted, numbers normalised: documented divergence), and whole
        # rows are kept with ``min_by``.
        ident = [F.to_json(F.col(c)) if c in variant else F.col(c) for c in data_cols]
        return (df.groupBy(F.xxhash64(*ident).alias("__h"), *[e.alias(f"__i{i}") for i, e in enumerate(ident)])
                .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order_col)).alias("__first"))
                .select("__first.*"))
    # Late materialisation: only (identity digest, ordinal) is aggregated, the winners' rows are joined back by ordinal.
    firsts = first_ordinals(df, key, order_col)
    rows = df.withColumn("__id", identity(df, key, order_col)).withColumn("__ord", F.col(order_col))
    first = F.row_number().over(Window.partitionBy("__id", "__ord").orderBy("__ord"))  # equal identity and ordinal: one of them
    return rows.join(firsts, ["__id", "__ord"]).withColumn("__n", first).filter("__n = 1").select(*[F.col(f"`{c}`") for c in cols])


def identity(df: DataFrame, key: str | None, order_col: str) -> Column:
    """128 bits (of SHA-256) that tell records apart: of the key's text, or of the whole row where there is no key."""
    data_cols = [c for c in df.columns if c != order_col]
    variant = {f.name for f in df.schema.fields if isinstance(f.dataType, VariantType)}
    whole = F.to_json(F.struct(*[F.to_json(F.col(f"`{c}`")).alias(c) if c in variant else F.col(f"`{c}`") for c in data_cols]), {"ignoreNullFields": "false"})
    if not key or key not in df.columns:
        text = F.concat(F.lit("r"), whole)
    else:
        k = F.col(f"`{key}`")
        keyed = F.to_json(k) if key in variant else k.cast(StringType())
        text = F.when(k.isNotNull(), F.concat(F.lit("k"), keyed)).otherwise(F.concat(F.lit("r"), whole))
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def first_ordinals(df: DataFrame, key: str | None, order_col: str) -> DataFrame:
    """(__id, __ord): the smallest ordinal of each identity.  Combined before the shuffle; no other column travels."""
    return df.select(identity(df, key, order_col).alias("__id"), F.col(order_col).alias("__o")).groupBy("__id").agg(F.min("__o").alias("__ord"))


def length_keep(columns: list[str], *, field: str = "text", min_length: int = 0, max_length: int = 100_000, **_kwargs) -> Column:
    if field not in columns:
        return F.lit(False)
    return F.length(F.col(field).cast(StringType())).between(int(min_length), int(max_length))


def length_filter(df: DataFrame, **params) -> DataFrame:
    """Keep rows with ``min_length <= len(field) <= max_length`` (code points)."""
    return _filter(df, length_keep(df.columns, **params))


def regex_keep(columns: list[str], *, field: str = "text", pattern: str, mode: str = "include", **_kwargs) -> Column:
    present = field in columns
    if mode == "include":
        return py_search(F.col(field).cast(StringType()), pattern) if present else F.lit(False)
    return F.coalesce(~py_search(F.col(field).cast(StringType()), pattern), F.lit(True)) if present else F.lit(True)


def regex_filter(df: DataFrame, **params) -> DataFrame:
    """Case-insensitive search; ``include`` keeps matches, any other mode drops them.

    Include drops rows without the field; exclude keeps them.
    """
    return _filter(df, regex_keep(df.columns, **params))


def _filter(df: DataFrame, keep: Column) -> DataFrame:
    return df.filter(keep)


def redactions(df: DataFrame, *, fields: list[str] | None = None, replacement: str = DEFAULT_REPLACEMENT,
               strict: bool = False, **_kwargs) -> dict[str, Column]:
    """The string fields that are redacted, with their redacted values."""
    types = dict(df.dtypes)
    return {f: redact(F.col(f), replacement, strict) for f in fields or DEFAULT_FIELDS if types.get(f) == "string"}


def pii_redact(df: DataFrame, **params) -> DataFrame:
    """Replace e-mail, phone, SSN, IP and card patterns in string fields; never drops rows."""
    return df.withColumns(redactions(df, **params))


def language_keep(columns: list[str], *, field: str = "text", languages: list[str] | None = None, **_kwargs) -> Column:
    if not languages or "en" not in {lang.lower() for lang in languages}:
        return F.lit(True)
    return ascii_ratio(F.col(field).cast(StringType())) > ENGLISH_ASCII_THRESHOLD if field in columns else F.lit(False)


def language_filter(df: DataFrame, **params) -> DataFrame:
    """ASCII-ratio heuristic: with ``en`` requested keep ratio > 0.85; else pass through."""
    return _filter(df, language_keep(df.columns, **params))
