"""Formatting helpers: ISO timestamps, fixed decimals, JSON type names, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of


def iso_timestamp(c: str | Column) -> Column:
    """``datetime.isoformat()`` of a UTC timestamp: ``.ffffff`` only when non-zero."""
    ts = col_of(c).cast("timestamp")
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(ts.isNull(), F.lit(None).cast("string")) \
        .when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(frac)


def fixed4(c: str | Column) -> Column:
    """``f"{x:.4f}"``: four decimals, no grouping commas.

    ``format_number`` rounds the exact binary value half-even, as Python does.
    """
    return F.regexp_replace(F.format_number(col_of(c).cast("double"), 4), ",", "")


def sha256_hex(c: str | Column) -> Column:
    """``hashlib.sha256(s.encode()).hexdigest()``."""
    return F.sha2(col_of(c).cast("string"), 256)


def py_type_name(schema_text: Column) -> Column:
    """Map ``schema_of_variant`` of a JSON value to Python's ``type(v).__name__``."""
    s = schema_text
    return (F.when(s.startswith("OBJECT"), "dict")
            .when(s.startswith("ARRAY"), "list")
            .when(s == "STRING", "str")
            .when(s == "BOOLEAN", "bool")
            .when((s == "BIGINT") | (s.startswith("DECIMAL") & s.endswith(",0)")), "int")
            .when(s.startswith("DECIMAL") | (s == "DOUBLE"), "float")
            .when(s == "VOID", "NoneType")
            .otherwise(s))
