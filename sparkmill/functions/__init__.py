"""Column expressions (JVM-side) shared by the operators."""

from .fmt import fixed4, iso_timestamp, py_type_name, sha256_hex
from .pii import DEFAULT_FIELDS, DEFAULT_REPLACEMENT, PII_PATTERNS, redact
from .text import (PY_WHITESPACE, WORD_CLASS, WS_CLASS, ascii_ratio, normalize_newlines, py_search,
                   py_strip, split_lines)

__all__ = [
    "fixed4", "iso_timestamp", "py_type_name", "sha256_hex",
    "DEFAULT_FIELDS", "DEFAULT_REPLACEMENT", "PII_PATTERNS", "redact",
    "PY_WHITESPACE", "WORD_CLASS", "WS_CLASS", "ascii_ratio", "normalize_newlines", "py_search",
    "py_strip", "split_lines",
]
