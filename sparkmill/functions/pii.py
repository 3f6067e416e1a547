"""Personal-data redaction as nested ``regexp_replace`` calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of, java_replacement, py_regex, python_regex_column

# Fixed values (must equal the reference for equal results): the five
# personal-data patterns, applied in this order, the default replacement and
# the default target fields.  The order is part of the semantics: PHONE runs
# before CREDIT_CARD, so a dash-separated card is only partly replaced.
PII_PATTERNS: list[tuple[str, str]] = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b"),
    ("SSN", r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b"),
    ("IP_ADDRESS", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("CREDIT_CARD", r"\b(?:\d{4}[-.\s]?){3}\d{4}\b"),
]
DEFAULT_REPLACEMENT = "[REDACTED]"
DEFAULT_FIELDS = ["text", "content", "input", "output", "instruction", "response"]

# Our own option (not the reference's behaviour): run the specific numeric
# patterns before PHONE so cards, SSNs and addresses are redacted whole.
STRICT_ORDER = ["EMAIL", "CREDIT_CARD", "SSN", "IP_ADDRESS", "PHONE"]


def ordered_patterns(strict: bool = False) -> list[tuple[str, str]]:
    if not strict:
        return list(PII_PATTERNS)
    by_name = dict(PII_PATTERNS)
    return [(n, by_name[n]) for n in STRICT_ORDER]


def redact(c: str | Column, replacement: str = DEFAULT_REPLACEMENT, strict: bool = False) -> Column:
    """Apply every pattern in order, each replacing all matches.

    Patterns are Python ``re`` patterns; ``py_regex`` spells ``\\b \\d \\s``
    the way Python defines them for Java's engine.
    """
    rep = java_replacement(replacement)
    patterns = ordered_patterns(strict)

    def chain(text: Column, exact: bool) -> Column:
        for _name, pat in patterns:
            text = F.regexp_replace(text, py_regex(pat, exact_words=exact), rep)
        return text

    return python_regex_column(c, chain)
