"""Token counts: character estimates (JVM-side) and BPE (Arrow-batched UDF).

The estimate is plain column arithmetic.  BPE needs a per-value codec, so it
runs as an iterator pandas UDF: the encoder is built once per Python worker
and whole Arrow batches are encoded at a time.  The encoder is chosen by name
from a registry; add one with ``register_encoder``.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

CHARS_PER_TOKEN = 4


def token_estimate_dataset(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``len(file) // 4`` for the lines of ``text_col`` joined by newlines.

    ``total_chars`` = sum of line lengths + one newline between lines.
    """
    n = F.count(F.col(text_col))
    chars = F.coalesce(F.sum(F.length(text_col)), F.lit(0)) + F.greatest(n - 1, F.lit(0))
    return df.agg(chars.cast("bigint").alias("total_chars")).select(
        "total_chars", F.floor(F.col("total_chars") / CHARS_PER_TOKEN).cast("bigint").alias("est_tokens"))


def value_estimate(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.floor(F.length(c) / CHARS_PER_TOKEN), F.lit(0)).cast("bigint")


def token_estimate_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Σ ``len(value) // 4`` over every present value of ``cols``."""
    per_row = sum((value_estimate(c) for c in cols), F.lit(0).cast("bigint"))
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).cast("bigint").alias("est_tokens"))


# ---------------------------------------------------------------- BPE encoders

EncoderFactory = Callable[[], object]
ENCODERS: dict[str, EncoderFactory] = {}
_LOADED: dict[str, object] = {}


def register_encoder(name: str, factory: EncoderFactory) -> None:
    """``factory()`` returns an object with ``encode_ordinary_batch(list[str])``."""
    ENCODERS[name] = factory


def _rank_file_encoder(filename: str, name: str) -> EncoderFactory:
    def build():
        import public_tokenizers as P  # noqa: N812
        import tiktoken
        with open(P.path(filename), "rb") as fh:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in fh if line.strip())}
        return tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return build


def _tiktoken_named(name: str) -> EncoderFactory:
    def build():
        import tiktoken
        return tiktoken.get_encoding(name)  # needs the encoding file locally or a network
    return build


register_encoder("byte_bpe_50k", _rank_file_encoder("byte_bpe_50k.tiktoken", "byte_bpe_50k"))
register_encoder("byte_bpe_multi_50k", _rank_file_encoder("byte_bpe_multi_50k.tiktoken", "byte_bpe_multi_50k"))
register_encoder("cl100k_base", _tiktoken_named("cl100k_base"))


def get_encoder(name: str, factory: EncoderFactory | None = None):
    """The encoder named ``name``, built once per Python process."""
    if name not in _LOADED:
        factory = factory or ENCODERS.get(name)
        if factory is None:
            raise ValueError(f"Unknown encoder: {name}")
        _LOADED[name] = factory()
    return _LOADED[name]


def bpe_count(c: str | Column, encoder: str = "byte_bpe_50k") -> Column:
    """Token count of each value (null stays null), Arrow batch at a time.

    The factory is resolved on the driver and shipped with the function, so an
    encoder registered at run time is known to every executor.
    """
    from ..session import ship_package
    ship_package()
    c = F.col(c) if isinstance(c, str) else c
    if encoder not in ENCODERS:
        raise ValueError(f"Unknown encoder: {encoder}")
    factory = ENCODERS[encoder]

    @F.pandas_udf(LongType())
    def _count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = get_encoder(encoder, factory)
        for s in batches:
            present = s.notna().to_numpy()
            texts = s[present].astype(str).tolist()
            lengths = iter(len(t) for t in enc.encode_ordinary_batch(texts)) if texts else iter(())
            yield pd.Series([next(lengths) if p else None for p in present], index=s.index, dtype="Int64")

    return _count(c)


def bpe_count_row(cols: list[str | Column], encoder: str = "byte_bpe_50k") -> Column:
    """Σ BPE tokens over the present values of several columns, per row.

    One Arrow round trip for all the columns: each batch's values are encoded
    together in a single ``encode_ordinary_batch`` call.
    """
    from ..session import ship_package
    ship_package()
    if encoder not in ENCODERS:
        raise ValueError(f"Unknown encoder: {encoder}")
    factory = ENCODERS[encoder]
    columns = [F.col(c) if isinstance(c, str) else c for c in cols]

    @F.pandas_udf(LongType())
    def _count(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        enc = get_encoder(encoder, factory)
        for series in batches:
            if isinstance(series, pd.Series):  # a single column arrives bare, not in a tuple
                series = (series,)
            n = len(series[0])
            texts, owner = [], []
            for s in series:
                present = s.notna().to_numpy()
                idx = present.nonzero()[0]
                texts.extend(s.iloc[idx].astype(str).tolist())
                owner.extend(idx.tolist())
            totals = [0] * n
            for row, toks in zip(owner, enc.encode_ordinary_batch(texts) if texts else []):
                totals[row] += len(toks)
            yield pd.Series(totals, dtype="int64")

    return _count(*columns)


def token_count_bpe(df: DataFrame, cols: list[str], encoder: str = "byte_bpe_50k") -> DataFrame:
    """Σ BPE tokens over every present value of ``cols`` (one Python pass)."""
    return df.agg(F.coalesce(F.sum(bpe_count_row(cols, encoder)), F.lit(0)).cast("bigint").alias("bpe_tokens"))
