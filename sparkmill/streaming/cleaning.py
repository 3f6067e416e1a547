"""The cleaning pipeline on a stream.

Filters, redaction and the language heuristic are stateless and run on the
stream unchanged.  Dedup becomes stateful.  With event times the copy of the smallest
ordinal wins in any order of arrival and state expires behind the watermark
(``stream_first``); without them the first arrival of each fingerprint stays
(``stream_dedup``; within one micro-batch the survivor is arbitrary) and its
fingerprint is held as long as the query runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from ..plans.pipeline import _fence, run_pipeline


def stream_identity(df: DataFrame, key: str | None, order_col: str = "ord"):
    """SHA-256 fingerprint of a record's identity: the key's text, or (key
    missing) the whole row as JSON; tagged so the two kinds never meet.

    State keeps the 32-byte fingerprint instead of the text itself, so its size
    does not grow with document length.
    """
    cols = [c for c in df.columns if c != order_col]
    row = F.to_json(F.struct(*[F.to_json(F.col(c)).alias(c) if isinstance(df.schema[c].dataType, VariantType)
                               else F.col(c) for c in cols]))
    if key and key in df.columns:
        k = F.col(key)
        text = F.when(k.isNotNull(), F.concat(F.lit("k:"), k.cast("string"))).otherwise(F.concat(F.lit("r:"), row))
    else:
        text = F.concat(F.lit("r:"), row)
    return F.sha2(text, 256)


def stream_dedup(df: DataFrame, *, key: str | None = None, order_col: str = "ord",
                 event_time: str | None = None, within: str | None = None, **_kwargs) -> DataFrame:
    """First arrival of each identity survives (state: one fingerprint per identity).

    With ``event_time`` and ``within`` (e.g. ``"1 hour"``) copies are
    recognised at least while they arrive within that horizon of the first
    one; the state expires behind the watermark (evicted at the end of the
    next batch): bounded state for streams whose duplicates arrive close in
    time.  Without them the state lives as long as
    the query (exact dedup over the whole stream).
    """
    tagged = df.withColumn("__id", stream_identity(df, key, order_col))
    if event_time and within:
        return tagged.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["__id"]).drop("__id")
    return tagged.dropDuplicates(["__id"]).drop("__id")


def stream_first(df: DataFrame, *, key: str | None = None, order_col: str = "ord", event_time: str, within: str, **_kwargs) -> DataFrame:
    """The copy of the smallest ordinal survives, whatever order copies arrive in.

    Copies no further apart than ``within`` in event time are one run.  The state holds the
    run's first record so far (smallest ordinal) and its time span; when the watermark has
    passed the run's end by ``within`` the record is emitted and the state goes, so state is
    bounded by the records of ``within`` and the lateness.  A copy after that
    begins a new run.  The stream needs a watermark on ``event_time``.
    """
    cols = [c for c in df.columns]
    tagged = df.withColumn("__id", stream_identity(df, key, order_col))
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in cols]), F.col(order_col))
    return tagged.groupBy("__id", F.session_window(event_time, within)).agg(first.alias("__first")).select("__first.*")


def run_stream_pipeline(stream: DataFrame, nodes: list[dict], *, order_col: str = "ord", event_time: str | None = None,
                        within: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """The batch compiler (filter hoisting, single evaluation of redaction) with
    the stateful dedup: filters hoisted before a dedup also shrink its state.

    With ``event_time`` and ``within`` a dedup keeps the first copy by ordinal
    (``stream_first``): output equals the batch pipeline's for copies no further apart
    than ``within`` that arrive within ``lateness``, one dedup node.  Without them the first arrival stays
    and its fingerprint is kept as long as the query runs.
    """
    if event_time is None or within is None:
        return run_pipeline(stream, nodes, order_col=order_col, dedup=stream_dedup)

    def first(df, **params):
        return stream_first(df, event_time=event_time, within=within, **params)

    # Every record moves the watermark on, also one that a filter drops: the fence keeps filters above it.
    timed = _fence(stream.withWatermark(event_time, lateness))
    return run_pipeline(timed, nodes, order_col=order_col, dedup=first)
