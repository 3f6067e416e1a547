"""Sliding-window request limits evaluated over a request log.

A request at time ``t`` is checked against the times its client has recorded in
``(t - w, t]`` and rejected when there are ``max`` of them or more.  Times are
members of a set, as in a sorted set keyed by time: requests of one client at the
same instant are one member.  They are judged in order of their id, so the first of
them does not see that member and the others do.  Rejected requests are still recorded.
With two tiers the minute check runs first and only requests that pass it are recorded
in (and checked against) the hour window.

Event sweep.  Each member is two events, +1 at its time and -1 when it leaves the
window; a request's count is the running sum of the events before it in the order
(client, time, leaving before arriving, id).  The events of a client sum to zero, so
one running sum over the whole order serves all clients.  The oldest member still
in the window is the one that leaves next.  The order is cut into sampled ranges of equal
depth wherever they fall, also inside a client or an instant; a range starts from the sum of
the ranges before it.  Every step is linear in the requests of a range, and a hot
client, window or instant spreads over as many tasks as its rows fill ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Limiter settings (requests per minute / per hour).
INFERENCE_LIMITS = (30, 500)
MINUTE_US = 60 * 1_000_000
HOUR_US = 3600 * 1_000_000
_KEY = ["__client", "__at", "__kind", "__id", "__sub"]
_LEAVES, _REQUEST, _ARRIVES = 0, 1, 2


def _events(requests: DataFrame, client: str, us: str, window_us: int, id_col: str, recorded: str | None) -> DataFrame:
    """Requests with all their columns, and the two events of each member (client, time, smallest recorded id)."""
    columns = F.struct(*[F.col(f"`{c}`") for c in requests.columns])
    rows = requests.select(F.col(client).alias("__client"), F.col(us).alias("__at"), F.lit(1).alias("__kind"), F.col(id_col).alias("__id"),
                           F.lit(_REQUEST).alias("__sub"), columns.alias("__row"))
    kept = requests.filter(F.col(us).isNotNull() if recorded is None else F.col(us).isNotNull() & F.col(recorded))
    members = kept.groupBy(F.col(client).alias("__client"), F.col(us).alias("__us")).agg(F.min(id_col).alias("__id"))
    both = F.array(F.struct((F.col("__us") + window_us).alias("at"), F.lit(0).alias("kind"), F.lit(_LEAVES).alias("sub")),
                   F.struct(F.col("__us").alias("at"), F.lit(1).alias("kind"), F.lit(_ARRIVES).alias("sub")))
    moves = members.withColumn("__e", F.explode(both)).select(
        "__client", F.col("__e.at").alias("__at"), F.col("__e.kind").alias("__kind"), "__id", F.col("__e.sub").alias("__sub"))
    return rows.unionByName(moves, allowMissingColumns=True)


def window_counts(requests: DataFrame, *, client_col: str, us_col: str, window_us: int, prefix: str = "w",
                  recorded: str | None = None, id_col: str = "event_id", ranges: int | None = None) -> DataFrame:
    """Add ``{prefix}_prior`` (members in ``(t-w, t]`` recorded before this request)
    and ``{prefix}_oldest_us`` (the oldest member in the window, this request's own included).

    ``recorded`` names a boolean column: only those requests are members (all when
    omitted; ``oldest`` means nothing for others).  ``id_col`` orders requests of one client
    at one instant.  A null client is a client; a null time is never a member and
    gets null counts; equal rows are judged one by one.
    """
    leaving = F.col("__sub") == _LEAVES
    n = ranges or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # Ranges are sampled whenever the plan runs, so the cut is written once: sums and rows see the same ranges.
    cut = cut_lineage(_events(requests, client_col, us_col, window_us, id_col, recorded)
                      .repartitionByRange(n, *_KEY).withColumn("__grp", F.spark_partition_id()))
    change = F.when(leaving, F.lit(-1)).when(F.col("__sub") == _ARRIVES, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    left = F.when(leaving, F.col("__at") - window_us)
    # one row for each range, ``n`` in all
    sums = cut.groupBy("__grp").agg(F.sum(change).alias("__sum"), F.min(F.when(leaving, F.struct(*_KEY))).alias("__next"))
    order = Window.orderBy("__grp").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.orderBy(F.col("__grp").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("__grp", F.coalesce(F.sum("__sum").over(order), F.lit(0)).alias("__before"),
                          (F.last(F.col("__next.__at"), ignorenulls=True).over(back) - window_us).alias("__after"))
    inside = Window.partitionBy("__grp").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("__grp").orderBy(*[F.col(k).desc() for k in _KEY]).rowsBetween(Window.unboundedPreceding, -1)
    swept = (cut.withColumn("__run", F.sum(change).over(inside)).withColumn("__left", F.last(left, ignorenulls=True).over(ahead))
             .filter(F.col("__sub") == _REQUEST).join(F.broadcast(carried), "__grp"))
    timed = F.col("__at").isNotNull()
    return swept.select("__row.*", F.when(timed, F.col("__before") + F.coalesce("__run", F.lit(0))).cast("bigint").alias(f"{prefix}_prior"),
                        F.when(timed, F.coalesce("__left", "__after")).alias(f"{prefix}_oldest_us"))


def _retry_after(us_col: str, oldest_col: str, window_us: int) -> Column:
    secs = F.floor((F.lit(window_us) - (F.col(us_col) - F.col(oldest_col))) / F.lit(1_000_000)).cast("bigint")
    return F.greatest(secs, F.lit(1))


def rate_limit_window(requests: DataFrame, *, client_col: str = "client", us_col: str = "us", window_us: int = MINUTE_US,
                      max_requests: int = 60, id_col: str = "event_id", ranges: int | None = None) -> DataFrame:
    """One tier: adds ``prior_count``, ``allowed`` and ``retry_after`` (null when allowed; all three null without a time)."""
    c = window_counts(requests, client_col=client_col, us_col=us_col, window_us=window_us, id_col=id_col, ranges=ranges)
    allowed = F.col("w_prior") < max_requests
    return (c.withColumn("allowed", allowed)
            .withColumn("retry_after", F.when(~allowed, _retry_after(us_col, "w_oldest_us", window_us)))
            .withColumnRenamed("w_prior", "prior_count").drop("w_oldest_us"))


def rate_limit_two_tier(requests: DataFrame, *, client_col: str = "client", us_col: str = "us", minute_us: int = MINUTE_US,
                        per_minute: int = INFERENCE_LIMITS[0], hour_us: int = HOUR_US, per_hour: int = INFERENCE_LIMITS[1],
                        id_col: str = "event_id", ranges: int | None = None) -> DataFrame:
    """Two stacked windows; ``verdict`` is ``ok``, ``minute`` or ``hour`` (null without a time).

    Every request is recorded in the minute window; only requests that pass the minute
    check are recorded in the hour window, so that is a second sweep over the same rows.
    """
    m = window_counts(requests, client_col=client_col, us_col=us_col, window_us=minute_us, prefix="m", id_col=id_col, ranges=ranges)
    m = m.withColumn("__passed", F.col("m_prior") < per_minute)
    h = window_counts(m, client_col=client_col, us_col=us_col, window_us=hour_us, prefix="h", recorded="__passed", id_col=id_col, ranges=ranges)
    hour_hit = F.col("h_prior") >= per_hour
    verdict = F.when(~F.col("__passed"), "minute").when(F.col("__passed") & hour_hit, "hour").when(F.col("__passed"), "ok")
    retry = (F.when(~F.col("__passed"), _retry_after(us_col, "m_oldest_us", minute_us))
             .when(hour_hit, _retry_after(us_col, "h_oldest_us", hour_us)))
    return h.select(*[F.col(f"`{c}`") for c in requests.columns], verdict.alias("verdict"), retry.alias("retry_after"))
