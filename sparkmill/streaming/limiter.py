"""Online two-tier sliding-window limiter: sorted keyed state of clients.

A request that arrives late changes the counts of the requests after it, so a
verdict is only final when the watermark has passed its request.  For each client there are

* *pending*: a list state of requests not yet judged, appended to as they arrive;
* *members*: the sorted times still inside each window (the minute set holds
  every request's time, the hour set those of requests that passed the minute check).

Every call on a key's state costs milliseconds, so a key is one of ``BUCKETS`` buckets of clients:
their state is read and written together, as packed columns, and each client is judged by itself.

An event-time timer stands at the earliest pending request of a bucket.  When it fires, every
pending request up to the watermark is judged in the order (time, id), at its own
time, whenever it arrived; the verdicts equal those of the batch limiter for all
requests that arrive no later than ``lateness`` after a newer one.  Members older than
a window behind the watermark go, and a last timer removes the state of a quiet
bucket: state holds a window and ``lateness`` of requests, not the history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.limits import HOUR_US, INFERENCE_LIMITS, MINUTE_US

OUTPUT_SCHEMA = "event_id long, client long, us long, verdict string, retry_after long"
#: Columns of 64-bit numbers as bytes.
PENDING_SCHEMA = "client binary, us binary, id binary"
MEMBERS_SCHEMA = "minute_client binary, minute binary, hour_client binary, hour binary"
#: Buckets of clients; more of them than cores, few enough that calls on their state do not count.
BUCKETS = 1024


def _packed(*columns: np.ndarray) -> tuple[bytes, ...]:
    return tuple(np.ascontiguousarray(c, np.int64).tobytes() for c in columns)


def _unpacked(row) -> list[np.ndarray]:
    return [np.frombuffer(bytes(c), np.int64) for c in row]


def judge_tier(members: np.ndarray, us: np.ndarray, window_us: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times recorded before each request in ``(t - w, t]``, the oldest there with its own, all members).

    ``members`` are sorted distinct times before every request, ``us`` the sorted times
    of the requests; equal ones are one member, seen by all but the first of them.
    """
    times = np.union1d(members, us)
    repeated = np.zeros(len(us), bool)
    repeated[1:] = us[1:] == us[:-1]
    first = np.searchsorted(times, us - window_us, side="right")
    return np.searchsorted(times, us) - first + repeated, times[first], times


def _retry(window_us: int, now: np.ndarray, oldest: np.ndarray) -> np.ndarray:
    return np.maximum((window_us - (now - oldest)) // 1_000_000, 1)


class Limiter(StatefulProcessor):
    def __init__(self, minute_us: int, per_minute: int, hour_us: int, per_hour: int):
        self.minute_us, self.per_minute, self.hour_us, self.per_hour = minute_us, per_minute, hour_us, per_hour

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING_SCHEMA)
        self.members = handle.getValueState("members", MEMBERS_SCHEMA)

    def _timer(self, us: int) -> None:
        """The only timer of the bucket stands at ``us`` from now on, rounded up to milliseconds."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(int(-(-us // 1000)))

    def _pending(self) -> list[np.ndarray]:
        """client, us and id of the requests not yet judged, each client's by time and id."""
        parts = [_unpacked(p) for p in self.pending.get()] if self.pending.exists() else []
        client, us, ids = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(3))
        order = np.lexsort((ids, us, client))
        return [client[order], us[order], ids[order]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new = new[~new["beat"]]
        if not len(new):
            return
        client, us, ids = (new[c].to_numpy(np.int64) for c in ("client", "us", "event_id"))
        waiting = [int(t) * 1000 for t in self.handle.listTimers()] if self.pending.exists() else []
        self.pending.appendValue(_packed(client, us, ids))
        if not waiting or us.min() < min(waiting):
            self._timer(int(us.min()))
        return
        yield  # verdicts come from the timer

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        final = timerValues.getCurrentWatermarkInMs() * 1000
        client, us, ids = self._pending()
        due = us <= final
        members = _unpacked(self.members.get()) if self.members.exists() else [np.empty(0, np.int64)] * 4
        out, (minute_client, minute, hour_client, hour) = self._judge(bool(key[1]), client[due], us[due], ids[due], members)
        keep_m, keep_h = minute > final - self.minute_us, hour > final - self.hour_us
        minute_client, minute, hour_client, hour = minute_client[keep_m], minute[keep_m], hour_client[keep_h], hour[keep_h]
        left = us[~due]
        if due.any():
            self.pending.clear()
            if len(left):
                self.pending.put([_packed(client[~due], left, ids[~due])])
        if len(minute) or len(hour):
            self.members.update(_packed(minute_client, minute, hour_client, hour))
        else:
            self.members.clear()
        if len(left):
            self._timer(int(left.min()))
        elif len(minute) or len(hour):
            self._timer(max(int(x.max()) + w for x, w in ((minute, self.minute_us), (hour, self.hour_us)) if len(x)))
        yield out

    def _judge(self, known: bool, client: np.ndarray, us: np.ndarray, ids: np.ndarray, members: list[np.ndarray]):
        """Verdicts of requests sorted by client and time, and the members of all clients with them."""
        prior_m, oldest_m, minute = self._tier(client, us, members[0], members[1], self.minute_us)
        passed = prior_m < self.per_minute
        prior_h, oldest_h, hour = self._tier(client[passed], us[passed], members[2], members[3], self.hour_us)
        verdict = np.where(passed, "ok", "minute").astype(object)
        retry = np.where(passed, -1, _retry(self.minute_us, us, oldest_m))
        at, rejected = np.flatnonzero(passed), prior_h >= self.per_hour
        verdict[at[rejected]] = "hour"
        retry[at] = np.where(rejected, _retry(self.hour_us, us[passed], oldest_h), -1)
        out = pd.DataFrame({"event_id": ids, "client": pd.array(client if known else [None] * len(us), dtype="Int64"), "us": us, "verdict": verdict,
                            "retry_after": pd.array(np.where(retry < 0, 0, retry), dtype="Int64")})
        out.loc[retry < 0, "retry_after"] = pd.NA
        return out, (*minute, *hour)

    @staticmethod
    def _tier(client: np.ndarray, us: np.ndarray, of: np.ndarray, members: np.ndarray, window_us: int):
        """``judge_tier`` of every client; (counts, oldest, (clients, times) of all members).  All columns are sorted by client."""
        prior, oldest = np.empty(len(us), np.int64), np.empty(len(us), np.int64)
        clients, start = np.unique(client, return_index=True)
        end, lo, hi = [*start[1:].tolist(), len(us)], np.searchsorted(of, clients).tolist(), np.searchsorted(of, clients, side="right").tolist()
        quiet = ~np.isin(of, clients)
        who, times = [of[quiet]], [members[quiet]]
        for c, s, e, m, n in zip(clients.tolist(), start.tolist(), end, lo, hi, strict=True):
            prior[s:e], oldest[s:e], every = judge_tier(members[m:n], us[s:e], window_us)
            who.append(np.full(len(every), c, np.int64))
            times.append(every)
        who, times = np.concatenate(who), np.concatenate(times)
        order = np.lexsort((times, who))
        return prior, oldest, (who[order], times[order])

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, *, minute_us: int = MINUTE_US, per_minute: int = INFERENCE_LIMITS[0],
                      hour_us: int = HOUR_US, per_hour: int = INFERENCE_LIMITS[1],
                      lateness: str = "10 minutes") -> DataFrame:
    """Streaming ``(event_id, client, us)`` → verdict per request, append mode.

    Requests may arrive in any order up to ``lateness`` behind the newest one; later
    ones are dropped by the watermark, since verdicts after them are out.  A verdict
    follows when the watermark passes its request.  A row without event_id is a
    heartbeat: it carries the watermark on and has no verdict, so a source that falls
    silent sends one to have its last requests judged.
    """
    from ..session import ship_package
    ship_package(requests.sparkSession)
    # A heartbeat is marked, not filtered: a filter would move below the watermark it is to carry on.
    # No column of the processor's rows is null (whole columns would become floating point); ``known`` tells a null client.
    timed = (requests.filter("us is not null")
             .select(F.coalesce("event_id", F.lit(-1)).alias("event_id"), F.col("event_id").isNull().alias("beat"),
                     F.coalesce("client", F.lit(0)).alias("client"), F.col("client").isNotNull().alias("known"), "us")
             .withColumn("__ts", F.timestamp_micros("us")).withWatermark("__ts", lateness))
    return (timed.withColumn("bucket", F.pmod(F.xxhash64("client"), F.lit(BUCKETS)))
            .groupBy("bucket", "known")
            .transformWithStateInPandas(Limiter(minute_us, per_minute, hour_us, per_hour), OUTPUT_SCHEMA, "append", "eventTime"))


def with_heartbeat(requests: DataFrame, *, lateness_us: int = 600 * 1_000_000) -> DataFrame:
    """``requests`` and one heartbeat behind the newest of them, for a finite input whose last requests are to be judged."""
    after = requests.agg(F.max("us").alias("us")).filter("us is not null").select(
        F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("client"), (F.col("us") + lateness_us + 2_000_000).alias("us"))
    return requests.select("event_id", "client", "us").unionByName(after)


# The state store that keeps lists and timers apart; a last batch without data fires the timers of the last requests.
QUERY_CONF = {"spark.sql.streaming.noDataMicroBatches.enabled": "true",
              "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}  # a batch writes its changes, not all of its state
