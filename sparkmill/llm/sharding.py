"""Uniform sharding with exact sizes by a hypergeometric communication matrix.

Rows fall into ``cells`` virtual partitions by a seeded hash (physical partition
numbers change from run to run).  The number of rows that cell c sends to shard
s is drawn exactly: row c of the matrix is multivariate hypergeometric given the
capacity each shard has left.  Inside its cell a row's rank under a seeded hash
picks the shard (local permutation); after the exchange a second seeded hash
orders each shard (second permutation).  Shard sizes are exact (at most one
apart) and every assignment is equally likely.

Only DataFrame functions touch rows.  The driver holds cell counts
(``cells`` integers) and shard bucket counts (``shards * buckets``), both fixed
by parameters and not by the data, and HOT_KEYS hot keys at most are broadcast.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.llm.common import HOT_KEYS, stage

CELLS = 2048
BUCKETS = 256


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """(cells, shards) integers with the given row sums and column sums at most one apart."""
    total = sum(counts)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for c, n in enumerate(counts):
        rest, pool = int(n), int(left.sum())
        for s in range(shards):  # marginals, one shard after the other
            pool -= int(left[s])
            take = rest if s == shards - 1 else _hypergeometric(rng, int(left[s]), pool, rest)
            out[c, s] = take
            rest -= take
        left -= out[c]
    return out


#: The library's own sampler takes pools below this; it and the other one draw from the same law.
LIBRARY_POOL = 1_000_000_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among ``n`` draws without replacement from ``good + bad``, of any size."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    return int(rng.hypergeometric(good, bad, n)) if good + bad < LIBRARY_POOL else _conditioned(rng, good, bad, n)


def _conditioned(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """The same draw by rejection, for pools of any size.

    If X is binomial over the good ones and Y over the bad ones with one probability, X
    given X + Y = n is hypergeometric.  So X is drawn and kept with the probability of
    n - X under Y's law over that of Y's mode; the larger side plays Y, which keeps about
    every second draw.
    """
    if good > bad:
        return n - _conditioned(rng, bad, good, n)
    if 2 * n > good + bad:  # those left behind are as random as those drawn
        return good - _conditioned(rng, good, bad, good + bad - n)
    p = n / (good + bad)
    top = _log_binomial(min(int((bad + 1) * p), bad), bad, p)
    while True:
        x = int(rng.binomial(good, p))
        if 0 <= n - x <= bad and math.log(1.0 - rng.random()) <= _log_binomial(n - x, bad, p) - top:
            return x


def _log_binomial(x: int, n: int, p: float) -> float:
    """log P(X = x) of a binomial by the saddle-point expansion, which does not cancel at any size."""
    if x == 0:
        return n * math.log1p(-p)
    if x == n:
        return n * math.log(p)
    lead = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
    return lead - 0.5 * (math.log(2 * math.pi * x) + math.log1p(-x / n))


def _stirling_error(n: int) -> float:
    """log n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi))
    nn = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / nn) / nn) / nn) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, by a series where x is near the mean."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    out, term, k = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = out + term / (2 * k + 1)
        if more == out:
            return out
        out, k = more, k + 1


def _key(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def shard(df: DataFrame, identity: list[str], shards: int = 16, seed: int = 17, cells: int = CELLS,
          buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``shard`` (int, 0 to shards - 1) and ``slot`` (long, gapless from 0 in each shard).

    ``identity`` names the columns that tell rows apart; rows equal in all of
    them are interchangeable (very many of them are dealt apart by their places in the
    input).  Nulls hash like values; null identities are allowed.  An empty table gives an empty result.  Columns of ``df`` are kept;
    one named ``shard`` or ``slot`` is replaced.
    """
    cols = [F.col(f"`{c}`") for c in identity]
    spark = df.sparkSession
    keyed = stage(df.drop("shard", "slot").withColumns({"_first": _key(seed, *cols), "_second": _key(seed + 1, *cols)}), "shard-rows")
    # Rows equal in all identity columns have one key; where they are 1/HOT_KEYS of all rows
    # or more they are interchangeable and get keys of their own, so no cell or bucket fills up.
    each = stage(keyed.groupBy("_first").agg(F.count(F.lit(1)).alias("_n")), "shard-keys")
    total = each.agg(F.sum("_n")).first()[0] or 0
    hot = each.filter(F.col("_n") >= max(1000, total // HOT_KEYS + 1)).select("_first", F.lit(True).alias("_hot"))
    own = F.monotonically_increasing_id()
    keyed = keyed.join(F.broadcast(hot), "_first", "left").withColumns(
        {c: F.when(F.col("_hot"), F.xxhash64(c, own)).otherwise(F.col(c)) for c in ("_first", "_second")}).drop("_hot")
    keyed = stage(keyed.withColumn("_cell", F.pmod(F.shiftright("_first", 20), F.lit(cells)).cast("int")), "shard-cells")
    found = {r["_cell"]: r["n"] for r in keyed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix([found.get(c, 0) for c in range(cells)], shards, seed)
    cuts = [(c, [int(x) for x in matrix[c].cumsum()]) for c in range(cells)]
    plan = spark.createDataFrame(cuts, "_cell int, _cuts array<bigint>")  # `cells` rows whatever the data
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_first", *cols))
    sent = keyed.withColumn("_rank", rank).join(F.broadcast(plan), "_cell").withColumn(
        "shard", F.size(F.filter("_cuts", lambda c: c < F.col("_rank"))).cast("int")).withColumn(
        "_bucket", F.pmod(F.shiftright("_second", 20), F.lit(buckets)).cast("int")).drop("_cuts", "_cell", "_first", "_rank")
    sent = stage(sent, "shard-sent")
    sizes = {(r[0], r[1]): r[2] for r in sent.groupBy("shard", "_bucket").agg(F.count(F.lit(1))).collect()}
    offsets, rows = {}, []
    for s in range(shards):
        at = 0
        for b in range(buckets):
            rows.append((s, b, at))
            at += sizes.get((s, b), 0)
        offsets[s] = at
    starts = spark.createDataFrame(rows, "shard int, _bucket int, _start bigint")  # shards * buckets rows
    place = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_second", *cols))
    return sent.withColumn("_place", place).join(F.broadcast(starts), ["shard", "_bucket"]).withColumn(
        "slot", F.col("_start") + F.col("_place") - 1).drop("_bucket", "_second", "_place", "_start")


def shard_documents(documents: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """The digest of the sharding query: whole documents by the law ``rows``.

    A null text counts as no bytes (size 1, crc 0).
    """
    rows = documents.select(
        F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard(rows, ["doc_id", "text_crc32", "size"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
