"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The mix has as many words as the corpus.  Each source's share follows its
weight but stops at ``max_epochs`` times its own size, the excess going to the
others by weight.  Words are handed out in blocks of equal size: a block goes to
the source with the highest quotient target / (2 * seats + 1), which is what
rounding every target by one common divisor gives.  The allocation is house
monotone, so cutting the sequence of seats into shards gives each shard integer
quotas per source.  A source's documents lie in seeded order on a line of its
words; whole passes over the line come first, and the rest of the quota picks
blocks of the line by a seeded permutation.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.llm.common import stage

BLOCK_WORDS = 64
SHARDS = 16
MAX_EPOCHS = 3
#: Buckets of a source's line; a source is summed bucket by bucket, so none is sorted in one task.
BUCKETS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], max_epochs: int = MAX_EPOCHS) -> list[float]:
    """Words wanted from each source: total by weight, none above ``max_epochs`` times its size."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > max_epochs * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(max_epochs * sizes[i])
            left -= out[i]
        open_ -= over
    return out


def sainte_lague(wanted: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats per source by highest quotients wanted / (2k + 1), at most ``most`` each; ties to the earlier source.

    The seats above one divisor are counted at once (bisection), so the work does
    not grow with the number of seats.
    """
    v, cap = np.array(wanted, dtype=float), np.array(most, dtype=np.int64)
    seats = min(seats, int(cap[v > 0].sum()))
    if seats <= 0:
        return [0] * len(wanted)

    def held(q: float) -> np.ndarray:  # seats whose quotient is above q
        return np.minimum(np.maximum(np.ceil((v / q - 1) / 2), 0).astype(np.int64), cap)

    low, high = float(v[v > 0].min()) / (4.0 * seats + 4 * float(v.max() / v[v > 0].min()) + 4), float(v.max()) * 2
    for _ in range(200):
        mid = math.sqrt(low * high)
        if mid in (low, high):
            break
        if held(mid).sum() >= seats:
            low = mid
        else:
            high = mid
    got = held(high)
    while (rest := seats - int(got.sum())) > 0:  # seats at the divisor itself
        quotients = np.where(got < cap, v / (2 * got + 1), -1)
        got[np.argsort(-quotients, kind="stable")[:1 if rest < len(got) else rest]] += 1
        got = np.minimum(got, cap)
    return [int(x) for x in got]


def shard_quotas(wanted: list[float], seats: int, most: list[int], shards: int = SHARDS) -> list[list[int]]:
    """Blocks per shard and source: the seat sequence cut into ``shards`` runs at most one block apart."""
    upto = [sainte_lague(wanted, seats * k // shards, most) for k in range(shards + 1)]
    return [[b - a for a, b in zip(upto[k], upto[k + 1], strict=True)] for k in range(shards)]


def _coprime(n: int, start: int) -> int:
    a = max(1, start % n) if n else 1
    while math.gcd(a, max(n, 1)) != 1:
        a += 1
    return a


def most_step(n: int) -> int:
    """Steps below this (and a little above) times ``n`` blocks stay inside 64 bits."""
    return max(2, min(2**31, (2**62) // max(n, 1)))


def apportion(totals: list[tuple], block: int, max_epochs: int, seed: int, shards: int = SHARDS) -> list[dict]:
    """The plan of each source from its (name, words); ``totals`` by code point, null last."""
    sizes = [int(n) for _, n in totals]
    weights = [1.0 + i % 3 for i in range(len(totals))]
    wanted = targets(sizes, weights, max_epochs)
    per_pass = [-(-n // block) for n in sizes]
    seats = round(sum(wanted) / block)
    quotas = shard_quotas(wanted, seats, [max_epochs * n for n in per_pass], shards)
    rng = np.random.default_rng(seed)
    out = []
    for i, (name, _) in enumerate(totals):
        n, taken = per_pass[i], sum(q[i] for q in quotas)
        passes, rest = divmod(taken, n) if n else (0, 0)
        r = int(rng.integers(1, 2**31)), int(rng.integers(0, 2**31))
        out.append({"source": name, "source_size": sizes[i], "target": wanted[i], "blocks": n, "passes": passes, "rest": rest,
                    "step": (a := _coprime(n, r[0] % most_step(n))), "back": pow(a, -1, n) if n > 1 else 0, "shift": r[1] % max(n, 1),
                    "quotas": [q[i] for q in quotas]})
    return out


PLAN = ("source string, source_size bigint, target double, blocks bigint, passes bigint, rest bigint, "
        "step bigint, back bigint, shift bigint, quotas array<bigint>")
#: Source plans broadcast at most; beyond it they are joined by shuffle, and the few plans are many sources.
MAX_BROADCAST_SOURCES = 10_000


def mix(docs: DataFrame, block: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS, seed: int = 29,
        shards: int = SHARDS, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with what the mix takes, plan per source).

    ``docs`` needs doc_id, source and text.  Documents come back with ``size``
    (words), ``source_size``, ``target`` (the source's) and ``taken`` (words of the
    document in the mix, repeats counted, at most ``max_epochs`` times its size).  A null
    or empty text has size 0 and is never taken; a null source is a source of its
    own, last; an empty table gives empty results.  Per-source totals, one row a
    source, are the only rows that reach the driver.  Equal rows (doc_id, size) lie
    next to each other in either order, which changes no sum.  The text isn't kept.

    ``key`` names a unique bigint column, for tables whose doc_ids repeat or are null:
    it settles the order of equal rows, spreads rows of null doc_id and comes back
    with ``first_word``, the row's place on its source's line.
    """
    spark = docs.sparkSession
    keys = [key] if key else []
    rows = docs.select("doc_id", "source", *keys, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    rows = stage(rows.withColumn("_at", F.xxhash64(F.lit(seed), F.coalesce("doc_id", *keys), "size")).withColumn(
        "_bucket", F.pmod(F.shiftright("_at", 40), F.lit(BUCKETS)).cast("int")), "mix-rows")
    sums = stage(rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words")), "mix-sums")
    totals = sorted(((r[0], r[1]) for r in sums.groupBy("source").agg(F.sum("_words")).collect()),
                    key=lambda r: (r[0] is None, r[0] or ""))
    plans = spark.createDataFrame([tuple(p.values()) for p in apportion(totals, block, max_epochs, seed, shards)], PLAN)
    starts = sums.withColumn("_start", F.sum("_words").over(
        Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce("_start", F.lit(0)).alias("_start"))
    within = Window.partitionBy("source", "_bucket").orderBy("_at", "doc_id", "size", *keys).rowsBetween(
        Window.unboundedPreceding, -1)
    small = len(totals) <= MAX_BROADCAST_SOURCES
    bounded = F.broadcast if small else lambda x: x
    lined = rows.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    lined = lined.join(bounded(starts) if len(totals) * BUCKETS <= 100_000 else starts,
                       F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    plan = plans.withColumnRenamed("source", "_name").drop("quotas")
    at = lined.join(bounded(plan), F.col("source").eqNullSafe(F.col("_name"))).withColumn(
        "_from", F.col("_start") + F.col("_before")).withColumn("_to", F.col("_from") + F.col("size"))
    first, last = F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block)

    def taken_of(k):  # words of the document inside block k, if the permutation picks it
        picked = F.pmod((k % F.col("blocks")) * F.col("step") + F.col("shift"), F.col("blocks")) < F.col("rest")
        inside = F.least(F.col("_to"), (k + 1) * block) - F.greatest(F.col("_from"), k * block)
        return F.when(picked, inside).otherwise(F.lit(0)).cast("bigint")

    part = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.aggregate(
        F.sequence(first.cast("bigint"), last.cast("bigint")), F.lit(0).cast("bigint"), lambda a, k: a + taken_of(k))).otherwise(
        F.lit(0).cast("bigint"))
    out = at.select("doc_id", "source", "size", "source_size", "target",
                    (F.col("passes") * F.col("size") + part).cast("bigint").alias("taken"),
                    *([key, F.col("_from").cast("bigint").alias("first_word")] if key else []))
    return out, plans


def blocks(plans: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Every block of the mix: (source, pass, first word, last word + 1, shard).

    Pass by pass, inside a pass in the permutation's order; shard quotas are cut
    from that order.
    """
    n = F.col("passes") * F.col("blocks") + F.col("rest")
    seat = plans.filter(n > 0).withColumn("seat", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    ends = F.transform(F.sequence(F.lit(1), F.size("quotas")),
                       lambda k: F.aggregate(F.slice("quotas", F.lit(1), k), F.lit(0).cast("bigint"), lambda a, x: a + x))
    # the block in place p of a pass is the one the permutation sends to p
    p = F.pmod(F.col("seat"), F.col("blocks"))
    place = F.pmod(F.pmod(p - F.col("shift"), F.col("blocks")).cast("decimal(38,0)") * F.col("back"), F.col("blocks"))
    return seat.select(
        "source", F.floor(F.col("seat") / F.col("blocks")).alias("pass"), (place * block).cast("bigint").alias("first_word"),
        F.least((place + 1) * block, F.col("source_size")).cast("bigint").alias("end_word"),
        F.size(F.filter(ends, lambda e: e <= F.col("seat"))).alias("shard"))


def mix_documents(documents: DataFrame) -> DataFrame:
    """The digest of the mixing query."""
    return mix(documents)[0].select("doc_id", "size", "source_size", "target", "taken")
