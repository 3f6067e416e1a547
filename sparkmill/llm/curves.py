"""Nearest neighbours by shifted space-filling curves.

Each of several curves projects the vectors by its own random orthonormal frame,
shifts them by its own offset and orders them by the Hilbert index of the
projection.  The order is range-partitioned in Spark.  A query's neighbours in
every order, ``window`` places to either side, are measured by their exact distance
on the original vectors; the best of all orders are merged.

The window is fitted: over a bounded sample of queries the true neighbours are
found by brute force, and the window is the least in which the wanted share of
them lies on some curve.  One rule for every size: where vectors have structure
windows are narrow; for isotropic vectors no order keeps neighbours near, and the
fitted windows cover a fixed share of the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.llm.common import ship, stage
from sparkmill.llm.vectors import answers, classes, valid

CURVES, DIMS, BITS = 12, 4, 10
SEED = 5
#: Distinct vectors that fit the scale of the curves; queries whose true neighbours fit the window; share wanted.
SAMPLE, FIT_QUERIES, RECALL = 2048, 128, 0.97
#: Places of an order held by one task, and queries met there.
BLOCK, CHUNK = 4096, 2048
PIECES = 64


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of rows of non-negative integers below 2 ** bits (public transpose form)."""
    x = x.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo excess work from the top bit down
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & (q - 1)
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ t)
            x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def frames(sample: np.ndarray, curves: int, dims: int, seed: int) -> list[tuple]:
    """(projection, low, width) of each curve: an orthonormal frame and a shifted box around the sample."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    out = []
    for _ in range(curves):
        frame = np.linalg.qr(rng.normal(size=(d, max(1, min(dims, d)))))[0]
        p = sample @ frame
        low, high = p.min(0), p.max(0)
        width = np.maximum(high - low, 1e-12) * 1.5
        out.append((frame, low - width / 3 * rng.uniform(0, 1, len(low)), width))
    return out


def keys_of(v: np.ndarray, frame: tuple, bits: int = BITS) -> np.ndarray:
    projection, low, width = frame
    return hilbert(np.clip(((v @ projection) - low) / width * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)


def nearest(x: np.ndarray, cid: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (and exact distances) of the k nearest rows of ``x`` to ``q``, ties to the smaller cid."""
    d2 = ((x - q) ** 2).sum(1)
    top = np.argpartition(d2, k - 1)[:k] if len(d2) > k else np.arange(len(d2))
    top = np.flatnonzero(d2 <= d2[top].max()) if len(top) else top
    d = np.sqrt(d2[top])
    order = np.lexsort((cid[top], d))[:k]
    return top[order], d[order]


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, 1))


def _exact(found: DataFrame, asked: np.ndarray, names: np.ndarray, k: int) -> DataFrame:
    """Brute force for a bounded set of query vectors: the k nearest classes of each, (q, cid, score)."""
    def scan(batches):
        for b in batches:
            x, cid = _matrix(b["v"]), b["cid"].to_numpy()
            got = [(names[i], *nearest(x, cid, v, k)) for i, v in enumerate(asked)] if len(b) else []
            yield pd.DataFrame({"q": [int(n) for n, at, _ in got for _ in at], "cid": [int(c) for _, at, _ in got for c in cid[at]],
                                "score": [float(d) for *_, ds in got for d in ds]})

    near = found.select("cid", "v").mapInPandas(scan, "q bigint, cid bigint, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "cid"))
    return near.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def ordered(found: DataFrame, curve_frames: list[tuple]) -> DataFrame:
    """(curve, place, cid, v, asks): every class once a curve, places counted along all curves one after the other."""
    ship(found.sparkSession)

    def key(batches):
        for b in batches:
            v = _matrix(b["v"])
            for c, frame in enumerate(curve_frames):
                if len(b):
                    yield pd.DataFrame({"curve": c, "key": keys_of(v, frame), "cid": b["cid"], "v": b["v"], "asks": b["n_query"] > 0})

    keyed = found.select("cid", "v", "n_query").mapInPandas(key, "curve int, key bigint, cid bigint, v array<double>, asks boolean")
    # The range partition is written with its number, so places and rows come from one and the same partitioning.
    keyed = stage(keyed.repartitionByRange(PIECES, "curve", "key", "cid").withColumn("part", F.spark_partition_id()), "curve-order")
    sizes = sorted((r[0], r[1]) for r in keyed.groupBy("part").agg(F.count(F.lit(1))).collect())  # PIECES rows or what AQE makes of them
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    starts = keyed.sparkSession.createDataFrame(starts, "part int, _start bigint")
    place = F.row_number().over(Window.partitionBy("part").orderBy("curve", "key", "cid"))
    out = keyed.withColumn("_n", place).join(F.broadcast(starts), "part")
    return out.select("curve", (F.col("_start") + F.col("_n") - 1).alias("place"), "cid", "v", "asks")


def fitted_window(order: DataFrame, truth: DataFrame, recall: float) -> int:
    """Least window in which ``recall`` of the true neighbours lie near their query on some curve."""
    places = order.select("curve", "place", "cid")
    a = truth.join(places.withColumnsRenamed({"cid": "q", "place": "pq"}), "q")
    b = a.join(places.withColumnsRenamed({"place": "pc"}), ["curve", "cid"])
    gap = b.groupBy("q", "cid").agg(F.min(F.abs(F.col("pq") - F.col("pc"))).alias("gap"))
    got = gap.agg(F.percentile("gap", F.lit(recall))).first()[0]
    return int(got or 0) + 1


def search(rows: DataFrame, is_query, k: int = 10, curves: int = CURVES, recall: float = RECALL, window: int | None = None,
           block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score) of (vec_id, v) rows: the k nearest found, exact Euclidean distances.

    Ties go to the smaller vec_id; a query's own row is no candidate, its copies
    are (equal vectors share one place of an order and are expanded at the end).
    With k candidates or fewer all are found and returned; an empty table gives no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    found, asked = classes(rows, is_query, k + 1)
    by_hash = F.xxhash64("cid")
    sample = found.orderBy(by_hash, "cid").select("v").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = np.array([r["v"] for r in sample])
    order = stage(ordered(found, frames(sample, curves, DIMS, SEED)), "curve-places")
    if window is None:
        some = found.filter("n_query > 0").orderBy(by_hash, "cid").select("cid", "v").limit(FIT_QUERIES).collect()
        if not some:
            return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
        truth = stage(_exact(found, np.array([r["v"] for r in some]), np.array([r["cid"] for r in some]), k + 1), "curve-truth")
        window = max(fitted_window(order, truth, recall), 4 * (k + 1))
    asks = order.filter("asks").select("curve", F.col("place").alias("at"), F.col("cid").alias("q"), "v")
    n_asks = max(1, asked.count())
    total = max(1, order.count() // curves)
    # queries whose window reaches a block, and the chunks they are dealt into
    chunks = int(max(1, -(-n_asks * min(total, 2 * window + block) // total // chunk)))
    blocks = order.select("curve", F.floor(F.col("place") / block).alias("block"), "place", "cid", "v").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asks = stage(asks, "curve-queries").withColumn("chunk", F.pmod(F.xxhash64("q", F.lit(3)), F.lit(chunks)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.floor(F.greatest(F.col("at") - window, F.lit(0)) / block), F.floor((F.col("at") + window) / block))))

    def visit(group: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(group) and len(some):
            group = group.sort_values("place")
            place, cid, x = group["place"].to_numpy(), group["cid"].to_numpy(), _matrix(group["v"]).astype(np.float64)
            for q, at, v in zip(some["q"], some["at"], some["v"], strict=True):
                a, b = np.searchsorted(place, [at - window, at + window + 1])
                near, d = nearest(x[a:b], cid[a:b], np.asarray(v, dtype=np.float64), k + 1)
                out += [(q, int(c), float(s)) for c, s in zip(cid[a:b][near], d, strict=True)]
        return pd.DataFrame(out, columns=["q", "cid", "score"])

    met = blocks.groupBy("curve", "block", "chunk").cogroup(asks.groupBy("curve", "block", "chunk")).applyInPandas(
        visit, "q bigint, cid bigint, score double")
    best = met.groupBy("q", "cid").agg(F.min("score").alias("score"))
    return answers(asked, found, stage(best, "curve-best"), k, descending=False)


def nearest_neighbours(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """The result of the neighbour query: queries with vec_id divisible by 100, against every row."""
    return search(valid(embeddings, nonzero=True), F.col("vec_id") % 100 == 0, k)
