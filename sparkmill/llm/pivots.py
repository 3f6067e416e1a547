"""Exact top-k by inner product with a pivot table.

Distances of every vector to P pivots are precomputed.  For a query q and a
vector x the triangle inequality gives |q - x| >= max over pivots of
|d(q, p) - d(x, p)|, hence q.x <= (|q|^2 + |x|^2 - that^2) / 2.  Vectors live in the cell of
their nearest pivot.  A query first meets a block of its own cell, which gives a
lower limit of its k-th score; a cell whose bound (from its ranges of distances
and norms) is below the limit is not visited; inside a visited block candidates
are evaluated in bound order until the bound falls below the k-th score found.
Nothing is approximate: bounds are widened by their rounding error and ties are
evaluated.

Cells are dealt into blocks of bounded size and queries into chunks, so a task
holds BLOCK vectors and CHUNK queries whatever the sizes of cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import ship, stage
from sparkmill.llm.vectors import answers, classes, valid

PIVOTS = 32
#: Pivots are chosen, farthest first, from this many distinct vectors (those whose id has the smallest hashes).
SAMPLE = 1024
BLOCK = 8192
CHUNK = 2048
STEP = 1024
#: Beyond this the sum of products could lose integers in a double.
EXACT = float(2 ** 53)


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first traversal from the first vector."""
    if not len(sample):
        return sample
    picked = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(n, len(sample)):
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None] - 2 * x @ pivots.T, 0))


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, 1))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of integer-valued doubles, by Python's integers where a double could not hold them."""
    if len(x) and np.abs(x).max() * np.abs(q).max() * len(q) >= EXACT:
        ints = [int(c) for c in q]
        return np.array([sum(int(a) * b for a, b in zip(r, ints, strict=True)) for r in x], dtype=object)
    return np.rint(x @ q).astype(np.int64)


def search_block(u, norm2, dist, cid, q, q_dist, floor, k) -> list[tuple[int, int, int]]:
    """(query row, cid, score): the k best of the block for each query, none below its ``floor``."""
    out, q2s = [], (q ** 2).sum(1)
    for i in range(len(q)):
        gap = np.abs(dist - q_dist[i]).max(1)
        scale = norm2 + q2s[i] + 1
        bound = (norm2 + q2s[i] - np.maximum(gap - 1e-6 * np.sqrt(scale), 0) ** 2) / 2 + 1e-9 * scale
        least = floor[i]
        left = np.flatnonzero(bound >= least)
        left = left[np.argsort(-bound[left], kind="stable")]
        best: list[tuple[int, int]] = []
        for at in range(0, len(left), STEP):
            some = left[at:at + STEP]
            if bound[some[0]] < least:
                break  # no later candidate can reach the k-th score
            s = products(u[some], q[i])
            good = np.flatnonzero(s >= least)
            best = sorted([*best, *((-int(s[g]), int(cid[some[g]])) for g in good)])[:k]
            if len(best) == k:
                least = max(least, -best[-1][0])
        out += [(i, c, -s) for s, c in best]
    return out


def top_inner(rows: DataFrame, is_query, k: int = 20, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score) of (vec_id, v) rows, v integer-valued.

    Ties go to the smaller vec_id; a query row is not its own candidate, its copies
    are.  Repeated vec_ids are rows of their own.  With fewer candidates than k all
    are returned; an empty table gives no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    found, asked = classes(rows, is_query, k + 1)
    sample = found.orderBy(F.xxhash64("cid"), "cid").select("v").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    pivots = choose_pivots(np.array([r["v"] for r in sample]))

    def measure(batches):
        for b in batches:
            u = _matrix(b["v"])
            if len(b):
                d = distances(u, pivots)
                yield pd.DataFrame({"cid": b["cid"], "v": b["v"], "norm2": (u ** 2).sum(1), "dist": list(d),
                                    "cell": d.argmin(1).astype(np.int32), "asks": b["n_query"] > 0})

    placed = found.select("cid", "v", "n_query").mapInPandas(
        measure, "cid bigint, v array<double>, norm2 double, dist array<double>, cell int, asks boolean")
    placed = stage(placed, "pivot-table")
    p = len(pivots)
    spans = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("norm2").alias("norm2"), *[f(F.col("dist")[i]).alias(f"{c}{i}") for i in range(p) for f, c in (
            (F.min, "lo"), (F.max, "hi"))]).collect()  # one row a cell: PIVOTS rows
    cells = np.array([r["cell"] for r in spans])
    low, high = (np.array([[r[f"{c}{i}"] for i in range(p)] for r in spans]) for c in ("lo", "hi"))
    most = np.array([r["norm2"] for r in spans])
    blocks = {int(r["cell"]): -(-r["n"] // block) for r in spans}
    counts = spark.createDataFrame(list(blocks.items()), "cell int, blocks bigint")
    stored = placed.join(F.broadcast(counts), "cell").withColumn("part", F.pmod(F.xxhash64("cid"), "blocks")).drop("blocks", "asks")
    queries = stage(placed.filter("asks").select(F.col("cid").alias("q"), "v", "dist", "cell"), "pivot-queries")
    chunks = max(1, -(-queries.count() // chunk))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("q", F.lit(3)), F.lit(chunks)).cast("int"))
    kinds = "q bigint, cid bigint, score bigint"

    def visit(group: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(asks):
            return pd.DataFrame({"q": [], "cid": [], "score": []})
        got = search_block(_matrix(group["v"]), group["norm2"].to_numpy(), _matrix(group["dist"]), group["cid"].to_numpy(), _matrix(asks["v"]),
                           _matrix(asks["dist"]), asks["floor"].to_numpy(dtype=float), k + 1)
        ids = asks["q"].to_numpy()
        return pd.DataFrame({"q": [int(ids[i]) for i, _, _ in got], "cid": [c for _, c, _ in got], "score": [s for _, _, s in got]})

    def meet(left: DataFrame, asks: DataFrame) -> DataFrame:
        return left.groupBy("cell", "part", "chunk").cogroup(asks.groupBy("cell", "part", "chunk")).applyInPandas(visit, kinds)

    every_chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    copies = stored.select("*", every_chunk)
    at_home = queries.join(F.broadcast(counts), "cell").withColumn("part", F.pmod(F.xxhash64("q"), "blocks")).drop("blocks")
    first = meet(copies, at_home.withColumn("floor", F.lit(float("-inf"))))
    floors = first.groupBy("q").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("floor"))  # k + 1 rows a query at most
    floors = stage(floors, "pivot-floors")

    def route(batches):
        for b in batches:
            if not len(b):
                continue
            u, d, floor = _matrix(b["v"]), _matrix(b["dist"]), b["floor"].fillna(float("-inf")).to_numpy(dtype=float)
            q2 = (u ** 2).sum(1)
            gap = np.maximum(np.maximum(low[None] - d[:, None], d[:, None] - high[None]), 0).max(2)  # (queries, cells)
            scale = q2[:, None] + most[None] + 1
            bound = (q2[:, None] + most[None] - np.maximum(gap - 1e-6 * np.sqrt(scale), 0) ** 2) / 2 + 1e-9 * scale
            i, c = np.nonzero(bound >= floor[:, None])
            yield pd.DataFrame({"q": b["q"].to_numpy()[i], "v": b["v"].to_numpy()[i], "dist": b["dist"].to_numpy()[i],
                                "floor": floor[i], "cell": cells[c].astype(np.int32), "chunk": b["chunk"].to_numpy()[i]})

    sent = queries.drop("cell").join(floors, "q", "left").mapInPandas(
        route, "q bigint, v array<double>, dist array<double>, floor double, cell int, chunk int")
    sent = sent.join(F.broadcast(counts), "cell").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks")
    return answers(asked, found, stage(meet(copies, sent), "pivot-best"), k, descending=True)


def top_products(embeddings: DataFrame, k: int = 20, scale: int = 64) -> DataFrame:
    """The result of the exact search query: components floor(scale * x), queries with vec_id divisible by 20.

    Components are held as integer-valued doubles; scores must fit 64 bits.
    """
    rows = valid(embeddings, nonzero=False)
    whole = rows.select("vec_id", F.transform("v", lambda x: F.rint(x * scale - F.pmod(x * scale, F.lit(1.0)))).alias("w"), "v")
    # floor() as a double: the integer at or below the product, also beyond 64 bits
    down = F.zip_with("w", "v", lambda w, x: F.when(w > x * scale, w - 1).when(w + 1 <= x * scale, w + 1).otherwise(w) + F.lit(0.0))
    return top_inner(whole.select("vec_id", down.alias("v")), F.col("vec_id") % 20 == 0, k)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
