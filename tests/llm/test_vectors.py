"""Exact and approximate vector search against brute force."""

import numpy as np
import pytest

from sparkmill.llm import curves, pivots
from sparkmill.llm.common import table

SCHEMA = "vec_id bigint, embedding array<float>, label int, cid bigint, n int, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, 1, 2, "x") for i, e in rows], SCHEMA)


def edge_rows():
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8).round(1).tolist()) for i in range(160)]
    rows += [(200 + i, [1.0, -0.5] + [0.25] * 6) for i in range(90)]  # copies, queries among them
    rows += [(400, None), (420, [1.0, None] + [0.0] * 6), (440, [float("nan")] + [0.0] * 7), (460, [float("inf")] + [0.0] * 7), (480, [0.0] * 8),
             (500, []), (520, [1.0]), (None, [1.0] * 8), (540, [3.0] * 8), (541, [-0.0] * 8), (542, [1e-3] * 8)]
    return rows


def usable(rows, nonzero):
    out = [(i, np.array(e, dtype=np.float32).astype(float)) for i, e in rows if i is not None and e and len(e) == 8 and all(
        x is not None and np.isfinite(x) for x in e)]
    return [(i, v) for i, v in out if not nonzero or v.any()]


def brute(rows, every, k, inner):
    out = []
    for q, a in rows:
        if q % every == 0:
            s = sorted(((-int(np.floor(64 * a) @ np.floor(64 * b)) if inner else float(np.sqrt(((a - b) ** 2).sum()))), i) for i, b in rows if i != q)
            out += [(q, n + 1, i, -v if inner else v) for n, (v, i) in enumerate(s[:k])]
    return out


def test_pivot_search_is_exact(spark):
    rows = edge_rows()
    want = brute(usable(rows, False), 20, 20, True)
    df = frame(spark, rows).repartition(3)
    assert sorted(tuple(r) for r in pivots.top_products(df).collect()) == sorted(want)


def test_pivot_search_over_many_blocks_and_chunks(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(1).normal(size=(300, 8)).round(2))]
    from pyspark.sql import functions as F

    whole = frame(spark, rows).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double")).alias("v"))
    got = pivots.top_inner(whole, F.col("vec_id") % 20 == 0, 20, block=16, chunk=4)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(usable(rows, False), 20, 20, True))


def test_few_candidates_and_none(spark):
    two = frame(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])])
    assert [tuple(r) for r in pivots.top_products(two).collect()] == [(0, 1, 1, 64 * 64 * 4)]
    assert [tuple(r)[:3] for r in curves.nearest_neighbours(two).collect()] == [(0, 1, 1)]
    for empty in (frame(spark, []), frame(spark, [(0, None)]), frame(spark, [(0, [1.0])])):
        assert pivots.top_products(empty).count() == 0 and curves.nearest_neighbours(empty).count() == 0


def test_products_beyond_doubles():
    x = np.array([[2.0 ** 30, 1.0]])
    assert pivots.products(x, np.array([2.0 ** 30, 1.0])).tolist() == [2 ** 60 + 1]


def test_whole_windows_are_exact(spark):
    rows = edge_rows()
    want = brute(usable(rows, True), 100, 10, False)
    got = curves.search(curves.valid(frame(spark, rows), True), curves.F.col("vec_id") % 100 == 0, 10, curves=2, window=1000, block=32, chunk=1)
    got = sorted(tuple(r) for r in got.collect())
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
    assert np.allclose([r[3] for r in got], [r[3] for r in sorted(want)], atol=1e-12)


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_visits_every_cell_by_unit_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    order = cells[np.argsort(curves.hilbert(cells, bits))]
    assert len(set(curves.hilbert(cells, bits))) == len(cells)
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_recall(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in df.collect()]
    want = {(q, i) for q, _, i, _ in brute(rows, 100, 10, False)}
    got = {(r.query_id, r.vec_id) for r in curves.nearest_neighbours(df).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
