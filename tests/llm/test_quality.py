"""Quality: solver parts against brute force, held-out accuracy, defined results at the edges."""

import numpy as np

from sparkmill.llm import quality as Q
from sparkmill.llm.common import table

SF = "/root/testdata/sf0.1"
DOCS = "doc_id bigint, text string, lang string, score double, x int, key string"


def test_isotonic_is_the_best_monotone_fit():
    r = np.random.default_rng(3)
    for _ in range(20):
        n = int(r.integers(1, 9))
        x, y, w = np.arange(n, dtype=float), r.integers(0, 5, n) / 4, r.integers(1, 4, n).astype(float)
        knots, values = Q.isotonic(x, y, w)
        got = np.interp(x, knots, values)
        # the classic max-min formula
        want = [max(min(np.average(y[i:j + 1], weights=w[i:j + 1]) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert np.allclose(got, want) and np.all(np.diff(got) >= -1e-12)


def test_normal_equations_equal_direct_ridge(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, len(Q.STATISTICS)))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(5)
    model = Q.fit(df, df, features=32)
    z = model.features(x)
    penalty = np.diag(np.r_[np.full(32, Q.RIDGE), 1e-12])
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z / 300 + penalty, z.T @ y / 300), atol=1e-8)


def test_fourier_features_approximate_the_gaussian_kernel(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(50, len(Q.STATISTICS)))
    df = spark.createDataFrame([(a.tolist(), float(i % 2)) for i, a in enumerate(x)], "x array<double>, y double")
    model = Q.fit(df, df, features=4096)
    z = model.features(x)[:, :-1]
    s = np.clip((x - model.mean) / model.scale, -Q.CLIP, Q.CLIP)
    kernel = np.exp(-((s[:, None] - s[None]) ** 2).sum(-1) / (2 * Q.WIDTH ** 2 * s.shape[1]))
    assert np.abs(z @ z.T - kernel).max() < 0.1


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = Q.score_documents(docs, labels)
    rows = out.join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").toPandas()
    assert out.count() == docs.count()
    assert (rows.predicted == rows.quality).mean() > 0.97
    good, bad = rows.score[rows.quality == 1].to_numpy(), rows.score[rows.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.98


def test_edges(spark):
    import zlib

    docs = spark.createDataFrame([(1, "", "en", 0.0, 1, "k"), (2, None, None, None, None, None), (None, "text", "en", 0.0, 1, "k"),
                                  (3, "word " * 50_000, "en", 0.0, 1, "k"), (3, "word", "en", 0.0, 1, "k")], DOCS)
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = Q.score_documents(docs, empty).collect()
    assert len(out) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in out)
    assert {r.doc_id: r.held_out for r in out} == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in (1, 2, 3, None)}
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3)] + [(None, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in Q.score_documents(docs, labels).collect())
    assert Q.score_documents(docs.limit(0), labels).count() == 0
