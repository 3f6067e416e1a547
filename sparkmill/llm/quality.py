"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

A Gaussian kernel over document statistics is approximated by random Fourier
features.  Each partition sums its share of the normal equations; the sums are
added in Spark and one system of ``features + 1`` unknowns is solved.  Raw ridge
scores are calibrated by isotonic regression (pool adjacent violators) over a
fixed grid of score bins from rows the fit has not seen.

The model sees nothing but statistics of the text.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import lean, ship, stage

FEATURES = 256
RIDGE = 1e-4
#: Kernel width in standard deviations per root dimension.
WIDTH = 1.0
SEED = 11
#: Bins of the raw score (from LOW to HIGH, ends open) in which calibration counts labels.
BINS, LOW, HIGH = 2048, -0.5, 1.5
#: Weight of the raw score inside a flat step of the calibration, so that ranking is kept there.
WITHIN_STEP = 1e-3
CLIP = 5.0

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_sd", "upper", "digit", "space", "non_ascii", "exclaim", "bar", "symbol",
    "sentence_end", "comma", "distinct_words", "top_word", "distinct_trigrams", "distinct_lines", "log_line_words", "short_lines",
    "capital_words", "ends_in_symbol", "word_entropy", "same_next_word", "distinct_chars", "long_words")
_SYMBOLS = set("#$%&*@^~<>{}[]\\/=+_`")


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of a whole text; null and empty texts have all zeros but for what counts as none."""
    text = text or ""
    n, words = max(len(text), 1), text.split()
    w, chars = max(len(words), 1), Counter(text)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    trigrams = len(set(zip(words, words[1:], words[2:]))) / (w - 2) if w > 2 else 1.0
    upper = sum(c for ch, c in chars.items() if ch.isupper())
    repeats = sum(a == b for a, b in zip(words, words[1:])) / w
    entropy = -sum(c / w * math.log(c / w) for c in counts.values()) / math.log(w) if w > 1 else 1.0
    line_words = [x.count(" ") + 1 for x in lines]
    return [
        math.log1p(len(text)), math.log1p(len(words)), float(lengths.mean()), float(lengths.std()), upper / n,
        sum(c for ch, c in chars.items() if ch.isdigit()) / n, sum(c for ch, c in chars.items() if ch.isspace()) / n,
        sum(c for ch, c in chars.items() if ch > "\x7f") / n, chars["!"] / n, chars["|"] / n, sum(chars[c] for c in _SYMBOLS) / n,
        (chars["."] + chars["?"]) / w, chars[","] / w, len(counts) / w, max(counts.values(), default=0) / w, trigrams,
        len(set(lines)) / len(lines), math.log1p(sum(line_words) / len(lines)), sum(k < 4 for k in line_words) / len(lines),
        sum(x[0].isupper() for x in words) / w, sum(not x[-1].isalnum() and x[-1] not in ".,;:?" for x in words) / w, entropy, repeats,
        math.log1p(len(chars)), float((lengths > 15).mean())]


def document_statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, x array<double>) of every whole text."""
    ship(docs.sparkSession)

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], ["key", "x"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(measure, f"key {kind}, x array<double>").withColumnRenamed("key", key)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        d = self.frequencies.shape[1]
        return np.hstack([np.cos(z @ self.frequencies + self.phases) * math.sqrt(2 / d), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 where nothing was learned."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        level = np.interp(raw, self.knots, self.values) if len(self.knots) else np.clip(raw, 0, 1)
        return (1 - WITHIN_STEP) * level + WITHIN_STEP / (1 + np.exp(-np.clip(raw, -30, 30)))


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over increasing ``x`` (means ``y``, weights ``n``): ends of the steps and their levels."""
    steps: list[list[float]] = []  # level, weight, first x, last x
    for a, b, w in zip(x, y, n, strict=True):
        steps.append([b, w, a, a])
        while len(steps) > 1 and steps[-2][0] >= steps[-1][0]:
            top = steps.pop()
            low = steps[-1]
            low[0] = (low[0] * low[1] + top[0] * top[1]) / (low[1] + top[1])
            low[1] += top[1]
            low[3] = top[3]
    return np.array([v for s in steps for v in s[2:]]), np.array([s[0] for s in steps for _ in range(2)])


def _sum_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": [int(pdf["i"].iloc[0])], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})


def fit(rows: DataFrame, calibration: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model | None:
    """Model from (x, y) rows; ``calibration`` rows must not be among them.  None without rows.

    With rows of one label only, every score is that label's.  The driver receives
    ``features + 1`` summed rows and at most BINS counts.
    """
    d = len(STATISTICS)
    ship(rows.sparkSession)
    got = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)],
                   *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)]).first()
    if not got["n"]:
        return None
    rng = np.random.default_rng(seed)
    model = Model(np.array([got[f"m{i}"] for i in range(d)]), np.array([got[f"s{i}"] or 1.0 for i in range(d)]) + 1e-9,
                  rng.normal(size=(d, features)) / (WIDTH * math.sqrt(d)), rng.uniform(0, 2 * math.pi, features))

    def sums(batches):
        total = np.zeros((features + 1, features + 2))
        for b in batches:
            x, y = np.stack(b["x"].to_list()), b["y"].to_numpy(dtype=float)
            z = model.features(x)
            total += z.T @ np.hstack([z, y[:, None]])
        yield pd.DataFrame({"i": range(features + 1), "v": list(total)})

    parts = rows.select("x", F.col("y").cast("double").alias("y")).mapInPandas(sums, "i int, v array<double>")
    total = np.stack([r["v"] for r in sorted(parts.groupBy("i").applyInPandas(_sum_rows, "i int, v array<double>").collect())])
    a, b = total[:, :-1] / got["n"], total[:, -1] / got["n"]
    penalty = np.full(features + 1, ridge)
    penalty[-1] = 1e-12  # the intercept is free
    model.weights = np.linalg.solve(a + np.diag(penalty), b)

    def binned(batches):
        for c in batches:
            raw = model.raw(np.stack(c["x"].to_list())) if len(c) else np.zeros(0)
            at = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)
            yield pd.DataFrame({"bin": at, "raw": raw, "y": c["y"].to_numpy(dtype=float)})

    bins = calibration.select("x", F.col("y").cast("double").alias("y")).mapInPandas(binned, "bin int, raw double, y double").groupBy(
        "bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    model.knots, model.values = isotonic(*(np.array([r[c] for r in bins], dtype=float) for c in ("raw", "y", "n")))
    return model


def score(stats: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """``stats`` with ``score`` in place of the statistics."""
    model = model or Model(np.zeros(1), np.ones(1), np.zeros((1, 1)), np.zeros(1))

    def apply(batches):
        for b in batches:
            x = np.stack(b["x"].to_list()) if len(b) else np.zeros((0, len(STATISTICS)))
            yield b.drop(columns="x").assign(score=model.score(x))

    kinds = ", ".join(f"`{c}` {k}" for c, k in stats.dtypes if c != "x")
    return stats.mapInPandas(apply, f"{kinds}, score double")


def remainder(key):
    return F.crc32(key.cast("string").cast("binary")) % 3


def train(stats: DataFrame, labels: DataFrame) -> Model | None:
    """The model of labelled statistics: rows with remainder 0 fit, rows with remainder 2 calibrate, the others are held out.

    Null labels and null ids teach nothing; a label given twice counts twice.
    """
    taught = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").alias("y"))
    rows = stats.join(taught, "doc_id").withColumn("_r", remainder(F.col("doc_id"))).filter("_r != 1")
    rows = stage(rows.select("x", "y", "_r"), "quality-rows")
    return fit(rows.filter("_r = 0"), rows.filter("_r = 2"))


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` (with a text) whose score is 0.5 or more; one pass, nothing is joined."""
    ship(docs.sparkSession)
    if model is None:
        return docs

    def keep(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            x = np.array([statistics(t.as_py()) for t in texts]).reshape(b.num_rows, len(STATISTICS))
            yield b.filter(pa.array(model.score(x) >= 0.5, pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of the quality query; a null id is scored and not held out."""
    stats = stage(document_statistics(documents), "quality-stats")
    scored = score(stats, train(stats, labels))
    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
