"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic
regression.

The features approximate a Gaussian kernel. Each partition of the training rows sums its share of the normal equations; the
sums are added and solved. A fold that the fit has not seen maps raw scores to probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm.common import add_columns, held_out, share_of
from trackloom.plans.session import settle

#: Most labelled rows (in the mean; a sample by id) that the classifier is fitted on.
TRAIN_ROWS = 50_000
#: Random Fourier features, width of the kernel in standard deviations of a statistic, and ridge penalty a row.
FEATURES, WIDTH, RIDGE = 256, 6.0, 1e-4
#: Raw scores are counted in so many bins before the isotonic fit.
BINS = 512
_SEGMENT = 1 << 18
_LOWER, _UPPER, _DIGIT, _SPACE, _POINT, _LINE, _MARK = range(7)
STATISTICS = (
    "chars", "words", "word_length", "word_spread", "lower", "upper", "digits", "spaces", "points", "marks", "bangs", "pipes",
    "distinct_words", "distinct_pairs", "same_as_before", "line_length", "distinct_lines", "capitals",
)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point of the basic plane; anything above counts as a mark."""
    kinds = np.full(0x10000, _MARK, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if c == "\n":
            kinds[i] = _LINE
        elif c.isspace():
            kinds[i] = _SPACE
        elif c.isupper():
            kinds[i] = _UPPER
        elif c.isalpha():
            kinds[i] = _LOWER
        elif c.isdigit():
            kinds[i] = _DIGIT
        elif c in ".,;:?'\"()-":
            kinds[i] = _POINT
    return kinds


def _segment_statistics(text: str) -> list[float]:
    """The shares among STATISTICS of one segment."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    kinds = np.bincount(_classes()[np.minimum(points, 0xFFFF)], minlength=7)
    n = len(points)
    words = text.split()
    many = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = max(1, len(words) - 1)
    shares = (kinds[[_LOWER, _UPPER, _DIGIT, _SPACE, _POINT, _MARK]] / n).tolist()
    return [
        np.log1p(sizes.mean()), np.log1p(sizes.std()), *shares, text.count("!") / n, text.count("|") / n,
        np.log1p(len(set(words))) / np.log1p(many), len(set(zip(words, words[1:], strict=False))) / pairs,
        sum(map(eq, words, words[1:])) / pairs, np.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
        sum(1 for w in words if w[0].isupper()) / many,
    ]


def statistics(text: str) -> list[float]:
    """STATISTICS of a whole text. A long text is read in segments; its shares are means weighted by their length."""
    if not text:
        return [0.0] * len(STATISTICS)
    parts = [text[at : at + _SEGMENT] for at in range(0, len(text), _SEGMENT)]
    weights = np.array([len(p) for p in parts], float) / len(text)
    shares = weights @ np.array([_segment_statistics(p) for p in parts])
    words = sum(len(p.split()) for p in parts)
    return [float(np.log1p(len(text))), float(np.log1p(words)), *shares.tolist()]


def _isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to ``values`` by weighted squares: neighbours out of order are pooled."""
    blocks: list[list[float]] = []
    for value, weight in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            total = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.empty(0)


@dataclass(frozen=True)
class QualityModel:
    """Scaling of the statistics, directions and phases of the features, ridge weights, calibration points."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    base: float
    weights: np.ndarray
    raw: np.ndarray
    probability: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        scaled = np.clip((rows - self.mean) / self.scale, -4, 4)
        return np.sqrt(2.0 / len(self.phases)) * np.cos(scaled @ self.directions + self.phases)

    def raw_scores(self, rows: np.ndarray) -> np.ndarray:
        return self.base + self.features(rows) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1, from 0 to 1."""
        return np.clip(np.interp(self.raw_scores(rows), self.raw, self.probability), 0.0, 1.0)


def _untrained(base: float) -> QualityModel:
    n = len(STATISTICS)
    return QualityModel(np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), base, np.zeros(1), np.array([0.0, 1.0]), np.array([base, base]))


def fit_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    train_rows: int = TRAIN_ROWS, seed: int = 7,
) -> QualityModel:
    """Learns from labelled documents that are not held out, from about ``train_rows`` of them at most.

    The sample is by a hash of the id. Its ids and labels, whose number that bounds, are broadcast, so no text is
    shuffled. Labels that repeat an id are averaged; null ids and labels are left out. A fifth of the sample calibrates
    and takes no part in the ridge fit. Without labels every score is 0.5.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.avg(label).alias("_y"))
    share = min(1.0, train_rows / max(1, known.count()))
    sample = known.where(share_of("_id") < share)

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t or "") for t in texts])

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id")
    fold = F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(5)) == 0
    rows = settle(rows.select(stats("_text").alias("x"), F.col("_y").alias("y"), fold.alias("calibrate")), "quality-rows")
    n = len(STATISTICS)
    moments = rows.agg(
        F.count(F.lit(1)), F.avg("y"), *[F.avg(F.get("x", F.lit(i))) for i in range(n)], *[F.stddev_pop(F.get("x", F.lit(i))) for i in range(n)]
    ).first()
    if not moments[0]:
        return _untrained(0.5)
    mean, scale = np.array(moments[2 : 2 + n], float), np.array(moments[2 + n :], float)
    scale = np.where(scale > 1e-6, scale, 1.0)
    chance = np.random.default_rng(seed)
    start = QualityModel(
        mean, scale, chance.normal(size=(n, FEATURES)) / WIDTH, chance.uniform(0, 2 * np.pi, FEATURES),
        float(moments[1]), np.zeros(FEATURES), np.empty(0), np.empty(0),
    )

    def sums(batches):
        left, right, count = np.zeros((FEATURES, FEATURES)), np.zeros(FEATURES), 0
        for batch in batches:
            if len(batch):
                z = start.features(np.array(batch["x"].tolist()))
                left += z.T @ z
                right += z.T @ (batch["y"].to_numpy(float) - start.base)
                count += len(batch)
        yield pd.DataFrame({"left": [left.tobytes()], "right": [right.tobytes()], "rows": [count]})

    # the sample is bounded, so are its partitions; each sends one matrix
    found = rows.where("not calibrate").coalesce(8).mapInPandas(sums, "left binary, right binary, rows bigint").collect()
    left = sum((np.frombuffer(r.left).reshape(FEATURES, FEATURES) for r in found), np.zeros((FEATURES, FEATURES)))
    right = sum((np.frombuffer(r.right) for r in found), np.zeros(FEATURES))
    fitted = sum(r.rows for r in found)
    weights = np.linalg.solve(left + RIDGE * max(1, fitted) * np.eye(FEATURES), right)
    model = QualityModel(mean, scale, start.directions, start.phases, start.base, weights, np.empty(0), np.empty(0))

    @F.pandas_udf("double")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(model.raw_scores(np.array(x.tolist())) if len(x) else [], dtype=float)

    scored = rows.where("calibrate").select(raw("x").alias("s"), "y")
    bins = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(1.999), F.col("s"))) * F.lit(BINS // 3))
    table = scored.groupBy(bins.alias("b")).agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    table = table.orderBy("b").toPandas()  # at most BINS + 1 rows
    if table.empty:
        points, levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        # one row's worth of doubt toward the mean in each bin
        n_rows = table["n"].to_numpy(float)
        smooth = (table["y"].to_numpy(float) * n_rows + start.base * 0.1) / (n_rows + 0.1)
        points, levels = table["s"].to_numpy(float), _isotonic(smooth, n_rows)
    return QualityModel(mean, scale, start.directions, start.phases, start.base, weights, points, levels)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1, higher: better) and predicted (1 if score >= threshold, else 0).

    Scores come from the whole text alone; null text is empty, and an empty text has statistics of 0 throughout. Columns
    of those names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[str]) -> list[list]:
        found = sent.value.scores(np.array([statistics(t) for t in texts]))
        return [found.tolist(), (found >= threshold).astype(int).tolist()]

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return add_columns(docs, text, fields, compute)


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with their own columns."""
    model = fit_quality(docs, labels, doc_id, text)
    names = docs.columns
    own = docs.toDF(*[f"_{i}" for i in range(len(names))])
    found = score_quality(own, model, f"_{names.index(text)}", threshold)
    return found.where("predicted = 1").select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])
