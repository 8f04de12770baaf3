"""Quality classifier: a regularised quadratic discriminant over statistics of the text.

Each text gives FEATURES: lengths, shares of byte classes, word and line
repetition, compressibility; logarithms and log-odds bring them near normal.
For each class a mean and a covariance are estimated from labelled rows, the
covariance shrunk towards the pooled one and towards its diagonal. The
score comes from the difference of the classes' log densities (Mahalanobis
distances by Cholesky factors, which the model holds, and log determinants),
through a logistic curve fitted on a third of the labelled rows that the
densities have not seen, so that it is the probability of label 1.

Null texts are scored like empty ones. Repeated rows get equal scores. Without
labelled rows of both classes the score is the share of label 1, or 0.5.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField

from surveylab.llm import common
from surveylab.llm.quality_rules import repeated_words

FEATURES = ("log_words", "log_chars", "word_length", "word_length_spread", "upper", "digits", "marks", "symbols",
            "shouts", "non_ascii", "lines", "line_words", "repeated_lines", "repeated_words", "distinct_words",
            "marked_words", "capital_words", "top_word", "byte_entropy", "compressed")
#: Shares of the pooled covariance and of its diagonal in each class's covariance.
TO_POOLED, TO_DIAGONAL = 0.10, 0.10
_ZIP_CHUNK = 1 << 16

# Byte classes.
_UPPER, _LOWER, _DIGITS = list(range(65, 91)), list(range(97, 123)), list(range(48, 58))
_MARKS = list(b".,;:?'\"()-")
_SYMBOLS = list(b"#*$%&|<>@~^_=+\\/{}[]`")
_SPACE = [0x20, *range(0x09, 0x0E)]


def _odds(part: float, whole: float) -> float:
    """Log odds of a share, smoothed."""
    return math.log((part + 0.5) / (whole - part + 0.5)) if whole >= part else 0.0


def statistics(text: bytes) -> list[float]:
    """FEATURES of a whole UTF-8 text."""
    seen = np.bincount(np.frombuffer(text, "u1"), minlength=256)
    size = len(text)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    ink = size - int(seen[_SPACE].sum())
    letters = int(seen[_UPPER].sum() + seen[_LOWER].sum())
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), "int64", n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    marked = sum(not (w[-1:].isalnum() or w[-1] >= 128) for w in words)
    capital = sum(w[:1].isupper() for w in words)
    share = seen[seen > 0] / size
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(text[i:i + _ZIP_CHUNK])) for i in range(0, size, _ZIP_CHUNK)) + len(packer.flush())
    return [
        math.log(n), math.log(size), math.log(ink / n), math.log1p(float(lengths.std())),
        _odds(int(seen[_UPPER].sum()), letters), _odds(int(seen[_DIGITS].sum()), ink),
        _odds(int(seen[_MARKS].sum()), ink), _odds(int(seen[_SYMBOLS].sum()), ink), _odds(int(seen[33]), ink),
        _odds(int(seen[128:].sum()), ink), math.log(len(lines)), math.log(n / len(lines)),
        _odds(len(lines) - len(set(lines)), len(lines)), _odds(repeated_words(words), n), _odds(len(counts), n),
        _odds(marked, n), _odds(capital, n), _odds(max(counts.values()), n),
        float(-(share * np.log2(share)).sum()), math.log(packed / size)]


def with_statistics(df: DataFrame, text: str = "text", name: str = "statistics", keep=None) -> DataFrame:
    """Append FEATURES of each text as an array."""
    def task():
        return lambda col: [pa.array([statistics(t) for t in common.text_bytes(col)], pa.list_(pa.float64()))]

    return common.map_columns(df, [text], [StructField(name, ArrayType(DoubleType()))], task, keep)


@dataclass(frozen=True)
class Model:
    """Centre and scale of the statistics; per class the mean, the inverse Cholesky factor of the covariance and its
    log determinant; slope and offset of the logistic curve."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    log_dets: tuple[float, ...]
    curve: tuple[float, float]
    prior: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = (x - self.centre) / self.scale
        one, zero = (-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d
                     for m, f, d in zip(self.means[::-1], self.factors[::-1], self.log_dets[::-1]))
        return one - zero

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        # The square root of the distances tames the tails of the densities.
        a, b = self.curve
        d = self.difference(x)
        return 1 / (1 + np.exp(-np.clip(a * np.sign(d) * np.sqrt(np.abs(d)) + b, -30, 30)))


def _curve(d: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic slope and offset by Newton steps with a small ridge."""
    x = np.column_stack([np.sign(d) * np.sqrt(np.abs(d)), np.ones(len(d))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2),
                             x.T @ (weight * (p - y)) + 1e-3 * w)
    return float(w[0]), float(w[1])


def fit_rows(x: np.ndarray, y: np.ndarray, third: np.ndarray, prior: float) -> Model:
    """The model of statistics and labels; rows where ``third`` is set fit the curve, the others the densities."""
    none = Model(np.zeros(0), np.ones(0), (), (), (), (0.0, 0.0), prior)
    a, b = ~third, third
    if min(((y[a] == c).sum() for c in (0, 1)), default=0) < 2 or len({*y[b]}) < 2:
        return none
    centre, scale = x[a].mean(axis=0), x[a].std(axis=0) + 1e-6
    z = (x[a] - centre) / scale
    parts = [z[y[a] == c] for c in (0, 1)]
    covs = [np.cov(p, rowvar=False) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, covs)) / len(z)
    means, factors, dets = [], [], []
    for p, c in zip(parts, covs):
        few = len(c) / (len(c) + len(p))  # small classes lean more on the pooled covariance
        mix = min(1.0, TO_POOLED + few)
        c = (1 - mix) * c + mix * pooled
        c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        root = np.linalg.cholesky(c)
        means.append(p.mean(axis=0))
        factors.append(np.linalg.inv(root))
        dets.append(float(2 * np.log(np.diag(root)).sum()))
    model = Model(centre, scale, tuple(means), tuple(factors), tuple(dets), (0.0, 0.0), prior)
    # Each class weighs as much as it does among all labelled rows.
    share = y[b].mean()
    weight = np.where(y[b] == 1, prior / share, (1 - prior) / (1 - share))
    return Model(centre, scale, tuple(means), tuple(factors), tuple(dets),
                 _curve(model.difference(x[b]), y[b], weight), prior)


def fit(labelled: DataFrame, counts: dict[int, int], text: str = "text", label: str = "label",
        doc_id: str = "doc_id") -> Model:
    """The model of labelled rows (a bounded sample; ``counts``: rows of each class that it stands for)."""
    n = sum(counts.values())
    rows = with_statistics(labelled.withColumn("__third", F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(3)) == 0),
                           text, "statistics", [label, "__third"]).collect()
    x = np.array([r["statistics"] for r in rows], float).reshape(len(rows), len(FEATURES))
    y = np.array([r[label] for r in rows], float)
    third = np.array([r["__third"] for r in rows], bool)
    return fit_rows(x, y, third, counts.get(1, 0) / n if n else 0.5)


def score(df: DataFrame, model: Model, text: str = "text", keep=None) -> DataFrame:
    """Append ``score`` (0 to 1, higher: label 1 is likelier) and ``predicted`` of each whole text."""
    def task():
        def batch(col):
            x = np.array([statistics(t) for t in common.text_bytes(col)], float).reshape(len(col), len(FEATURES))
            s = model.scores(x)
            return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("int32"), pa.int32())]

        return batch

    return common.map_columns(df, [text], [StructField("score", DoubleType()), StructField("predicted", IntegerType())],
                              task, keep)
