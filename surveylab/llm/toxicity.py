"""Toxicity by compression distance: is a text told more shortly by what toxic texts or by what ordinary texts say?

Two zstandard dictionaries are trained from windows of labelled texts: one on
the ordinary windows, one on the spans of toxic windows that set them apart.
Those are runs of bytes, of any script and without a notion of words, that
stand between many different bytes in toxic text (copies of one text repeat
their surroundings, so that they don't count as places) and hardly in ordinary
text. Each window of a text is compressed twice, with the ordinary dictionary
alone and with the toxic one before it; the bytes saved are the window's
distance. A document's distances (mean, share and number of windows over two
thresholds, largest ones) go into a logistic calibration; it and the two
thresholds are fitted on labelled rows the dictionaries have not seen. The
sizes of both dictionaries follow the samples.

Null texts are scored like empty ones (no window: the calibration's value for no
distance). Repeated rows get equal scores. Without labelled rows of either
class the score is the share of toxic rows, or 0 if there are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField

from surveylab.llm import common

WINDOW_WORDS = 6
TRAIN_WORDS = 16
WINDOW_BYTES = 512
LEVEL = 9
#: Bytes of a sample for each byte of its dictionary, and the least size of a dictionary.
ORDINARY_PART, ORDINARY_LEAST = 1024, 4096
TOXIC_PART, TOXIC_LEAST = 24, 256
#: Most training windows of each class (a documented sample, by hash).
MOST_WINDOWS = 60_000
#: Bytes of a telling run, and of what is looked at before and after it (both fit into 64 bits).
RUN, BESIDE = 7, 6
#: A telling run stands between that many different bytes, is that many times as frequent as in ordinary windows, and
#: its places are that unlikely by chance (log-likelihood ratio).
PLACES, TIMES, SURPRISE = 12, 6.0, 60.0
#: A run that stands in less than this share of the places of one overlapping it is chance beside that one.
SHARE = 0.5
#: Windows and share of the runs that are looked at together.
SLICE_WINDOWS, PARTS = 4096, 8
#: Thresholds to calibrate: saved bytes that a window may be asked for.
THRESHOLDS = tuple(range(2, 9))
PREDICT_FROM = 0.3


def windows(text: str, words: int) -> list[bytes]:
    """The text in windows of words, each with a space before and after; long ones cut by bytes."""
    tokens = text.lower().split()
    out = []
    for i in range(0, len(tokens), words):
        w = f" {' '.join(tokens[i:i + words])} ".encode()
        out.extend([w] if len(w) <= WINDOW_BYTES else [w[k:k + WINDOW_BYTES] for k in range(0, len(w), WINDOW_BYTES)])
    return out


def _packed(text: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes from each place on, as a number."""
    out = np.zeros(len(text) - size + 1, "uint64")
    for i in range(size):
        out <<= np.uint64(8)
        out |= text[i:i + len(out)]
    return out


def _runs(sample: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the joined windows; for each place the run there, what stands before and after it, and if it is in a
    window."""
    gap = b"\n" * max(RUN, BESIDE)  # windows have no line ends
    for k in range(0, len(sample), SLICE_WINDOWS):
        joined = gap + gap.join(sample[k:k + SLICE_WINDOWS]) + gap + gap
        text = np.frombuffer(joined, "uint8")
        runs, beside = _packed(text, RUN), _packed(text, BESIDE)
        before, after = np.zeros(len(runs), "uint64"), np.zeros(len(runs), "uint64")
        before[BESIDE:] = beside[:len(runs) - BESIDE]
        after[:len(beside) - RUN] = beside[RUN:]
        gaps = np.concatenate([[0], np.cumsum(text == 10, dtype="int32")])
        yield joined, runs, before, after, gaps[RUN:] == gaps[:-RUN]


def _standing(sample: list[bytes], chosen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs inside of windows that ``chosen`` picks, with what stands before and after them."""
    found = []
    for _, runs, before, after, inside in _runs(sample):
        at = np.flatnonzero(inside & chosen(runs))
        found.append((runs[at], before[at], after[at]))
    return tuple(map(np.concatenate, zip(*found)))


def _places(runs: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs in order, and beside how many different bytes each stands."""
    order = np.lexsort((beside, runs))
    r, b = runs[order], beside[order]
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (b[1:] != b[:-1])
    return np.unique(r[first], return_counts=True)


def telling_spans(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The spans of the toxic windows that set them apart from ordinary ones, each as often as it stands there."""
    # Part by part and slice by slice, so that the driver holds a few arrays of a part of the sample's size.
    parts = []
    for part in range(PARTS):
        runs, before, after = _standing(toxic, lambda r: r % np.uint64(PARTS) == part)
        found, n = _places(runs, before)
        n = np.minimum(n, _places(runs, after)[1])
        parts.append((found[n >= PLACES], n[n >= PLACES]))
    kinds, a = map(np.concatenate, zip(*parts))
    order = np.argsort(kinds)
    kinds, a = kinds[order], a[order].astype(float)
    if not len(kinds):
        return []
    t_all, o_all = (max(1, sum(int(w[4].sum()) for w in _runs(sample))) for sample in (toxic, ordinary))
    runs, *sides = _standing(ordinary, lambda r: np.isin(r, kinds))
    b = np.zeros(len(kinds))
    for beside in sides:
        found, n = _places(runs, beside)
        at = np.searchsorted(kinds, found)
        b[at] = np.maximum(b[at], n)
    share = t_all / (t_all + o_all)
    rest = b * np.log(np.maximum(b, 1) / ((a + b) * (1 - share)))
    telling = (a / t_all > TIMES * (b + 1) / o_all) & (2 * (a * np.log(a / ((a + b) * share)) + rest) >= SURPRISE)
    kinds, a = kinds[telling], a[telling]
    if not len(kinds):
        return []
    spans = []
    for joined, runs, _, _, inside in _runs(toxic):
        at = np.minimum(np.searchsorted(kinds, runs), len(kinds) - 1)
        places = np.where(inside & (kinds[at] == runs), a[at], 0)
        most = np.lib.stride_tricks.sliding_window_view(np.pad(places, RUN - 1), 2 * RUN - 1).max(1)
        starts = np.flatnonzero((places > 0) & (places >= SHARE * most))
        edges = np.zeros(len(joined) + 1, int)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + RUN, -1)
        covered = np.concatenate([[False], np.cumsum(edges) > 0])
        turns = np.flatnonzero(covered[1:] != covered[:-1])
        spans += [joined[i:j] for i, j in zip(turns[::2], turns[1::2])]
    return spans


def _dictionary(size: int, sample: list[bytes], **settings) -> bytes:
    try:
        return zstandard.train_dictionary(size, sample, **settings).as_bytes()
    except zstandard.ZstdError:  # too few samples: they are the dictionary themselves
        return b"".join(dict.fromkeys(sample))[:size]


def train(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries of two window samples."""
    spans = telling_spans(toxic, ordinary)
    return (_dictionary(max(ORDINARY_LEAST, sum(map(len, ordinary)) // ORDINARY_PART), ordinary),
            _dictionary(max(TOXIC_LEAST, sum(map(len, spans)) // TOXIC_PART), spans, k=16, d=6) if spans else b"")


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    thresholds: tuple[int, int] = THRESHOLDS[:2]
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.0


class Distances:
    """Bytes that the toxic dictionary saves for each window of a text."""

    def __init__(self, model: Model):
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False,
            write_dict_id=False)
        self.plain, self.paired = (
            zstandard.ZstdCompressor(compression_params=settings, dict_data=zstandard.ZstdCompressionDict(
                raw or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for raw in (model.ordinary, model.toxic + model.ordinary))

    def of(self, text: str) -> np.ndarray:
        parts = windows(text, WINDOW_WORDS)
        if not parts:
            return np.zeros(0)
        plain, paired = (np.fromiter(map(len, c.multi_compress_to_buffer(parts, threads=0)), "int64", len(parts))
                         for c in (self.plain, self.paired))
        return (plain - paired).astype(float)


def features(saved: np.ndarray, thresholds=THRESHOLDS) -> list[float]:
    """Statistics of a text's distances; two of them for each threshold, at the end."""
    n = len(saved)
    if not n:
        return [0.0] * (5 + 2 * len(thresholds))
    top = np.sort(saved)[-2:]
    over = [int((saved >= t).sum()) for t in thresholds]
    return [float(saved.mean()), float(top[-1]), float(top.mean()), float(np.maximum(saved - 2, 0).sum() / n),
            float(np.log1p(n)), *[k / n for k in over], *[float(np.log1p(k)) for k in over]]


def _columns(thresholds: tuple[int, int]) -> list[int]:
    """Where the features of two thresholds stand among those of all."""
    at = [5 + THRESHOLDS.index(t) for t in thresholds]
    return [*range(5), *at, *[k + len(THRESHOLDS) for k in at]]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3, rounds: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        bend = x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, tuple, tuple, tuple]:
    """(log-likelihood, means, scales, weights) of the logistic curve over some features."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(y)), (x - mean) / scale])
    w = _logistic(z, y, weight)
    odds = np.clip(z @ w, -30, 30)
    return float((weight * (y * odds - np.log1p(np.exp(odds)))).sum()), tuple(mean), tuple(scale), tuple(w)


def fit(labelled: DataFrame, counts: dict[int, int], text: str = "text", label: str = "label",
        doc_id: str = "doc_id", most_windows: int = MOST_WINDOWS) -> Model:
    """The model of labelled rows (a bounded sample; ``counts``: rows of each class that it stands for). The dictionaries
    learn from at most ``most_windows`` windows of each class in two thirds of the rows, the rest calibrates."""
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    rows = common.stored(labelled.select(F.col(text).alias(text), F.col(label).alias(label), (
        F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(3)) != 0).alias("__fit")), "labelled")

    def cut():
        return lambda col: [pa.array([[w.decode(errors="ignore") for w in windows(t, TRAIN_WORDS)]
                                      for t in common.texts(col)], pa.list_(pa.string()))]

    cuts = common.map_columns(rows.where("__fit"), [text], [StructField("w", ArrayType(StringType()))], cut, [label])
    parts = cuts.select(label, F.explode("w").alias("w")).distinct()
    sample = {c: [r[0].encode() for r in parts.where(F.col(label) == c).select("w")
                  .orderBy(F.xxhash64("w"), "w").limit(most_windows).collect()] for c in (0, 1)}
    if not sample[0] or not sample[1]:
        return Model(b"", b"", prior=prior)
    model = Model(*train(sample[1], sample[0]))
    seen = _with_features(rows.where("not __fit"), model, text, [label]).collect()
    x = np.array([r["features"] for r in seen], float).reshape(len(seen), 5 + 2 * len(THRESHOLDS))
    y = np.array([r[label] for r in seen], float)
    if len({*y}) < 2:
        return Model(b"", b"", prior=prior)
    # Each class weighs as much as it does among all labelled rows.
    share = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    found = [(*_calibrated(x[:, _columns(pair)], y, share), pair) for pair in combinations(THRESHOLDS, 2)]
    _, mean, scale, w, pair = max(found, key=lambda f: f[0])
    return Model(model.ordinary, model.toxic, pair, mean, scale, w, prior)


def _with_features(df: DataFrame, model: Model, text: str, keep) -> DataFrame:
    def task():
        distances = common.cached_in_task(("distances", hash(model)), lambda: Distances(model))
        return lambda col: [pa.array([features(distances.of(t)) for t in common.texts(col)], pa.list_(pa.float64()))]

    return common.map_columns(df, [text], [StructField("features", ArrayType(DoubleType()))], task, keep)


def score(df: DataFrame, model: Model, text: str = "text", keep=None) -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` (1 from PREDICT_FROM on) of each whole text."""
    def task():
        if not model.weights:
            made = lambda texts: np.full(len(texts), model.prior)
        else:
            distances = common.cached_in_task(("distances", hash(model)), lambda: Distances(model))
            mean, scale, w = map(np.array, (model.mean, model.scale, model.weights))

            def made(texts):
                x = np.array([features(distances.of(t), model.thresholds) for t in texts]).reshape(len(texts), len(mean))
                x = (x - mean) / scale
                return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))

        def batch(col):
            s = made(common.texts(col))
            return [pa.array(s, pa.float64()), pa.array((s >= PREDICT_FROM).astype("int32"), pa.int32())]

        return batch

    return common.map_columns(df, [text], [StructField("score", DoubleType()), StructField("predicted", IntegerType())],
                              task, keep)


def ordinary_rows(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` that are not predicted toxic, with their columns as they are (also if named like a result)."""
    held = [f"__t_{i}" for i in range(len(df.columns))]
    scored = score(df.toDF(*held), model, held[df.columns.index(text)])
    return scored.where("predicted = 0").select(*[F.col(h).alias(c) for h, c in zip(held, df.columns)])
