"""Quality scores by a linear support vector machine over naive Bayes features.

A text is the set of its n-grams: runs of three bytes, and runs of three word shapes (length, case, digits, signs, and
whether the word repeats the one before it). Each indicator is scaled by the log ratio of its rate in good and bad
texts; a linear hinge-loss model over these is fitted by dual coordinate descent, and its margins are turned into
probabilities. Texts are scored in one pass, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from tallygrain.llm.common import map_whole_rows, to_batch
from tallygrain.llm.tokens import mix, slices, text_bytes, word_codes, words

SAMPLE = 6_000  # labelled documents that the model is fitted on, at most
BITS = 16  # of a feature's number
PENALTY = 1.0
EPOCHS = 20
SMOOTHING = 1.0

_FEATURES = pa.schema([("label", pa.int32()), ("features", pa.binary())])
_DIGITS, _CAPITALS, _LETTERS = (np.zeros(256, bool) for _ in range(3))
_DIGITS[48:58] = True
_CAPITALS[65:91] = True
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A small number for the looks of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask[data])))
        return total[ends] - total[starts]

    size = ends - starts
    letters, capitals, digits = share(_LETTERS), share(_CAPITALS), share(_DIGITS)
    codes = word_codes(data, starts, ends)
    repeat = np.zeros(len(codes), bool)
    repeat[1:] = codes[1:] == codes[:-1]
    repeat[counts[:-1][counts[:-1] < len(codes)]] = False
    length = np.searchsorted([2, 4, 7, 12, 20], size, "right")
    case = np.where(capitals == 0, 0, np.where(capitals > 1, 2, 1))
    signs = np.minimum(size - letters - digits, 3)
    return (((length * 3 + case) * 4 + signs) * 2 + (digits > 0)) * 2 + repeat


def text_features(batch_text: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct feature numbers of each text."""
    data, offsets = text_bytes(batch_text)
    starts, ends, counts = words(data, offsets)
    wide = data.astype(np.uint64)
    three = wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16) if len(data) > 2 else wide[:0]
    by_bytes = (mix(three + np.uint64(1)) >> np.uint64(64 - BITS)).astype(np.int64)
    shapes = _shapes(data, starts, ends, counts).astype(np.uint64)
    run = shapes[:-2] | shapes[1:-1] << np.uint64(16) | shapes[2:] << np.uint64(32) if len(shapes) > 2 else shapes[:0]
    by_shapes = (mix(run + np.uint64(1 << 60)) >> np.uint64(64 - BITS)).astype(np.int64)
    seen = np.zeros(1 << BITS, bool)
    for i in range(len(offsets) - 1):
        seen[by_bytes[offsets[i] : max(offsets[i], offsets[i + 1] - 2)]] = True
        seen[by_shapes[counts[i] : max(counts[i], counts[i + 1] - 2)]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


@dataclass
class QualityModel:
    weights: np.ndarray  # of each feature, ratio and slope in one
    bias: float
    slope: float
    offset: float

    def score(self, features: np.ndarray) -> float:
        """Probability of a good text."""
        margin = self.bias + (self.weights[features].sum() / np.sqrt(len(features)) if len(features) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))


def _log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log of each feature's share among good texts over that among bad ones."""
    counts = np.full((2, 1 << BITS), SMOOTHING)
    for features, label in zip(rows, labels, strict=True):
        counts[label, features] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def _dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, seed: int = 5) -> np.ndarray:
    """Weights of the L1 hinge loss; the last one belongs to a constant feature. Rarer labels weigh more."""
    weights = np.zeros((1 << BITS) + 1)
    alpha = np.zeros(len(rows))
    norms = np.array([x @ x for x in values]) + 1
    bound = np.where(signs > 0, PENALTY * len(signs) / (2 * (signs > 0).sum()), PENALTY * len(signs) / (2 * (signs < 0).sum()))
    random = np.random.Generator(np.random.PCG64(seed))
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            gradient = signs[i] * (weights[rows[i]] @ values[i] + weights[-1]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), bound[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                weights[rows[i]] += step * values[i]
                weights[-1] += step
                alpha[i] = new
    return weights


def _calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, with softened labels, by Newton's method."""
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    design = np.column_stack((margins, np.ones(len(margins))))
    at = np.array([1.0, 0.0])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-design @ at))
        curvature = (design * (chance * (1 - chance))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(curvature, design.T @ (target - chance) - 1e-6 * at)
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(at[0]), 1e-6), float(at[1])


def fit_quality(rows: list[np.ndarray], labels: np.ndarray) -> QualityModel:
    """Fit on feature sets and labels 0 and 1; with one label only, its share alone decides."""
    if len(np.unique(labels)) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return QualityModel(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(share / (1 - share))))
    # Margins for the calibration come from halves that the weights were not fitted on.
    margins = np.zeros(len(rows))
    half = np.arange(len(rows)) % 2
    for part in (0, 1):
        inside, outside = np.flatnonzero(half == part), np.flatnonzero(half != part)
        if len(np.unique(labels[inside])) < 2 or not len(outside):
            inside = outside = np.arange(len(rows))
        weights, bias = _weights([rows[i] for i in inside], labels[inside])
        model = QualityModel(weights, bias, 1.0, 0.0)
        for i in outside:
            margins[i] = bias + (model.weights[rows[i]].sum() / np.sqrt(len(rows[i])) if len(rows[i]) else 0.0)
    slope, offset = _calibrated(margins, labels)
    weights, bias = _weights(rows, labels)
    return QualityModel(weights, bias, slope, offset)


def _weights(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    ratios = _log_ratios(rows, labels)
    values = [ratios[x] / np.sqrt(max(1, len(x))) for x in rows]
    weights = _dual_coordinate_descent(rows, values, np.where(labels == 1, 1.0, -1.0))
    return weights[:-1] * ratios, float(weights[-1])


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> QualityModel:
    """Fit on at most ``sample`` labelled documents, picked by id hash.

    Labels other than 0 and 1, labels without id, and ids with both labels teach nothing; repeated labels count once.
    Of rows that share an id the least text counts, and null text is empty. Without any labelled document every text gets a score of one half. The picked ids are
    few by that bound, so they are broadcast; only feature sets reach the driver.
    """
    one = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    one = one.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    one = one.where("label = other").select("doc_id", "label")
    total = one.count()
    steps = 1 << 30
    share = int(steps * min(1.0, 0.95 * sample / max(1, total)))
    picked = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < share).limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [x.astype(np.uint16).tobytes() for x in text_features(batch.column("text"))]
            yield to_batch({"label": batch.column("label"), "features": found}, _FEATURES)

    rows = known.mapInArrow(run, "label int, features binary").orderBy(F.xxhash64("features"), "label").collect()
    return fit_quality([np.frombuffer(r.features, np.uint16).astype(np.int64) for r in rows], np.array([r.label for r in rows], np.int64))


def score_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the probability that the text is good.

    Null text counts as empty; a text without n-grams gets the score of the constant term. Whole texts count. A column
    that already has the new name is replaced. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score_col)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in slices(batches, column=f"c{place}"):
            scores = [judge.score(found) for found in text_features(batch.column(place))]
            columns = [*batch.columns, pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    return map_whole_rows(docs, run, [StructField(score_col, DoubleType())])
