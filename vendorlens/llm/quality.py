"""Quality classifier: naive Bayes support vectors.

A document is the set of its n-grams (indicators, hashed into a fixed number of places). Each place is scaled by its class
log-count ratio; a linear hinge-loss model on the scaled indicators is fitted by dual coordinate descent. Its
margin becomes a probability through a logistic curve fitted on training rows the model has not seen.

The n-grams: 1 to 3 bytes of the text; 2, 4 and 6 characters of its shape (upper, lower, digit, other signs as
they are); and what repeats: equal neighbouring words and equal lines, in steps of their share.
"""

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, byte_texts, id_crc, tidied

PLACES = 1 << 18
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = 48
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 18


def _grams(data: np.ndarray, n: int, kind: int) -> np.ndarray:
    count = max(0, len(data) - n + 1)
    code = np.zeros(count, np.uint64)
    for k in range(n):
        code = (code << np.uint64(8)) | data[k:k + count]
    return ((code + np.uint64(kind << 56)) * _MIX) >> np.uint64(64 - 18)


def _step(share: float) -> int:
    """0 for none, then one step for each doubling from 1 in 256 on."""
    return 0 if share <= 0 else max(1, 9 + int(np.floor(np.log2(share))))


def features(data: bytes | None) -> np.ndarray:
    """The distinct places of a text's n-grams, sorted. A long text is read in pieces that overlap."""
    data = data or b""
    marked = np.zeros(PLACES, bool)
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, max(1, len(whole)), _PIECE):
        piece = whole[at:at + _PIECE + 5]
        for n in (1, 2, 3):
            marked[_grams(piece, n, n)] = True
        shape = _SHAPE[piece]
        for n in (2, 4, 6):
            marked[_grams(shape, n, 8 + n)] = True
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    same = sum(map(operator.eq, words, words[1:])) / max(1, len(words) - 1)
    again = 1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0
    extra = np.array([(32 << 8) + _step(same), (33 << 8) + _step(again), (34 << 8) + (not words)], np.uint64)
    marked[(extra * _MIX) >> np.uint64(64 - 18)] = True
    return np.flatnonzero(marked).astype(np.int32)


def log_count_ratios(rows: list, y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of the share of each place among the places of class 1, over that of class -1."""
    counts = {s: smooth + np.bincount(np.concatenate([r for r, z in zip(rows, y) if z == s] or [np.zeros(0, int)]), minlength=PLACES) for s in (1, -1)}
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())


def dual_coordinate_descent(rows: list, values: list, y: np.ndarray, cost: np.ndarray, size: int, rounds: int = 30, seed: int = 0):
    """Weights (the last one for the constant 1) that minimise |w|^2 / 2 + sum of cost * hinge loss.

    Each step solves for one dual variable exactly and moves the weights along; a round without a step above 1e-4 ends it.
    """
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            new = min(max(alpha[i] - slope / square[i], 0), cost[i])
            move = new - alpha[i]
            if move:
                alpha[i] = new
                w[rows[i]] += move * y[i] * values[i]
                w[-1] += move * y[i]
                worst = max(worst, abs(move))
        if worst < 1e-4:
            break
    return w


@dataclass
class Model:
    """Margin of a set of places: their weights' sum over the root of their scaled length, plus a constant; then a logistic curve."""

    weight: np.ndarray
    square: np.ndarray
    constant: float
    slope: float
    shift: float

    def margin(self, places: np.ndarray) -> float:
        return float(self.weight[places].sum() / np.sqrt(max(self.square[places].sum(), 1e-12)) + self.constant)

    def score(self, data: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(data)) + self.shift, -500, 500))))


def _logistic(margins: np.ndarray, y: np.ndarray):
    """Slope (positive) and shift of the curve that fits best, by Newton steps on smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    beta, x = np.array([1.0, 0.0]), np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (beta[0], beta[1]) if beta[0] > 0 else (1.0, 0.0)


def fit(rows: list, labels: list, cost: float = 1.0) -> Model:
    """A model from sets of places and labels (1 good, 0 not). The last fifth sets the curve. One class alone gives its constant."""
    y = np.where(np.array(labels) == 1, 1, -1)
    if len(set(y.tolist())) < 2:
        share = 0.5 if not len(y) else float(y[0] > 0) * 0.98 + 0.01
        return Model(np.zeros(PLACES), np.ones(PLACES), 0.0, 1.0, float(np.log(share / (1 - share))))
    train = np.arange(len(y)) % 5 != 4
    if len(set(y[train].tolist())) < 2 or len(set(y[~train].tolist())) < 2:
        train = np.ones(len(y), bool)
    mine = [rows[i] for i in np.flatnonzero(train)]
    ratio = log_count_ratios(mine, y[train])
    values = [ratio[r] / max(np.sqrt((ratio[r] ** 2).sum()), 1e-6) for r in mine]
    share = np.array([(y[train] == s).mean() for s in (1, -1)])
    weights = np.where(y[train] > 0, 0.5 / share[0], 0.5 / share[1]) * cost
    w = dual_coordinate_descent(mine, values, y[train], weights, PLACES)
    model = Model(w[:-1] * ratio, ratio ** 2, float(w[-1]), 1.0, 0.0)
    held = np.flatnonzero(~train) if (~train).any() else np.arange(len(y))
    model.slope, model.shift = map(float, _logistic(np.array([model.margin(rows[i]) for i in held]), y[held]))
    return model


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int, doc_id="doc_id", text="text", label="quality") -> DataFrame:
    """``id, label, places`` of at most ``per_class`` labelled rows of each class, by hash of the id, outside the held-out fold.

    A document with several labels counts with the least. Texts are read whole, in the tasks; ids alone are chosen from.
    """
    of = (labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & (id_crc(doc_id) % 3 != 1))
          .groupBy(F.col(doc_id).alias("id")).agg(F.min(label).cast("int").alias("label")))
    here = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"))
    chosen = bounded_sample(of.join(here, "id", "left_semi"), "label", per_class)

    def run(batches):
        for batch in batches:
            places = [features(x) for x in byte_texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int32()))], names=["id", "label", "places"])

    # At most 2 * per_class rows of two numbers.
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text")
    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, label int, places array<int>")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, doc_id="doc_id", text="text", label="quality") -> Model:
    """A model from a sample bounded by ``per_class`` documents of each class; a document gives PLACES numbers at most, some thousand as a rule."""
    rows = training_sample(docs, labels, per_class, doc_id, text, label).toArrow()
    order = np.lexsort((rows.column("label").to_numpy(), rows.column("id").to_numpy()))
    places = rows.column("places").combine_chunks()
    return fit([places[i].values.to_numpy() for i in order], rows.column("label").to_numpy()[order].tolist())


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality", **limits) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``; the score looks at the text alone.

    ``held_out``: the id's crc32 leaves 1 modulo 3; such rows are never learned from. Null texts score as empty ones.
    Without any label the score is 0.5; with one class only it is 0.99 or 0.01. A null doc_id is neither held out nor learned from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels, doc_id=doc_id, text=text, label=label, **limits))

    def run(batches):
        for batch in batches:
            scores = np.array([shared.value.score(x) for x in byte_texts(batch.column(2))], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    wanted = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(id_crc(doc_id) % 3 == 1, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return wanted.mapInArrow(tidied(run), f"doc_id {wanted.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
