"""Quality scores by attention-based multiple-instance learning.

A text is a bag of passages of ``WORDS`` words. Each passage is encoded as the shares of its bytes (ASCII one by one,
the rest by their leading bits) and word statistics, then by one learned layer. Gated attention, tanh(V h) * sigmoid(U h)
weighted and normalised over the bag, learns from document labels alone which passages tell; the weighted sum of the
passages is scored by a logistic output. Everything is trained together by gradient descent on the driver.

Fitting reads a bounded sample (``per_label`` texts of each label, those of the smallest text hash, whole texts);
scoring reads every passage of every text. Defined cases: a null or blank text is a bag of one empty passage and gets
that passage's score; with no label or only one, every score is that label's share (0.5 without any). Rows with equal
texts get equal scores. Empty tables give empty results; other columns are carried along (see ``assess``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WORDS = 64

_CLASS = np.arange(256, dtype=np.int64)
_CLASS[128:] = 128 + (np.arange(128) >> 4)
_KINDS = 136
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_WIDTH = _KINDS + 6


def encode(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages x features, first passage of each text: n + 1)."""
    parts, firsts, base = [], [np.zeros(1, np.int64)], 0
    for i, j in common.slices(offsets, 1 << 20):
        part, first = _encode(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts.append(part)
        firsts.append(first[1:] + base)
        base += len(part)
    return (np.concatenate(parts) if parts else np.zeros((0, _WIDTH), np.float32)), np.concatenate(firsts)


def _encode(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first_word = common.words(body, offsets, _WORD)
    counts = np.diff(first_word)
    bags = np.maximum(1, -(-counts // WORDS))
    first = np.concatenate([[0], np.cumsum(bags)])
    n = int(first[-1])
    text_of = np.repeat(np.arange(len(counts)), counts)
    passage = first[text_of] + (np.arange(len(starts)) - first_word[text_of]) // WORDS
    out = np.zeros((n, _WIDTH), np.float32)
    # A passage's bytes reach from its first word to the next passage's; blanks before the first word count there.
    cut = np.repeat(offsets[:-1], bags)
    lead = np.flatnonzero(np.diff(passage, prepend=-1) != 0)
    inner = passage[lead] != first[text_of[lead]]
    cut[passage[lead[inner]]] = starts[lead[inner]]
    owner = np.zeros(len(body) + 1, np.int64)
    np.add.at(owner, cut[1:], 1)
    owner = np.cumsum(owner[:-1])
    size = np.bincount(owner, minlength=n).astype(np.float64)
    out[:, :_KINDS] = np.bincount(owner * _KINDS + _CLASS[body], minlength=n * _KINDS).reshape(n, _KINDS) / np.maximum(size, 1)[:, None]
    length = (ends - starts).astype(np.float64)
    words_ = np.bincount(passage, minlength=n).astype(np.float64)
    most = np.maximum(words_, 1)
    mean = np.bincount(passage, length, minlength=n) / most
    spread = np.sqrt(np.maximum(0, np.bincount(passage, length**2, minlength=n) / most - mean**2))
    key = common.word_hashes(body, starts, ends)
    order = np.lexsort((key, passage))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order][new], minlength=n) / most
    upper = (body[starts] >= 65) & (body[starts] <= 90) if len(starts) else np.zeros(0, bool)
    out[:, _KINDS:] = np.stack([mean / 8, spread / 8, distinct, np.bincount(passage, upper, minlength=n) / most, words_ / WORDS, np.log1p(size) / 8], axis=1)
    return out, first


@dataclass(frozen=True)
class QualityModel:
    share: float  # of label 1; the score where nothing could be learned
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    layers: dict[str, np.ndarray] | None = None

    def score(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(offsets) - 1, self.share)
        out = []
        for i, j in common.slices(offsets, 4 << 20):
            x, first = encode(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out.append(_forward(self.layers, (x - self.mean) / self.spread, first)["p"])
        return np.concatenate(out) if out else np.zeros(0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["enc"] + w["enc0"])
    v, u = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
    g = v * u
    e = g @ w["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), np.diff(first)))
    a = e / np.repeat(np.add.reduceat(e, first[:-1]), np.diff(first))
    z = np.add.reduceat(h * a[:, None], first[:-1], axis=0)
    return {"h": h, "v": v, "u": u, "g": g, "a": a, "z": z, "p": _sigmoid((z @ w["out"] + w["out0"]).astype(np.float64))}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    f, size = _forward(w, x, first), np.diff(first)
    d = ((f["p"] - y) * weight).astype(np.float32)
    dz = np.repeat(d, size)[:, None] * w["out"]
    da = (f["h"] * dz).sum(axis=1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), size))
    dg = de[:, None] * w["a"]
    dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
    dh = (f["a"][:, None] * dz + dv @ w["v"].T + du @ w["u"].T) * (1 - f["h"] ** 2)
    return {"enc": x.T @ dh, "enc0": dh.sum(axis=0), "v": f["h"].T @ dv, "u": f["h"].T @ du, "a": f["g"].T @ de, "out": f["z"].T @ d, "out0": d.sum(keepdims=True)}


def fit(texts: list[str], labels: list[int], hidden: int = 24, gate: int = 12, epochs: int = 60, bags: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> QualityModel:
    share = float(np.mean(labels)) if labels else 0.5
    if len(set(labels)) < 2:
        return QualityModel(share)
    x, first = encode(*common.buffers(pa.array(texts, pa.string())))
    mean, spread = x.mean(axis=0), x.std(axis=0) + 0.01
    x = ((x - mean) / spread).astype(np.float32)
    y = np.array(labels, np.float64)
    weight = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    draw = np.random.default_rng(seed)
    shapes = {"enc": (x.shape[1], hidden), "enc0": (hidden,), "v": (hidden, gate), "u": (hidden, gate), "a": (gate,), "out": (hidden,), "out0": (1,)}
    w = {k: (draw.normal(0, 1 / np.sqrt(s[0]), s) * (not k.endswith("0"))).astype(np.float32) for k, s in shapes.items()}
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = draw.permutation(len(y))
        for lo in range(0, len(order), bags):
            pick = order[lo : lo + bags]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in pick])
            cut = np.concatenate([[0], np.cumsum([first[i + 1] - first[i] for i in pick])])
            step += 1
            for k, grad in _gradients(w, x[rows], cut, y[pick], weight[pick] / len(pick)).items():
                grad = grad + decay * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad**2
                w[k] = w[k] - (rate * (1 - epoch / epochs) + 1e-4) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(share, mean, spread, w)


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1000, text: str = "text", doc_id: str = "doc_id", label: str = "quality", **options) -> QualityModel:
    """Fits on at most ``per_label`` labelled texts of each label, 1 or 0.

    A label above 0 counts as 1, any other as 0; an id with several labels counts as its largest; rows with a null label or
    id teach nothing.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    rank = F.xxhash64(F.col("id"), F.lit(23))
    picks = [known.filter(F.col("y") == y).select("id", "y", rank.alias("h")).orderBy("h", "id").limit(per_label) for y in (0, 1)]
    chosen = [tuple(r) for r in picks[0].unionByName(picks[1]).collect()]
    if not chosen:
        return fit([], [], **options)
    keys = docs.sparkSession.createDataFrame(chosen, "id long, y int, h long")
    got = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(keys), "id").groupBy("id", "y", "h").agg(F.min("t").alias("t")).orderBy("h", "id").collect()
    model = fit([r["t"] or "" for r in got], [r["y"] for r in got], **options)
    common.release(True)
    return model


def assess(docs: DataFrame, model: QualityModel, text: str = "text", into: str = "quality_score") -> DataFrame:
    """``docs`` with a last column ``into``: the probability of label 1.

    Where ``docs`` has a column of that name, underscores are added to it; the new column is the last one in any case.
    """
    into = common.free_name(docs, into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            found = pa.array(shared.value.score(*common.buffers(batch.column(at))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], schema=pa.schema([*batch.schema, pa.field(into, found.type)]))

    return docs.mapInArrow(score, schema)
