"""Language identification by string kernels.

A text is the set of its byte 1-, 2- and 3-grams (ASCII letters in lower case): the blended-spectrum presence kernel of
two texts is the number of n-grams they share, divided by the root of the product of their counts. Nyström landmarks
give each training text a vector (kernel values with the landmarks, whitened by the landmarks' own kernel matrix), and
one-versus-rest kernel ridge regression is solved on those vectors. The kernel is linear in the presence vector, so the
landmarks' part of a score is folded once into a matrix n-gram x class, and a batch of texts is scored by the product of
its presence matrix with that matrix. Grams are addressed by 16 hash bits.

Fitting reads a bounded sample of whole texts (see ``train``); scoring reads every byte of every text. Defined cases: a null text or one without a letter is ``und`` with score 0;
ties go to the first language in alphabetical order; without any training row every text is ``und``. Empty tables give
empty results, and other columns are carried along whatever their names (see ``identify``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNDECIDED = "und"
_D = 1 << 16


def gram_codes(body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """16-bit codes of the 1-, 2- and 3-grams that begin at each byte."""
    b = common.LOWER[body].astype(np.uint32)
    one = (b * np.uint32(40503) + np.uint32(7)).astype(np.uint16)
    two_ = b[:-1] << np.uint32(8) | b[1:]
    two = (two_ * np.uint32(2654435761) >> np.uint32(16)).astype(np.uint16)
    three_ = two_[:-1] << np.uint32(8) | b[2:]
    three = ((three_ ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519) >> np.uint32(16)).astype(np.uint16)
    return one, two, three


def presence(body: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The codes that occur in each text, ascending."""
    flags = np.zeros(_D, bool)
    for i, j in common.slices(offsets, 1 << 20):
        at = offsets[i : j + 1] - offsets[i]
        one, two, three = gram_codes(body[offsets[i] : offsets[j]])
        for s, e in zip(at[:-1], at[1:], strict=True):
            flags[one[s:e]] = True
            flags[two[s : max(s, e - 1)]] = True
            flags[three[s : max(s, e - 2)]] = True
            found = np.flatnonzero(flags)
            flags[found] = False
            yield found


@dataclass(frozen=True)
class LanguageModel:
    classes: tuple[str, ...]
    weights: np.ndarray  # n-gram x class
    scale: float

    def scores(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each class for each text: batched products, then a logistic link."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.classes)))
        if not len(self.classes):
            return out
        codes, sizes, first, held = [], [], 0, 0

        def flush(upto: int) -> None:
            if not codes:
                return
            flat, size = np.concatenate(codes), np.array(sizes)
            total = np.zeros((len(flat) + 1, len(self.classes)))
            np.cumsum(self.weights[flat], axis=0, out=total[1:])
            ends = np.cumsum(size)
            out[first:upto] = (total[ends] - total[ends - size]) / np.sqrt(np.maximum(size, 1))[:, None]
            codes.clear()
            sizes.clear()

        for i, found in enumerate(presence(body, offsets)):
            codes.append(found)
            sizes.append(len(found))
            held += len(found) * len(self.classes)
            if len(codes) == 256 or held > 1 << 22:
                flush(i + 1)
                first, held = i + 1, 0
        flush(n)
        z = out * self.scale
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], landmarks: int = 192, ridge: float = 1e-3, scale: float = 6.0) -> LanguageModel:
    """Kernel ridge regression, one class against the rest, on the Nyström vectors of ``texts``."""
    classes = tuple(sorted(set(labels)))
    if not classes:
        return LanguageModel((), np.zeros((_D, 0)), scale)
    body, offsets = common.buffers(pa.array(texts, pa.string()))
    sets = list(presence(body, offsets))
    chosen = np.unique(np.linspace(0, len(sets) - 1, min(landmarks, len(sets))).astype(int))
    marks = np.zeros((len(chosen), _D), np.uint8)
    for row, i in enumerate(chosen):
        marks[row, sets[i]] = 1
    root = np.sqrt([max(1, len(codes)) for codes in sets])
    kernel = np.stack([marks[:, codes].sum(axis=1, dtype=np.int64) for codes in sets]) / root[:, None] / root[chosen]
    del marks
    values, vectors = np.linalg.eigh(kernel[chosen])
    fine = values > 1e-6 * max(values.max(), 1e-12)
    whiten = vectors[:, fine] / np.sqrt(values[fine])
    phi = kernel @ whiten
    y = np.where(np.array(labels)[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    weight = np.array([1 / max(1, labels.count(c)) for c in labels]) * len(labels) / len(classes)
    w = np.linalg.solve(phi.T @ (phi * weight[:, None]) + ridge * len(sets) * np.eye(phi.shape[1]), phi.T @ (y * weight[:, None]))
    folded = np.zeros((_D, len(classes)))
    for i, part in zip(chosen, (whiten @ w) / root[chosen][:, None], strict=True):
        folded[sets[i]] += part
    return LanguageModel(classes, folded, scale)


def train(docs: DataFrame, learn: Column, per_class: int = 300, most: int = 60_000, text: str = "text", lang: str = "lang", **options) -> LanguageModel:
    """Fits on a bounded sample of the rows for which ``learn`` holds: of each language at most ``per_class`` different texts.

    Every language of those rows is learned. With more than ``most`` / ``per_class`` of them, each has as many fewer texts
    (one at least) that the sample has about ``most``. A language's texts are dealt to buckets by hash; each bucket gives
    its smallest hash, and of those the smallest are taken, so one pass over keys finds the sample, the same on any cluster.
    """
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("label"), F.xxhash64(F.col(text), F.lit(17)).alias("h"))
    buckets = common.written(rows.groupBy("label", F.pmod("h", F.lit(8 * per_class)).alias("bucket")).agg(F.min("h").alias("h")), "sample")
    classes = buckets.select("label").distinct().count()
    if not classes:
        return fit([], [], **options)
    each = max(1, min(per_class, most // classes))
    place = F.row_number().over(Window.partitionBy("label").orderBy("h"))  # of 8 * per_class rows at most
    chosen = buckets.withColumn("place", place).filter(F.col("place") <= each).select("label", "h")
    source = docs.filter(learn).select(F.col(lang).alias("label"), F.col(text).alias("t"), F.xxhash64(F.col(text), F.lit(17)).alias("h"))
    got = source.join(F.broadcast(chosen), ["label", "h"]).groupBy("label", "h").agg(F.min("t").alias("t")).orderBy("h", "label").collect()
    model = fit([r["t"] for r in got], [r["label"] for r in got], **options)
    common.release(True)
    return model


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def has_letters(texts: pa.Array, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter; only texts without ASCII letters are looked at by character."""
    count = np.zeros(len(body) + 1, np.int64)
    np.cumsum(_ASCII_LETTER[body], out=count[1:])
    out = count[offsets[1:]] > count[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a last column ``into``: struct of lang_pred and score. Other columns pass through.

    Where ``docs`` has a column of that name, underscores are added to it; the new column is the last one in any case.
    """
    into = common.free_name(docs, into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))])
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        model_ = shared.value
        for batch in batches:
            texts = batch.column(at)
            body, offsets = common.buffers(texts)
            parts = [has_letters(texts.slice(i, j - i), body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in common.slices(offsets, 4 << 20)]
            fine = np.concatenate([np.zeros(0, bool), *parts]) & bool(model_.classes)
            p = model_.scores(body, offsets)
            if model_.classes:
                top = p.argmax(axis=1)
                names = [model_.classes[k] if ok else UNDECIDED for k, ok in zip(top, fine, strict=True)]
                best = np.where(fine, p.max(axis=1), 0.0)
            else:
                names, best = [UNDECIDED] * batch.num_rows, np.zeros(batch.num_rows)
            found = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(best, pa.float64())], names=["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([*batch.columns, found], schema=pa.schema([*batch.schema, pa.field(into, found.type)]))

    return docs.mapInArrow(score, schema)
