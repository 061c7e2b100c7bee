"""Quality classifier: averaged vectors of hashed words, word pairs and character n-grams, with softmax."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .samples import labelled_sample
from .wordbytes import NONSPACE, mix, slices, words

BITS, DIM, EPOCHS, RATE, SEED = 16, 8, 6, 0.6, 11
CHAR_NGRAMS = (2, 3, 4)
#: Rows of each label to learn from, in expectation.
PER_CLASS = 1500
THRESHOLD = 0.7
SPACE = ~NONSPACE


def features(buf: np.ndarray, off: np.ndarray):
    """(bucket ids, where each text's begin and end, per kind) for words, word pairs and n-grams.

    Character n-grams lie within a word or take in the white space before or after it.
    """
    _, _, w, bounds = words(buf, off, NONSPACE)
    top = np.uint64(64 - BITS)
    yield (w >> top).astype(np.int32), bounds[:-1], bounds[1:]
    if len(w) > 1:
        pair = mix(w[:-1] * np.uint64(3) + w[1:])
        pair[w[:-1] == w[1:]] = 0  # one pair stands for all words that come twice in a row
        yield (pair >> top).astype(np.int32), np.minimum(bounds[:-1], len(pair)), np.maximum(np.minimum(bounds[:-1], len(pair)), bounds[1:] - 1)
    space = SPACE[buf]
    b = np.where(space, np.uint8(32), buf).astype(np.uint32)
    for n in CHAR_NGRAMS:
        if len(b) < n:
            continue
        m = len(b) - n + 1
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = (h + b[k : m + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        inner = np.zeros(m, bool)
        for k in range(1, n - 1):
            inner |= space[k : m + k]
        if n == 2:
            inner = space[:m] & space[1 : m + 1]
        kept = np.flatnonzero(~inner)
        ids = (h[kept] >> np.uint32(32 - BITS)).astype(np.int32)
        lo = np.searchsorted(kept, off[:-1])
        yield ids, lo, np.maximum(lo, np.searchsorted(kept, off[1:] - n + 1))


class QualityModel:
    """With two classes, softmax of an average is the logistic function of an average of numbers:
    each bucket's vector times the difference of the output vectors. Those numbers are what scores need.
    """

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
        for ids, lo, hi in features(buf, off):
            if not len(ids):
                continue
            run = np.concatenate([[0.0], np.cumsum(self.weight[ids], dtype=np.float64)])
            total += run[hi] - run[lo]
            count += hi - lo
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def train(sample: list[tuple[str, str]], odds: float = 1.0) -> QualityModel:
    """Stochastic gradient descent over documents, with the rate falling to zero.

    Classes weigh the same while it learns; odds, those of label 1 among all labelled rows, then
    shift the bias, so that scores are probabilities for such rows.
    """
    texts = [np.frombuffer(t.encode(), np.uint8) for _, t in sample]
    y = np.array([lab == "1" for lab, _ in sample])
    bags = []
    for t in texts:
        ids = np.concatenate([i for i, *_ in features(t, np.array([0, len(t)]))] or [np.zeros(0, np.int32)])
        u, c = np.unique(ids, return_counts=True)
        bags.append((u, (c / max(1, c.sum())).astype(np.float32)))
    rng = np.random.default_rng(SEED)
    e = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    if not len(y) or y.all() or not y.any():
        return QualityModel(np.zeros(1 << BITS, np.float32), 4.0 if len(y) and y.all() else -4.0 if len(y) else 0.0)
    # each class has the same total weight
    weight = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    steps = EPOCHS * len(bags)
    for k in range(steps):
        if k % len(bags) == 0:
            order = rng.permutation(len(bags))
        i = int(order[k % len(bags)])
        u, c = bags[i]
        v = c @ e[u]
        z = out @ v + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[int(y[i])] -= 1
        p *= np.float32(RATE * (1 - k / steps) * weight[i])
        back = p @ out
        out -= np.outer(p, v)
        bias -= p * np.float32(0.1)
        # averages of hundreds of vectors move slowly, so their step is scaled by the bag's size
        e[u] -= np.outer(c * np.float32(min(len(u), 400) ** 0.5), back)
    return QualityModel((e @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]) + float(np.log(odds)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    """Learns from labels 0 and 1 of rows whose crc32(id as text) mod 4 is not 2."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold(F.col("id"), 4) != 2))
    good, bad = known.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return train(labelled_sample(base, known, per_class, 2 * per_class), (good + 1) / (bad + 1))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Scores every whole text: id, held_out, score, predicted (1 from THRESHOLD on).

    Null and empty texts have no features and get the score of the model's bias. Repeated rows are
    scored each. With keep, docs' own rows with predicted 1 come back instead, unchanged.
    """

    def run(batches):
        for batch in batches:
            s = [model.scores(buf, off) for _, buf, off in slices(batch.column(batch.schema.names.index(text_col)))]
            s = np.concatenate(s) if s else np.zeros(0)
            if keep:
                yield batch.filter(pa.array(s >= THRESHOLD))
            else:
                good = (s >= THRESHOLD).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array(good)], names=[id_col, "held_out", "score", "predicted"])

    if keep:
        return docs.mapInArrow(run, docs.schema)
    base = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(fold(F.col(id_col), 4) == 2, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias(text_col))
    return base.mapInArrow(run, f"{id_col} long, held_out boolean, score double, predicted int")
