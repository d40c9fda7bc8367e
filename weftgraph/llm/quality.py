"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal training.

Tokens are runs of letters, of digits or of other signs, taken from the bytes of a text with
numpy: no Python object a word. Unigrams and bigrams hash into 2**BITS weights. A text's score is
the sparse dot product of its n-gram counts, divided by the root of their number, with the weights.

Training reads a bounded sample, `max_train` labelled documents (those whose doc_id hashes lowest),
in one task that streams them in hash order through follow-the-regularised-leader updates; its
L1 term leaves few weights other than 0, and those are all that reaches the driver. Scoring is one
narrow pass over all documents.

Edge cases: a null text counts as empty and an empty one has only the bias, the base rate;
labels that are null or without a document train nothing; several labels of one document train
each; without usable labels every document gets 0.5 and is kept; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, segment_sums

BITS = 20
MAX_TRAIN = 8000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
SCHEMA = "doc_id bigint, quality_score double, keep boolean"

_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[:33] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(indices of all unigrams and bigrams, text after text; where each text's begin)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    kind = _KIND[b]
    start = kind != 0
    start[1:] &= kind[1:] != kind[:-1]
    at = np.flatnonzero(start)
    first = np.zeros(len(raw), dtype=np.int64)
    first[1:] = np.cumsum([len(r) + 1 for r in raw[:-1]])
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(len(raw), dtype=np.int64)
    with np.errstate(over="ignore"):
        size = np.diff(np.append(at, len(b)))
        step = np.arange(len(b), dtype=np.int64)
        step[at[0] :] -= np.repeat(at, size)
        step[: at[0]] = 0
        power = np.cumprod(np.full(int(step.max()) + 2, 0x9E3779B97F4A7C15, dtype=np.uint64))
        word = _mix(np.add.reduceat(np.where(kind != 0, (b.astype(np.uint64) + np.uint64(1)) * power[step], np.uint64(0)), at))
        pair = _mix(word[:-1] * np.uint64(0xD6E8FEB86659FD93) + word[1:])
    begin = np.searchsorted(at, first)  # the first token of each text
    both = np.zeros(2 * len(word), dtype=np.uint64)
    both[0::2] = word
    both[1:-1:2] = pair
    # a pair sits after its first token; the last token of a text has none
    keep = np.ones(len(both), dtype=bool)
    last = np.append(begin[1:], len(word)) - 1
    keep[2 * last[last >= begin] + 1] = False
    idx = (both >> np.uint64(64 - bits)).astype(np.int64)[keep]
    tokens = np.append(begin[1:], len(word)) - begin
    return idx, np.append(0, np.cumsum(np.maximum(2 * tokens - 1, 0)))[:-1]


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss; the last weight is the bias."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weight(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.where(i == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, idx: np.ndarray, label: float) -> None:
        i, c = np.unique(idx, return_counts=True)
        i = np.append(i, len(self.z) - 1)
        x = np.append(c / np.sqrt(max(1, len(idx))), 1.0)
        w = self.weight(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        s = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - s * w
        self.n[i] += g * g


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_train: int) -> DataFrame:
    """(h, label, text): the bounded sample, the same whatever the order of rows."""
    ids = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("double").alias("label")).dropna()
    # max_train rows of 24 bytes
    ids = ids.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "label").limit(max_train)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select("h", "label", "text")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, epochs: int = EPOCHS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(indices, weights, bias), or None without labelled documents."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(bits), []
        for batch in batches:
            y = batch.column(1).to_pylist()
            for lo, _, part in chunks(batch.column(2).to_pylist()):
                idx, starts = features(part, bits)
                for k, (s, e) in enumerate(zip(starts, np.append(starts[1:], len(idx)))):
                    seen.append((idx[s:e].astype(np.int32), y[lo + k]))
        for _ in range(epochs):
            for idx, label in seen:
                model.update(idx.astype(np.int64), label)
        if seen:
            w = model.weight(np.arange((1 << bits) + 1))
            i = np.flatnonzero(w)
            i = np.unique(np.append(i, 1 << bits))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(w[i])], names=["i", "w"])

    sample = labelled_sample(docs, labels, "quality", max_train)
    one = sample.repartition(1).sortWithinPartitions("h", "label", "text")
    got = one.mapInArrow(train, "i int, w double").toArrow()
    if not got.num_rows:
        return None
    i, w = got.column("i").to_numpy(), got.column("w").to_numpy()
    at = i == 1 << bits
    return i[~at], w[~at], float(w[at][0])


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = 0.5) -> DataFrame:
    """(doc_id, quality_score, keep) for each row of docs; labels(doc_id, quality 0/1)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_train))  # at most 2**BITS weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        dense = np.zeros(1 << BITS, dtype=np.float32)
        if model:
            dense[model[0]] = model[1]
        for batch in batches:
            for lo, hi, part in chunks(batch.column(1).to_pylist()):
                if model:
                    idx, starts = features(part)
                    n = np.append(starts[1:], len(idx)) - starts
                    logit = segment_sums(dense[idx], starts, len(idx)) / np.sqrt(np.maximum(n, 1)) + model[2]
                else:
                    logit = np.zeros(len(part))
                p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "quality_score", "keep"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(score, SCHEMA)
