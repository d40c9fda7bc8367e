"""Language identification with interpolated Kneser-Ney character models.

One model per language is counted over every labelled row of the corpus (no sample): Python
workers count character 4-grams with numpy, the JVM adds up (language, 4-gram) counts, and the
driver turns the distinct 4-grams - a number bounded by the alphabet, not by the corpus - into
interpolated Kneser-Ney tables: sorted arrays of 64-bit n-gram hashes with one column a language.
Scoring is one narrow pass: a text goes to the language of the lowest cross-entropy a character.
The characters of a model are a-z, the boundary between words, and 21 classes that all other letters share by
code point: enough to tell languages and scripts apart, not to read them.

Rejection is calibrated on the corpus counts themselves. For each language they give the mean and
variance of a character's code length; a null text of independently drawn characters of the same
corpus gives the code length of non-language. A text is rejected when its cross-entropy is above
the midpoint of the two plus `z` standard errors at its own length, so that short texts are not
rejected for chance.

Edge cases: a null text counts as empty; a text without letters has no language (`und`) and is
rejected; null labels train nothing but their rows are scored; ties go to the language that sorts
first; repeated rows are scored each by itself; with no labelled row everything is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, grams, segment_sums

WIDTH = 48
ORDER = 4
_SPAN = WIDTH**ORDER
SCHEMA = "doc_id bigint, predicted_lang string, cross_entropy double, margin double, n_scored bigint, keep boolean"


def hash_codes(codes: np.ndarray, order: int) -> np.ndarray:
    """64-bit mix of an n-gram code and its order (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        z = codes.astype(np.uint64) + np.uint64(order) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class SortedHashArray:
    """Values of shape (keys, languages) behind a sorted array of hashes; 0/`default` if absent."""

    def __init__(self, codes: np.ndarray, values: np.ndarray, order: int, default: float = 0.0):
        h = hash_codes(codes, order)
        at = np.argsort(h)
        self.keys, self.values, self.order, self.default = h[at], values[at], order, default

    def get(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full((len(codes), self.values.shape[1]), self.default)
        h = hash_codes(codes, self.order)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where((self.keys[i] == h)[:, None], self.values[i], self.default)


class KneserNey:
    """Interpolated Kneser-Ney over 4-gram counts; all languages side by side."""

    def __init__(self, languages: list[str], langs: np.ndarray, codes: np.ndarray, counts: np.ndarray, z: float = 6.0):
        self.languages = languages
        n = len(languages)
        self.mass, self.back = [], []
        per = [(codes[langs == k].astype(np.int64), counts[langs == k].astype(np.float64)) for k in range(n)]
        raw = per
        for order in range(ORDER, 0, -1):
            mass, back = [], []
            for c, x in per:
                n1, n2 = float((x == 1).sum()), float((x == 2).sum())
                d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                ctx, inv = np.unique(c // WIDTH, return_inverse=True)
                total = np.bincount(inv, weights=x, minlength=len(ctx))
                kinds = np.bincount(inv, minlength=len(ctx))
                mass.append((c, (x - d) / total[inv] if len(c) else x))
                back.append((ctx, d * kinds / np.maximum(total, 1)))
            self.mass.append(self._table(mass, order, 0.0))
            self.back.append(self._table(back, 10 + order, 1.0))
            if order > 1:  # continuation counts: the distinct characters before each shorter gram
                per = [np.unique(c % WIDTH ** (order - 1), return_counts=True) for c, _ in per]
        self.mean, self.var, self.null = np.zeros(n), np.zeros(n), np.zeros(n)
        for k, (c, x) in enumerate(raw):
            if not len(c):
                continue
            cost = -self.log_prob(c)[:, k]
            self.mean[k] = (x * cost).sum() / x.sum()
            self.var[k] = (x * (cost - self.mean[k]) ** 2).sum() / x.sum()
            self.null[k] = self._null_cost(c, x, k)
        self.z = z

    def _table(self, parts: list[tuple[np.ndarray, np.ndarray]], order: int, default: float) -> SortedHashArray:
        keys = np.unique(np.concatenate([c for c, _ in parts]))
        values = np.full((len(keys), len(parts)), default, dtype=np.float32)
        for k, (c, v) in enumerate(parts):
            values[np.searchsorted(keys, c), k] = v
        return SortedHashArray(keys, values, order, default)

    def _null_cost(self, codes: np.ndarray, counts: np.ndarray, k: int) -> float:
        share = np.bincount(codes % WIDTH, weights=counts, minlength=WIDTH)
        z = np.random.default_rng(7).choice(WIDTH, size=20_000, p=share / share.sum())
        z1 = np.append(0, z[:-1])
        z2 = np.append([0, 0], z[:-2]) * (z1 != 0)
        z3 = np.append([0, 0, 0], z[:-3]) * (z2 != 0)
        uniq, n = np.unique(((z3 * WIDTH + z2) * WIDTH + z1) * WIDTH + z, return_counts=True)
        return float((n * -self.log_prob(uniq)[:, k]).sum() / n.sum())

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        """Natural-log probability of each 4-gram's last character, one column a language."""
        codes = codes.astype(np.int64)
        p = np.full((len(codes), len(self.languages)), 1.0 / WIDTH)
        for order in range(1, ORDER + 1):
            c = codes % WIDTH**order
            p = self.mass[ORDER - order].get(c) + self.back[ORDER - order].get(c // WIDTH) * p
        return np.log(np.maximum(p, 1e-12))

    def limit(self, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Highest cross-entropy at which a text of n characters is still language k."""
        return (self.mean[k] + np.maximum(self.null[k], self.mean[k])) / 2 + self.z * np.sqrt(self.var[k] / np.maximum(n, 1))


class Scorer:
    """A worker's memo over the sorted hash arrays: each distinct 4-gram is looked up once."""

    def __init__(self, model: KneserNey):
        self.model = model
        self.memo = np.zeros(_SPAN, dtype=np.int32)
        self.rows = np.zeros((1 << 16, len(model.languages)), dtype=np.float32)
        self.used = 1

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(summed log-probabilities by text and language, characters scored by text)"""
        codes, starts = grams(texts, WIDTH, False)
        at = self.memo[codes]
        unknown = np.unique(codes[at == 0])
        if len(unknown):
            while self.used + len(unknown) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.used : self.used + len(unknown)] = self.model.log_prob(unknown)
            self.memo[unknown] = np.arange(self.used, self.used + len(unknown))
            self.used += len(unknown)
            at = self.memo[codes]
        total = np.column_stack([segment_sums(self.rows[:, k][at], starts, len(codes)) for k in range(self.rows.shape[1])])
        return total, np.append(starts[1:], len(codes)) - starts

    def decide(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        total, n = self(texts)
        cost = -total / np.maximum(n, 1)[:, None]
        best = cost.argmin(axis=1)
        low = cost[np.arange(len(cost)), best]
        rest = cost.copy()
        rest[np.arange(len(cost)), best] = np.inf
        margin = np.where(np.isinf(second := rest.min(axis=1)), 0.0, second - low)
        return best, low, margin, n, (n > 0) & (low <= self.model.limit(best, n))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    keys: list[np.ndarray] = []
    sums: list[np.ndarray] = []

    def merge() -> tuple[np.ndarray, np.ndarray]:
        k, inv = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(inv, weights=np.concatenate(sums)).astype(np.int64)

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi, part in chunks(texts):
            codes, starts = grams(part, WIDTH, False)
            ids = np.array([names.setdefault(x, len(names)) for x in langs[lo:hi]], dtype=np.int64)
            key = np.repeat(ids, np.append(starts[1:], len(codes)) - starts) * _SPAN + codes
            k, n = np.unique(key, return_counts=True)
            keys.append(k)
            sums.append(n)
            if sum(map(len, keys)) > 1 << 22:
                k, n = merge()
                keys, sums = [k], [n]
    if keys:
        k, n = merge()
        by_id = np.array(list(names), dtype=object)
        for lo in range(0, len(k), 1 << 18):
            part = slice(lo, lo + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(by_id[k[part] // _SPAN], type=pa.string()), pa.array((k[part] % _SPAN).astype(np.int32)), pa.array(n[part])], names=["lang", "code", "n"])


def fit(docs: DataFrame, z: float = 6.0) -> KneserNey | None:
    """Count all labelled rows of docs(text, lang); None if there are none."""
    counted = docs.select("text", "lang").where(F.col("lang").isNotNull()).mapInArrow(_count, "lang string, code int, n bigint")
    table = counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    if not table.num_rows:
        return None
    lang = table.column("lang").combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), dtype=np.int64)
    rank[order] = np.arange(len(names))
    return KneserNey(sorted(names), rank[lang.indices.to_numpy()], table.column("code").to_numpy(), table.column("n").to_numpy(), z)


def identify(docs: DataFrame, z: float = 6.0) -> DataFrame:
    """One row for each row of docs(doc_id, text, lang): predicted_lang (`und` if rejected for
    lack of letters), cross_entropy in nats a character, margin to the second language, the
    number of characters scored, and keep (false where the language is rejected)."""
    model = fit(docs, z)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model) if model else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi, part in chunks(texts):
                if scorer:
                    best, cost, margin, n, ok = scorer.decide(part)
                    names = [model.languages[b] if m else "und" for b, m in zip(best, n)]
                else:
                    names, cost, margin, n, ok = ["und"] * len(part), np.zeros(len(part)), np.zeros(len(part)), np.zeros(len(part), int), np.zeros(len(part), bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names, type=pa.string()), pa.array(cost), pa.array(margin), pa.array(n.astype(np.int64)), pa.array(ok)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(score, SCHEMA)


def keep_identified(docs: DataFrame, z: float = 6.0) -> DataFrame:
    """The rows of docs whose language is not rejected, with all their columns, in one narrow pass."""
    model = fit(docs, z)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model is None:
            return
        scorer = Scorer(model)
        for batch in batches:
            for lo, hi, part in chunks(batch.column(at).to_pylist()):
                yield batch.slice(lo, hi - lo).filter(pa.array(scorer.decide(part)[4]))

    return docs.mapInArrow(choose, docs.schema)
