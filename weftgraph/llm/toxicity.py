"""Toxicity behind obfuscation: a noisy channel decoded by Viterbi, then a score of what it restores.

The channel writes letters as look-alikes (leetspeak, letters of other scripts, letter signs of all planes), puts separators between letters and repeats
letters. A character 4-gram model, counted over all documents (Python workers count, the JVM adds up),
says how likely a restored string is; the Viterbi path through the lattice of readings is the text.

Words are scored by log-odds learned from labelled documents, a bounded sample of `max_train` of
them. A word belongs to the lexicon if its odds are at least e**MIN_WEIGHT and its toxic
documents hold it in many different contexts. Equal labelled texts are learned from once, so copies of one
document outweigh nothing. Only words of the Latin script are learned.

Only a span that the channel can make from a lexicon word can change a score, so lattices are
built for those spans alone. They are found exactly: letters that share a look-alike form one
class, separators are dropped, runs collapsed, and an automaton of the lexicon in that alphabet
reads the whole text. The lattice then decides: 'los er' stays two words, 'l 0 s e r' is restored.

Edge cases: null and empty texts score the base rate without hits; labels that are null or have no
document teach nothing; with no lexicon nothing is toxic; repeated rows are scored each by itself;
texts of any length are read whole.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, code_points, grams
from .quality import labelled_sample

WIDTH = 27
MAX_TRAIN = 16000
MIN_WEIGHT = 3.0
MIN_CONTEXTS = 5
THRESHOLD = 0.95
LEET = {"0": "o", "1": "il", "!": "i", "|": "il", "3": "e", "4": "a", "@": "a", "$": "s", "5": "s", "7": "t", "+": "t", "8": "b", "6": "g", "9": "g", "(": "c", "<": "c", "€": "e", "£": "l", "2": "z"}
#: Letters of other scripts that look like one of a-z
LEET |= dict(zip("аеорсухіјѕһԁӏкмтвнгипьαοριυκχτενβγωημ", "aeopcyxijshdlkmtbhrunbaopiukxtevbywnu"))
LEET |= {k.upper(): v for k, v in LEET.items() if k.upper() != k and len(k.upper()) == 1} | {"Η": "h", "Υ": "y", "Β": "b", "Χ": "x", "Ν": "n", "Ζ": "z", "Р": "p"}
#: Channel costs in nats: a look-alike, the first and each further repetition of a letter, a separator
#: dropped between two single letters or beside one, white space or another sign dropped elsewhere.
C_LEET, C_REPEAT, C_AGAIN, C_SINGLE, C_BESIDE, C_SPACE, C_SIGN = 1.0, 6.0, 0.3, 0.3, 3.0, 12.0, 2.0
#: Keeping one separator of spelled-out letters as a boundary: such spelling drops all or none.
C_KEEP = 3.0
#: Reading a look-alike that touches a letter as no letter, unless it is common punctuation.
C_SYMBOL = 4.0
PUNCTUATION = "!|(+"
SCHEMA = "doc_id bigint, toxicity double, n_hits int, n_restored int, toxic boolean, keep boolean"


def _merged() -> dict[str, str]:
    """Letter by class: letters that one look-alike can stand for are one class."""
    root = {c: c for c in "abcdefghijklmnopqrstuvwxyz"}
    for letters in LEET.values():
        for x in letters[1:]:
            low, high = sorted((root[letters[0]], root[x]))
            root = {k: low if v == high else v for k, v in root.items()}
    return root


_CLASS = _merged()


def collapse(word: str) -> str:
    """A word of a-z in the alphabet of classes, without repetitions."""
    out: list[str] = []
    for ch in word:
        if not out or out[-1] != _CLASS[ch]:
            out.append(_CLASS[ch])
    return "".join(out)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """1-26 by code point for whatever reads as a letter a-z after folding case, accents and compatibility forms
    (circled, squared, fullwidth and mathematical letters), 0 for the rest."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for cp in (*range(0x3000), *range(0xA640, 0xABFF), *range(0xFB00, 0xFB07), *range(0xFF21, 0xFF5B), *range(0x1D400, 0x1D800), *range(0x1F110, 0x1F18A)):
        ch = chr(cp)
        whole = unicodedata.normalize("NFKD", ch).lower().strip("()")
        first = unicodedata.normalize("NFKD", ch.lower())[:1]
        if ch.isalpha() and "a" <= first <= "z":
            out[cp] = ord(first) - 96
        elif len(whole) == 1 and "a" <= whole <= "z":
            out[cp] = ord(whole) - 96
        elif 0x1F150 <= cp < 0x1F16A or 0x1F170 <= cp < 0x1F18A:  # negative letters, which have no such form
            out[cp] = (cp - 0x1F150) % 32 + 1
    return out


@lru_cache(maxsize=1)
def _class_codes() -> np.ndarray:
    merged = np.array([0] + [ord(_CLASS[chr(96 + k)]) - 96 for k in range(1, 27)], dtype=np.uint8)
    table = merged[_letters()]
    for sign, letters in LEET.items():
        table[ord(sign)] = ord(_CLASS[letters[0]]) - 96
    return table


def fold_words(text: str) -> list[str]:
    """Words of a-z after folding case and accents; all else separates."""
    cls = _letters()[code_points(text)]
    return np.where(cls == 0, 32, cls + 96).astype(np.uint8).tobytes().decode("ascii").split()


def _fold(ch: str) -> str:
    """The a-z letter of a character, '' if it has none."""
    cls = _letters()[ord(ch)]
    return chr(96 + cls) if cls else ""


def char_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of interpolated Kneser-Ney from counts of shape (WIDTH,) * 4."""
    levels = [counts.astype(np.float64)]
    while levels[-1].ndim > 1:
        levels.append((levels[-1] > 0).sum(axis=0).astype(np.float64))
    p = np.full(WIDTH, 1.0 / WIDTH)
    for k in reversed(levels):
        total, kinds = k.sum(-1, keepdims=True), (k > 0).sum(-1, keepdims=True)
        p = np.where(total > 0, (np.maximum(k - 0.75, 0) + 0.75 * kinds * p) / np.maximum(total, 1), p)
    return np.log(np.maximum(p, 1e-12)).astype(np.float32)


def _spacing(text: str, i: int) -> tuple[float, float]:
    """Costs of dropping and of keeping the separator at i, by the fragments beside it."""

    def solid(k: int) -> bool:
        return 0 <= k < len(text) and (text[k] in LEET or bool(_fold(text[k])))

    if not (solid(i - 1) and solid(i + 1)):  # a gap of several signs, or the edge
        return (C_SPACE if text[i].isspace() else C_SIGN), 0.0
    singles = (not solid(i - 2)) + (not solid(i + 2))
    if singles == 2:
        return C_SINGLE, C_KEEP
    return C_BESIDE if singles else C_SPACE if text[i].isspace() else C_SIGN, 0.0


def decode(text: str, model: np.ndarray) -> str:
    """The most likely reading of text: words of a-z, one space between them."""
    # hypotheses by the last three classes and whether a repetition was dropped last: (cost, output)
    beam: dict[tuple[int, int, int, bool], tuple[float, tuple | None]] = {(0, 0, 0, False): (0.0, None)}
    for i, ch in enumerate(text):
        letter = _fold(ch)
        emits = [(ord(letter) - 96, 0.0)] if letter else [(ord(x) - 96, C_LEET) for x in LEET.get(ch, "")]
        drop, keep = (0.0, 0.0 if ch in PUNCTUATION else C_SYMBOL) if emits else _spacing(text, i)
        new: dict[tuple[int, int, int, bool], tuple[float, tuple | None]] = {}

        def reach(key: tuple, cost: float, out: tuple | None, new: dict = new) -> None:
            if key not in new or cost < new[key][0]:
                new[key] = cost, out

        for (a, b, c, again), (cost, out) in beam.items():
            for x, price in emits:
                reach((b, c, x, False) if c else (0, 0, x, False), cost + price - float(model[a, b, c, x]), (x, out))
                if c == x:
                    reach((a, b, c, True), cost + (C_AGAIN if again else C_REPEAT), out)
            if not letter:  # a boundary; more of them cost nothing
                if c:
                    reach((0, 0, 0, False), cost + keep - float(model[a, b, c, 0]), (0, out))
                    if not emits:
                        reach((a, b, c, again), cost + drop, out)
                else:
                    reach((0, 0, 0, False), cost, out)
        beam = new
    # a word that is still open pays for its end
    out = min(((cost - float(model[key[:3] + (0,)]) if key[2] else cost, tail) for key, (cost, tail) in beam.items()), key=lambda x: x[0])[1]
    said = []
    while out:
        said.append(" " if out[0] == 0 else chr(96 + out[0]))
        out = out[1]
    return "".join(reversed(said)).strip()


class Scorer:
    """Finds, decodes and scores the spans of a lexicon {word: weight}."""

    def __init__(self, lexicon: dict[str, float], bias: float, model: np.ndarray):
        self.lexicon, self.bias, self.model = lexicon, bias, model
        self.table = _class_codes()
        self.memo: dict[str, list[str]] = {}
        self.automaton = ahocorasick.Automaton()
        for w in lexicon:
            self.automaton.add_word(collapse(w), len(collapse(w)))
        if lexicon:
            self.automaton.make_automaton()

    def windows(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """(text, start, end) of the white-space tokens that a lexicon word may hide in."""
        cp = code_points("\n".join(texts) + "\n")
        cls = self.table[cp]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        cls[ends - 1] = 27  # what no pattern crosses
        at = np.flatnonzero(cls)
        c = cls[at]
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        word = (c[first] + 96).tobytes().decode("latin-1")
        for end, size in self.automaton.iter(word):
            lo = int(at[first[end - size + 1]])
            hi = int(at[first[end + 1] - 1]) + 1 if end + 1 < len(first) else int(at[-1]) + 1
            k = int(np.searchsorted(ends, lo, side="right"))
            base = int(ends[k - 1]) if k else 0
            yield k, lo - base, hi - base

    def hits(self, texts: list[str]) -> list[list[tuple[str, bool]]]:
        """For each text the lexicon words found, and whether each had to be restored."""
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if self.lexicon:
            for k, lo, hi in self.windows(texts):
                t = texts[k]
                while lo and not t[lo - 1].isspace():
                    lo -= 1
                while hi < len(t) and not t[hi].isspace():
                    hi += 1
                spans[k].append((lo, hi))
        out: list[list[tuple[str, bool]]] = [[] for _ in texts]
        for k, found in spans.items():
            merged: list[list[int]] = []
            for lo, hi in sorted(found):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(hi, merged[-1][1])
                else:
                    merged.append([lo, hi])
            for lo, hi in merged:
                piece = texts[k][lo:hi]
                plain = Counter(w for w in fold_words(piece) if w in self.lexicon)
                got = self.memo.get(piece)
                if got is None:
                    got = [w for w in decode(piece, self.model).split() if w in self.lexicon]
                    if len(piece) < 64 and len(self.memo) < 1 << 18:
                        self.memo[piece] = got
                out[k] += [(w, False) for w in plain.elements()]
                out[k] += [(w, True) for w in (Counter(got) - plain).elements()]
        return out

    def score(self, hits: list[tuple[str, bool]]) -> float:
        z = self.bias + sum(self.lexicon[w] for w in {w for w, _ in hits})
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(WIDTH**4, dtype=np.int64)
    for batch in batches:
        for _, _, part in chunks(batch.column(0).to_pylist()):
            total += np.bincount(grams(part, WIDTH, True)[0], minlength=WIDTH**4)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])


def count_model(docs: DataFrame) -> np.ndarray:
    """The character model of all texts; at most WIDTH**4 counts reach the driver."""
    table = docs.select("text").mapInArrow(_count, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(WIDTH**4, dtype=np.int64)
    counts[table.column("code").to_numpy()] = table.column("n").to_numpy()
    return char_model(counts.reshape((WIDTH,) * 4))


def learn_words(rows: list[tuple[float, str]]) -> tuple[dict[str, float], float]:
    """(lexicon, bias) from rows (label, text)."""
    toxic, clean, contexts = Counter(), Counter(), defaultdict(set)
    n = [0, 0]
    for label, text in sorted(set(rows), key=lambda r: -r[0]):
        bad = label >= 0.5
        n[bad] += 1
        words = fold_words(text)
        if bad:
            toxic.update(set(words))
            for before, w, after in zip(["", *words], words, [*words[1:], ""]):
                contexts[w].add((before, after))
        else:
            clean.update(w for w in set(words) if w in toxic)
    lexicon = {}
    for w, t in toxic.items():
        weight = math.log((t + 0.5) / (n[1] + 1) / ((clean[w] + 0.5) / (n[0] + 1)))
        if weight >= MIN_WEIGHT and len(contexts[w]) >= max(MIN_CONTEXTS, t / 2) and len(w) > 2:
            lexicon[w] = weight
    return lexicon, math.log((n[1] + 0.5) / (n[0] + 0.5))


def fit_words(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[dict[str, float], float]:
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(y, t or "") for b in batches for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        lexicon, bias = learn_words(rows)
        words = sorted(lexicon)
        yield pa.RecordBatch.from_arrays([pa.array(["", *words]), pa.array([bias, *(lexicon[w] for w in words)])], names=["word", "weight"])

    sample = labelled_sample(docs, labels, "toxic", max_train).repartition(1)
    got = {r.word: r.weight for r in sample.mapInArrow(learn, "word string, weight double").collect()}
    bias = got.pop("", 0.0)
    return got, bias


def detect(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, toxicity, n_hits, n_restored, toxic, keep) for each row of docs(doc_id, text);
    labels(doc_id, toxic 0/1). keep is the opposite of toxic."""
    lexicon, bias = fit_words(docs, labels, max_train)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, bias, count_model(docs)))  # the model has WIDTH**4 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            for lo, hi, part in chunks(batch.column(1).to_pylist()):
                hits = scorer.hits(part)
                p = np.array([scorer.score(h) for h in hits])
                bad = (p >= threshold) & np.array([bool(h) for h in hits])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p), pa.array([len(h) for h in hits], type=pa.int32()), pa.array([sum(r for _, r in h) for h in hits], type=pa.int32()), pa.array(bad), pa.array(~bad)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
