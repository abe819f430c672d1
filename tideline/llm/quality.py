"""Text quality by logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader updates.

Features of a text are hashed: each word's letters (lower-cased), its shape and its last signs, each pair of
neighbouring words and of neighbouring shapes, and whether a word repeats one of the two before it. A feature's
value is its share of the text's words, scaled. FTRL-proximal keeps weights sparse; a text's score is the logistic
of a sparse dot product, recalibrated so that 0.7 is where labels of the learning rows are told apart best.

Defined results: a null text counts as empty; texts without words have the score of the bias alone; without
learning rows of both labels all scores are the share of label 1 (0 without any); rows that repeat are scored each,
null ids too (never held out); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fold, learning_texts, ship
from tideline.llm.tokens import in_slices

#: Bound of the learning sample: rows of each label, and characters of a text that may be in it.
PER_CLASS = 2500
LONGEST = 50_000
BITS = 18
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.2, 1.0
SCALE = 8.0
THRESHOLD = 0.7
#: Words of which a process keeps the hashes, before it starts anew.
HELD = 300_000

_MASK = (1 << BITS) - 1


class Features:
    """Hashed features of texts; each distinct word is taken apart once."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, 4), np.uint32)
        self.core = re.compile(r"^\W*(.*?)(\W*)$", re.DOTALL)

    def _word(self, w: str) -> tuple[int, int, int, int]:
        core, end = self.core.match(w).groups()
        shape = re.sub(r"(.)\1+", r"\1", "".join(["A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in w]))
        h = zlib.crc32
        return h(b"w" + core.lower().encode("utf-8", "replace")), h(b"s" + shape.encode("utf-8", "replace")), h(b"e" + end.encode("utf-8", "replace")), h(b"l%d" % min(len(core), 24))

    def _rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) > HELD:
            self.index, self.table = {}, np.zeros((0, 4), np.uint32)
        new = [w for w in words if w not in self.index]
        if new:
            n = len(self.index)
            self.table = np.concatenate((self.table, np.array([self._word(w) for w in new], np.uint32)))
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Features of the texts' words, one row of seven a word (of empty words none), and each text's count of words."""
        parted = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        coded = parted.flatten().dictionary_encode()
        kinds = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = self._rows(kinds)[coded.indices.to_numpy()] if kinds else np.zeros(0, np.int64)
        length = pc.list_value_length(parted).to_numpy(zero_copy_only=False).astype(np.int64)
        t = self.table[number]
        text = np.repeat(np.arange(len(texts)), length)
        word = np.ones(len(number), bool)
        empty = np.array([k == "" for k in kinds], bool)
        if empty.any():
            word = ~empty[coded.indices.to_numpy()]
            t, text = t[word], text[word]
            length = np.bincount(text, minlength=len(texts))
        before = np.zeros_like(t)
        before[1:] = t[:-1]
        same_text = np.zeros(len(t), bool)
        same_text[1:] = text[1:] == text[:-1]
        before[~same_text] = 0
        two = np.zeros(len(t), np.uint32)
        two[2:] = np.where(text[2:] == text[:-2], t[:-2, 0], 0) if len(t) > 2 else two[2:]
        again = np.where(t[:, 0] == before[:, 0], 1, np.where((t[:, 0] == two) & (two != 0), 2, 0)).astype(np.uint32)
        mix = np.uint32(0x9E3779B1)
        f = np.empty((len(t), 7), np.uint32)
        f[:, :4] = t
        f[:, 4] = (t[:, 0] * mix) ^ (before[:, 0] * np.uint32(0x85EBCA6B))
        f[:, 5] = (t[:, 1] * mix) ^ (before[:, 1] * np.uint32(0xC2B2AE35)) ^ np.uint32(5)
        f[:, 6] = again * np.uint32(0x27D4EB2F) + np.uint32(11)
        f ^= f >> np.uint32(15)
        f *= np.uint32(0x2C1B3C6D)
        f ^= f >> np.uint32(12)
        return (f & np.uint32(_MASK)).astype(np.int64), length


def _document(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index, count = np.unique(features.reshape(-1), return_counts=True)
    return index, SCALE * count / max(1, len(features))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Ftrl:
    """FTRL-proximal with a step size of its own for each weight."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, index: np.ndarray, value: np.ndarray, y: float, weight: float) -> None:
        i = np.append(index, 1 << BITS)
        x = np.append(value, 1.0)
        w = self.weights(i)
        g = weight * (_sigmoid(w @ x) - y) * x
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA * w
        self.n[i] += g * g


def fit(rows: list[tuple], counts: dict[str, int]) -> dict:
    """Weights from the learning sample (id, label, text) and the calibration of their scores."""
    labelled = [r for r in rows if r[1] in ("0", "1")]
    y = np.array([float(r[1]) for r in labelled])
    if len(labelled) < 4 or y.min() == y.max():
        total = sum(counts.values())
        return {"constant": counts.get("1", 0) / total if total else 0.0}
    make = Features()
    docs = []
    for r in labelled:
        f, _ = make.of(pa.array([r[2]], pa.string()))
        docs.append(_document(f))
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)

    def trained(use: np.ndarray) -> Ftrl:
        model = Ftrl()
        for _ in range(EPOCHS):
            for k in use:
                model.update(*docs[k], y[k], weight[k])
        return model

    # scores of rows that a model hasn't learned from set the calibration
    at = np.arange(len(y))
    raw = np.zeros(len(y))
    for part in (0, 1):
        model = trained(at[at % 2 != part])
        w = model.weights(np.arange((1 << BITS) + 1))
        for k in at[at % 2 == part]:
            raw[k] = docs[k][1] @ w[docs[k][0]] + w[-1]
    model = trained(at)
    w = model.weights(np.arange((1 << BITS) + 1))
    own = counts.get("1", 0) / (y == 1).sum(), counts.get("0", 0) / (y == 0).sum()
    natural = np.where(y == 1, own[0], own[1])
    a, b = 1.0, 0.0  # the label's chance as a logistic of the raw score, over rows as frequent as they are
    for _ in range(50):
        p = _sigmoid(a * raw + b)
        d, h = natural * (p - y), natural * p * (1 - p) + 1e-9
        m = np.array([[(h * raw * raw).sum() + 1, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, np.array([(d * raw).sum() + (a - 1), d.sum()]))
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    a = max(a, 1e-3)
    # of the places to part the labels, the one with the fewest errors (each label counting alike) gets the threshold
    order = np.argsort(raw)
    wrong = np.cumsum(np.where(y[order] == 1, 0.5 / (y == 1).sum(), -0.5 / (y == 0).sum()))
    k = int(np.argmin(wrong))
    cut = (raw[order[k]] + raw[order[min(k + 1, len(y) - 1)]]) / 2
    b = np.log(THRESHOLD / (1 - THRESHOLD)) - a * cut
    return {"weights": w.astype(np.float32), "a": float(a), "b": float(b)}


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """Fit on labels of rows outside the held-out fold."""
    rows, counts = learning_texts(docs, labels.where(fold(F.col("doc_id"), 4) != 2), "quality", PER_CLASS, LONGEST)
    return fit(rows, counts)


def scores(model: dict, make: Features, texts: pa.Array) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    f, length = make.of(texts)
    w = model["weights"]
    sums = np.concatenate(([0.0], np.cumsum(w[f].sum(1, dtype=np.float64))))
    ends = np.cumsum(length)
    dot = SCALE * (sums[ends] - sums[ends - length]) / np.maximum(1, length) + w[-1]
    return _sigmoid(model["a"] * dot + model["b"])


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    ship(docs.sparkSession)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, 1 MiB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in in_slices(texts, 4_000_000):
                s = scores(broadcast.value, make, texts.slice(lo, hi - lo))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
