"""Language identification by string kernels: blended n-gram presence, Nystroem landmarks, one-versus-rest kernel ridge.

A window's features are the presence (not the count) of its hashed byte n-grams of all lengths from 1 to 4, case
folded. The kernel of two windows is the share of n-grams they have in common (their inner product over the product
of their norms). Landmarks are learning windows, the same number of each language; a window is described by its
kernels with the landmarks, whitened by their own kernel matrix, and ridge regressions against each language score
it. A batch of windows is scored by matrix products. A document's scores are the mean of its windows' scores, so
whole texts of any length count alike; a softmax of them gives the confidence. Windows are scored in blocks, so that
one long text takes no more memory than many short ones.

Defined results: a null text, or one without a letter, is `und` with score 0; without any learning row every text
is `und`; with one language every text with letters is that; ties go to the language first in the alphabet; rows
that repeat are predicted each, null ids too (never held out); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fold, learning_texts, ship
from tideline.llm.tokens import in_slices

#: Bound of the learning sample: rows of each language, and characters of a text that may be in it.
PER_CLASS = 300
LONGEST = 20_000
LANDMARKS = 48
WINDOW = 1024
#: Windows whose presence values are held at once, 64 KiB each.
BLOCK = 512
BITS = 14
LENGTHS = (1, 2, 3, 4)
RIDGE = 1e-2
#: Scores are near 0 and 1, so a softmax needs them spread.
SHARPNESS = 6.0


def presence(texts: list[bytes], starts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A row of 2**BITS presence values, scaled to length 1, for each window of texts; and each row's text.

    An n-gram belongs to the window that it starts in. starts: in how many first bytes of each text n-grams may
    start, the rest being what follows a part of a longer text; the whole text if not given.
    """
    size = np.array([len(t) for t in texts], np.int64)
    head = size if starts is None else np.array(starts, np.int64)
    cut = np.maximum(1, -(-head // WINDOW))
    owner = np.repeat(np.arange(len(texts)), cut)
    out = np.zeros((len(owner), 1 << BITS), np.float32)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    begin = np.cumsum(size) - size
    end = np.repeat(begin + size, size)  # where the text of each byte ends
    place = np.arange(len(data)) - np.repeat(begin, size)
    inside = place < np.repeat(head, size)
    row = np.repeat(np.cumsum(cut) - cut, size) + np.where(inside, place, 0) // WINDOW
    code = np.zeros(len(data), np.uint32)
    flat = out.reshape(-1)
    base = row << BITS
    for n in LENGTHS:
        if len(data) < n:
            break
        code = code[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
        at = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
        fits = (np.arange(len(at)) + n <= end[: len(at)]) & inside[: len(at)]
        flat[(base[: len(at)] + at)[fits]] = 1.0
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    out /= np.maximum(norm, 1.0)[:, None]
    return out, owner


def blocks(texts: list[bytes], most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Presence values of all windows in turn, at most so many at once however long a text is, and each row's text."""
    own: list[int] = []
    parts: list[bytes] = []
    starts: list[int] = []
    held = 0

    def done() -> tuple[np.ndarray, np.ndarray]:
        x, owner = presence(parts, starts)
        return x, np.array(own)[owner]

    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t)), most * WINDOW):
            n = min(len(t) - lo, most * WINDOW)
            windows = max(1, -(-n // WINDOW))
            if held and held + windows > most:
                yield done()
                own, parts, starts, held = [], [], [], 0
            own.append(i)
            parts.append(t[lo : lo + n + max(LENGTHS) - 1])
            starts.append(n)
            held += windows
    if held:
        yield done()


def folded(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def fit(rows: list[tuple]) -> dict:
    """Landmarks and regressions from the learning sample (id, language, text)."""
    langs = sorted({r[1] for r in rows})
    if len(langs) < 2:
        return {"langs": langs}
    texts = [folded(r[2]) for r in rows]
    keep = [i for i, t in enumerate(texts) if t]
    some = [texts[i] for i in keep]
    counts = [max(1, -(-len(t) // WINDOW)) for t in some]
    y = np.repeat([langs.index(rows[i][1]) for i in keep], counts)
    chosen = np.sort(np.concatenate([np.flatnonzero(y == k)[:LANDMARKS] for k in range(len(langs))]))
    marks = np.zeros((len(chosen), 1 << BITS), np.float32)
    at = 0
    for x, _ in blocks(some):
        inside = (chosen >= at) & (chosen < at + len(x))
        marks[inside] = x[chosen[inside] - at]
        at += len(x)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    whiten = vector / np.sqrt(np.maximum(value, 1e-6))
    z = np.concatenate([(x @ marks.T).astype(np.float64) @ whiten for x, _ in blocks(some)])
    z = np.c_[z, np.ones(len(z))]
    target = (y[:, None] == np.arange(len(langs))).astype(float)
    weight = 1.0 / np.bincount(y, minlength=len(langs))[y]  # languages count alike
    a = (z * weight[:, None]).T @ z + RIDGE * np.eye(z.shape[1])
    w = np.linalg.solve(a, (z * weight[:, None]).T @ target)
    return {"langs": langs, "marks": marks.T.astype(np.float32).copy(), "weights": (whiten @ w[:-1]).astype(np.float32), "bias": w[-1].astype(np.float32)}


def learn(docs: DataFrame) -> dict:
    """Fit on text and language of rows outside the held-out fold."""
    labels = docs.where(fold(F.col("doc_id"), 4) != 2).where("lang is not null").select("doc_id", "lang")
    rows, _ = learning_texts(docs, labels, "lang", PER_CLASS, LONGEST)
    return fit(rows)


def scores(model: dict, texts: list[bytes]) -> np.ndarray:
    """Texts' mean scores by language."""
    total, count = np.zeros((len(texts), len(model["langs"]))), np.zeros(len(texts))
    for x, owner in blocks(texts):
        np.add.at(total, owner, (x @ model["marks"]) @ model["weights"] + model["bias"])
        count += np.bincount(owner, minlength=len(texts))
    return total / count[:, None]


def predicted(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from whole texts."""
    ship(docs.sparkSession)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # landmarks: LANDMARKS * languages rows of 64 KiB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        langs = model["langs"]
        for batch in batches:
            texts, letters = batch.column(1), batch.column(2).to_pylist()
            for lo, hi in in_slices(texts, 400_000):
                some = [folded(t) if has else b"" for t, has in zip(texts.slice(lo, hi - lo).to_pylist(), letters[lo:hi], strict=True)]
                pred, conf = ["und"] * len(some), np.zeros(len(some))
                at = [i for i, t in enumerate(some) if t]
                if at and len(langs) == 1:
                    for i in at:
                        pred[i], conf[i] = langs[0], 1.0
                elif at and langs:
                    for part in range(0, len(at), 256):
                        own = at[part : part + 256]
                        s = scores(model, [some[i] for i in own])
                        e = np.exp(SHARPNESS * (s - s.max(1, keepdims=True)))
                        best, p = s.argmax(1), e / e.sum(1, keepdims=True)
                        for j, i in enumerate(own):
                            pred[i], conf[i] = langs[best[j]], float(p[j, best[j]])
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(pred), pa.array(conf)], names=["doc_id", "lang_pred", "score"])

    has_letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), has_letter.alias("letters"))
    out = rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
