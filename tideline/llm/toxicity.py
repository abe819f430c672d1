"""Toxicity by compression distance: one zstandard dictionary of ordinary and one of toxic text, compared on short windows.

A window is six words, lower-cased, in a code of two bytes a character (the character, and a mark of it and its
predecessor), which makes what a dictionary saves large against the whole bytes that a compressed length is counted
in. Both dictionaries are trained by zstandard. A toxic document is mostly ordinary text, so the toxic one is trained
on those windows of two words of toxic documents, and at last single words of them, that a dictionary of other toxic
documents compresses better than the ordinary one does, by a cut that ordinary text seldom reaches; training and
choice take turns, on halves of the documents, so that no window is chosen by a dictionary that knows it. The content that both dictionaries share comes
first and cancels out. A window's difference of compressed lengths says how much better the toxic dictionary knows
it. Per document the windows above each of several differences are counted and held against what ordinary text has;
a logistic calibration of these counts, on texts that the dictionaries weren't trained on, gives the score.

Defined results: a null text counts as empty; a text without words has the score of the calibration at no evidence;
without learning rows of both labels all scores are the share of toxic learning rows (0 without any); rows that
repeat are scored each, null ids too (never held out); an empty table gives an empty result; other columns are
ignored, or kept by without_toxic, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fold, learning_texts, ship
from tideline.llm.tokens import in_slices, release, trim

#: Bound of the learning sample: rows of each label, and characters of a text that may be in it.
PER_CLASS = 1500
LONGEST = 50_000
#: Words of a window that is scored, and of one that is chosen to train on.
WINDOW_WORDS = 6
CHOICE_WORDS = 2
WINDOW_BYTES = 192
LEVEL = 13
#: Bytes of the content that both dictionaries share, and of what each has of its own in each turn; the last turns
#: train on single words of the windows chosen before.
SHARED_BYTES = 65_536
OWN_BYTES = (8_192, 8_192, 6_144, 3_072)
LAST_TURNS = 2
K = 32
#: Ordinary windows that the shared content is trained on, and those that a choice is held against.
SHARED_WINDOWS = 120_000
CONTROL = 24_000
#: A difference tells toxic windows if it is so many times as frequent in toxic documents as in ordinary ones.
TIMES = 8.0
DIFFERENCES = tuple(range(-3, 24))


def windows(text: str | None, words: int = WINDOW_WORDS) -> list[bytes]:
    """Windows of a whole text in the code of two bytes a character."""
    norm = b" " + b" ".join((text or "").encode("utf-8", "replace").lower().split()) + b" "
    if len(norm) < 3:
        return []
    a = np.frombuffer(norm, np.uint8).astype(np.uint32)
    code = np.empty(2 * len(a), np.uint8)
    code[1::2] = a
    code[0::2] = (a * 7 + np.concatenate((a[:1], a[:-1])) * 29) & 255
    raw = code.tobytes()
    cuts = np.flatnonzero(a == 32)[::words].tolist()
    if cuts[-1] != len(norm) - 1:
        cuts.append(len(norm) - 1)
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi - lo <= WINDOW_BYTES:
            out.append(raw[2 * lo : 2 * hi + 2])
        else:
            out += [raw[2 * i : 2 * min(i + WINDOW_BYTES, hi) + 2] for i in range(lo, hi, WINDOW_BYTES)]
    return out


def compressor(raw: bytes):
    """A function from bytes to what they compress to, given a dictionary's content."""
    import zstandard as z

    p = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
    return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=p).compress


def _lengths(compress, some: list[bytes]) -> np.ndarray:
    """What each window compresses to; equal windows are compressed once."""
    known = {w: len(compress(w)) for w in set(some)}
    return np.fromiter(map(known.__getitem__, some), np.int32, len(some))


class Differences:
    """Compressors with both dictionaries."""

    def __init__(self, pair: tuple[bytes, bytes]):
        self.ordinary, self.toxic = compressor(pair[0]), compressor(pair[1])

    def of(self, text: str | None) -> np.ndarray:
        """How many bytes the toxic dictionary spares in each window."""
        some = windows(text)
        a, b = self.ordinary, self.toxic
        return np.fromiter([len(a(w)) - len(b(w)) for w in some], np.int32, len(some))


def trained(size: int, samples: list[bytes], k: int) -> bytes:
    """A dictionary by zstandard's trainer. It wants some samples, so few of them are given several times."""
    import zstandard as z

    samples = [w for w in samples if len(w) >= 8] or [b"no words"]
    while len(samples) < 64 or sum(map(len, samples)) < 2 * size:
        samples = samples * 2
    return z.train_dictionary(size, samples, k=k, d=8).as_bytes()


def _cut(toxic: np.ndarray, ordinary: np.ndarray) -> int:
    """The least difference that is TIMES as frequent in toxic documents, or where the ratio is highest."""
    a = np.array([(toxic >= d).mean() for d in range(1, 24)])
    b = np.array([(ordinary >= d).mean() for d in range(1, 24)])
    ratio = a / (b + 1 / (1 + len(ordinary)) + 1e-4)
    reached = np.flatnonzero(ratio >= TIMES)
    return int(reached[0] if len(reached) else ratio.argmax()) + 1


def _words(window: bytes) -> list[bytes]:
    """A window's words, each with the blanks around it."""
    blanks = np.flatnonzero(np.frombuffer(window, np.uint8)[1::2] == 32).tolist()
    return [window[2 * a : 2 * b + 2] for a, b in zip(blanks[:-1], blanks[1:], strict=True)]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes, list[bytes]]:
    """Raw contents of the ordinary dictionary, of the toxic one, and two toxic ones, each of every second toxic text alone.

    The two of halves tell what texts of the other half look like to a dictionary that doesn't know them.
    """
    plain = [w for t in ordinary for w in windows(t, CHOICE_WORDS)]
    shared = trained(SHARED_BYTES, plain[:: max(1, len(plain) // SHARED_WINDOWS)], 64)
    control = plain[:: max(1, len(plain) // CONTROL)]
    own = [[w for t in toxic[h::2] for w in windows(t, CHOICE_WORDS)] for h in (0, 1)]
    chosen, known = own, None
    for turn, size in enumerate(OWN_BYTES):
        if turn == len(OWN_BYTES) - LAST_TURNS:  # from here on the words of what was chosen
            own = chosen = [[x for w in c for x in _words(w)] or c for c in chosen]
            control, known = [x for w in control for x in _words(w)], None
        if known != size:
            common = compressor(shared + trained(size, control, K))
            plain_length, length, known = _lengths(common, control), [_lengths(common, o) for o in own], size
        tell = [compressor(shared + trained(size, c, K)) for c in chosen]
        chosen = []
        for h in (0, 1):
            gain = length[h] - _lengths(tell[1 - h], own[h])
            cut = _cut(gain, plain_length - _lengths(tell[1 - h], control))
            chosen.append([w for w, g in zip(own[h], gain.tolist(), strict=True) if g >= cut] or own[h])
    size = OWN_BYTES[-1]
    halves = [shared + trained(size, c, K) for c in chosen]
    return shared + trained(size, control, K), shared + trained(size, chosen[0] + chosen[1], K), halves


def evidence(differences: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """A document's features: counts of windows at each difference or above, against the usual share of each."""
    m = len(differences)
    ranked = np.sort(differences)
    count = m - np.searchsorted(ranked, DIFFERENCES, side="left")
    return np.concatenate(((count - m * usual) / np.sqrt(m * usual + 1), np.log1p(count) - np.log1p(m * usual), [np.log1p(m)]))


def fit(rows: list[tuple], counts: dict[str, int]) -> dict:
    """The model from the learning sample: dictionaries, and their calibration by texts that they weren't trained on."""
    toxic, ordinary = [r[2] for r in rows if r[1] == "1"], [r[2] for r in rows if r[1] == "0"]
    if len(toxic) < 2 or len(ordinary) < 2:
        total = sum(counts.values())
        return {"constant": counts.get("1", 0) / total if total else 0.0}
    common, full, halves = dictionaries(toxic, ordinary)
    pair = (common, full)
    dt: list[np.ndarray] = []
    for h in (0, 1):
        tell = Differences((common, halves[1 - h]))
        dt += [tell.of(t) for t in toxic[h::2]]
    # of the ordinary texts, halves of them by each; the toxic dictionaries know none of them
    do: list[np.ndarray] = []
    for h in (0, 1):
        tell = Differences((common, halves[h]))
        do += [tell.of(t) for t in ordinary[h::2]]
    every = np.concatenate([*do, np.zeros(1, np.int32)])
    usual = np.array([(every >= d).mean() for d in DIFFERENCES])
    x = np.array([evidence(d, usual) for d in dt + do])
    y = np.array([1.0] * len(dt) + [0.0] * len(do))
    # the sample holds the labels in other shares than the rows do
    rate_t, rate_o = len(dt) / max(1, counts.get("1", 0)), len(do) / max(1, counts.get("0", 0))
    weight = np.where(y == 1, 1.0 / rate_t, 1.0 / rate_o)
    weight *= len(y) / weight.sum()
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(len(w))
        w += np.linalg.solve(h, z.T @ (weight * (y - p)) - w)
    return {"pair": pair, "usual": usual, "mean": mean, "spread": spread, "weights": w}


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """Fit on labels of rows outside the held-out fold."""
    rows, counts = learning_texts(docs, labels.where(fold(F.col("doc_id"), 5) != 0), "toxic", PER_CLASS, LONGEST)
    return fit(rows, counts)


class Scorer:
    def __init__(self, model: dict):
        self.model = model
        self.tell = Differences(model["pair"]) if "pair" in model else None

    def score(self, text: str | None) -> float:
        m = self.model
        if self.tell is None:
            return float(m["constant"])
        x = (evidence(self.tell.of(text), m["usual"]) - m["mean"]) / m["spread"]
        return float(1 / (1 + np.exp(-np.clip(x @ m["weights"][:-1] + m["weights"][-1], -30, 30))))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = Scorer(model)
        for batch in batches:
            trim()
            texts = batch.column(1)
            for lo, hi in in_slices(texts):
                values = [scorer.score(t) for t in texts.slice(lo, hi - lo).to_pylist()]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(values, pa.float64()), pa.array([int(v >= 0.5) for v in values], pa.int32())], names=["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """docs without the rows predicted toxic, all columns kept; texts stay where they are, nothing is shuffled."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = Scorer(model)
        for batch in batches:
            trim()
            texts = batch.column(batch.schema.get_field_index("text"))
            for lo, hi in in_slices(texts):
                yield batch.slice(lo, hi - lo).filter(pa.array([scorer.score(t) < 0.5 for t in texts.slice(lo, hi - lo).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
