"""Packing of documents into sequences of one length, by non-negative least squares over length combinations.

A document's whole windows are sequences of their own; what remains of each document is shorter than the window.
A shard counts these remainders by length class, enumerates the shallow combinations of classes that fill the window,
solves for how often to repeat each so that the histogram is met (non-negative least squares), rounds down, and
places remainders whole by those patterns. The residual remainders are packed greedily: cut where needed, they fill
the gaps that the patterns leave and then new sequences; a shard's last sequence is cut into powers of two, which
need no padding. Shards pack on their own, so nothing is shuffled and a lost task is only that task again.

Defined results: a null text counts as empty: its end id alone is one piece; rows that repeat an id are packed
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ship
from tideline.llm.tokens import WordIds, encoder, in_slices, rest

#: Length classes of a window, lengths in a combination at most, and ids or documents at which a shard is packed.
CLASSES = 64
DEPTH = 4
SHARD_TOKENS = 1 << 22
SHARD_DOCS = 1 << 14

#: Chunks that a packing worker's encoder holds: fewer than elsewhere, as packing follows other stages in the same workers.
HELD = 400_000
#: Characters that are encoded at once; what that takes is some forty bytes for each.
SLICE = 500_000

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@functools.lru_cache(maxsize=4)
def combinations(classes: int = CLASSES, depth: int = DEPTH) -> np.ndarray:
    """Columns: how many lengths of each class a combination has; all multisets of at most depth that sum to classes."""
    found: list[list[int]] = []

    def grow(most: int, left: int, chosen: list[int]) -> None:
        if not left:
            found.append(chosen)
        elif len(chosen) < depth:
            for c in range(min(most, left), (left - 1) // (depth - len(chosen)), -1):
                grow(c, left - c, [*chosen, c])

    grow(classes - 1, classes, [])
    a = np.zeros((classes + 1, len(found)))
    for j, chosen in enumerate(found):
        for c in chosen:
            a[c, j] += 1
    return a


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Least |ax - b| with x >= 0, by the active-set method; stops at the optimum or after so many rounds."""
    n = a.shape[1]
    x = np.zeros(n)
    active = np.zeros(n, bool)
    scale = 1e-9 * max(1.0, float(np.abs(a.T @ b).max()) if n else 1.0)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        j = int(np.argmax(w)) if n else 0
        if not n or w[j] <= scale:
            break
        active[j] = True
        while True:
            cols = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            low = s <= 0
            if not low.any():
                x[:] = 0
                x[cols] = s
                break
            own = x[cols]
            step = np.min(own[low] / np.maximum(own[low] - s[low], 1e-300))
            x[cols] = own + step * (s - own)
            gone = cols[(x[cols] <= 1e-12) & low] if len(cols) else cols
            if not len(gone):
                gone = cols[low]
            x[gone] = 0
            active[gone] = False
    return x


def pack(lengths: np.ndarray, window: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Pieces of documents of these lengths: (document, start, length, sequence, offset), and the count of sequences.

    Every sequence but the last few is full; those have the lengths of powers of two.
    """
    lengths = np.asarray(lengths, np.int64)
    docs = np.arange(len(lengths))
    out: list[tuple] = []
    full = lengths // window
    n_seq = int(full.sum())
    if n_seq:
        doc = np.repeat(docs, full)
        nth = np.arange(n_seq) - np.repeat(np.cumsum(full) - full, full)
        out.append((doc, nth * window, np.full(n_seq, window), np.arange(n_seq), np.zeros(n_seq, np.int64)))
    rest = lengths - full * window
    item = docs[rest > 0]
    size, begin = rest[item], full[item] * window
    step = -(-window // CLASSES)
    kind = -(-size // step)
    order = np.lexsort((-size, kind))
    histogram = np.bincount(kind, minlength=CLASSES + 1).astype(float)
    combos = combinations()
    repeats = np.floor(nnls(combos, histogram) + 1e-6).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(histogram.astype(np.int64))))
    taken = np.zeros(CLASSES + 1, np.int64)
    slots: list[tuple[np.ndarray, np.ndarray, int]] = []  # (sequence, item) of one class in one combination
    n_pattern = 0
    for j in np.flatnonzero(repeats):
        need = combos[:, j].astype(np.int64)
        used = np.flatnonzero(need)
        times = int(min(repeats[j], min((histogram[c] - taken[c]) // need[c] for c in used)))
        if times <= 0:
            continue
        seq = n_pattern + np.arange(times)
        for c in used:
            for _ in range(need[c]):
                at = first[c] + taken[c]
                slots.append((seq, order[at : at + times], int(c)))
                taken[c] += times
        n_pattern += times
    seq_of = np.concatenate([s for s, _, _ in slots]) if slots else np.zeros(0, np.int64)
    item_of = np.concatenate([i for _, i, _ in slots]) if slots else np.zeros(0, np.int64)
    fill = np.bincount(seq_of, weights=size[item_of], minlength=n_pattern).astype(np.int64)
    # the residual must cover the gaps: the patterns with the largest gaps are given up until it does
    pool = int(size.sum() - fill.sum())
    by_gap = np.argsort(-(window - fill), kind="stable")
    gaps, fills = np.cumsum((window - fill)[by_gap]), np.cumsum(fill[by_gap])
    total_gap = int(gaps[-1]) if n_pattern else 0
    short = np.flatnonzero(np.concatenate(([total_gap <= pool], total_gap - gaps <= pool + fills)))
    stays = np.ones(n_pattern, bool)
    stays[by_gap[: short[0] if len(short) else n_pattern]] = False
    number = np.cumsum(stays) - 1
    on = stays[seq_of] if len(seq_of) else np.zeros(0, bool)
    seq_of, item_of = number[seq_of[on]], item_of[on]
    n_pattern = int(stays.sum())
    by_seq = np.argsort(seq_of, kind="stable")
    seq_of, item_of = seq_of[by_seq], item_of[by_seq]
    ends = np.cumsum(size[item_of])
    fill = np.bincount(seq_of, weights=size[item_of], minlength=n_pattern).astype(np.int64)
    before = np.concatenate(([0], np.cumsum(fill)))[seq_of] if len(seq_of) else ends
    out.append((item[item_of], begin[item_of], size[item_of], n_seq + seq_of, ends - size[item_of] - before))
    # residual: a stream of items, largest first, over the gaps and then over new sequences
    left = np.ones(len(item), bool)
    left[item_of] = False
    stream = np.flatnonzero(left)
    stream = stream[np.argsort(-size[stream], kind="stable")]
    pool = int(size[stream].sum())
    gap = window - fill
    more, tail = divmod(pool - int(gap.sum()), window)
    powers = [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
    room = np.concatenate((gap, np.full(more, window, np.int64), np.array(powers, np.int64))).astype(np.int64)
    shift = np.concatenate((fill, np.zeros(more + len(powers), np.int64)))
    if pool:
        item_end, room_end = np.cumsum(size[stream]), np.cumsum(room)
        cuts = np.unique(np.concatenate(([0], item_end, room_end)))
        lo, hi = cuts[:-1], cuts[1:]
        i = np.searchsorted(item_end, lo, side="right")
        r = np.searchsorted(room_end, lo, side="right")
        within = lo - (item_end[i] - size[stream][i])
        out.append((item[stream[i]], begin[stream[i]] + within, hi - lo, n_seq + r, shift[r] + lo - (room_end[r] - room[r])))
    columns = [np.concatenate([p[k] for p in out]) if out else np.zeros(0, np.int64) for k in range(5)]
    return (*columns, n_seq + n_pattern + more + len(powers))


def packed(docs: DataFrame, path: str, end: int = 1, window: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(WordIds, path)
        words.held = HELD
        tail = np.array([end], f"<u{words.width}").tobytes()
        base = TaskContext.get().partitionId() << 40
        names: list = []
        parts: list = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base
            lengths = np.array([len(p) // words.width for p in parts], np.int64)
            doc, start, length, seq, offset, n_seq = pack(lengths, window)
            order = np.lexsort((start, doc))
            doc, start, length, seq, offset = (x[order] for x in (doc, start, length, seq, offset))
            crc, at, raw = [], -1, b""
            for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
                if d != at:
                    at, raw = d, memoryview(np.frombuffer(parts[d], f"<u{words.width}").astype("<u4").tobytes())
                crc.append(zlib.crc32(raw[4 * s : 4 * (s + k)]))
            ids = pa.array(names, pa.int64()).take(pa.array(doc))
            out = pa.record_batch([ids, *(pa.array(x, pa.int64()) for x in (start, length, np.array(crc, np.int64), lengths[doc], base + seq, offset))], names=[c.split(" ")[0] for c in PIECES.split(", ")])
            base += n_seq
            return out

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in in_slices(texts, SLICE):
                for name, coded in zip(ids[lo:hi], words.encode(texts.slice(lo, hi - lo)), strict=True):
                    names.append(name)
                    parts.append(coded + tail)
                    held += len(coded) // words.width + 1
                    if held >= SHARD_TOKENS or len(names) >= SHARD_DOCS:
                        yield flush()
                        names, parts, held = [], [], 0
        if names:
            yield flush()
        rest()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)
