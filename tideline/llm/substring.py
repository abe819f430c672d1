"""Substring deduplication by hashing lines, and sentences within lines, over the whole corpus.

A text's units are its lines and, within a line, its sentences: a sentence ends after a full stop, question or
exclamation mark that white space follows, or before a capitalised word that follows a word without a capital at its
end (where a passage was put into the middle of a sentence), or after a full stop of Chinese and Japanese. Units are
normalised (white space between words doesn't count, case folded) and digested; digests are grouped globally; the
earliest occurrence (least doc_id, then offset) stays and all others go, with their offsets in the original text. A
line that goes takes its sentences with it. Lines under LINE_WORDS and sentences under SENTENCE_WORDS words are too
common by chance to go on their own; they go in runs: from each short unit on, and up to each, so many neighbours (in
other lines too) as have SENTENCE_WORDS words together are one more unit. Text without spaces counts by its
characters. So a short unit stays, however often it is repeated, where its neighbours differ. A run that overlaps its
own first occurrence stays. A passage between words of another sentence may keep its last words up to its last full
stop there, and whatever stands before its first capital.

Texts are cut and digested as arrays of code points, many texts at once. Digests are made twice rather than kept:
first to learn which occur again, by half a digest, then those alone are grouped by the whole of it.

Defined results: a null text counts as empty, has no units and stays null; a document may become empty; rows that
repeat an id are ordered by their text, and units of wholly equal rows count as one occurrence; null ids rank
last; an empty table gives an empty result; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fresh, key_filter, row_key, ship, shuffle_width, tidy, written
from tideline.llm.tokens import in_slices, release, trim

LINE_WORDS = 4
SENTENCE_WORDS = 8
#: Characters of texts that are cut at once, and of a word that is hashed as one.
SLICE = 400_000
WORD_CHARS = 1 << 16

_SPACE, _BLANK, _STOP, _UPPER, _WORD, _CJK_STOP, _CJK_CLOSE, _TWO, _FOUR = (1 << k for k in range(9))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Classes and lower case of the code points below 0x10000; a letter whose lower case is longer stays."""
    kind = np.zeros(0x10000, np.uint16)
    low = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isspace():
            kind[c] |= _SPACE
        if x.isalnum() or x == "_":
            kind[c] |= _WORD
        if len(y := x.lower()) == 1:
            low[c] = ord(y)
    for x in " \t":
        kind[ord(x)] |= _BLANK
    for x in ".!?":
        kind[ord(x)] |= _STOP
    for x in "。！？":
        kind[ord(x)] |= _CJK_STOP
    for x in "”’」』）":
        kind[ord(x)] |= _CJK_CLOSE
    for lo, hi in ((0x41, 0x5A), (0xC0, 0xD6), (0xD8, 0xDE)):
        kind[lo : hi + 1] |= _UPPER
    for lo, hi in ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)):  # Chinese and Japanese: two count as a word
        kind[lo : hi + 1] |= _TWO
    for lo, hi in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF)):  # Thai, Lao, Burmese, Khmer: four count as a word
        kind[lo : hi + 1] |= _FOUR
    return kind, low


_TABLES: list = []


def classes(points: np.ndarray) -> np.ndarray:
    """Each code point's class bits."""
    if not _TABLES:
        _TABLES.extend(_tables())
    bits = _TABLES[0][np.minimum(points, 0xFFFF)]
    if (far := points > 0xFFFF).any():
        bits[far] = np.where((points[far] >= 0x20000) & (points[far] <= 0x3FFFF), _TWO | _WORD, _WORD)
    return bits


_POWERS: dict = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base; those of usual lengths are kept."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, 5 * WORD_CHARS), base, np.uint64))))
        if len(held) <= 16 * WORD_CHARS:
            _POWERS[base] = held
    return held[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Sums:
    """Polynomial hashes of any part of a sequence of 64-bit values, from running sums modulo 2**64."""

    def __init__(self, values: np.ndarray, base: int):
        self.back = _powers(pow(base, -1, 1 << 64), len(values) + 1)
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(base, len(values)))))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mixed((self.total[hi] - self.total[lo]) * self.back[lo] + (hi - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: Odd multipliers of the two halves of a digest, of characters in words and of words in units.
_BASES = ((0x9E6C63D0876A9A47, 0xD1342543DE82EF95), (0xC2B2AE3D27D4EB4F, 0xAF251AF3B0F025B5))


@dataclass
class Units:
    """Units of several texts: place of each in the texts joined, words, whether it is a line, its text, and its first and last word."""

    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    number: np.ndarray
    text: np.ndarray
    words: np.ndarray
    first: np.ndarray
    last: np.ndarray
    several: np.ndarray
    digests: tuple[Sums, Sums]
    begin: np.ndarray


def _values(base: int) -> np.ndarray:
    """What a character of a word counts as: the same for a letter's cases."""
    name = ("values", base)
    if name not in _POWERS:
        low = _TABLES[1].astype(np.uint64)
        _POWERS[name] = _mixed(low + np.uint64(base & 0xFFFFFFFF))
    return _POWERS[name]


def _word_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of words, of so many at once as have about WORD_CHARS characters."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + 4 * WORD_CHARS, side="right")))
        some = points[start[at] : end[to - 1]]
        values = _values(base)[np.minimum(some, 0xFFFF)]
        if (far := some > 0xFFFF).any():
            values[far] = _mixed(some[far].astype(np.uint64) + np.uint64(base & 0xFFFFFFFF))
        out[at:to] = Sums(values, base).of(start[at:to] - start[at], end[at:to] - start[at])
        at = to
    return out


def cut(texts: list[str]) -> Units:
    """Lines and sentences of texts. Texts are joined by a line feed, so no unit spans two."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(size[:-1] + 1)))
    n = len(points)
    bits = classes(points)
    space, blank = (bits & _SPACE) != 0, (bits & _BLANK) != 0

    def at(mask: np.ndarray, i: np.ndarray) -> np.ndarray:
        return np.where((i >= 0) & (i < n), mask[np.clip(i, 0, max(0, n - 1))], False) if n else np.zeros(len(i), bool)

    # ends of Chinese and Japanese sentences, which part words too
    closing, cjk = (bits & _CJK_CLOSE) != 0, (bits & _CJK_STOP) != 0
    wide = np.zeros(0, np.int64)
    if n > 1 and cjk.any():
        wide = np.flatnonzero(~(space | cjk | closing)[1:] & (cjk[:-1] | (closing[:-1] & np.concatenate(([False], cjk[:-2]))))) + 1
    # words
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    word_start, word_end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(wide):
        word_start, word_end = np.sort(np.concatenate((word_start, wide))), np.sort(np.concatenate((word_end, wide)))
    pieces = -(-(word_end - word_start) // WORD_CHARS)
    if (pieces > 1).any():  # a very long word counts as several
        rest = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        word_end = np.minimum(np.repeat(word_end, pieces), np.repeat(word_start, pieces) + (rest + 1) * WORD_CHARS)
        word_start = np.repeat(word_start, pieces) + rest * WORD_CHARS
    sums = [Sums(_word_hashes(points, word_start, word_end, inner), outer) for inner, outer in _BASES]
    # lines
    feeds = np.flatnonzero(points == 10)
    line_start, line_end = np.concatenate(([0], feeds + 1)), np.append(feeds, n)
    # sentences: blanks between words that part two of them
    edge = np.diff(np.concatenate(([False], blank, [False])).astype(np.int8))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    good = (lo > 0) & (hi < n)
    lo, hi = lo[good], hi[good]
    good = ~space[lo - 1] & ~space[hi]
    lo, hi = lo[good], hi[good]
    stop, upper, word = (bits & _STOP) != 0, (bits & _UPPER) != 0, (bits & _WORD) != 0
    after_stop = np.zeros(len(lo), bool)
    walk = np.ones(len(lo), bool)
    for back in range(1, 6):  # a full stop, and up to four other signs after it
        i = lo - back
        after_stop |= walk & at(stop, i)
        walk &= at(~(stop | space | word), i)
    capital = ~upper[lo - 1] & ~stop[lo - 1] & upper[hi] & at(word & ~upper, hi + 1)
    parts = after_stop | capital
    cut_from, cut_to = lo[parts], hi[parts]
    if len(wide):
        cut_from, cut_to = np.concatenate((cut_from, wide)), np.concatenate((cut_to, wide))
        order = np.argsort(cut_from, kind="stable")
        cut_from, cut_to = cut_from[order], cut_to[order]
    line_of_cut = np.searchsorted(line_start, cut_from, side="right") - 1
    cuts = np.bincount(line_of_cut, minlength=len(line_start))
    several = cuts > 0
    # a line of several sentences has one more of them than cuts
    whole = np.flatnonzero(several)
    s_start = np.sort(np.concatenate((line_start[whole], cut_to)))
    s_end = np.sort(np.concatenate((line_end[whole], cut_from)))
    start, end = np.concatenate((line_start, s_start)), np.concatenate((line_end, s_end))
    line = np.arange(len(start)) < len(line_start)
    number = np.concatenate((np.arange(len(line_start)), np.repeat(whole, cuts[whole] + 1)))
    first, last = np.searchsorted(word_start, start, side="left"), np.searchsorted(word_start, end, side="left")
    words = last - first
    if (bits & (_TWO | _FOUR)).any():
        two, four = (np.concatenate(([0], np.cumsum((bits & b) != 0))) for b in (_TWO, _FOUR))
        words = words + (two[end] - two[start]) // 2 + (four[end] - four[start]) // 4
    text = np.searchsorted(begin, start, side="right") - 1
    return Units(start, end, line, number, text, words, first, last, several, (sums[0], sums[1]), begin)


def _digests(u: Units, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(s.of(first, last).view(np.int64) for s in u.digests)


def long_units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units that go if they are repeated: text, start and end in it, and both halves of the digest.

    These are long lines and sentences, and runs of short ones with their neighbours.
    """
    u = cut(texts)
    some = u.last > u.first
    short = (u.words < np.where(u.line, LINE_WORDS, SENTENCE_WORDS)) | (u.end - u.start < 3)
    own = np.flatnonzero(some & ~short)
    start, end, text, first, last = ([x[own]] for x in (u.start, u.end, u.text, u.first, u.last))
    fine = np.flatnonzero(some & (~u.line | ~u.several[u.number]))
    fine = fine[np.argsort(u.start[fine], kind="stable")]
    k = np.flatnonzero(short[fine])
    if len(k):
        total = np.concatenate(([0], np.cumsum(u.words[fine])))
        owner = u.text[fine]
        until, since = np.searchsorted(owner, owner[k], side="right"), np.searchsorted(owner, owner[k], side="left")
        up = np.searchsorted(total, total[k] + SENTENCE_WORDS, side="left") - 1  # the unit that brings a run from k on to so many words
        down = np.searchsorted(total, total[k + 1] - SENTENCE_WORDS, side="right") - 1
        a = np.concatenate((k[(up < until) & (up > k)], down[(down >= since) & (down < k) & (down >= 0)]))
        b = np.concatenate((up[(up < until) & (up > k)], k[(down >= since) & (down < k) & (down >= 0)]))
        both = np.unique(a * len(fine) + b)
        a, b = fine[both // len(fine)], fine[both % len(fine)]
        for out, x in zip((start, end, text, first, last), (u.start[a], u.end[b], u.text[a], u.first[a], u.last[b]), strict=True):
            out.append(x)
    start, end, text, first, last = (np.concatenate(x) for x in (start, end, text, first, last))
    one, two = _digests(u, first, last)
    return text, start - u.begin[text], end - u.begin[text], one, two


def text_units(docs: DataFrame) -> DataFrame:
    """Units long enough to go, runs of short ones among them: _id, _row (the row's key), _start, _end, _one and _two (the digest)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            trim()
            texts = batch.column(2)
            for lo, hi in in_slices(texts, SLICE):
                some = texts.slice(lo, hi - lo).to_pylist()
                text, start, end, one, two = long_units([t or "" for t in some])
                name, row = batch.column(0).slice(lo, hi - lo).take(pa.array(text)), batch.column(1).slice(lo, hi - lo).take(pa.array(text))
                yield pa.record_batch([name, row, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(one), pa.array(two)], names=["_id", "_row", "_start", "_end", "_one", "_two"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), row_key(F.col("doc_id"), F.col("text")).alias("_row"), F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(run, "_id bigint, _row bigint, _start int, _end int, _one bigint, _two bigint")


def repeated_units(docs: DataFrame) -> DataFrame:
    """Units that are not the earliest of their digest: _id, _row, _start, _end, and first_doc and first_start of that one."""
    found = text_units(docs)
    width = -(-shuffle_width(docs.sparkSession) // 4)
    again = found.groupBy("_one").agg(F.count("*").alias("_n")).where("_n > 1").select("_one")
    again, _ = written(again.coalesce(width), "repeated-halves")
    hit = key_filter(again, "_one", again.count())(F.col("_one"))
    # what passes is grouped by the whole digest, combined in each task first; a digest that only shares a half drops out here
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_row", "_start", "_end")
    some = found.where(hit)
    firsts = some.groupBy("_one", "_two").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f <> l").select("_one", "_two", "f")
    firsts, _ = written(firsts.coalesce(width), "first-units")
    overlaps = F.col("_id").eqNullSafe(F.col("f._id")) & (F.col("_row") == F.col("f._row")) & (F.col("_start") < F.col("f._end"))
    later = some.join(firsts, ["_one", "_two"]).where(~overlaps)
    return later.select("_id", "_row", "_start", "_end", F.col("f._id").alias("first_doc"), F.col("f._start").alias("first_start"))


def removed_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of a text that go, given its repeated units: its lines and sentences within those; where all sentences of a line go, the line."""
    u = cut([text])
    lows, highs = np.array(sorted(spans), np.int64).reshape(-1, 2).T
    reach = np.concatenate(([-1], np.maximum.accumulate(highs)))
    goes = (u.end > u.start) & (u.end <= reach[np.searchsorted(lows, u.start, side="right")])
    gone = u.line & goes
    lines = np.zeros(len(u.several), bool)
    lines[u.number[gone]] = True
    inner = ~u.line & (u.end > u.start)
    stay = np.zeros(len(u.several), bool)
    stay[u.number[inner & ~goes]] = True
    lines |= u.several & ~stay
    out = (u.line & lines[u.number]) | (inner & goes & ~lines[u.number])
    return sorted(zip(u.start[out].tolist(), u.end[out].tolist(), strict=True))


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a line wholly gone takes its line feed along, a sentence the blank after it."""
    kept, at = [], 0
    for a, b in spans:
        if a < at:
            continue
        kept.append(text[at:a])
        whole = (a == 0 or text[a - 1] == "\n") and (b == len(text) or text[b] == "\n")
        at = b
        if whole and b < len(text):
            at = b + 1
        else:
            while at < len(text) and text[at] in " \t":
                at += 1
    kept.append(text[at:])
    out = "".join(kept)
    return out.rstrip("\n") if not text.endswith("\n") else out


def _spans(docs: DataFrame) -> DataFrame:
    """One row per document with repeated units: _row and _spans, at most three for each unit of its text."""
    one = F.struct(F.col("_start").alias("s"), F.col("_end").alias("e"))
    return repeated_units(docs).groupBy("_row").agg(F.collect_set(one).alias("_spans"))


def deduplicated(docs: DataFrame, removed: str | None = None) -> DataFrame:
    """docs, all columns kept, with repeated units cut out of text.

    removed names one more column, with the (start, end) code points in the original text that went; docs must not
    have it. Texts without repeated units aren't shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    tidy(spark)
    own = docs.columns
    if removed is not None and removed.lower() in [c.lower() for c in own]:
        raise ValueError(f"docs has a column {removed}")
    name = removed or fresh(docs, "_removed")[0]
    kept_key, kept_spans = fresh(docs, "_row", "_spans")
    spans, _ = written(_spans(docs), "repeated-spans")
    key = row_key(F.col("doc_id"), F.col("text"))
    maybe = key_filter(spans, "_row", spans.count())(key)
    empty = F.array().cast("array<struct<start:int,end:int>>").alias(name)
    rows = docs.where(maybe).withColumn(kept_key, key).join(spans.select(F.col("_row").alias(kept_key), F.col("_spans").alias(kept_spans)), kept_key, "left")
    place = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            trim()
            texts, spans = batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            new, gone = [], []
            for t, found in zip(texts, spans, strict=True):
                where = removed_spans(t, [(x["s"], x["e"]) for x in found]) if t and found else []
                new.append(cut_out(t, where) if where else t)
                gone.append([{"start": a, "end": b} for a, b in where])
            columns = [*batch.columns[:-1]]
            columns[place] = pa.array(new, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=[*own, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.where(~maybe).select(*own, empty).unionByName(rows.select(*own, kept_spans).mapInArrow(run, f"{fields}, `{name}` array<struct<start:int,end:int>>"))
    return out if removed else out.drop(name)
