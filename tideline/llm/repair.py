"""Token-id output by Re-Pair grammar compression: shards of ids in ascending doc_id order, read back by document.

A file row is one shard of whole documents: its rules (left, right, expansion length), the compressed symbols of all
its documents and, for each document, its id, its count of symbols and its count of ids. Symbols below the
vocabulary's size are ids; symbol base + k is rule k. No rule spans documents, so any document is decoded from its
own symbols alone, and any part of it from the symbols that its rules' lengths point to. Rounds replace the most
frequent pairs of a shard at once, and of overlapping occurrences the more frequent pair's; each round counts all
pairs of the shard exactly. They go on until no pair is frequent enough or a round spares too little.

Defined results: a null text counts as empty and has the end id alone; null ids come first; rows that repeat an id
follow each other in order of their text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import ship, shuffle_width, written
from tideline.llm.tokens import WordIds, encoder, in_slices

#: A shard ends with the document that brings it to so many ids or documents.
SHARD_TOKENS = 1 << 20
SHARD_DOCS = 1 << 13
#: Chunks that a worker's encoder holds.
HELD = 1_500_000
#: Pairs replaced in a round at most, and the least count of a pair that is replaced.
PAIRS = 1 << 14
LEAST = 4
#: Rounds end when no pair is so frequent, or when one spares less than this share of the symbols.
GAIN = 1 / 256

SHARD_SCHEMA = (
    "part int, shard int, base int, n_docs int, n_tokens bigint, doc_ids binary, doc_null binary, doc_symbols binary, doc_tokens binary, "
    "rule_left binary, rule_right binary, rule_length binary, low binary, high binary"
)
_NAMES = [c.split(" ")[0] for c in SHARD_SCHEMA.split(", ")]


def compress(seq: np.ndarray, base: int, end: int, pairs: int = PAIRS, least: int = LEAST, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, left and right of each rule) of ids; no rule holds the id end, so ends stay in place."""
    seq = seq.astype(np.uint32)
    lefts, rights, size = [], [], base
    slots = np.uint64(64 - 18)
    while len(seq) >= 2:
        codes = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
        codes[(seq[:-1] == end) | (seq[1:] == end)] = np.uint64(0xFFFFFFFFFFFFFFFF)
        ranked = np.sort(codes)
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        count = np.diff(np.append(first, len(ranked)))
        kinds = ranked[first]
        count[kinds == np.uint64(0xFFFFFFFFFFFFFFFF)] = 0
        top = np.flatnonzero(count >= least)
        if not len(top):
            break
        chosen = kinds[top[np.argsort(-count[top], kind="stable")[:pairs]]]
        # a table of hashed pairs; of two in one slot the more frequent stays, the other waits for a later round
        spread = np.uint64(0x9E3779B97F4A7C15)
        rank_at = np.full(1 << 18, -1, np.int32)
        own = (chosen * spread) >> slots
        rank_at[own[::-1]] = np.arange(len(chosen) - 1, -1, -1, dtype=np.int32)
        rank = rank_at[(codes * spread) >> slots]
        rank[(rank >= 0) & (chosen[rank] != codes)] = -1
        at = np.flatnonzero(rank >= 0)
        none = np.int32(1 << 30)
        around = np.full(len(rank) + 2, none, np.int32)
        around[at + 1] = rank[at]
        mine = rank[at]
        won = (around[at] > mine) & (around[at + 2] >= mine)
        at, mine = at[won], mine[won]
        good = np.bincount(mine, minlength=len(chosen)) >= 2
        fit = good[mine]
        at, mine = at[fit], mine[fit]
        if not len(at):
            break
        number = np.cumsum(good) - 1
        seq[at] = size + number[mine]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
        used = chosen[good]
        lefts.append((used >> np.uint64(32)).astype(np.uint32))
        rights.append((used & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        size += len(used)
        if len(at) < gain * len(stay):
            break
    none32 = np.zeros(0, np.uint32)
    return seq, np.concatenate(lefts) if lefts else none32, np.concatenate(rights) if rights else none32


def rule_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to. Rules only name earlier symbols, so a few passes by depth settle all."""
    length = np.zeros(base + len(left), np.int64)
    length[:base] = 1
    own = length[base:]
    while len(own) and not own.all():
        a, b = length[left], length[right]
        np.copyto(own, np.where((a > 0) & (b > 0), a + b, 0))
    return own.copy()


def expansions(left: np.ndarray, right: np.ndarray, length: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """All rules' ids one after another, and where each rule begins."""
    start = np.concatenate(([0], np.cumsum(length)))
    symbols = base + np.arange(len(left), dtype=np.int64)
    while len(symbols) and (symbols >= base).any():
        rule = symbols >= base
        out = np.empty(len(symbols) + int(rule.sum()), np.int64)
        at = np.arange(len(symbols)) + np.concatenate(([0], np.cumsum(rule)[:-1]))
        out[at[~rule]] = symbols[~rule]
        k = symbols[rule] - base
        out[at[rule]], out[at[rule] + 1] = left[k], right[k]
        symbols = out
    return symbols.astype(np.uint32), start


def expand(symbols: np.ndarray, flat: np.ndarray, start: np.ndarray, base: int) -> np.ndarray:
    """Ids of symbols, given the rules' expansions; works on any slice of a shard's symbols."""
    symbols = symbols.astype(np.int64)
    rule = symbols >= base
    k = np.where(rule, symbols - base, 0)
    both = np.concatenate((flat, np.arange(base, dtype=np.uint32)))  # an id is its own expansion
    begin = np.where(rule, start[k] if len(start) > 1 else 0, len(flat) + symbols)
    size = np.where(rule, (start[k + 1] - start[k]) if len(start) > 1 else 1, 1)
    total = np.cumsum(size)
    return both[np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)]


def _shard_row(part: int, shard: int, base: int, end: int, ids: list[int | None], parts: list[bytes], width: int) -> list:
    seq = np.frombuffer(b"".join(parts), dtype=f"<u{width}").astype(np.uint32)
    tokens = np.array([len(p) // width for p in parts], dtype="<u4")
    symbols, left, right = compress(seq, base, end)
    ends = np.flatnonzero(symbols == end)
    # texts may hold the end id themselves, so ends are counted by document from the ids
    inner = np.add.reduceat((seq == end).astype(np.int64), np.cumsum(tokens, dtype=np.int64) - tokens)
    last = ends[np.cumsum(inner) - 1] + 1
    per = np.diff(np.concatenate(([0], last))).astype("<u4")
    null = np.array([i is None for i in ids], np.uint8)
    return [
        part, shard, base, len(ids), len(seq), np.array([i or 0 for i in ids], "<i8").tobytes(), null.tobytes(), per.tobytes(), tokens.tobytes(),
        left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), rule_lengths(left, right, base).astype("<u4").tobytes(),
        (symbols & 0xFFFF).astype("<u2").tobytes(), (symbols >> 16).astype(np.uint8).tobytes(),
    ]


def write_shards(docs: DataFrame, path: str, end: int = 2, out: str | None = None) -> tuple[DataFrame, str]:
    """Encode texts, append end to each, compress and write; returns the table of shards and its path.

    path: the tokenizer's file. out: where the shards go, to be kept; a table for this application without it.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(WordIds, path)
        words.held = HELD
        part = TaskContext.get().partitionId()
        tail = np.array([end], f"<u{words.width}").tobytes()
        ids: list = []
        parts: list = []
        held = shard = 0
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("base", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64())] + [(n, pa.binary()) for n in _NAMES[5:]])

        def row() -> pa.RecordBatch:
            values = _shard_row(part, shard, words.size, end, ids, parts, words.width)
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in in_slices(texts, 4_000_000):
                for name, coded in zip(names[lo:hi], words.encode(texts.slice(lo, hi - lo)), strict=True):
                    ids.append(name)
                    parts.append(coded + tail)
                    held += len(coded) // words.width + 1
                    if held >= SHARD_TOKENS or len(ids) >= SHARD_DOCS:
                        yield row()
                        ids, parts, held, shard = [], [], 0, shard + 1
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(run, SHARD_SCHEMA), "repair-shards", path=out)


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, shard and _start: ids in all shards before. Sums run within a part; only one row a part meets in one place."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    return shards.select("part", "shard", within.alias("_within")).join(parts, "part").select("part", "shard", (F.col("_within") + F.col("_before")).alias("_start"))


def decode_shard(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a shard and the ends of its documents among them."""
    base = row["base"]
    left, right = np.frombuffer(row["rule_left"], "<u4"), np.frombuffer(row["rule_right"], "<u4")
    flat, start = expansions(left, right, np.frombuffer(row["rule_length"], "<u4").astype(np.int64), base)
    symbols = np.frombuffer(row["low"], "<u2").astype(np.uint32) | (np.frombuffer(row["high"], np.uint8).astype(np.uint32) << 16)
    return expand(symbols, flat, start, base), np.cumsum(np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64))


def expanded(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Ids of a few symbols: only the rules that they name are followed."""
    symbols = symbols.astype(np.int64)
    while (rule := symbols >= base).any():
        out = np.empty(len(symbols) + int(rule.sum()), np.int64)
        at = np.arange(len(symbols)) + np.cumsum(rule) - rule
        out[at[~rule]] = symbols[~rule]
        k = symbols[rule] - base
        out[at[rule]], out[at[rule] + 1] = left[k], right[k]
        symbols = out
    return symbols.astype(np.uint32)


def decode_document(row: dict, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop (all without) of document k of a shard, from the symbols that cover them alone."""
    base = row["base"]
    last = np.cumsum(np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64))
    lo, hi = (last[k - 1] if k else 0), last[k]
    symbols = np.frombuffer(row["low"], "<u2")[lo:hi].astype(np.uint32) | (np.frombuffer(row["high"], np.uint8)[lo:hi].astype(np.uint32) << 16)
    left, right, length = (np.frombuffer(row[c], "<u4") for c in ("rule_left", "rule_right", "rule_length"))
    size = np.ones(len(symbols), np.int64)
    rule = symbols >= base
    size[rule] = length[symbols[rule].astype(np.int64) - base]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    stop = total if stop is None else min(stop, total)
    if start >= stop:
        return np.zeros(0, np.uint32)
    a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
    skip = start - (int(ends[a - 1]) if a else 0)
    return expanded(symbols[a:b], left, right, base)[skip : skip + stop - start]


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document of written shards."""
    spark: SparkSession = shards.sparkSession
    starts, _ = written(shard_starts(shards), "repair-starts", narrow=True)  # one row a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                ids, ends = decode_shard(row)
                raw, size = memoryview(ids.astype("<u4").tobytes()), np.diff(np.concatenate(([0], ends)))
                lo = ends - size
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), ends.tolist(), strict=True)]
                null = np.frombuffer(row["doc_null"], np.uint8).astype(bool)
                yield pa.record_batch(
                    [pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=null), pa.array(lo + row["_start"], pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    ship(spark)
    return shards.join(starts, ["part", "shard"]).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
