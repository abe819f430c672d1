"""Byte-level BPE encoding and decoding of whole texts, with tree concatenation for long unsplit text.

A text is cut before a single space between two characters that aren't white space, where the vocabulary's own cut
is certain; recurring pieces are encoded once. A stretch without such a place that is longer than UNSPLIT characters
is cut by the vocabulary's pattern, and a part of the pattern still longer is encoded by concatenation: its leaves
are encoded in parallel, then neighbours are joined level by level, re-encoding a window around each join that
grows until its outermost tokens are those that both sides already had. A sequence whose adjacent pairs are all
encodings of their own text is the encoding of the whole, so equal outermost tokens prove the join.

Defined results: a null text counts as empty, with no ids; special tokens' strings in a text become their ids, as
the library has it; rows that repeat stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ship
from tideline.llm.tokens import LONGEST, Generations, encoder, in_slices

#: The cut of byte-level BPE vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNSPLIT = 1024
LEAF = 256
FIRST_WINDOW = 4


class ByteBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.whole = Tokenizer.from_file(path)  # takes a part of the pattern as it is
        self.whole.no_truncation()
        self.whole.no_padding()
        self.whole.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.whole.encode_special_tokens = True
        self.model = self.tok.model
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special_ids = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.bar = self.special[0] if self.special and all(s.startswith("<|") for s in self.special) else None
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cut = re.compile(r"(?<=\S)(?= \S)")
        self.pattern = regex.compile(PATTERN)
        self.cache = Generations(450_000)

    # -- long unsplit text ---------------------------------------------------------------------------------------

    def _bpe(self, ids: list[int]) -> list[int]:
        """Re-encode the bytes of ids from scratch."""
        name = self.tok.id_to_token
        return [t.id for t in self.model.tokenize("".join([name(i) for i in ids]))]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        w = FIRST_WINDOW
        while True:
            a, b = min(w, len(left)), min(w, len(right))
            mid = self._bpe(left[-a:] + right[:b])
            whole_left, whole_right = a == len(left), b == len(right)
            if (whole_left or mid[0] == left[-a]) and (whole_right or mid[-1] == right[b - 1]) and (len(mid) > 1 or whole_left or whole_right):
                return left[: len(left) - a] + mid + right[b:]
            w *= 2

    def tree(self, part: str) -> list[int]:
        """Ids of one part of the pattern, however long."""
        before = os.environ.get("TOKENIZERS_PARALLELISM")
        os.environ["TOKENIZERS_PARALLELISM"] = "true"  # the leaves of one text go to all threads
        try:
            level = [e.ids for e in self.whole.encode_batch([part[i : i + LEAF] for i in range(0, len(part), LEAF)], add_special_tokens=False)]
        finally:
            os.environ["TOKENIZERS_PARALLELISM"] = before or "false"
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def long(self, text: str) -> list[int]:
        """Ids of text without a certain place to cut it."""
        out: list[int] = []
        for piece in self.at_special.split(text) if self.at_special else [text]:
            if piece in self.special_ids:
                out.append(self.special_ids[piece])
                continue
            for part in self.pattern.findall(piece):
                out += self.tree(part) if len(part) > UNSPLIT else self.whole.encode(part, add_special_tokens=False).ids
        return out

    # -- texts ---------------------------------------------------------------------------------------------------

    def _entries(self, lists: list[list[int]], pieces: list[str]) -> list[tuple[int, str, str]]:
        texts = self.tok.decode_batch(lists, skip_special_tokens=False)
        return [(len(ids), ",".join(map(str, ids)), p if t == p else t) for ids, t, p in zip(lists, texts, pieces, strict=True)]

    def _make(self, pieces: list[str]) -> list[tuple[int, str, str]]:
        """Entries of pieces; those without special signs go to the library a thousand at once, parted by a special token."""
        lists: list = [None] * len(pieces)
        joined = [i for i, p in enumerate(pieces) if "<|" not in p] if self.bar else []
        for lo in range(0, len(joined), 64_000):
            some = joined[lo : lo + 64_000]
            texts = [self.bar.join([pieces[i] for i in some[k : k + 1000]]) + self.bar for k in range(0, len(some), 1000)]
            for k, e in enumerate(self.tok.encode_batch_fast(texts, add_special_tokens=False)):
                ids, first = e.ids, 0
                for i, end in zip(some[1000 * k : 1000 * k + 1000], np.flatnonzero(np.array(ids) == self.special_ids[self.bar]).tolist(), strict=True):
                    lists[i] = ids[first:end]
                    first = end + 1
        alone = [i for i, x in enumerate(lists) if x is None]
        for lo in range(0, len(alone), 5000):
            some = alone[lo : lo + 5000]
            for i, e in zip(some, self.tok.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False), strict=True):
                lists[i] = e.ids
        return self._entries(lists, pieces)

    def _make_long(self, piece: str) -> tuple[int, str, str]:
        if len(piece) <= UNSPLIT:
            return self._make([piece])[0]
        return self._entries([self.long(piece)], [piece])[0]

    def entries(self, texts: list[str | None]) -> list[list[tuple[int, str, str]]]:
        """For each text its pieces' (count of ids, ids in decimal joined by commas, decoded text)."""
        parted = [self.cut.split(t) if t else [] for t in texts]
        keys = set().union(*parted) if parted else set()
        known = self.cache.ready({k for k in keys if len(k) <= LONGEST}, self._make)
        long = {k: self._make_long(k) for k in keys if len(k) > LONGEST}
        return [[known[p] if len(p) <= LONGEST else long[p] for p in pieces] for pieces in parted]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.entries([text])[0] for i in ids.split(",")] if text else []


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256, and decoded_same: whether the decoded text is the text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ByteBpe, path)
        for batch in batches:
            column = batch.column(1)
            for lo, hi in in_slices(column):
                n, ids, back, same = [], [], [], []
                texts = column.slice(lo, hi - lo).to_pylist()
                for text, parts in zip(texts, bpe.entries(texts), strict=True):
                    decoded = "".join([p[2] for p in parts])
                    n.append(sum([p[0] for p in parts]))
                    ids.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                    back.append(hashlib.sha256(decoded.encode()).hexdigest())
                    same.append(decoded == (text or ""))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids), pa.array(back), pa.array(same)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_same"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, decoded_same boolean")
