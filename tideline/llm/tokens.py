"""Token ids of whole texts, by way of distinct chunks: a chunk that recurs is encoded once by each worker.

Both vocabularies here cut a text before they merge, so a text may be parted at places where that cut is certain,
and its ids are the ids of its parts. The parts are encoded by the tokenizers library in batches.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import threading
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a cache of ids holds before it starts anew (some 60 bytes each), so that memory stays bounded.
HELD = 1_000_000
#: Longer chunks are encoded each time.
LONGEST = 64

#: Signs that a chunk may end with, and one that parts chunks given to the library together.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BAR = "\x01"

_ENCODERS: dict[tuple, object] = {}

#: Seconds after a task that a worker's caches are kept for another one.
REST_S = 2.0
_REST: list[threading.Timer] = []


def encoder(kind: type, path: str):
    """This process's encoder for a file, with its cache; worker processes are used again by later tasks."""
    key = (kind.__name__, path)
    while _REST:
        _REST.pop().cancel()
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would each hold memory
    found = _ENCODERS.get(key)
    if found is None:
        found = _ENCODERS[key] = kind(path)
    return found


class Generations:
    """A mapping of bounded size: when the young generation is full, it becomes the old one, which is dropped."""

    def __init__(self, most: int):
        self.young: dict = {}
        self.old: dict = {}
        self.most = most

    def ready(self, keys: set, make) -> dict:
        """A mapping that has all keys: make(list of missing keys) gives the values of those not yet known."""
        young, old = self.young, self.old
        missing = keys.difference(young)
        if missing:
            again = missing.intersection(old)
            for k in again:
                young[k] = old[k]
            missing -= again
        if missing:
            names = list(missing)
            young.update(zip(names, make(names), strict=True))
        if len(young) > self.most:
            self.old, self.young = young, {}
        return young


def trim() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release() -> None:
    """Drop the caches of this process, where other work than encoding begins."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
        trim()


def rest() -> None:
    """At the end of a task: drop the caches of this process soon, unless another task asks for an encoder before.

    Workers outlive their stage, and what they hold counts beside whatever the executor does next.
    """
    while _REST:
        _REST.pop().cancel()
    timer = threading.Timer(REST_S, release)
    timer.daemon = True
    _REST.append(timer)
    timer.start()


class Rows:
    """Row numbers of strings, by a 128-bit hash of each; the strings themselves aren't held."""

    def __init__(self):
        self.hash, self.check, self.row = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)

    @staticmethod
    def hashed(strings) -> tuple[np.ndarray, np.ndarray]:
        from xxhash import xxh3_128_digest

        both = np.frombuffer(b"".join(map(xxh3_128_digest, strings)), "<u8").reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()

    def find(self, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Rows, -1 for strings not held."""
        if not len(self.hash):
            return np.full(len(hashes[0]), -1, np.int32)
        order = np.argsort(hashes[0])
        at = np.empty(len(order), np.int64)
        at[order] = np.searchsorted(self.hash, hashes[0][order])
        at[at == len(self.hash)] = 0
        return np.where((self.hash[at] == hashes[0]) & (self.check[at] == hashes[1]), self.row[at], np.int32(-1))

    def add(self, hashes: tuple[np.ndarray, np.ndarray], first: int) -> None:
        self.hash = np.concatenate((self.hash, hashes[0]))
        self.check = np.concatenate((self.check, hashes[1]))
        self.row = np.concatenate((self.row, np.arange(first, first + len(hashes[0]), dtype=np.int32)))
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.check, self.row = self.hash[order], self.check[order], self.row[order]


class WordIds:
    """Ids of a vocabulary whose cut drops white space: texts are parted at spaces and line feeds.

    Such a vocabulary lower-cases, and parts letters from other signs, so a chunk is encoded as what it has up to its
    last letter and the signs after that, each once for all chunks that share it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.held = HELD
        self.calls = 0
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.width = self.dtype.itemsize
        self.bar = None
        if len(ids := self.tok.encode(f"a {_BAR} a", add_special_tokens=False).ids) == 3:
            self.bar = ids[1]
        # single words of ASCII letters need neither normalising nor the cut, and end with a token of their own kind
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.light = None
        if suffix and self.lowers():
            self.light = Tokenizer.from_file(path)
            self.light.no_truncation()
            self.light.no_padding()
            self.light.normalizer = normalizers.Sequence([])
            self.light.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(self.size, bool)
            self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        self.chunks = Rows()  # chunk -> its row in core and tail
        self.parts = Rows()  # what was encoded -> its row in start and length
        self.flat = np.zeros(0, self.dtype)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.core = np.zeros(0, np.int32)
        self.tail = np.zeros(0, np.int32)
        self._encode_parts([""])

    def lowers(self) -> bool:
        """Whether the vocabulary's ids don't depend on the case of ASCII letters."""
        e = self.tok.encode
        return e("AbC", add_special_tokens=False).ids == e("abc", add_special_tokens=False).ids

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of lower-case ASCII letters, and their counts."""
        texts = [" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)]
        flat = np.concatenate([np.array(e.ids, self.dtype) for e in self.light.encode_batch_fast(texts, add_special_tokens=False)])
        return flat, np.diff(np.concatenate(([-1], np.flatnonzero(self.ends[flat]))))

    def _library(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, and their counts; a sign between chunks parts them."""
        flat, sizes = [], []
        for lo in range(0, len(chunks), 16_000):
            some = chunks[lo : lo + 16_000]
            texts = [f" {_BAR} ".join(some[k : k + 1000]) + f" {_BAR}" for k in range(0, len(some), 1000)]
            ids = np.concatenate([np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.bar)
            flat.append(ids[ids != self.bar])
            sizes.append(np.diff(np.concatenate(([-1], ends))) - 1)
        return np.concatenate(flat), np.concatenate(sizes)

    def _alone(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks that may hold a special token's signs."""
        rows = [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))

    def _cores(self, chunk: str) -> tuple[str, str]:
        """A chunk as what is encoded for it: up to its last letter, and the signs after that."""
        core = chunk.rstrip(_SIGNS)
        if "<|" in chunk or not self.light:
            return chunk, ""
        if core.isascii():
            low = core.lower()
            return (low, chunk[len(core) :]) if low[-1:].isalpha() else (chunk.lower(), "")
        return (core, chunk[len(core) :]) if core[-1].isalpha() and core[-1].lower()[-1].isalpha() else (chunk, "")

    def _encode_parts(self, need: list[str]) -> None:
        """Encode parts that aren't held."""
        words, plain, odd = [], [], []
        for p in need:
            if self.light and p.isascii() and p.isalpha():
                words.append(p)
            elif self.bar is None or "<|" in p or _BAR in p:
                odd.append(p)
            else:
                plain.append(p)
        for some, make in ((words, self._words), (plain, self._library), (odd, self._alone)):
            if some:
                flat, size = make(some)
                first = len(self.flat) + np.cumsum(size) - size
                self.parts.add(Rows.hashed(some), len(self.start))
                self.flat = np.concatenate((self.flat, flat))
                self.start, self.length = np.concatenate((self.start, first)), np.concatenate((self.length, size.astype(np.int32)))

    def _learn(self, chunks: list[str], hashes: tuple[np.ndarray, np.ndarray]) -> None:
        """Hold chunks, encoding those of their parts that aren't held."""
        pairs = [self._cores(c) for c in chunks]
        names = list({p for pair in pairs for p in pair})
        own = Rows.hashed(names)
        known = self.parts.find(own)
        new = np.flatnonzero(known < 0)
        if len(new):
            self._encode_parts([names[i] for i in new.tolist()])
            known[new] = self.parts.find((own[0][new], own[1][new]))
        row = dict(zip(names, known.tolist(), strict=True))
        self.chunks.add(hashes, len(self.core))
        self.core = np.concatenate((self.core, np.fromiter([row[a] for a, _ in pairs], np.int32, len(pairs))))
        self.tail = np.concatenate((self.tail, np.fromiter([row[b] for _, b in pairs], np.int32, len(pairs))))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts (null: none) one after another, and each text's count of ids."""
        if len(texts) == 0:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        parted = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = parted.flatten().dictionary_encode()
        kinds = coded.dictionary.to_numpy(zero_copy_only=False)
        if len(self.core) > self.held or len(self.flat) > 6 * self.held:
            self._clear()
        hashes = Rows.hashed(kinds.tolist())
        row = self.chunks.find(hashes)
        new = np.flatnonzero(row < 0)
        if len(new):
            first = len(self.core)
            self._learn(kinds[new].tolist(), (hashes[0][new], hashes[1][new]))
            row[new] = np.arange(first, first + len(new), dtype=np.int32)
        del kinds, hashes
        at = row[coded.indices.to_numpy()]
        both = np.empty(2 * len(at), np.int32)
        both[0::2], both[1::2] = self.core[at], self.tail[at]
        size = self.length[both]
        upto = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        shift = self.start[both] - upto[:-1]
        ids = self.flat[np.repeat(shift, size) + np.arange(upto[-1])]
        ends = np.cumsum(pc.list_value_length(parted).to_numpy(zero_copy_only=False).astype(np.int64))
        counts = np.diff(np.concatenate(([0], upto[2 * ends])))
        del parted, coded, at, both, size, upto, shift, ends
        self.calls += 1
        if self.calls % 4 == 0:
            trim()
        return ids, counts

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Little-endian ids of each text, self.width bytes each."""
        ids, counts = self.encode_array(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        raw, ends = ids.tobytes(), (np.cumsum(counts) * self.width).tolist()
        return [raw[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]


def in_slices(texts: Iterable | pa.Array, chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters (bytes of an Arrow array) each; a longer text ends its range."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist() if isinstance(texts, pa.Array) else [len(t or "") for t in texts]
    start, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
