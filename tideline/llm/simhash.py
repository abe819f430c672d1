"""SimHash near-duplicates: bit-sliced comparison of fingerprints that share a table's bits.

Fingerprints are sums of the bits of hashed word shingles. Each distinct fingerprint is filed once in every table
under the bits that the table names; with the tables of `exact_tables` any two fingerprints within the radius share
a table's bits. Within a bucket, bit planes are stored vertically (bit k of 64 members in one word) and a block of
queries is compared with all members at once: planes are exclusive-ored, counted by carry-save adders of log2(radius)
bits and one sticky overflow, and blocks of members that are all beyond the radius for all queries are abandoned.
Buckets beyond BLOCK members are dealt into tiles, and each pair of tiles is a task's block, so that no bucket need
fit in a task and no pair is lost. Only spanning links leave a block; components are found over those.

Defined results: a null text has no words, so its fingerprint is zero, linked like any other; rows with equal
fingerprints are one component whatever their number; rows that repeat an id get the same component; a null id
takes part with the rows of its fingerprint and never names a component unless alone; an empty table gives an empty
result; other columns are ignored.

Similar documents are found the same way by fingerprints of their sets of shingles, of 128 bits: the tables are the
rarest shingles of each document, so that similar ones share a table for certain; those that meet are compared in bit
slices within a radius that no similar pair exceeds, and what is left is verified by the whole sets of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import discard, key_filter, looked_up, row_key, ship, shuffle_width, tidy, without, written
from tideline.llm.components import components, forest
from tideline.llm.tokens import in_slices, release, trim

#: Members of a block of a bucket.
BLOCK = 2048
#: Small buckets are compared as pairs side by side up to this size.
SMALL = 64
_SEED = 42


# -- fingerprints ----------------------------------------------------------------------------------------------------


def _counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, bit 63 first."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 255 << 8):
        some = hashes[lo : lo + (255 << 8)].astype(">u8")
        bits = np.zeros((-(-len(some) // 255) * 255, 64), np.uint8)
        bits[: len(some)] = np.unpackbits(some.view(np.uint8)).reshape(-1, 64)
        total += np.add.reduce(bits.reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)  # 255 bits fit a byte
    return total


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of words, repeats included; of all words if they are fewer; none without words."""
    import xxhash

    h = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([h(b" ".join(words), _SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1))
    return np.array([h(joined[a:b], _SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> np.ndarray:
    """64 bits: those that over half of the hashes have set."""
    h = shingle_hashes(text, shingle)
    return np.packbits(2 * _counts(h) > len(h)).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (8 bytes, the most significant first) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            trim()
            texts = batch.column(1)
            for lo, hi in in_slices(texts):
                fp = [fingerprint(t, shingle).astype(">u8").tobytes() for t in texts.slice(lo, hi - lo).to_pylist()]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(fp, pa.binary())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp binary")


# -- tables ----------------------------------------------------------------------------------------------------------


def exact_tables(bits: int, radius: int, extra: int = 2) -> list[list[int]]:
    """Bits of each table so that any two fingerprints within the radius agree on all bits of some table.

    The bits are cut into radius + extra ranges; at most radius of them differ, so some extra ranges agree.
    """
    cuts = np.linspace(0, bits, radius + extra + 1).round().astype(int)
    ranges = [list(range(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [[i for r in chosen for i in r] for chosen in combinations(ranges, extra)]


def _keys(fp: np.ndarray, tables: list[list[int]]) -> np.ndarray:
    """Keys of fingerprints (n, words) in each table, table number included: (n, tables) int64."""
    bits = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(len(fp), -1), axis=1)
    out = np.empty((len(fp), len(tables)), np.int64)
    for t, chosen in enumerate(tables):
        key = np.zeros(len(fp), np.int64)
        for i in chosen:
            key = (key << 1) | bits[:, i]
        out[:, t] = (key << 8) | t
    return out


# -- bit-sliced comparison -------------------------------------------------------------------------------------------


class Counters:
    """Carry-save counters of many lanes: adds one bit a lane at a time and remembers lanes that passed the radius."""

    def __init__(self, shape: tuple, radius: int):
        self.radius = radius
        self.levels = [np.zeros(shape, np.uint64) for _ in range(max(1, int(radius).bit_length()))]
        self.over = np.zeros(shape, np.uint64)

    def add(self, x: np.ndarray) -> None:
        for level in self.levels:
            carry = level & x
            level ^= x
            x = carry
        self.over |= x

    def beyond(self) -> np.ndarray:
        """Lanes whose count exceeds the radius so far."""
        greater = self.over.copy()
        equal = ~np.zeros_like(self.over)
        for k in range(len(self.levels) - 1, -1, -1):
            if self.radius >> k & 1:
                equal &= self.levels[k]
            else:
                greater |= equal & self.levels[k]
                equal &= ~self.levels[k]
        return greater

    def take(self, rows) -> None:
        self.levels = [v[rows] for v in self.levels]
        self.over = self.over[rows]


def planes(fp: np.ndarray) -> np.ndarray:
    """(bits, ceil(n / 64)) words: bit j of word w of plane k is bit k of fingerprint 64 w + j."""
    n = len(fp)
    bits = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(n, -1), axis=1)
    padded = np.zeros((-(-n // 64) * 64, bits.shape[1]), np.uint8)
    padded[:n] = bits
    return np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def within(queries: np.ndarray, members: np.ndarray, radius: int, some: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) of fingerprints (n, words) whose distance is at most the radius."""
    n = len(members)
    vertical = planes(members)
    found_q, found_m = [], []
    for lo in range(0, len(queries), some):
        own = queries[lo : lo + some]
        bits = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(len(own), -1), axis=1)
        flip = np.where(bits == 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        rows, columns = np.arange(len(own)), np.arange(vertical.shape[1])
        counters = Counters((len(own), vertical.shape[1]), radius)
        for k in range(vertical.shape[0]):
            counters.add(vertical[k, columns][None, :] ^ flip[rows, k][:, None])
            if k % 16 == 15 and k >= radius:  # abandon members' blocks and queries that are beyond the radius throughout
                alive = counters.beyond() != np.uint64(0xFFFFFFFFFFFFFFFF)
                row, column = alive.any(1), alive.any(0)
                if not row.any():
                    rows = rows[:0]
                    break
                if row.sum() * column.sum() < 0.7 * alive.size:
                    counters.take(np.ix_(np.flatnonzero(row), np.flatnonzero(column)))
                    rows, columns = rows[row], columns[column]
        if not len(rows):
            continue
        near = ~counters.beyond()
        r, c = np.nonzero(near)
        lanes = np.unpackbits(near[r, c].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, j = np.nonzero(lanes)
        member = columns[c[i]] * 64 + j
        ok = member < n
        found_q.append(lo + rows[r[i[ok]]])
        found_m.append(member[ok])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_q), np.concatenate(found_m)) if found_q else (none, none)


def side_by_side(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether fingerprints a[i] and b[i] are within the radius: pairs are the lanes."""
    out = np.zeros(len(a), bool)
    some = (1 << 17) // a.shape[1]
    for lo in range(0, len(a), some):
        x = planes(a[lo : lo + some] ^ b[lo : lo + some])
        lanes = np.arange(x.shape[1])
        counters = Counters((x.shape[1],), radius)
        for k in range(x.shape[0]):
            counters.add(x[k, lanes])
            if k % 16 == 15 and k >= radius:
                alive = counters.beyond() != np.uint64(0xFFFFFFFFFFFFFFFF)
                if alive.sum() < 0.7 * len(alive):
                    counters.take(alive)
                    lanes = lanes[alive]
        near = np.zeros(x.shape[1], np.uint64)
        near[lanes] = ~counters.beyond()
        out[lo : lo + some] = np.unpackbits(near.astype("<u8").view(np.uint8), bitorder="little")[: len(a[lo : lo + some])]
    return out


def _large_group(side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one block that connect what all its links do.

    Members near one pivot are connected through it, so pairs of them need no comparison; all other pairs have one.
    """
    tries = np.unique(np.linspace(0, len(fp) - 1, 4).astype(int))
    q, r = within(fp[tries], fp, radius)
    pivot = int(np.bincount(q, minlength=len(tries)).argmax())
    near = np.zeros(len(fp), bool)
    near[r[q == pivot]] = True
    own = np.flatnonzero(near)
    found = [(np.full(len(own), tries[pivot]), own)]
    blocks = [(np.flatnonzero(~near), np.arange(len(fp)))] if side[0] == 2 else [(np.flatnonzero((side == 0) & ~near), np.flatnonzero(side == 1)), (np.flatnonzero((side == 0) & near), np.flatnonzero((side == 1) & ~near))]
    for a, b in blocks:
        if len(a) and len(b):
            q, r = within(fp[a], fp[b], radius)
            q, r = a[q], b[r]
            found.append((q[q != r], r[q != r]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def block_links(group: np.ndarray, side: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of blocks: rows sorted by group. side 0 and 1 are the two tiles of a block, compared across; 2 is a tile of its own."""
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(first, len(group)))
    found_a, found_b = [], []
    small = size <= SMALL
    # small groups: at each shift, rows against the rows so far below them
    row_size, row_first = np.repeat(size, size), np.repeat(first, size)
    place = np.arange(len(group)) - row_first
    own = np.flatnonzero(np.repeat(small, size))
    for shift in range(1, SMALL):
        i = own[place[own] + shift < row_size[own]]
        if not len(i):
            break
        i = i[(side[i] == 2) | (side[i] != side[i + shift])]
        ok = side_by_side(fp[i], fp[i + shift], radius) if len(i) else np.zeros(0, bool)
        found_a.append(node[i[ok]])
        found_b.append(node[i[ok] + shift])
    for lo, n in zip(first[~small].tolist(), size[~small].tolist(), strict=True):
        a, b = _large_group(side[lo : lo + n], fp[lo : lo + n], radius)
        if len(a):
            a, b = forest(node[lo : lo + n][a], node[lo : lo + n][b])
        found_a.append(a)
        found_b.append(b)
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


# -- components ------------------------------------------------------------------------------------------------------


def near_links(nodes: DataFrame, radius: int, tables: list[list[int]], block: int = BLOCK) -> DataFrame:
    """Spanning links (a, b) of distinct fingerprints nodes(node bigint, fp binary) within the radius, found through the tables."""
    spark = nodes.sparkSession
    ship(spark)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            if not raw:
                continue
            fp = np.frombuffer(b"".join(raw), ">u8").reshape(len(raw), -1).astype(np.uint64)
            keys = _keys(fp, tables)
            for t in range(len(tables)):
                yield pa.record_batch([pa.array(keys[:, t]), batch.column(0), batch.column(1)], names=["key", "node", "fp"])

    filed = nodes.select("node", "fp").mapInArrow(file, "key bigint, node bigint, fp binary")
    # buckets beyond a block, one row for each block of rows at most: dealt into tiles, a row to each pair that has its own
    large, _ = written(filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "simhash-buckets", narrow=True)
    tiles = F.coalesce(F.ceil(F.col("n") / F.lit(block)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles")).cast("int")
    rows = filed.join(large, "key", "left").withColumn("tiles", tiles).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rows = rows.select(F.xxhash64("key", lo, hi).alias("block"), "key", lo.alias("lo"), hi.alias("hi"), side.cast("int").alias("side"), "node", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(columns: list[list]) -> pa.RecordBatch:
            key, low, high, side, node = (np.concatenate(c) for c in columns[:5])
            fp = np.frombuffer(b"".join(columns[5]), ">u8").reshape(len(node), -1).astype(np.uint64)
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
            a, b = block_links(np.cumsum(new), side, node, fp, radius)
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held: list[list] = [[] for _ in range(6)]
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6)]
            raw = batch.column(6).to_pylist()
            if n + batch.num_rows >= 50_000:  # whole groups so far, the last of this batch waits for its rest
                change = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]) | (now[2][1:] != now[2][:-1]))
                cut = int(change[-1]) + 1 if len(change) else 0
                if cut:
                    for h, x in zip(held[:5], now, strict=True):
                        h.append(x[:cut])
                    held[5].append(b"".join(raw[:cut]))
                    yield done(held)
                    held, n = [[] for _ in range(6)], 0
                    now, raw = [x[cut:] for x in now], raw[cut:]
            for h, x in zip(held[:5], now, strict=True):
                h.append(x)
            held[5].append(b"".join(raw))
            n += len(raw)
        if n:
            yield done(held)

    dealt = rows.repartition(shuffle_width(spark), "block").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(prints: DataFrame, radius: int, tables: list[list[int]]) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) for rows doc_id and fp, which must be a written table."""
    spark = prints.sparkSession
    kinds, kinds_path = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "simhash-kinds", narrow=True)
    links, links_path = written(near_links(kinds.where("node is not null"), radius, tables), "simhash-links")
    stars, stars_path = components(links)
    discard(spark, links_path)
    classes = kinds.join(stars, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id"))
    classes, _ = written(classes, "simhash-classes", narrow=True)
    discard(spark, kinds_path, stars_path)
    return looked_up(prints, classes, ["fp"], "n", prints.count()).select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row, by fingerprints of 64 bits."""
    prints, _ = written(fingerprints(docs, shingle), "simhash-prints")
    found = near_duplicates(prints, radius, exact_tables(64, radius))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


# -- similar documents -----------------------------------------------------------------------------------------------

#: Similar sets are told by fingerprints of two words: a pair of the least similarity differs in some 20 of 128 bits, with
#: a spread of 4.1, so one is beyond this radius by a chance of about a ten millionth. Sets of fewer shingles than FEW
#: may differ more, and are compared whatever their fingerprints.
SET_RADIUS = 42
FEW = 32
#: Bits of a set's odd sketch, and by how many spreads the distance of a similar pair may pass its mean.
SKETCH_BITS = 2048
SPREADS = 6.0
#: Least keys of each row that tell whether a pair has met before; what they don't tell is found again, and dropped later.
FIRSTS = 16
#: Rows of a key up to which all pairs are compared at once, and rows that share a pivot beyond.
SOME = 16
CHUNK = 512
#: Documents whose shingles are counted to learn which are common, and common shingles told to all tasks. Both only
#: order a document's shingles: any order that is the same for all documents finds the same pairs.
ORDER_DOCS = 20_000
ORDER_WORDS = 1 << 19


def _set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def least_overlap(n: int, similarity: float) -> int:
    """Shingles that a set of n shares with any set of the similarity at least."""
    return max(1, int(np.ceil(n * similarity - 1e-9)))


def set_print(h: np.ndarray) -> tuple[int, int]:
    """The fingerprint of a set of hashes: two words, of the hashes and of what they mix to."""
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    both = np.concatenate([2 * _counts(x) > len(h) for x in (h, mixed ^ (mixed >> np.uint64(32)))])
    one, two = np.packbits(both).view(">i8")
    return int(one), int(two)


def odd_sketch(h: np.ndarray) -> bytes:
    """SKETCH_BITS parities: how many of a set's hashes fall to each bit, modulo 2.

    What two sets share cancels, so their sketches differ in no more bits than they have elements that only one has.
    """
    return np.packbits(np.bincount((h % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1).tobytes()


def most_apart(both: np.ndarray, similarity: float) -> np.ndarray:
    """Bits in which the sketches of a similar pair differ at most, by the sum of both sizes.

    That is the most elements that only one set has. Where these are so many that they meet in bits, it is the mean for
    that number and SPREADS spreads (a chance of loss of about 10^-9).
    """
    alone = both * (1 - similarity) / (1 + similarity)
    odd = (1 - (1 - 2 / SKETCH_BITS) ** alone) / 2
    return np.minimum(alone + 1e-6, SKETCH_BITS * odd + SPREADS * np.sqrt(SKETCH_BITS * odd * (1 - odd)))


def sketches_near(size: np.ndarray, sketch: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the odd sketches (n, words) allow that sets i and j are of the similarity."""
    out = np.zeros(len(i), bool)
    most = most_apart(size[i].astype(np.int64) + size[j], similarity)
    some = (1 << 19) // sketch.shape[1]
    for lo in range(0, len(i), some):
        own = slice(lo, lo + some)
        out[own] = np.bitwise_count(sketch[i[own]] ^ sketch[j[own]]).sum(1, dtype=np.int64) <= most[own]
    return out


def met_before(key: np.ndarray, firsts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j, which meet at key[i], share a lesser one of their first keys (n, FIRSTS): there they have met too."""
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i), 1 << 13):
        own = slice(lo, lo + (1 << 13))
        a, b = firsts[i[own]], firsts[j[own]]
        out[own] = ((a[:, :, None] == b[:, None, :]) & (a < key[i[own], None])[:, :, None]).any((1, 2))
    return out


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles that several of some documents have, and in how many."""
    rate = ORDER_DOCS / max(ORDER_DOCS, docs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array(_set(t, shingle).view(np.int64))], names=["h"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_003)) < F.lit(rate * 1_000_003))
    counts = some.select(F.col("text").cast("string")).mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n"), "h").limit(ORDER_WORDS).toArrow()
    h, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], n[order].astype(np.int32)


def _text_row(docs: DataFrame) -> DataFrame:
    """node (the row's key), id and text of the rows with words."""
    return docs.where("text is not null and text rlike '[^ \\t-\\r]'").select(row_key(F.col("doc_id"), F.col("text")).alias("node"), F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))


def prefixes(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """key, node, size, one and two (the fingerprint): the rarest shingles of each document, so many that similar ones share one.

    Of n shingles, similar sets share least_overlap(n) at least; so in one order of all shingles, the first
    n - least_overlap(n) + 1 of both have one in common. These are the tables that fingerprints are filed in.
    """
    spark = docs.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(_common(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashes, counts = known.value
        for batch in batches:
            trim()
            nodes, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for lo, hi in in_slices(texts):
                keys, sizes, prints = [], [], []
                for t in texts.slice(lo, hi - lo).to_pylist():
                    h = _set(t, shingle)
                    prints.append(set_print(h))
                    if len(hashes):
                        place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                        h = h[np.argsort(np.where(hashes[place] == h, counts[place], 0), kind="stable")]
                    keys.append(h[: len(h) - least_overlap(len(h), similarity) + 1].view(np.int64))
                    sizes.append(len(h))
                n = np.array([len(k) for k in keys])
                own = np.array(prints, np.int64).reshape(-1, 2)
                columns = [np.concatenate(keys), np.repeat(nodes[lo:hi], n), np.repeat(np.array(sizes, np.int32), n), np.repeat(own[:, 0], n), np.repeat(own[:, 1], n)]
                yield pa.record_batch([pa.array(c) for c in columns], names=["key", "node", "size", "one", "two"])

    return _text_row(docs).select("node", "text").mapInArrow(run, "key bigint, node bigint, size int, one bigint, two bigint")


def _prints(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.stack((one, two), axis=1).view(np.uint64)


def _may_be_similar(size: np.ndarray, fp: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets i and j may be of the similarity, by their sizes and fingerprints."""
    if not len(i):
        return np.zeros(0, bool)
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    near = small >= similarity * large - 1e-9
    wide = np.flatnonzero(near & (small >= FEW))
    near[wide] = side_by_side(fp[i[wide]], fp[j[wide]], SET_RADIUS)
    return near


def _pairs(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distinct pairs of different nodes, the greater first."""
    a, b = np.maximum(node[i], node[j]), np.minimum(node[i], node[j])
    both = np.stack((a, b), axis=1)[a != b]
    return np.unique(both, axis=0) if len(both) else both


_MET = "a bigint, b bigint, key bigint, size int, one bigint, two bigint"


def _met(rows: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) among the rows of each key, and the rows (key, a, size, one, two) of keys with more than SOME.

    Of the latter, rows are only paired with the pivot of their chunk, and pivots with the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(now: list[np.ndarray], head: list[np.ndarray] | None) -> pa.RecordBatch:
            """Pairs and rows of keys; head is the first row of a key that goes on, where its first rows are done."""
            key = now[0]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(key)))
            size_of, place = np.repeat(count, count), np.arange(len(key)) - np.repeat(first, count)
            goes_on = head is not None and head[0][0] == key[0]
            many = size_of > SOME
            if goes_on:
                many |= key == key[0]
            few = np.flatnonzero(~many)
            left, right = [], []
            for shift in range(1, SOME):
                i = few[place[few] + shift < size_of[few]]
                left.append(i)
                right.append(i + shift)
            rows = np.flatnonzero(many)
            start = rows - place[rows]
            pivot = start + place[rows] // CHUNK * CHUNK
            member, lead = rows != pivot, (rows == pivot) & (rows != start)
            left += [rows[member], rows[lead]]
            right += [pivot[member], start[lead]]
            if goes_on:
                now = [np.concatenate((x, h)) for x, h in zip(now, head, strict=True)]
                left.append(np.zeros(1, np.int64))
                right.append(np.full(1, len(key)))
            _, node, size, one, two = now
            i, j = np.concatenate(left), np.concatenate(right)
            ok = _may_be_similar(size, _prints(one, two), i, j, similarity)
            return _met_batch(_pairs(node, i[ok], j[ok]), [x[rows] for x in now])

        held: list[np.ndarray] | None = None
        head: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None:
                now = [np.concatenate((h, x)) for h, x in zip(held, now, strict=True)]
            change = np.flatnonzero(now[0][1:] != now[0][:-1])
            whole = int(change[-1]) + 1 if len(change) else 0
            if whole:  # the last key waits for its rest
                yield done([x[:whole] for x in now], head)
                head, now = None, [x[whole:] for x in now]
            if len(now[0]) > 32 * CHUNK:  # but one with very many rows is dealt with in turn
                yield done(now, head)
                head = head if head is not None and head[0][0] == now[0][0] else [x[:1] for x in now]
                now = None
            held = now
        if held is not None:
            yield done(held, head)

    dealt = rows.repartition(shuffle_width(rows.sparkSession), "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, _MET)


def _met_batch(pairs: np.ndarray, rows: list[np.ndarray]) -> pa.RecordBatch:
    key, node, size, one, two = rows
    n, m = len(pairs), len(node)
    pair = np.arange(n + m) < n

    def of_rows(x: np.ndarray) -> pa.Array:
        return pa.array(np.concatenate((np.zeros(n, x.dtype), x)), mask=pair)

    a, b = np.concatenate((pairs[:, 0], node)), np.concatenate((pairs[:, 1], np.zeros(m, np.int64)))
    return pa.record_batch([pa.array(a), pa.array(b, mask=~pair), of_rows(key), of_rows(size.astype(np.int32)), of_rows(one), of_rows(two)], names=["a", "b", "key", "size", "one", "two"])


def _apart(docs: DataFrame, rows: DataFrame, near: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Candidate pairs (a, b) of rows (key, a, size, one, two) that share a key but no component yet.

    Keys whose rows are all of one component are done. Others are dealt into tiles, and each pair of tiles is a block.
    In a group of near copies that differ in other places each, most pairs are somewhat similar, so that fingerprints
    alone would let the square of its size pass; the odd sketches of the sets turn away nearly all that aren't similar.
    """
    spark = rows.sparkSession
    placed = rows.join(near, F.col("a") == F.col("node"), "left").select("key", "a", "size", "one", "two", F.coalesce("component", "a").alias("component"))
    placed, _ = written(placed, "similar-placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("m"), F.count("*").alias("n")).where("l < m").select("key", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("tiles"))
    mixed, _ = written(mixed, "similar-mixed", narrow=True)
    placed = placed.join(mixed, "key")
    firsts = F.slice(F.array_sort(F.collect_set("key")), 1, FIRSTS)
    named, _ = written(placed.groupBy(F.col("a").alias("node")).agg(firsts.alias("firsts")), "similar-named", narrow=True)
    sketches, _ = written(_told(docs, named, shingle, odd_sketch).join(named, "node").select(F.col("node").alias("a"), F.col("told").alias("sketch"), "firsts"), "similar-sketches")
    dealt = placed.join(sketches, "a").withColumn("own", F.pmod(F.xxhash64("a", F.lit(7)), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int")
    dealt = dealt.select("key", lo.alias("lo"), hi.alias("hi"), side.alias("side"), F.col("a").alias("node"), "size", "one", "two", "component", "sketch", "firsts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(now: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, low, high, side, node, size, one, two, component, sketch, firsts = now
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
            first = np.flatnonzero(new)
            fp = _prints(one, two)
            for at, to in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
                left = np.arange(at, to)[side[at:to] != 1]
                right = np.arange(at, to)[side[at:to] != 0]
                few = size[at:to].min() < FEW
                for k in range(0, len(left), 256):
                    some, rest = left[k : k + 256], right[k:] if side[at] == 2 else right
                    if few:
                        i, j = np.repeat(some, len(rest)), np.tile(rest, len(some))
                    else:
                        q, r = within(fp[some], fp[rest], SET_RADIUS)
                        i, j = some[q], rest[r]
                    other = (component[i] != component[j]) & ((side[i] != 2) | (i < j))
                    i, j = i[other], j[other]
                    ok = _may_be_similar(size, fp, i, j, similarity)
                    i, j = i[ok], j[ok]
                    ok = sketches_near(size, sketch, i, j, similarity)
                    i, j = i[ok], j[ok]
                    ok = ~met_before(key, firsts, i, j)
                    pairs = _pairs(node, i[ok], j[ok])
                    yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(9)]
            now.append(np.frombuffer(b"".join(batch.column(9).to_pylist()), np.uint64).reshape(batch.num_rows, -1))
            firsts = batch.column(10)
            own = np.tile(now[0][:, None], (1, FIRSTS))  # filled up with the row's key, which is no earlier one
            n = pc.list_value_length(firsts).to_numpy(zero_copy_only=False)
            own[np.arange(FIRSTS) < n[:, None]] = firsts.flatten().to_numpy(zero_copy_only=False)
            now.append(own)
            if held is not None:
                now = [np.concatenate((h, x)) for h, x in zip(held, now, strict=True)]
            change = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]) | (now[2][1:] != now[2][:-1]))
            whole = int(change[-1]) + 1 if len(change) else 0
            if whole:
                yield from done([x[:whole] for x in now])
            held = [x[whole:] for x in now]
        if held is not None:
            yield from done(held)

    dealt = dealt.repartition(shuffle_width(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def similar_sets(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets (ascending, distinct) is reached."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _told(docs: DataFrame, named: DataFrame, shingle: int, tell: Callable[[np.ndarray], bytes]) -> DataFrame:
    """node, id and told (what tell makes of the set of shingles) of the rows named (node, a written table).

    Of the texts, those that a filter of the named rows turns away are neither taken apart nor shuffled.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            trim()
            texts = batch.column(2)
            for lo, hi in in_slices(texts):
                raw = [tell(_set(t, shingle)) for t in texts.slice(lo, hi - lo).to_pylist()]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(raw, pa.binary())], names=["node", "id", "told"])

    maybe = key_filter(named, "node", named.count())(F.col("node"))
    rows = _text_row(docs).where(maybe).join(named, "node", "left_semi")
    return rows.mapInArrow(sets, "node bigint, id bigint, told binary").dropDuplicates(["node"])


def _verified(docs: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Those of the pairs (a, b) of rows whose whole shingle sets have the similarity, and node and id of all rows in pairs.

    Both are written.
    """

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = batch.column(2), batch.column(3)
            ok = [similar_sets(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity) for x, y in zip(own, other, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    named, named_path = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "similar-named", narrow=True)
    found, found_path = written(_told(docs, named, shingle, np.ndarray.tobytes), "similar-sets")
    a = found.select(F.col("node").alias("a"), F.col("told").alias("ha"))
    b = found.select(F.col("node").alias("b"), F.col("told").alias("hb"))
    links, _ = written(pairs.join(a, "a").join(b, "b").select("a", "b", "ha", "hb").mapInArrow(test, "a bigint, b bigint"), "similar-links", narrow=True)
    ids, _ = written(found.select("node", "id"), "similar-ids", narrow=True)
    discard(docs.sparkSession, named_path, found_path)
    return links, ids


def _stars(docs: DataFrame, similarity: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """node and component of each row that isn't the least of its component, and node and id of all of them.

    First the pairs of rows that meet in a table of few rows are tested, and rows of larger ones against a pivot; then
    those that share a large one and are still apart, so that a group of many similar documents isn't compared pair by pair.
    """
    spark = docs.sparkSession
    met, met_path = written(_met(prefixes(docs, similarity, shingle), similarity), "similar-met")
    pairs, pairs_path = written(met.where("b is not null").select("a", "b").distinct(), "similar-pairs", narrow=True)
    links, ids = _verified(docs, pairs, similarity, shingle)
    near, near_path = components(links)
    rows = met.where("b is null")
    if rows.isEmpty():
        discard(spark, met_path, pairs_path)
        return near, ids
    more = _apart(docs, rows.select("key", "a", "size", "one", "two"), near, similarity, shingle).distinct().join(pairs, ["a", "b"], "left_anti")
    more, more_path = written(more, "similar-more", narrow=True)
    discard(spark, met_path)
    if more.isEmpty():
        discard(spark, pairs_path, more_path)
        return near, ids
    links_too, ids_too = _verified(docs, more, similarity, shingle)
    near, _ = components(links.unionByName(links_too))
    discard(spark, pairs_path, more_path, near_path)
    return near, ids.unionByName(ids_too).distinct()


def _members(near: DataFrame, ids: DataFrame) -> DataFrame:
    """node, id, component and best (the row that stays: least id, null last) of each row in a component of several."""
    every = near.unionByName(near.groupBy("component").agg(F.lit(1).alias("_one")).select(F.col("component").alias("node"), "component"))
    rows, _ = written(every.join(ids, "node").select("node", "id", "component"), "similar-members", narrow=True)
    best = rows.groupBy("component").agg(F.count("*").alias("_n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("best"))
    return looked_up(rows, best, ["component"], "_n", rows.count())


def similar_components(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id and component_id (its least doc_id) of every row with words, by the Jaccard similarity of their sets of word shingles.

    All pairs of the similarity are found, and none below it is linked, whatever the number of documents. Rows that
    repeat an id are rows of their own; a null id names a component only if no other id is there.
    """
    members = _members(*_stars(docs, similarity, shingle)).select("node", F.col("best.id").alias("_least"))
    rows = _text_row(docs).select("node", F.col("id").alias("doc_id"))
    return rows.join(members, "node", "left").select("doc_id", F.coalesce("_least", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the smallest id; all columns kept.

    A document is a row's id and text: of rows that repeat an id with other texts each is judged by its own text, and
    rows that repeat both stay or go together. Rows without words stay. Only rows that a filter of the dropped ones
    doesn't clear are shuffled.
    """
    tidy(docs.sparkSession)
    gone = _members(*_stars(docs, similarity, shingle)).where("node <> best.node").select("node")
    gone, _ = written(gone.distinct(), "similar-gone", narrow=True)
    return without(docs, row_key(F.col("doc_id"), F.col("text")), gone, "node")
