"""Embedding near-duplicates over robust-pruned flat graphs.

Distinct vectors are dealt to regions: centroids come from a bounded sample, and a vector joins its nearest ones; a
region beyond what a task should hold is dealt into tiles. Within a region, vectors are clustered into small shards
that overlap, and each shard builds a graph: a vector's nearest in the shard are pruned robustly (a neighbour goes if
a nearer one, scaled, is closer to it), and back links are added. A vector's adjacency lists from all its shards and
regions are united to one flat graph. Then every vector is searched for in the region that it is nearest to: a greedy
walk begins at the best of the shards' medoids, follows united lists from shard to shard until its beam stands still,
and then expands to every neighbour of a vector within the radius. What is found is verified by the cosine in double
precision. A pair that two regions can find is counted by the first of them alone. The links' recall is audited
against brute force for a bounded sample of vectors, over all links and as the mean over vectors; below the target
the search is repeated with more overlap and a wider beam, and at last by comparing exactly: a vector then joins every
region whose centroid is no farther than its nearest one by twice the link's angle, where by the triangle inequality
any linked pair meets, and regions are compared in whole blocks.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing and are
classes of their own; equal vectors (any positive multiple of one another up to rounding is found by the search,
bitwise equal ones are joined beforehand) count with their number; vectors of another length than the first ones'
link only with those of their own length; a row without a vec_id counts as a vector where another row with an id has
the same components, and is returned with no links and no component; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import discard, looked_up, ship, shuffle_width, written
from tideline.llm.components import components, forest

THRESHOLD = 0.95
#: Vectors of a region on average, and the most that a task holds, in members and in bytes of components.
PER_REGION = 8192
MOST_MEMBERS = 32_768
MOST_BYTES = 64 << 20
#: Vectors of a shard of a region on average; vectors of the sample that centroids come from, and regions at most.
PER_SHARD = 512
SAMPLE = 16_384
MOST_CENTROIDS = 2048
#: Regions that a vector joins, and shards of each.
OVERLAP = 3
SHARDS = 2
#: Candidates before pruning, degree after it, and the scale by which a nearer neighbour prunes.
CANDIDATES = 48
DEGREE = 16
ALPHA = 1.2
BEAM = 24
AUDITED = 256
TARGET = 0.97


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def robust_pruned(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of each unit vector, (n, degree) padded with -1, by robust pruning of its nearest, with links back."""
    n = len(x)
    if n < 2:
        return np.full((n, degree), -1, np.int64)
    k = min(candidates, n - 1)
    near = np.empty((n, k), np.int64)
    for lo in range(0, n, 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        near[lo : lo + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    # a few far vectors keep the graph in one piece
    far = (np.arange(n)[:, None] * 7919 + np.array([1, n // 3 + 1, n // 2 + 1])) % n
    near = np.concatenate((near, far), axis=1)
    dist = 2 - 2 * np.einsum("ijk,ik->ij", x[near], x)
    dist[near == np.arange(n)[:, None]] = np.inf
    out = np.full((n, degree), -1, np.int64)
    rows = np.arange(n)
    for d in range(degree):
        best = dist.argmin(1)
        good = np.isfinite(dist[rows, best])
        if not good.any():
            break
        chosen = near[rows, best]
        out[good, d] = chosen[good]
        between = 2 - 2 * np.einsum("ijk,ik->ij", x[near], x[chosen])
        dist[(alpha * between <= dist) & good[:, None]] = np.inf
        dist[rows, best] = np.inf
    # links back: as many of each vector's incoming ones as a second list of the same length holds, spread evenly
    src, dst = np.repeat(rows, degree), out.reshape(-1)
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    back = np.full((n, degree), -1, np.int64)
    fits = place < degree
    back[dst[fits], place[fits]] = src[fits]
    return np.concatenate((out, back), axis=1)


def shards(x: np.ndarray, per: int = PER_SHARD, overlap: int = SHARDS) -> tuple[list[np.ndarray], np.ndarray]:
    """Members of each overlapping shard of a region's unit vectors, and the shards' medoids."""
    n = len(x)
    k = max(1, round(n / per))
    c = clustered(x[:: max(1, n // (16 * k))], k)
    near = np.concatenate([np.argpartition(-(x[lo : lo + 4096] @ c.T), min(overlap, len(c)) - 1, axis=1)[:, : min(overlap, len(c))] for lo in range(0, n, 4096)])
    rows, shard = np.repeat(np.arange(n), near.shape[1]), near.reshape(-1)
    order = np.argsort(shard, kind="stable")
    out, medoids = [], []
    for own in np.split(rows[order], np.searchsorted(shard[order], np.arange(1, len(c)))):
        if not len(own):
            continue
        medoids.append(own[(x[own] @ x[own].mean(0)).argmax()])
        parts = max(1, round(len(own) / (2 * per)))  # a crowded shard is dealt out
        out += [own[i::parts] for i in range(parts)]
    return out, np.unique(medoids)


def united(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) of the flat graph of a region: each shard's robust-pruned lists, united."""
    n = len(x)
    found = []
    for own in shards(x)[0]:
        nb = robust_pruned(x[own])
        r, c = np.nonzero(nb >= 0)
        found.append(own[r] * n + own[nb[r, c]])
    code = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return code // n, code % n


def range_search(queries: np.ndarray, x: np.ndarray, first: np.ndarray, nb: np.ndarray, entries: np.ndarray, threshold: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) found with cosine >= threshold: a greedy walk from the entries, then expansion within the radius.

    The neighbours of vector v are nb[first[v] : first[v + 1]].
    """
    m, n = len(queries), len(x)
    seen = np.zeros((m, n), bool)
    done = np.zeros((m, n), bool)
    start = queries @ x[entries].T
    seen[:, entries] = True
    hit_q, at = np.nonzero(start >= threshold)
    hits_q, hits_v = [hit_q], [entries[at]]
    best = np.argsort(-start, axis=1, kind="stable")[:, :beam]
    beam_at = np.full((m, beam), -1, np.int64)
    beam_sim = np.full((m, beam), -2.0)
    beam_at[:, : best.shape[1]], beam_sim[:, : best.shape[1]] = entries[best], np.take_along_axis(start, best, 1)
    rows = np.arange(m)
    degree = np.diff(first)

    def step(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unseen neighbours of v for queries q, and their similarity."""
        count = degree[v]
        upto = np.cumsum(count)
        q2 = np.repeat(q, count)
        v2 = nb[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(first[v] - (upto - count), count)]
        ok = ~seen[q2, v2]
        code = np.unique(q2[ok] * n + v2[ok])
        q2, v2 = code // n, code % n
        seen[q2, v2] = True
        return q2, v2, np.einsum("ij,ij->i", queries[q2], x[v2])

    while True:
        open_ = (beam_at >= 0) & ~done[rows[:, None], np.maximum(beam_at, 0)]
        active = np.flatnonzero(open_.any(1))
        if not len(active):
            break
        v = beam_at[active, open_[active].argmax(1)]  # the beam is in order of similarity
        done[active, v] = True
        q2, v2, s = step(active, v)
        near = s >= threshold
        hits_q.append(q2[near])
        hits_v.append(v2[near])
        if not len(q2):
            continue
        # merge into the beams: new ones of each query beside its old ones, the best stay
        uq, begin, count = np.unique(q2, return_index=True, return_counts=True)
        wide = int(count.max())
        add_at, add_sim = np.full((len(uq), wide), -1, np.int64), np.full((len(uq), wide), -2.0)
        r, c = np.repeat(np.arange(len(uq)), count), np.arange(len(q2)) - np.repeat(begin, count)
        add_at[r, c], add_sim[r, c] = v2, s
        both, sim = np.concatenate((beam_at[uq], add_at), 1), np.concatenate((beam_sim[uq], add_sim), 1)
        best = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
        beam_at[uq], beam_sim[uq] = np.take_along_axis(both, best, 1), np.take_along_axis(sim, best, 1)
    # range expansion: every vector within the radius opens its neighbours
    q, v = np.concatenate(hits_q), np.concatenate(hits_v)
    ok = ~done[q, v]
    q, v = q[ok], v[ok]
    while len(q):
        done[q, v] = True
        new_q, new_v = [], []
        for lo in range(0, len(q), 20_000):
            q2, v2, s = step(q[lo : lo + 20_000], v[lo : lo + 20_000])
            near = s >= threshold
            new_q.append(q2[near])
            new_v.append(v2[near])
        q, v = np.concatenate(new_q), np.concatenate(new_v)
        hits_q.append(q)
        hits_v.append(v)
    return np.concatenate(hits_q), np.concatenate(hits_v)


def clustered(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k unit centroids of unit vectors (as many as there are vectors at most) by spherical k-means."""
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds if k > 1 else 1):
        near = np.concatenate([(x[lo : lo + 4096] @ c.T).argmax(1) for lo in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def _usable(column: pa.Array) -> list[bytes | None]:
    """Components as bytes of doubles, scaled where they are very large or small; None for vectors that link with nothing."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # null components become non-finite ones
    out: list[bytes | None] = [None] * len(size)
    start = np.cumsum(size) - size
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        x = flat[start[rows][:, None] + np.arange(n)]
        most = np.abs(x).max(1)
        ok = np.isfinite(x).all(1) & (most > 0)
        odd = ok & ~((most > 1e-100) & (most < 1e100))
        x[odd] /= most[odd, None]
        raw = x.astype("<f8").tobytes()
        for k in np.flatnonzero(ok).tolist():
            out[rows[k]] = raw[8 * n * k : 8 * n * (k + 1)]
    return out


def usable_vectors(vectors: DataFrame) -> tuple[DataFrame, str]:
    """Every row's vec_id and vec (doubles as bytes, null if it links with nothing), and two hashes of vec, one and two; written."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(_usable(batch.column(1)), pa.binary())], names=["vec_id", "vec"])

    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id bigint, vec binary")
    return written(rows.select("*", F.xxhash64("vec").alias("one"), F.xxhash64(F.lit(41), "vec").alias("two")), "vectors")


def _assigned(kinds: DataFrame, c: np.ndarray, overlap: int, angle: float | None) -> DataFrame:
    """Rows node, weight, vec, regions (its nearest centroids, the nearest first), one row for each of them as region.

    With an angle, all centroids no farther than the nearest by so much, instead of a fixed number.
    """
    held = kinds.sparkSession.sparkContext.broadcast(c)  # at most MOST_CENTROIDS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            sim = unit(_matrix(batch.column(2))) @ c.T
            order = np.argsort(-sim, axis=1, kind="stable")
            away = np.arccos(np.clip(np.take_along_axis(sim, order, 1), -1, 1))
            inside = away <= away[:, :1] + angle + 1e-9 if angle is not None else np.broadcast_to(np.arange(len(c)) < overlap, sim.shape)
            r, j = np.nonzero(inside)
            lists = pa.array(np.split(order[r, j], np.searchsorted(r, np.arange(1, len(sim)))), pa.list_(pa.int64()))
            at = pa.array(r)
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), lists.take(at), pa.array(order[r, j])], names=["node", "weight", "vec", "regions", "region"])

    return kinds.select("node", "weight", "vec").mapInArrow(run, "node bigint, weight bigint, vec binary, regions array<bigint>, region bigint")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by the first columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and last != tuple(key[lo]):
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(key[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _graphs(tiled: DataFrame) -> DataFrame:
    """node and its neighbours' nodes, united over all shards of its regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 2):
            node = g.column("node").to_numpy()
            src, dst = united(unit(_matrix(g.column("vec").combine_chunks())).astype(np.float32))
            yield pa.record_batch([pa.array(node), pa.array(np.split(node[dst], np.searchsorted(src, np.arange(1, len(node)))), pa.list_(pa.int64()))], names=["node", "nb"])

    dealt = tiled.select("region", "tile", "node", "vec").repartition(shuffle_width(tiled.sparkSession), "region", "tile").sortWithinPartitions("region", "tile", "node")
    lists = dealt.mapInArrow(run, "node bigint, nb array<bigint>")
    # a vector is in OVERLAP regions and SHARDS shards of each, so its united list has at most 2 * DEGREE nodes for each
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("nb"))).alias("nb"))


def _compared(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (row of a, row of b) with cosine >= threshold, in blocks."""
    found = [np.nonzero(a[lo : lo + 512] @ b.T >= threshold) for lo in range(0, len(a), 512)]
    return np.concatenate([i + 512 * k for k, (i, _) in enumerate(found)]), np.concatenate([j for _, j in found])


def _searched(pairs: DataFrame, threshold: float, beam: int, exact: bool) -> DataFrame:
    """From rows of tile pairs: per vector the number of linked vectors that this pair counts, and spanning links."""

    def links(x: np.ndarray, node: np.ndarray, neighbours: pa.Array, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Codes of the unordered pairs of rows that queries a find among b."""
        n, wide = len(node), x.astype(np.float32)
        found = [np.zeros(0, np.int64)]
        if exact:
            q, v = _compared(wide[a], wide[b], threshold - 1e-4)
            found.append(np.minimum(a[q], b[v]) * n + np.maximum(a[q], b[v]))
        else:
            order = np.argsort(node[b], kind="stable")
            some = neighbours.take(pa.array(b))
            count = pc.list_value_length(some).to_numpy(zero_copy_only=False).astype(np.int64)
            names = some.flatten().to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(node[b][order], names), len(b) - 1)
            known = node[b][order][place] == names
            owner = np.repeat(np.arange(len(b)), count)[known]
            first = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(b)))))
            nb = order[place[known]]
            entries = shards(wide[b])[1]
            many = max(32, (12 << 20) // len(b))
            for lo in range(0, len(a), many):
                own = a[lo : lo + many]
                q, v = range_search(wide[own], wide[b], first, nb, entries, threshold - 1e-4, beam)
                found.append(np.unique(np.minimum(own[q], b[v]) * n + np.maximum(own[q], b[v])))
        return np.unique(np.concatenate(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 3):
            region, lo, hi = (int(g.column(i)[0].as_py()) for i in range(3))
            tile, node, weight = g.column("tile").to_numpy(), g.column("node").to_numpy(), g.column("weight").to_numpy()
            x = unit(_matrix(g.column("vec").combine_chunks()))
            regions = g.column("regions").combine_chunks()
            size = pc.list_value_length(regions).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = regions.flatten().to_numpy(zero_copy_only=False)
            home = flat[np.cumsum(size) - size]
            neighbours = g.column("nb").combine_chunks()
            left, right = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
            codes = [np.zeros(0, np.int64)]
            for a, b in ((left, right),) if lo == hi else ((left, right), (right, left)):
                a = a[home[a] == region]  # a vector is searched for at home
                if len(a) and len(b):
                    codes.append(links(x, node, neighbours, a, b))
            code = np.unique(np.concatenate(codes))
            i, j = code // len(node), code % len(node)
            ok = (i != j) & (np.einsum("ij,ij->i", x[i], x[j]) >= threshold)  # the verification, in double precision
            i, j = i[ok], j[ok]
            # a pair of different homes is found in both where each home has the other one too; the lesser home counts it
            member = np.unique(np.repeat(np.arange(len(node)), size) * (MOST_CENTROIDS + 1) + flat)
            away = np.where(home[i] == region, home[j], home[i])
            other = np.where(home[i] == region, i, j)
            both = np.isin(other * (MOST_CENTROIDS + 1) + away, member)
            mine = ((home[i] == region) & (home[j] == region)) | ~both | (region < away)
            count = np.zeros(len(node), np.int64)
            np.add.at(count, i[mine], weight[j[mine]])
            np.add.at(count, j[mine], weight[i[mine]])
            a, b = forest(node[i], node[j]) if len(i) else (node[:0], node[:0])
            some = np.flatnonzero(count)
            yield pa.record_batch(
                [pa.array(np.concatenate((node[some], a))), pa.array(np.concatenate((np.full(len(some), -1), b)), pa.int64(), mask=np.arange(len(some) + len(a)) < len(some)), pa.array(np.concatenate((count[some], np.zeros(len(a), np.int64))))],
                names=["a", "b", "n"],
            )

    dealt = pairs.select("region", "lo", "hi", "tile", "node", "weight", "vec", "regions", "nb").repartition(shuffle_width(pairs.sparkSession), "region", "lo", "hi").sortWithinPartitions("region", "lo", "hi", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint, n bigint")


def audit(kinds: DataFrame, found: DataFrame, threshold: float, n: int) -> float:
    """The recall of AUDITED distinct vectors' links, by brute force over all: the lesser of that of all links and the vectors' mean."""
    rows = kinds.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(max(1, n // AUDITED))) == 0).select("node", "vec").orderBy(F.xxhash64("node", F.lit(5))).limit(AUDITED).collect()
    if not rows:
        return 1.0
    names = np.array([r["node"] for r in rows])
    queries = unit(np.stack([np.frombuffer(r["vec"], "<f8") for r in rows]))
    held = kinds.sparkSession.sparkContext.broadcast((names, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = held.value
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column(2)))
            node, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            near = (queries @ x.T >= threshold) & (names[:, None] != node[None, :])
            total += near @ weight
        yield pa.record_batch([pa.array(names), pa.array(total)], names=["node", "n"])

    truth = kinds.select("node", "weight", "vec").mapInArrow(run, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("truth"))
    counted = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    got = F.least(F.coalesce("n", F.lit(0)), "truth")
    row = truth.where("truth > 0").join(counted, "node", "left").agg(F.sum("truth").alias("t"), F.sum(got).alias("g"), F.avg(got / F.col("truth")).alias("m")).head()
    return min(row["g"] / row["t"], row["m"]) if row["t"] else 1.0


def linked(vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, beam: int = BEAM) -> DataFrame:
    """vec_id, n_links, component_id, kept, and audited_recall of every row."""
    rows, _ = usable_vectors(vectors)
    parts = []
    for (size,) in sorted(rows.where("vec is not null").select(F.octet_length("vec")).distinct().collect()):  # lengths of vectors: one, but for odd data
        own = rows.where(F.octet_length("vec") == size)
        kinds = own.groupBy("one", "two").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.min("vec").alias("vec")).where("node is not null")
        kinds, _ = written(kinds.select("node", "weight", "vec", "one", "two"), "vector-kinds", narrow=True)
        n = kinds.count()
        if not n:
            continue
        rate = min(1.0, SAMPLE / n)
        sample = kinds.where(F.pmod(F.xxhash64("node"), F.lit(1_000_003)) < F.lit(int(rate * 1_000_003) + 1)).select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE).collect()
        c = clustered(unit(np.stack([np.frombuffer(r["vec"], "<f8") for r in sample])), int(min(MOST_CENTROIDS, max(1, n // PER_REGION)))) if sample else unit(np.ones((1, size // 8)))
        for attempt in range(3):
            exact = attempt == 2
            found, path = _links(kinds, c, size, threshold, overlap << attempt, beam << attempt, exact)
            recall = 1.0 if exact else audit(kinds, found, threshold, n)
            if recall >= TARGET:
                break
            discard(vectors.sparkSession, path)
        parts.append((own, kinds, found, recall, n))
    bare = [F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(1.0).alias("audited_recall")]
    out = rows.where("vec is null or vec_id is null").select("vec_id", *bare)
    for own, kinds, found, recall, n in parts:
        stars, _ = components(found.where("b is not null").select("a", "b"))
        counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        classes = kinds.drop("vec").join(counts, "node", "left").join(stars, "node", "left")
        classes, _ = written(classes.select("one", "two", "weight", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "vector-classes", narrow=True)
        some = looked_up(own.where("vec_id is not null").select("vec_id", "one", "two"), classes, ["one", "two"], "weight", n)
        out = out.unionByName(some.select("vec_id", "n_links", "component_id", F.lit(recall).alias("audited_recall")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), "audited_recall")


def _links(kinds: DataFrame, c: np.ndarray, size: int, threshold: float, overlap: int, beam: int, exact: bool = False) -> tuple[DataFrame, str]:
    """The written table of counts (a, null, n) and spanning links (a, b, 0)."""
    spark = kinds.sparkSession
    most = max(256, min(MOST_MEMBERS, MOST_BYTES // size))
    assigned, assigned_path = written(_assigned(kinds, c, overlap, 2 * float(np.arccos(threshold)) if exact else None), "vector-regions")
    sizes = assigned.groupBy("region").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("tiles"))  # at most MOST_CENTROIDS rows
    tiled = assigned.join(F.broadcast(sizes), "region").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(11)), F.col("tiles")).cast("int"))
    graph_path = None
    if exact:
        rows = tiled.withColumn("nb", F.array().cast("array<bigint>"))
    else:
        graph, graph_path = written(_graphs(tiled), "vector-graph")
        rows = tiled.join(graph, "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    found = written(_searched(rows.withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other")), threshold, beam, exact), "vector-links")
    discard(spark, assigned_path, *([graph_path] if graph_path else []))
    return found
