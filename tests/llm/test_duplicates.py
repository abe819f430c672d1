"""Exact copies, near copies, repeated passages and near vectors against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from helpers import PLANTED, components, documents, odd_texts, rng, text
from pyspark.sql import functions as F

from tideline.llm import exact, simhash, substring, vecgraph
from tideline.llm.components import components as spark_components
from tideline.llm.components import forest


def exact_brute(texts):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    groups = {}
    for i, n in enumerate(norm):
        groups.setdefault(n, []).append(i)
    out = {}
    for n, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            out[i] = (keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest())
    return out


def test_exact(spark):
    base = [text(rng(i), 30) for i in range(20)]
    texts = odd_texts() + base + base[:5] + [t.replace(" ", "  ") for t in base[3:8]] + ["a b", "ab ", "a\tb"] + [base[0]] * 40
    docs = documents(spark, texts, extra="yes")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact.exact_groups(docs, capacity=4).collect()}
    assert got == exact_brute(texts)
    kept = exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, v in got.items() if v[2])
    assert exact.exact_groups(documents(spark, [])).count() == 0


def test_exact_repeated_rows_and_null_ids(spark):
    docs = documents(spark, ["same", "same", "other"])
    docs = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("bigint")))
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact.exact_groups(docs).collect()} == {(0, 0, 3), (1, 0, 3), (2, 2, 2), (None, 2, 2)}
    assert sorted(r["doc_id"] for r in exact.drop_exact_copies(docs).collect()) == [0, 2]


def test_directory_doubles(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("_key"))
    slots, depth = exact.directory(keys, capacity=100)
    rows = slots.collect()
    assert depth >= 5 and len({r["_slot"] for r in rows}) == len(rows) <= 1 << depth
    placed = keys.withColumn("_slot", exact.slot(F.col("_key"), depth)).join(slots, "_slot").groupBy("_bucket", "_local_depth").count().collect()
    assert sum(r["count"] for r in placed) == 2000
    assert all(r["count"] <= 100 or r["_local_depth"] == depth for r in placed)


def test_collision_of_hashes_is_seen(spark, monkeypatch):
    def weak(docs):
        rows = docs.select(F.col("doc_id").alias("_id"), F.col("doc_id").alias("_row"), F.length("text").alias("_len"), F.col("text").alias("_norm"))
        return rows.select("_id", "_row", "_len", "_norm", F.lit(7).cast("bigint").alias("_key"), F.lit("same").alias("_sha"))

    monkeypatch.setattr(exact, "keyed", weak)
    rows = exact.exact_groups(documents(spark, ["one", "two", "one", "four"])).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows} == {(0, 0, 2, True), (2, 0, 2, False), (1, 1, 1, True), (3, 3, 1, True)}


def simhash_brute(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def test_simhash(spark):
    base = [text(rng(i), 200) for i in range(25)]
    near = [b.replace(b.split()[50], "changed", 1) for b in base[:10]]
    texts = odd_texts() + base + near + base[:3] * 4
    fps = simhash_brute(texts)
    comp = components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(documents(spark, texts, extra="yes")).collect()}
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in range(len(texts))}
    assert simhash.simhash_components(documents(spark, [])).count() == 0


def test_bit_slices():
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = base ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64))
    fp = np.concatenate((base, near, near ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64))))[:, None]
    d = np.bitwise_count(fp[:, 0][:, None] ^ fp[:, 0][None])
    for radius in (0, 1, 2, 3, 7, 30):
        q, m = simhash.within(fp, fp, radius)
        assert set(zip(q.tolist(), m.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(d <= radius)), strict=True))
        i, j = r.integers(0, len(fp), 500), r.integers(0, len(fp), 500)
        assert (simhash.side_by_side(fp[i], fp[j], radius) == (d[i, j] <= radius)).all()


@pytest.mark.parametrize("tiled", [False, True])
def test_large_blocks_lose_no_component(tiled):
    r = np.random.default_rng(4)
    start = int(r.integers(0, 1 << 62))
    fp = np.array([start ^ sum(1 << int(b) for b in r.integers(0, 63, r.integers(0, 6))) for _ in range(400)] + r.integers(0, 1 << 62, 50).tolist(), np.uint64)[:, None]
    side = np.arange(450) % 2 if tiled else np.full(450, 2)
    near = np.bitwise_count(fp[:, 0][:, None] ^ fp[:, 0][None]) <= 3
    wanted = near & (side[:, None] != side[None]) if tiled else near
    a, b = simhash.block_links(np.zeros(450, int), side, np.arange(450), fp, 3)
    mine, all_ = components(450, zip(a.tolist(), b.tolist(), strict=True)), components(450, zip(*(x.tolist() for x in np.nonzero(wanted)), strict=True))
    assert all(mine[i] == mine[j] for i, j in zip(*np.nonzero(wanted), strict=True)) and len(set(mine)) <= len(set(all_))


def test_tables_meet_every_near_pair():
    tables = simhash.exact_tables(64, 3)
    r = rng(9)
    for _ in range(500):
        differ = set(r.sample(range(64), 3))
        assert any(not differ & set(t) for t in tables)


def test_tiles_and_equal_results(spark):
    r = np.random.default_rng(6)
    start = int(r.integers(0, 1 << 62))
    fps = list({start ^ sum(1 << int(b) for b in r.integers(0, 20, 3)) for _ in range(300)})
    prints = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in enumerate(fps)], "node bigint, fp binary")
    links = simhash.near_links(prints, 3, simhash.exact_tables(64, 3), block=40).collect()
    mine = components(len(fps), [(x["a"], x["b"]) for x in links])
    brute = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert mine == brute


def test_components(spark):
    r = rng(11)
    for n, m in ((400, 250), (300, 500)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(50)] + [(0, n - 1)]
        df = spark.createDataFrame(links, "a bigint, b bigint")
        got = {x["node"]: x["component"] for x in spark_components(df)[0].collect()}
        assert [got.get(i, i) for i in range(n)] == components(n, links)
    a, b = forest(np.array([5, 3, 9, 7]), np.array([3, 1, 7, 9]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {3: 1, 5: 1, 9: 7}
    assert spark_components(df.where("false"))[0].count() == 0


def test_similar_documents(spark):
    base = [text(rng(100 + i), 300) for i in range(30)]

    def edited(t, n, r):
        w = t.split()
        for i in r.sample(range(len(w)), n):
            w[i] = "edited"
        return " ".join(w)

    near = [edited(t, 3, rng(i)) for i, t in enumerate(base[:20])]
    far = [edited(t, 90, rng(i)) for i, t in enumerate(base[20:])]
    docs = documents(spark, base + near + far + [None, "", "  "], extra="yes")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(30)) | set(range(50, 63))


def shingle_sets(texts):
    out = []
    for t in texts:
        w = t.lower().split()
        out.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return out


def test_similar_documents_against_brute_force(spark):
    texts = []
    for i in range(60):  # an edit of single words apart from each other changes five shingles
        w = text(rng(500 + i), 40 + 7 * i).split()
        texts.append(" ".join(w))
        r = rng(i)
        for share in (0.09, 0.1, 0.11, 0.12, 0.14):
            v = list(w)
            for k in range(max(1, round(share * len(w) / 5))):
                v[min(len(w) - 1, k * 5 + r.randrange(5) + 5)] = f"edit{i}x{share}"
            texts.append(" ".join(v))
    line = "This one line stands at the end of every text and is no reason to link them"
    texts = [f"{t}\n{line}" for t in texts] + [texts[0] + f" tail{k}" for k in range(50)]
    texts += [" ".join(f"w{k}" for k in range(22)), " ".join(f"w{k}" for k in range(20)) + " x y"]  # 16 of 20 shingles
    sets = shingle_sets(texts)
    similar = [(i, j, len(a & sets[j]) / len(a | sets[j])) for i, a in enumerate(sets) for j in range(i)]
    assert sum(0.8 <= s < 0.85 for *_, s in similar) > 20 and sum(0.75 <= s < 0.8 for *_, s in similar) > 20
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == components(len(texts), [(i, j) for i, j, s in similar if s >= 0.8])


def test_substring(spark):
    own = [text(rng(200 + i), 60) for i in range(6)]
    w = own[1].split()
    inside = " ".join(w[:20]) + " lower words here " + PLANTED + " " + " ".join(w[20:])
    texts = [own[0] + "\n" + PLANTED, inside, own[2] + "\n" + PLANTED + "\n" + own[3], own[4], None, "", own[5] + "\n" + own[5], "A shared line of five words\n" + own[4][:40]]
    docs = documents(spark, texts + ["A shared line of five words\nrest"], extra="yes")
    got = {r["doc_id"]: r for r in substring.deduplicated(docs, removed="gone").collect()}
    new = {i: r["text"] for i, r in got.items()}
    assert new[0] == texts[0] and new[3] == own[4] and new[4] is None and new[5] == ""
    assert PLANTED not in new[1] and "It has whole sentences" not in new[1] and " ".join(w[:20]) in new[1] and " ".join(w[20:]) in new[1]
    assert new[2] == own[2] + "\n" + own[3]
    assert new[6] == own[5]
    assert new[8] == "rest"
    for i, r in got.items():
        for s in r["gone"]:
            assert 0 <= s["start"] < s["end"] <= len(texts[i] if i < len(texts) else "A shared line of five words\nrest")
    assert substring.deduplicated(documents(spark, [])).count() == 0


def test_substring_of_short_units(spark):
    own = [text(rng(700 + i), 60) for i in range(12)]
    lines = "\n".join(f"row {k}" for k in range(30))
    sentences = " ".join(f"It was day {k}." for k in range(15))
    names = "gestern sah Anna Berta Carl im Haus am Markt und dann Doris Emil auf dem Weg nach Hause bei Frau Gerda Huber"
    chinese = "这是一段在多个文件中重复出现的中文文字。它没有空格，但是读者会认出它来。"
    texts = []
    for k, passage in enumerate((lines, sentences, names, chinese)):
        texts += [own[3 * k] + "\n" + passage, own[3 * k + 1] + "\n" + passage + "\n" + own[3 * k + 2]]
    texts += ["Yes.\n" + text(rng(800), 30), "Yes.\n" + text(rng(801), 30), "这里的开头与众不同各有各的样子。" + chinese, "\n".join(["ha"] * 16)]
    new = {r["doc_id"]: r["text"] for r in substring.deduplicated(documents(spark, texts)).collect()}
    for k in range(4):
        assert new[2 * k] == texts[2 * k]
        assert new[2 * k + 1] == own[3 * k + 1] + "\n" + own[3 * k + 2]
    assert new[8] == texts[8] and new[9] == texts[9]  # one short line among others stays
    assert new[10] == "这里的开头与众不同各有各的样子。"
    assert new[11] == "\n".join(["ha"] * 8)  # the first run of eight words stays whole


@pytest.mark.parametrize("some,chunk", [(16, 512), (2, 4)])
def test_large_groups_of_similar_documents_against_brute_force(spark, monkeypatch, some, chunk):
    monkeypatch.setattr(simhash, "SOME", some)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "BLOCK", 30)
    texts = []
    for i in range(4):  # families with links between members but not to the first
        w = text(rng(40 + i), 90).split()
        for k in range(45):
            v = list(w)
            r = rng(1000 * i + k)
            for at in r.sample(range(len(w)), r.randrange(0, 5)):
                v[at] = f"edit{r.randrange(3)}"
            texts.append(" ".join(v))
    texts += [" ".join(f"w{k}" for k in range(n)) for n in (4, 5, 8, 9, 10)]
    sets = shingle_sets(texts)
    links = [(i, j) for i, a in enumerate(sets) for j in range(i) if len(a & sets[j]) >= 0.8 * len(a | sets[j])]
    want = components(len(texts), links)
    assert len(set(want)) > 12
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_unlike_pairs_of_a_large_group_are_not_verified(spark, monkeypatch):
    w = text(rng(77), 150).split()
    texts = []
    for k in range(240):  # most are similar to some others only
        r = rng(7000 + k)
        v = list(w)
        for at in r.sample(range(len(w)), r.randrange(0, 8)):
            v[at] = f"edit{k}x{at}"
        texts.append(" ".join(v))
    sets = shingle_sets(texts)
    found = [(i, j, len(a & sets[j]) / len(a | sets[j])) for i, a in enumerate(sets) for j in range(i)]
    want = components(len(texts), [(i, j) for i, j, s in found if s >= 0.8])
    assert len(set(want)) > 20
    made, own = [], simhash._apart
    monkeypatch.setattr(simhash, "_apart", lambda *args: made.append(own(*args)) or made[-1])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    rows = sum(df.count() for df in made)
    assert 0 < rows <= sum(0.75 <= s for *_, s in found) < 0.5 * len(found)


def test_similar_documents_are_told_by_row(spark):
    base, other = text(rng(61), 80), text(rng(62), 80)
    rows = [(5, base, "x"), (1, base + " more", "x"), (5, other, "x"), (5, other, "x"), (None, base + " end", "x"), (9, None, "x"), (9, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _gone string")
    kept = sorted(((r["doc_id"] or 0, r["text"] or "") for r in simhash.drop_near_duplicates(docs).collect()))
    assert kept == sorted([(1, base + " more"), (5, other), (5, other), (9, ""), (9, " ")])


def test_set_fingerprints_of_similar_sets():
    r = np.random.default_rng(3)
    for n in (32, 36, 60, 400):
        for _ in range(300):
            own = r.integers(0, 1 << 63, n, dtype=np.uint64)
            cut = n // 9  # of n, so many are exchanged: a similarity of 0.8 or a little more
            a, b = np.sort(own), np.sort(np.concatenate((own[cut:], r.integers(0, 1 << 63, cut, dtype=np.uint64))))
            one, two = (np.array([simhash.set_print(x)], np.int64).view(np.uint64) for x in (a, b))
            assert np.bitwise_count(one ^ two).sum() <= simhash.SET_RADIUS


def test_odd_sketches_of_similar_sets():
    r = np.random.default_rng(5)
    for n in (1, 4, 9, 10, 40, 300, 3000, 30_000):
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        many = 200 if n < 1000 else 20
        sets = [a]
        for _ in range(many):
            cut = int(r.integers(0, n // 9 + 1))  # exchanged, or left out: a similarity of 0.8 at least
            sets.append(np.concatenate((a[cut:], r.integers(0, 1 << 63, cut, dtype=np.uint64))))
            sets.append(a[: n - int(r.integers(0, n // 5 + 1))])
        unlike = [np.concatenate((a[n // 4 :], r.integers(0, 1 << 63, n // 4, dtype=np.uint64))) for _ in range(many)]  # 0.6
        sizes = np.array([len(x) for x in sets + unlike], np.int32)
        own = np.array([np.frombuffer(simhash.odd_sketch(x), np.uint64) for x in sets + unlike])
        near = simhash.sketches_near(sizes, own, np.zeros(len(own), np.int64), np.arange(len(own)), 0.8)
        assert near[: len(sets)].all()
        assert n < 40 or n > 3000 or not near[len(sets) :].any()


def test_pairs_that_met_at_a_lesser_key():
    firsts = np.full((4, simhash.FIRSTS), 9, np.int64)
    firsts[0, :3], firsts[1, :2], firsts[2, :1] = (-5, 2, 9), (2, 9), (-7,)
    key = np.array([9, 9, 9, 9])
    i, j = np.array([0, 0, 1, 0, 1]), np.array([1, 2, 2, 3, 3])
    assert simhash.met_before(key, firsts, i, j).tolist() == [True, False, False, False, False]
    assert not simhash.met_before(np.full(4, 2), firsts, i, j).any()


def test_a_sentence_that_occurs_once_stays(spark):
    one, two = "This first sentence stands in both of the two documents.", "That other sentence stands in both of the documents too."
    docs = documents(spark, [f"{one} Foo bar. {two}", f"Opening part here. {one} Never seen before. {two}"])
    new = {r["doc_id"]: r["text"] for r in substring.deduplicated(docs).collect()}
    assert new[0] == f"{one} Foo bar. {two}" and new[1] == "Opening part here. Never seen before. "


def units_brute(text):
    """Normalised text of each unit that may go, with its place, one text at a time."""
    break_ = re.compile(r"(?:(?<=[。！？])|(?<=[。！？][”’」』）]))(?=[^\s。！？”’」』）])|(?<=[.!?])([^\w\s.!?]{0,4})[ \t]+(?=\S)|(?<=[^\s.!?A-ZÀ-ÖØ-Þ])[ \t]+(?=[A-ZÀ-ÖØ-Þ][^\WA-ZÀ-ÖØ-Þ])")
    every, at = [], 0
    for line in text.split("\n"):
        cuts = [(m.start() + len(m[1] or ""), m.end()) for m in break_.finditer(line)]
        every.append((True, bool(cuts), at, at + len(line)))
        begin = 0
        for a, b in [*cuts, (len(line), len(line))] if cuts else []:
            every.append((False, False, at + begin, at + a))
            begin = b
        at += len(line) + 1
    rows = [(line, several, a, b, text[a:b].lower().split()) for line, several, a, b in every if text[a:b].split()]
    short = [len(w) < (4 if line else 8) or b - a < 3 for line, _, a, b, w in rows]
    out = {(a, b, " ".join(w)) for (*_, a, b, w), s in zip(rows, short, strict=True) if not s}
    fine = [(r, s) for r, s in zip(rows, short, strict=True) if not (r[0] and r[1])]
    for k, (_, s) in enumerate(fine):
        for i, j in [(k, j) for j in range(k + 1, len(fine))] + [(i, k) for i in range(k - 1, -1, -1)] if s else []:
            words = [w for r, _ in fine[i : j + 1] for w in r[4]]
            inner = words[len(fine[i][0][4]) :] if i < k else words[: len(words) - len(fine[j][0][4])]
            if len(words) >= 8 and len(inner) < 8:
                out.add((fine[i][0][2], fine[j][0][3], " ".join(words)))
    return out


def test_units_against_brute_force():
    r = rng(5)
    pieces = ["Word", "ein", "Haus.", "“Oh!”", "\n", "\n\n", "\t", " ", "  ", "x", "Ünd", "so?", "NASA", "Mc", "1.", "a.b", "(Foo)", "straße", "\r\n", "…", "-", "Zwei drei vier fünf sechs sieben acht neun zehn elf."]
    texts = [" ".join(r.choice(pieces) for _ in range(r.randrange(0, 60))) for _ in range(300)] + ["", "\n", "a" * 70_000]
    text, start, end, one, two = (x.tolist() for x in substring.long_units(texts))
    found = [set() for _ in texts]
    name = {}
    for t, a, b, *code in zip(text, start, end, one, two, strict=True):
        unit = " ".join(texts[t][a:b].lower().split())
        found[t].add((a, b, unit))
        assert name.setdefault(tuple(code), unit) == unit  # equal digests have equal text
    assert len(set(name.values())) == len(name)  # and equal texts equal digests
    assert found[:-1] == [units_brute(t) for t in texts[:-1]]


def substring_brute(texts):
    """Texts without the units that an earlier text or place has, by comparing all units as strings."""
    first = {}
    for i, t in enumerate(texts):
        for a, b, unit in sorted(units_brute(t or "")):
            first.setdefault(unit, (i, a, b))
    out = []
    for i, t in enumerate(texts):
        spans = [(a, b) for a, b, unit in units_brute(t or "") if first[unit] != (i, a, b) and not (first[unit][0] == i and a < first[unit][2])]
        out.append(substring.cut_out(t, substring.removed_spans(t, spans)) if spans else t)
    return out


def test_substring_against_brute_force(spark):
    r = rng(77)
    shared = [text(rng(900 + k), r.randrange(3, 30)) for k in range(25)]
    texts = ["\n".join(" ".join(r.choice(shared) if r.random() < 0.3 else text(r, r.randrange(2, 14)) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 6))) for _ in range(80)] + [None, "", shared[0]]
    got = [row["text"] for row in substring.deduplicated(documents(spark, texts, extra="yes")).orderBy("doc_id").collect()]
    assert got == substring_brute(texts) and sum(a != b for a, b in zip(got, texts, strict=True)) > 30


def vector_brute(vectors, ids):
    ok = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = {i: np.array(vectors[i], float) / np.linalg.norm(vectors[i]) for i in ok}
    links = [(i, j) for i in ok for j in ok if i != j and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.95]
    comp = components(len(vectors), links)
    return {ids[i]: (sum(a == i for a, _ in links), ids[comp[i]]) for i in range(len(vectors))}


def test_vectors(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(120, 16))
    rows = [*base.tolist(), *(base[:40] + 0.03 * r.normal(size=(40, 16))).tolist(), *[base[5].tolist()] * 30, None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], []]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>, node int, n string")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in vecgraph.linked(df).collect()}
    assert got == vector_brute(rows, list(range(len(rows))))
    assert vecgraph.linked(df.where("false")).count() == 0
    assert {(x["n_links"], x["kept"]) for x in vecgraph.linked(df.where("vec_id >= 190 and vec_id <= 193")).collect()} == {(0, True)}


def test_large_tight_group_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(vecgraph, "MOST_MEMBERS", 64)
    r = np.random.default_rng(9)
    center = r.normal(size=16)
    rows = [(center + 0.02 * r.normal(size=16)).tolist() for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>")
    got = vecgraph.linked(df).collect()
    brute = vector_brute(rows, list(range(600)))
    assert sum(x["n_links"] for x in got) >= 0.97 * sum(n for n, _ in brute.values())
    assert {x["component_id"] for x in got} == {0}


def many_vectors(seed, groups=60, members=12, d=24, spread=0.045):
    r = np.random.default_rng(seed)
    return np.concatenate([c + spread * np.linalg.norm(c) / np.sqrt(d) * 4 * r.normal(size=(members, d)) * r.random((members, 1)) for c in r.normal(size=(groups, d))])


def test_regions_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vecgraph, "PER_REGION", 60)
    monkeypatch.setattr(vecgraph, "PER_SHARD", 24)
    rows = many_vectors(12)
    brute = vector_brute(rows.tolist(), list(range(len(rows))))
    df = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id bigint, embedding array<double>")
    got = {x["vec_id"]: x["n_links"] for x in vecgraph.linked(df).collect()}
    total = sum(n for n, _ in brute.values())
    assert total > 1000 and all(n <= brute[i][0] for i, n in got.items()) and sum(got.values()) >= 0.97 * total


def test_below_the_target_all_is_compared(spark, monkeypatch):
    monkeypatch.setattr(vecgraph, "PER_REGION", 60)
    monkeypatch.setattr(vecgraph, "audit", lambda *_: 0.1)
    rows = many_vectors(13)
    df = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id bigint, embedding array<double>")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in vecgraph.linked(df, overlap=1, beam=1).collect()}
    assert got == vector_brute(rows.tolist(), list(range(len(rows))))


def flat(links, n):
    src, dst = links
    return np.concatenate(([0], np.cumsum(np.bincount(src, minlength=n)))), dst


def test_walks_cross_shards(monkeypatch):
    monkeypatch.setattr(vecgraph, "PER_SHARD", 40)
    x = vecgraph.unit(many_vectors(14, groups=50))
    monkeypatch.setattr(vecgraph.shards, "__defaults__", (40, 2))
    own, medoids = vecgraph.shards(x)
    assert len(own) > 5 and set(np.concatenate(own)) == set(range(len(x))) and len(medoids) > 5
    first, nb = flat(vecgraph.united(x), len(x))
    # from one medoid alone, so that nearly all finds lie in other shards
    q, v = vecgraph.range_search(x, x, first, nb, medoids[:1], 0.95)
    truth = int((x @ x.T >= 0.95).sum())
    assert len(set(zip(q.tolist(), v.tolist(), strict=True))) >= 0.9 * truth


def test_rows_without_ids_and_repeated_rows_of_vectors(spark):
    v, w = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [(None, v, 1), (3, v, 1), (3, v, 1), (4, [2.0, 0.0, 1.0], 1), (None, w, 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, vec int")
    got = sorted((x["vec_id"] or -1, x["n_links"], x["component_id"] or -1, x["kept"]) for x in vecgraph.linked(df).collect())
    assert got == [(-1, 0, -1, True)] * 3 + [(3, 3, 3, True)] * 2 + [(4, 3, 3, False)]
