"""Classifiers on held-out rows, and what they make of odd ones."""

import os

import numpy as np
import pytest
from helpers import documents, odd_texts, rng, words
from pyspark.sql import functions as F

from tideline.llm import langid, quality, toxicity
from tideline.llm.common import fold, learning_texts

LETTERS = {"aa": "abcdefgh ", "bb": "mnopqrst ", "cc": "uvwxyzéà "}
BAD = ("vileness", "slurword", "hatefulo")


def corpus(spark):
    rows, labels = [], []
    for i in range(900):
        r = rng(i)
        lang = r.choice(list(LETTERS))
        w = words(r, 60, LETTERS[lang].strip())
        toxic, good = int(r.random() < 0.3), int(r.random() < 0.7)
        if toxic:
            for _ in range(6):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        if not good:
            w = [x + "&&&" for x in w]
        rows.append((i, " ".join(w), lang, "s", 0))
        labels.append((i, good, toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def data(spark):
    return corpus(spark)


def test_languages(spark, data):
    docs, _ = data
    model = langid.learn(docs)
    held = langid.predicted(docs, model).where("held_out").join(docs, "doc_id").collect()
    assert len(held) > 100 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    odd = {r["doc_id"]: r for r in langid.predicted(documents(spark, [*odd_texts(), "123 456 !"], extra="yes"), model).collect()}
    assert [odd[i]["lang_pred"] for i in (0, 1, 2, 9)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in odd.values()) and odd[4]["lang_pred"] in LETTERS
    assert langid.predicted(docs.where("false"), model).count() == 0
    none = langid.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predicted(docs.limit(5), none).collect()} == {"und"}
    one = langid.learn(docs.withColumn("lang", F.lit("xx")))
    assert {r["lang_pred"] for r in langid.predicted(docs.limit(5), one).collect()} == {"xx"}


def test_labels_of_the_held_out_fold_are_not_seen(data):
    docs, labels = data
    flipped = labels.withColumn("toxic", F.when(fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs, flipped)
    assert (a["weights"] == b["weights"]).all() and a["pair"] == b["pair"]
    flipped = labels.withColumn("quality", F.when(fold(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.learn(docs, labels)["weights"] == quality.learn(docs, flipped)["weights"]).all()


def test_toxicity(spark, data):
    docs, labels = data
    model = toxicity.learn(docs, labels)
    held = toxicity.scored(docs, model).where("held_out").join(labels, "doc_id").collect()
    assert len(held) > 80
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.93
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in toxicity.scored(docs, model).where("predicted = 0").collect()}
    odd = toxicity.scored(documents(spark, odd_texts(), extra="yes"), model).collect()
    assert len(odd) == len(odd_texts()) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.scored(docs.where("false"), model).count() == 0
    for labels_ in (labels.where("false"), labels.where("toxic = 1")):
        assert {r["score"] for r in toxicity.scored(docs.limit(3), toxicity.learn(docs, labels_)).collect()} <= {0.0, 1.0}


def test_long_toxic_text_is_read_to_its_end(spark, data):
    docs, labels = data
    model = toxicity.learn(docs, labels)
    clean = " ".join(words(rng(1), 4000, LETTERS["aa"].strip()))
    late = clean + " " + " ".join(BAD * 40)
    a, b = (r["score"] for r in toxicity.scored(documents(spark, [clean, late]), model).orderBy("doc_id").collect())
    assert b > a


def test_quality(spark, data):
    docs, labels = data
    model = quality.learn(docs, labels)
    held = quality.scored(docs, model).where("held_out").join(labels, "doc_id").collect()
    assert len(held) > 100 and sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.97
    odd = quality.scored(documents(spark, odd_texts(), extra="yes"), model).collect()
    assert len(odd) == len(odd_texts()) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.scored(docs.where("false"), model).count() == 0
    assert {r["score"] for r in quality.scored(docs.limit(3), quality.learn(docs, labels.where("false"))).collect()} == {0.0}


def test_sample_is_bounded_and_without_copies(data):
    docs, labels = data
    some = docs.withColumn("text", F.when(F.col("doc_id") < 300, F.lit("the same words stand in all of these")).otherwise(F.col("text")))
    rows, counts = learning_texts(some.unionByName(some), labels.unionByName(labels), "toxic", 100, 400)
    whole = {r["doc_id"]: r["text"] for r in some.collect()}
    assert sum(counts.values()) == 1800 and 20 < len(rows) <= 300 and len({r[0] for r in rows}) == len(rows)
    assert all(r[2] == whole[r[0]] and len(r[2]) <= 400 for r in rows)
    assert sum(r[2].startswith("the same") for r in rows) <= 1


def test_presence_kernel_against_sets():
    r = rng(4)
    texts = [langid.folded(" ".join(words(r, n, "abcdeé"))).ljust(1, b" ") for n in (1, 3, 40, 400, 900)] + [b"x"]

    def grams(t, lo, hi):
        out = set()
        for i in range(lo, min(hi, len(t))):
            for n in langid.LENGTHS:
                if i + n <= len(t):
                    code = 0
                    for k in range(n):
                        code = (code * 0x01000193 + t[i + k] + k + 1) & 0xFFFFFFFF
                    out.add(((code * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - langid.BITS))
        return out

    want = [(i, grams(t, lo, lo + langid.WINDOW)) for i, t in enumerate(texts) for lo in range(0, len(t), langid.WINDOW)]
    assert len(want) > len(texts)
    for most in (1, 2, 512):
        rows = [(int(o), x[k]) for x, owner in langid.blocks(texts, most) for k, o in enumerate(owner)]
        assert len(rows) == len(want)
        for (i, g), (j, x) in zip(want, rows, strict=True):
            assert i == j and set(np.flatnonzero(x).tolist()) == g and abs(float(x @ x) - 1) < 1e-5
        kernel = float(rows[0][1] @ rows[2][1])
        assert abs(kernel - len(want[0][1] & want[2][1]) / np.sqrt(len(want[0][1]) * len(want[2][1]))) < 1e-5


def test_a_long_text_takes_little_memory(spark, data):
    docs, _ = data
    model = langid.learn(docs)
    t = langid.folded(" ".join(words(rng(2), 30, "abcdefgh")) * 20_000)
    assert len(t) > 2_000_000 and max(len(x) for x, _ in langid.blocks([t])) <= langid.BLOCK
    assert model["langs"][int(langid.scores(model, [t]).argmax())] == "aa"


def test_ftrl_against_a_scalar_loop():
    r = np.random.default_rng(5)
    model, z, n = quality.Ftrl(), {}, {}
    bias = 1 << quality.BITS

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        sign = 1.0 if z[i] > 0 else -1.0
        return -(z[i] - sign * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(200):
        index = np.unique(r.integers(0, 50, 8))
        value, y, w = r.random(len(index)) * 3, float(r.integers(0, 2)), float(r.random() + 0.5)
        model.update(index, value, y, w)
        x = [*zip(index.tolist(), value.tolist(), strict=True), (bias, 1.0)]
        own = {i: weight(i) for i, _ in x}
        p = 1 / (1 + np.exp(-sum(own[i] * v for i, v in x)))
        for i, v in x:
            g = w * (p - y) * v
            before = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / quality.ALPHA * own[i]
            n[i] = before + g * g
    at = np.array([*range(50), bias])
    assert np.allclose(model.weights(at), [weight(i) if i in z else 0.0 for i in at.tolist()])


def test_sparse_dot_product_of_whole_texts():
    import pyarrow as pa

    make = quality.Features()
    texts = ["", "One two two. THREE!", "a b c d " * 500, None]
    w = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    model = {"weights": w, "a": 0.7, "b": 0.1}
    got = quality.scores(model, make, pa.array(texts, pa.string()))
    for t, s in zip(texts, got, strict=True):
        f, _ = make.of(pa.array([t], pa.string()))
        index, value = quality._document(f)
        assert abs(s - 1 / (1 + np.exp(-(0.7 * (float(value @ w[index]) + float(w[-1])) + 0.1)))) < 1e-4


def test_compression_differences_against_single_calls():
    import zstandard as z

    r = rng(8)
    plain = [w for _ in range(60) for w in toxicity.windows(" ".join(words(r, 40)))]
    shared = toxicity.trained(2048, plain, 32)
    pair = (shared + toxicity.trained(512, plain[::2], 32), shared + toxicity.trained(512, toxicity.windows(" ".join(BAD * 30), 2), 32))
    text = " ".join(words(r, 30)) + " " + " ".join(BAD) + " " + "y" * 900

    def size(window, content):
        p = z.ZstdCompressionParameters.from_level(toxicity.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
        return len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=p).compress(window))

    want = [size(w, pair[0]) - size(w, pair[1]) for w in toxicity.windows(text)]
    assert toxicity.Differences(pair).of(text).tolist() == want and max(want) > 5
    assert toxicity._lengths(toxicity.compressor(pair[0]), plain[:50] * 2).tolist() == [size(w, pair[0]) for w in plain[:50]] * 2
    coded = b"".join(w[1::2][1:] for w in toxicity.windows(text))
    assert coded.split() == text.encode().split() or b"".join(coded.split()) == b"".join(text.encode().split())  # windows leave nothing out


def test_toxic_dictionary_holds_what_marks_toxic_texts():
    r = rng(9)
    plain = [" ".join(words(r, 60)) for _ in range(120)]
    toxic = [" ".join(x for w in words(r, 60) for x in ([w, r.choice(BAD)] if r.random() < 0.08 else [w])) for _ in range(120)]
    common, full, halves = toxicity.dictionaries(toxic, plain)
    for bad in BAD:
        coded = toxicity.windows(bad, 1)[0][6:14]
        assert all(coded in x for x in (full, *halves)) and coded not in common


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_on_the_small_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    lang = langid.predicted(docs, langid.learn(docs)).where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in lang) / len(lang) > 0.97
    held = quality.scored(docs, quality.learn(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
