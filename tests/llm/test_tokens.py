"""Encoders against the library, Re-Pair's round trip, and packing."""

import hashlib
import time
import zlib

import numpy as np
import pytest
from helpers import documents, odd_texts, rng, text
from tokenizers import Tokenizer

from tideline.llm import bpe, packing, repair, tokens
from tideline.llm.common import tokenizer_path
from tideline.llm.tokens import WordIds

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "a", "The", "ing", "é", "ß", "İ", "Σ", "1", "23", ",", ".", "!!", "'s", "'ll", "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "中", "😀", "́", "\x1c", "\x01", "　", "J̌", "≠", "ǅ"]


@pytest.fixture(scope="module")
def word():
    return WordIds(WORD), Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return bpe.ByteBpe(BYTE), Tokenizer.from_file(BYTE)


def test_encoders_equal_the_library(word, byte):
    r = rng(3)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(0, 30))) for _ in range(1500)] + [t for t in odd_texts() if t]
    own, lib = word
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, own.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    own, lib = byte
    for t, parts in zip(texts, own.entries(texts), strict=True):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert [int(i) for p in parts for i in p[1].split(",")] == ids, repr(t)
        assert "".join(p[2] for p in parts) == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("alphabet", ["abcdethein", "!?.,-*", "0123456789", " \n\t", "éñßü中文", ["the", "ing", "er", "tion"]])
def test_tree_concatenation_equals_one_pass(byte, alphabet):
    own, lib = byte
    r = rng(5)
    for n in (1025, 2048, 7000):
        t = "".join(r.choice(alphabet) for _ in range(n))
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids


def test_bpe_operator(spark):
    lib = Tokenizer.from_file(BYTE)
    docs = documents(spark, odd_texts(), extra="yes")
    for r in bpe.encoded(docs, BYTE).collect():
        t = odd_texts()[r["doc_id"]] or ""
        ids = lib.encode(t, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert r["decoded_same"]
    assert bpe.encoded(docs.where("false"), BYTE).count() == 0


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_repair_round_trip():
    r = np.random.default_rng(0)
    cases = [[], [2], [5] * 101 + [2], [2, 2, 7, 2], [1, 2, 1, 2, 1, 2] * 50, r.integers(0, 20, 5000).tolist(), ([3, 4, 5, 6, 7] * 40 + [2]) * 30]
    for seq in cases:
        seq = np.array(seq, np.uint32)
        symbols, left, right = repair.compress(seq, 100, 2)
        length = repair.rule_lengths(left, right, 100)
        flat, start = repair.expansions(left, right, length, 100)
        assert np.array_equal(repair.expand(symbols, flat, start, 100), seq)
        assert len(symbols) <= len(seq) and not np.isin([left, right], [2]).any()
    assert len(symbols) < len(seq) / 4


def test_repair_operator(spark):
    lib = Tokenizer.from_file(WORD)
    texts = odd_texts() + [text(rng(i), 60) for i in range(30)] + [text(rng(1), 60)] * 5
    docs = documents(spark, texts, extra="yes")
    docs = docs.unionByName(docs.where("doc_id = 9"))
    shards, _ = repair.write_shards(docs, WORD)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in repair.read_documents(shards).collect())
    start, expected = 0, []
    for i in sorted([*range(len(texts)), 9]):
        ids = [*lib.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == expected
    for row in shards.collect():
        row = row.asDict()
        names = np.frombuffer(row["doc_ids"], "<i8")
        for k in (0, len(names) - 1):
            ids = [*lib.encode(texts[names[k]] or "", add_special_tokens=False).ids, 2]
            assert repair.decode_document(row, k).tolist() == ids
            for a, b in ((0, 1), (len(ids) // 3, len(ids) // 2), (len(ids) - 1, len(ids) + 5), (len(ids), None)):
                assert repair.decode_document(row, k, a, b).tolist() == ids[a:b]
    empty, _ = repair.write_shards(docs.where("false"), WORD)
    assert repair.read_documents(empty).count() == 0


def test_nnls():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    assert packing.nnls(a, np.array([4.0, 2.0])) @ np.ones(3) == pytest.approx(2)
    assert np.allclose(packing.nnls(np.eye(2), np.array([3.0, -1.0])), [3, 0])
    r = np.random.default_rng(1)
    for _ in range(20):
        a, b = r.random((6, 9)), r.random(6)
        x = packing.nnls(a, b)
        w = a.T @ (b - a @ x)
        assert (x >= 0).all() and (w <= 1e-6).all() and np.abs(w[x > 1e-9]).max(initial=0) < 1e-6


@pytest.mark.parametrize("lengths", [[], [1], [2047], [2048], [5000, 1, 1], [1025] * 77, [1] * 1000, "short", "long"])
def test_packing(lengths):
    r = np.random.default_rng(2)
    lengths = np.array({"short": r.integers(1, 300, 3000), "long": r.integers(1, 9000, 800)}.get(lengths, lengths) if isinstance(lengths, str) else lengths, np.int64)
    doc, start, length, seq, offset, n = packing.pack(lengths)
    assert (np.bincount(doc, weights=length, minlength=len(lengths)) == lengths).all() and (length > 0).all()
    fill = np.bincount(seq, weights=length, minlength=n).astype(int)
    assert len(fill) == n and all(f == 2048 or f & (f - 1) == 0 for f in fill)
    assert (fill != 2048).sum() <= 11
    for key, at in ((doc, start), (seq, offset)):
        order = np.lexsort((at, key))
        ends = dict.fromkeys(range(max(len(lengths), n)), 0)
        for k, a, size in zip(key[order].tolist(), at[order].tolist(), length[order].tolist(), strict=True):
            assert a == ends[k]
            ends[k] += size


def test_packing_keeps_most_documents_whole():
    lengths = np.random.default_rng(3).integers(50, 1500, 5000)
    doc = packing.pack(lengths)[0]
    assert (np.bincount(doc) > 1).mean() < 0.1


def test_packing_operator(spark):
    lib = Tokenizer.from_file(WORD)
    texts = odd_texts() + [text(rng(i), 400) for i in range(20)]
    rows = packing.packed(documents(spark, texts, extra="yes"), WORD).collect()
    for r in rows:
        ids = [*lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
    assert {r["doc_id"] for r in rows} == set(range(len(texts)))
    assert packing.packed(documents(spark, []), WORD).count() == 0


def test_idle_workers_drop_their_caches(spark):
    def held(batches):
        for _ in batches:
            pass
        time.sleep(0.2)
        yield tokens.pa.record_batch([tokens.pa.array([len(tokens._ENCODERS)])], names=["n"])

    def clear(batches):
        for _ in batches:
            pass
        tokens.release()  # what other tests' tasks left
        time.sleep(0.2)
        yield from ()

    spark.range(0, 24, 1, 24).mapInArrow(clear, "n bigint").count()
    packed = packing.packed(documents(spark, [text(rng(k), 50) for k in range(40)]), WORD)
    assert packed.count() >= 40
    time.sleep(tokens.REST_S + 2)
    assert max(r["n"] for r in spark.range(0, 24, 1, 24).mapInArrow(held, "n bigint").collect()) == 0


def test_an_encoder_that_is_asked_for_again_stays(monkeypatch):
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    monkeypatch.setattr(tokens, "REST_S", 0.3)
    first = tokens.encoder(WordIds, WORD)
    tokens.rest()
    assert tokens.encoder(WordIds, WORD) is first
    time.sleep(0.8)
    assert tokens._ENCODERS
    tokens.rest()
    time.sleep(0.8)
    assert not tokens._ENCODERS


def test_no_frequent_pair_is_left():
    r = np.random.default_rng(2)
    seq = np.concatenate([np.append(r.choice(60, 40, p=np.arange(60) / 1770), 2) for _ in range(300)])
    seq = np.concatenate((seq, np.tile(seq[:300], 30)))
    symbols, left, right = repair.compress(seq, 100, 2, gain=0.0)
    lengths = repair.rule_lengths(left, right, 100)
    assert lengths.max() > 32  # rules go deeper than a few rounds
    flat, start = repair.expansions(left, right, lengths, 100)
    assert (repair.expand(symbols, flat, start, 100) == seq).all() and (repair.expanded(symbols, left, right, 100) == seq).all()
    count, at = {}, 0
    while at + 1 < len(symbols):  # occurrences that don't overlap
        a, b = int(symbols[at]), int(symbols[at + 1])
        if 2 not in (a, b):
            count[a, b] = count.get((a, b), 0) + 1
            if a == b and at + 2 < len(symbols) and symbols[at + 2] == b:
                at += 1
        at += 1
    assert max(count.values()) < 2 * repair.LEAST
