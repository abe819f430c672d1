"""Rows and brute-force results for the corpus operators' tests."""

import glob
import os
import random
import re

from tideline import llm

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PLANTED = "Every passage of this kind stands in more than one document. It has whole sentences of some length, so that a reader would know it again. Nobody meant to repeat it here, but somebody did so anyway, and the corpus now has it twice."


def words(r, n, alphabet="abcdefghijklmnop"):
    return [" ".join("".join(r.choice(alphabet) for _ in range(r.randrange(2, 9))) for _ in range(1))[:9] for _ in range(n)]


def text(r, n):
    out = []
    while n > 0:
        k = min(n, r.randrange(5, 15))
        w = words(r, k)
        out.append(" ".join([w[0].capitalize(), *w[1:]]) + ".")
        n -= k
    return " ".join(out)


def odd_texts():
    """Null, empty, blank, one word, long unsplit, many copies of a word, several scripts."""
    return [None, "", " \n\t", "word", "x" * 5000, "he " * 400, "Ärger über Ähren. Él señaló. Это текст. 中文。 😀", "a\n\nb\n", "Word"]


def documents(spark, texts, extra=""):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("clash").alias(name) for name in names_in_use() if name not in df.columns])
    return df


def names_in_use():
    """Every name that the corpus operators give a column, from their code, and others that they might."""
    found = {"component_id", "fp", "kept", "_removed", "_tid", "_kid", "_ksha", "_gone"}
    for path in glob.glob(os.path.join(os.path.dirname(os.path.abspath(llm.__file__)), "*.py")):
        with open(path, encoding="utf-8") as f:
            found.update(x for pair in re.findall(r"""alias\("(\w+)"\)|withColumn\("(\w+)\"|fresh\(docs, "(\w+)\"""", f.read()) for x in pair if x)
    return sorted({x.lower() for x in found})


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def rng(seed=1):
    return random.Random(seed)
