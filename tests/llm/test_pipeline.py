"""The pipeline's stages and the entry without them."""

import os
import subprocess
import sys

import pytest
from helpers import PLANTED, documents, rng, text
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run(spark):
    out = pipeline.run(spark, SF)
    total = out.groupBy("sequence_id").sum("length").collect()
    assert out.count() > 0 and all(r[1] <= 2048 for r in total)


def test_stages(spark):
    base = [text(rng(300 + i), 150) for i in range(12)]
    near = base[0].replace(base[0].split()[40], "changed", 1)
    texts = [*base, base[1], near, base[2] + "\n" + PLANTED, base[3][:200] + "\n" + PLANTED, None, ""]
    docs = documents(spark, texts)
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    a = stages["exact_dedup"](spark, docs, SF)
    assert {r["doc_id"] for r in a.collect()} == set(range(18)) - {12, 17}
    b = stages["near_dedup"](spark, a, SF)
    assert 13 not in {r["doc_id"] for r in b.collect()}
    c = stages["substring_dedup"](spark, b, SF)
    assert c.columns == docs.columns
    rows = {r["doc_id"]: r for r in c.collect()}
    assert sum(PLANTED in (r["text"] or "") for r in rows.values()) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values() if r["text"] is not None)
    d = stages["packing"](spark, c, SF)
    assert {r["doc_id"] for r in d.collect()} == set(rows)
    empty = docs.where("false")
    for name in list(stages)[1:]:
        assert stages[name](spark, empty, SF).count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls, empty and repeated rows, repeated ids and clashing names: what a stage keeps stays as it was."""
    base = [text(rng(400 + i), 60) for i in range(6)]
    docs = documents(spark, [*base, base[0], base[1] + " end", None, "", "  ", "x" * 3000, "word"], extra="yes")
    more = docs.where("doc_id = 2").unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(2).cast("bigint"))).unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("bigint")))
    docs = docs.unionByName(more)
    names = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert len(names) > 40
    stages = dict(pipeline.STAGES)

    def rows(df):
        return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in df.collect())

    clean = stages["toxicity"](spark, docs, SF)
    assert clean.schema == docs.schema and rows(clean) == rows(docs)
    exact = stages["exact_dedup"](spark, docs, SF)
    kept = [0, 1, 2, 2, 4, 5, 7, 10, 11, 12]  # of base 3 the row with the smaller id, of no text the longest
    assert [i for i, _ in rows(exact)] == kept
    near = stages["near_dedup"](spark, docs, SF)
    assert sorted(i for i, _ in rows(near)) == [0, 1, 2, 2, 2, 4, 5, 8, 9, 10, 11, 12]
    parts = stages["substring_dedup"](spark, exact, SF)
    assert [i for i, _ in rows(parts)] == kept and dict(rows(parts))[7] == "end"
    for df in (exact, near, parts):
        assert df.columns == docs.columns and {tuple(r[c] for c in names) for r in df.collect()} == {("clash",) * len(names)}
    pieces = stages["packing"](spark, docs, SF).groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"] for r in pieces} == {*range(13), None}
    empty = docs.where("false")
    for name, stage in stages.items():
        assert stage(spark, empty, SF).count() == 0, name


def test_entry_without_the_corpus_part(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('tideline.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())\n"
        "assert 'density' in e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
