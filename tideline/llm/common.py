"""Helpers that the corpus operators share: shared storage, written tables, label folds and samples."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.shipping import ship_package

#: Rows and bytes of a batch between Spark and Python: whole texts are long, and both sides hold batches outside the heap.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that workers can import it anywhere.

    The session's batches for Python are made no larger than BATCH_ROWS and BATCH_BYTES.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
    ship_package(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (tests).

    Without the setting a session on a cluster is refused: its machines share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tideline-shared-"))
            found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, tag: str, narrow: bool = False, path: str | None = None) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and lost executors cost nothing.

    narrow: rows of a few numbers, made cheaply; they are written by a quarter of the tasks, into as many files.
    path: where to write instead, to be kept. Other tables are deleted when the application ends, if not before by
    discard(). Returns the table and its path.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(-(-shuffle_width(spark) // 4))
    at = path or f"{shared_dir(spark)}/tideline/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    if path is None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(at), at


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that docs has no column of, so that a column of the user's never meets one of ours."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        own, k = name, 0
        while own.lower() in taken:
            own, k = f"{name}_{k}", k + 1
        taken.add(own.lower())
        out.append(own)
    return out


def row_key(doc_id: Column, text: Column) -> Column:
    """A hash that names a row by its id and its whole text, so that rows which only share an id are told apart."""
    return F.xxhash64(doc_id.cast("bigint"), doc_id.isNull(), text.cast("string"), text.isNull())


#: Bits of a key filter for each key, and the most in all (1 MiB); beyond, more rows pass it than need to.
FILTER_BITS = 16
MOST_FILTER_BITS = 1 << 23


def key_filter(keys: DataFrame, name: str, n: int) -> Callable[[Column], Column]:
    """A test for hashes (bigint): true for each of the n in the column, and for few others, sized from n up to a bound.

    What it lets pass is joined afterwards, so the bound costs time alone. Rows that it turns away need no shuffle.
    """
    bits = min(MOST_FILTER_BITS, max(1 << 16, 1 << (FILTER_BITS * max(1, n) - 1).bit_length()))
    shift = 64 - bits.bit_length() + 1

    def bit(key: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(31)).cast("int"))

    def word(key: Column) -> Column:
        return F.shiftrightunsigned(key, shift + 5)

    words = keys.select(word(F.col(name)).alias("id"), bit(F.col(name)).alias("b")).groupBy("id").agg(F.bit_or("b").alias("b"))
    dense = keys.sparkSession.range(bits // 32).join(words, "id", "left").select("id", F.coalesce("b", F.lit(0)).alias("b"))
    held = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda x: x["b"]).alias("bits"))
    return lambda key: F.get(held.scalar(), word(key).cast("int")).bitwiseAND(bit(key)) != 0


#: An entry that more than this share of all rows look up is told to all tasks: there are at most so many of them.
HOT_ENTRIES = 4096


def looked_up(rows: DataFrame, entries: DataFrame, keys: list[str], size: str, n: int) -> DataFrame:
    """Rows with the entry of their keys. size is the column with an entry's number of rows, of n in all.

    Hot entries are broadcast, so that no task gets all rows of a hot key; there are HOT_ENTRIES of them at most.
    """
    hot = F.col(size) > max(1000, n // HOT_ENTRIES)
    own = entries.where(hot)
    rest = rows.join(F.broadcast(own.select(*keys)), keys, "left_anti").join(entries.where(~hot), keys)
    return rows.join(F.broadcast(own), keys).unionByName(rest)


def without(docs: DataFrame, key: Column, gone: DataFrame, name: str) -> DataFrame:
    """docs but the rows whose key is in the column of gone (a written table); rows that the key filter clears aren't shuffled."""
    maybe = key_filter(gone, name, gone.count())(key)
    own = fresh(docs, "_key")[0]
    rest = docs.where(maybe).withColumn(own, key).join(gone.select(F.col(name).alias(own)), own, "left_anti").select(*docs.columns)
    return docs.where(~maybe).unionByName(rest)


def tidy(spark: SparkSession) -> None:
    """Let the driver collect plans that are no longer referred to, so that Spark's cleaner deletes their shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus: the split into learning and held-out rows."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; TIDELINE_TOKENIZERS overrides the folder."""
    own = os.environ.get("TIDELINE_TOKENIZERS")
    if own:
        return os.path.join(own, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def learning_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int) -> tuple[list[tuple], dict[str, int]]:
    """A bounded sample of labelled rows for fitting: ((id, label, whole text) without near copies, in hashed order), and rows of each label.

    labels: doc_id and the label column, learning rows only. About 1.2 * per_class rows of each label are gathered
    at most, of texts of up to longest characters: per_class and longest are the documented bound of the classifiers
    here. Which rows are taken depends on their ids and lengths alone; an id that repeats gives one text, the least.
    Of rows that share most of their word sequences one stays, so that a large group of copies doesn't outweigh the rest.
    """
    lab = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col(label).cast("string").alias("_y")).where("_id is not null and _y is not null")
    counts = {r["_y"]: r["n"] for r in lab.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], counts
    rate = F.lit(0.0)
    for y, n in counts.items():
        rate = F.when(F.col("_y") == F.lit(y), F.lit(min(1.0, 1.2 * per_class / n))).otherwise(rate)
    unit = F.pmod(F.xxhash64(F.col("_id"), F.lit(17)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    ids = sorted((r["_id"], r["_y"]) for r in lab.where(unit < rate).distinct().collect())
    if not ids:
        return [], counts
    small = docs.sparkSession.createDataFrame(ids, "_id bigint, _y string")  # about 1.2 * per_class rows a label
    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
        .where(F.length("_t") <= longest)
        .join(F.broadcast(small), "_id")
        .groupBy("_id", "_y")
        .agg(F.min("_t").alias("_t"))
        .collect()
    )
    order = sorted(((r["_id"], r["_y"], r["_t"]) for r in rows), key=lambda r: (zlib.crc32(b"%d" % r[0]), r))
    seen: set = set()
    out = []
    for r in order:
        marks = _marks(r[2])
        if not marks & seen:
            out.append(r)
        seen |= marks
    return out, counts


def _marks(text: str) -> set[tuple[int, int]]:
    """Three least hashes of the text's runs of four words: texts that share most runs share one of them, likely."""
    w = text.encode("utf-8", "replace").split()
    h = np.array([zlib.crc32(b" ".join(w[i : i + 4])) for i in range(max(1, len(w) - 3))] if w else [0], np.uint64)
    return {(k, int(((h * np.uint64(m) + np.uint64(k)) & np.uint64(0xFFFFFFFF)).min())) for k, m in enumerate((1, 2654435761, 2246822519))}
