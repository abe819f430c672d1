"""Exact deduplication through an extendible-hash index kept in shared files; DataFrame operations only.

Texts are equal when they are identical after deleting every character of [\\x20\\x09-\\x0D]. A row's key is a 64-bit
hash of its normalised text, and a directory over the key's leading bits doubles until each bucket holds at most its
capacity; an overfull bucket is split by one more bit, so buckets have depths of their own. What tasks have of a key
is combined first, however hot it is, then dealt by bucket: the owner of a range of buckets reads what its buckets
hold, merges it, chains texts that share a key by their SHA-256 and decides size and survivor of each; its result is
the index, in files by bucket. Rows look their entry up in the bucket that the directory names. The bytes of all rows
of an entry of more than one are compared, and rows that only share both hashes are told apart by their text.

Defined results: a null text counts as empty; all empty texts are one group; rows with a null doc_id are members
of their group and stay only if no other id is there; rows that repeat an id count as rows; an empty table gives an
empty result; other columns are ignored, or kept by drop_exact_copies, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import discard, fresh, key_filter, looked_up, row_key, shuffle_width, tidy, without, written

#: What a bucket holds before it is split, and the most bits of the directory (2**20 slots).
BUCKET_CAPACITY = 4096
MAX_DEPTH = 20
#: Parts that the copies of one key are combined in before its owner merges them.
PARTS = 8


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def keyed(docs: DataFrame) -> DataFrame:
    """Rows as _id, _row (the row's own key), _norm, _len (code points of the original text), _key and _sha."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), row_key(F.col("doc_id"), F.col("text")).alias("_row"), F.length(F.coalesce(text, F.lit(""))).alias("_len"), normalised(text).alias("_norm"))
    return rows.select("_id", "_row", "_len", "_norm", F.xxhash64("_norm").alias("_key"), F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"))


def _combined(rows: DataFrame, *keys: str) -> DataFrame:
    """Size and survivor of what rows have of each key, combined in each task before the shuffle."""
    top = F.max(F.struct(F.col("_len"), (-F.col("_id")).alias("_neg"))).alias("_top")
    return rows.groupBy(*keys).agg(F.count("*").alias("_size"), top)


def _entry(size: Column, top: str = "_top") -> list[Column]:
    return [size.alias("_size"), F.col(f"{top}._len").alias("_keep_len"), (-F.col(f"{top}._neg")).alias("_keep")]


def slot(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth)


def directory(parts: DataFrame, capacity: int = BUCKET_CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """Slots of the directory (_slot, _bucket, _local_depth) and its global depth.

    A bucket is the shortest run of leading bits whose keys fit the capacity. The directory stays within
    2**max_depth slots: from there on the capacity grows with the input.
    """
    n = parts.count()
    capacity = max(capacity, -(-n // (1 << (max_depth - 2))))
    depth = min(max_depth, max(1, math.ceil(math.log2(max(2, n / capacity))) + 2))
    slots = parts.groupBy(slot(F.col("_key"), depth).alias("_slot")).agg(F.count("*").alias("_n"))
    local = F.lit(depth)
    for d in range(depth - 1, 0, -1):
        part = F.shiftright("_slot", depth - d)
        slots = slots.withColumn(f"_n{d}", F.sum("_n").over(Window.partitionBy(part)))
        local = F.when(F.col(f"_n{d}") <= capacity, F.lit(d)).otherwise(local)
    slots = slots.withColumn("_local_depth", local)
    first = F.expr(f"shiftleft(shiftright(_slot, {depth} - _local_depth), {depth} - _local_depth)")
    return slots.select("_slot", first.alias("_bucket"), "_local_depth"), depth


def _placed(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """Rows with the bucket of their key. The directory has at most 2**MAX_DEPTH slots of 20 bytes."""
    return rows.withColumn("_slot", slot(F.col("_key"), depth)).join(F.broadcast(slots), "_slot").drop("_slot")


def build_index(members: DataFrame, capacity: int = BUCKET_CAPACITY) -> tuple[DataFrame, DataFrame, int, list[str]]:
    """The index of members (_id, _len, _key, _sha), its directory and depth, and the paths of both.

    An entry is _bucket, _local_depth, _key, _chain (its place among texts of the same key), _sha, _size, _keep_len, _keep.
    """
    spark = members.sparkSession
    some = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(PARTS)).cast("int")
    parts, path = written(_combined(members.withColumn("_part", some), "_key", "_sha", "_part"), "exact-parts", narrow=True)
    slots, depth = directory(parts, capacity)
    slots, slots_path = written(slots, "exact-directory", narrow=True)
    # an owner has a range of buckets; grouping and chaining need no further exchange
    owned = _placed(parts, slots, depth).repartitionByRange(-(-shuffle_width(spark) // 4), "_bucket")
    merged = owned.groupBy("_bucket", "_local_depth", "_key", "_sha").agg(F.sum("_size").alias("_size"), F.max("_top").alias("_top"))
    chain = F.row_number().over(Window.partitionBy("_bucket", "_key").orderBy("_sha")) - 1
    index, index_path = written(merged.select("_bucket", "_local_depth", "_key", chain.alias("_chain"), "_sha", *_entry(F.col("_size"))), "exact-index")
    discard(spark, path)
    return index, slots, depth, [index_path, slots_path]


def _looked_up(members: DataFrame, index: DataFrame, slots: DataFrame, depth: int, n: int) -> DataFrame:
    """Members with their entry, found in their bucket."""
    keys = ["_bucket", "_key", "_sha"]
    return looked_up(_placed(members, slots, depth), index.select(*keys, "_size", "_keep_len", "_keep"), keys, "_size", n)


def _collisions(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Keys whose members differ in their bytes though both hashes agree.

    A filter made of the keys with more than one row spares most single rows; each task compares what it has of a
    key and passes on the least and the greatest text, which are equal but for a collision.
    """
    multiple = index.where("_size > 1")
    hit = key_filter(multiple, "_key", multiple.count())(F.col("_key"))
    return keyed(docs).where(hit).groupBy("_key", "_sha").agg(F.min("_norm").alias("_a"), F.max("_norm").alias("_b")).where("_a <> _b").select("_key", "_sha")


def _found(docs: DataFrame, capacity: int) -> tuple[DataFrame, list[str]]:
    """Every row's _id, _row, _len, _key, _sha, _size, _keep_len, _keep and _bucket, and paths of what that reads."""
    spark = docs.sparkSession
    members, members_path = written(keyed(docs).select("_id", "_row", "_len", "_key", "_sha"), "exact-members")
    n = members.count()
    index, slots, depth, paths = build_index(members, capacity)
    bad, bad_path = written(_collisions(docs, index), "exact-collisions", narrow=True)
    paths += [members_path, bad_path]
    if bad.isEmpty():
        return _looked_up(members, index, slots, depth, n), paths
    texts = keyed(docs).join(bad, ["_key", "_sha"], "left_semi")
    own = _combined(texts, "_key", "_sha", "_norm").select("_key", "_sha", "_norm", *_entry(F.col("_size")))
    apart = _placed(texts, slots, depth).join(own, ["_key", "_sha", "_norm"]).drop("_norm")
    rest = members.join(bad, ["_key", "_sha"], "left_anti")
    return _looked_up(rest, index, slots, depth, n).unionByName(apart, allowMissingColumns=True), paths


_KEPT = "_id <=> _keep and _len = _keep_len"


def exact_groups(docs: DataFrame, capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_code_points and bucket.

    Of equal texts the row with the most code points stays, then the smallest doc_id.
    """
    found, _ = _found(docs, capacity)
    return found.select(
        F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.expr(_KEPT).alias("kept"), F.col("_sha").alias("text_sha256"),
        F.col("_len").alias("n_code_points"), F.col("_bucket").cast("bigint").alias("bucket"),
    )


def drop_exact_copies(docs: DataFrame, capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """docs without the rows whose text another row has, all columns kept; rows that repeat id and text become one.

    Only rows that a filter of the dropped ones doesn't clear are shuffled.
    """
    spark = docs.sparkSession
    tidy(spark)
    found, paths = _found(docs, capacity)
    gone, _ = written(found.where(f"not ({_KEPT})").select("_row").distinct(), "exact-gone", narrow=True)
    stay = found.where(_KEPT).select("_row", "_key", "_sha")
    several = stay.groupBy("_key", "_sha").agg(F.count("*").alias("_n")).where("_n > 1").select("_key", "_sha")
    several, several_path = written(stay.join(several, ["_key", "_sha"], "left_semi").select("_row").distinct(), "exact-several", narrow=True)
    discard(spark, *paths)
    key = row_key(F.col("doc_id"), F.col("text"))
    out = without(docs, key, gone, "_row")
    n = several.count()
    if not n:
        discard(spark, several_path)
        return out
    maybe = key_filter(several, "_row", n)(key)
    own = fresh(docs, "_sha")[0]
    one = out.where(maybe).withColumn(own, F.sha2(normalised(F.col("text")).cast("binary"), 256)).dropDuplicates([own]).select(*docs.columns)
    return out.where(~maybe).unionByName(one)
