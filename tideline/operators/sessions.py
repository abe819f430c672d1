"""Recording chunks to sessions: a chunk goes on with the session before if it begins within an hour of its end under the same title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_MS = 3_600_000


def classified(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with platform and user_name, and those that lack one."""
    known = (F.coalesce("platform", F.lit("")) != "") & (F.coalesce("user_name", F.lit("")) != "")
    return chunks.where(known), chunks.where(~known)


def clustered(chunks: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """chunks (path, created_ms, modified_ms, platform, user_name, room_title) with session_no, from 1 for each user."""
    by = Window.partitionBy("platform", "user_name").orderBy("created_ms", "path")
    title = F.trim(F.coalesce("room_title", F.lit("")))
    rows = chunks.withColumn("title", title)
    follows = (F.col("created_ms") - F.lag("modified_ms").over(by) <= gap_ms) & (F.col("title") == F.lag("title").over(by))
    return rows.withColumn("_opens", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("session_no", F.sum("_opens").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def ordinal_label(start: Column, ordinal: Column, title: Column) -> Column:
    """The label is the date, the day's running number and, if there is one, the title."""
    base = F.format_string("%s 第%d场", F.date_format(start, "yyyy-MM-dd"), ordinal)
    return F.when(title != "", F.concat(base, F.lit(" · "), title)).otherwise(base)


def sessions(chunks: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """platform, user_name, start_ms, end_ms, title, n_chunks, chunks, ordinal (of the local day) and label."""
    first = F.struct("created_ms", "path")
    rows = clustered(chunks, gap_ms).groupBy("platform", "user_name", "session_no").agg(
        F.min("created_ms").alias("start_ms"), F.max_by("modified_ms", first).alias("end_ms"), F.min_by("title", first).alias("title"), F.count("*").alias("n_chunks"),
        F.sort_array(F.collect_list(F.struct("created_ms", "path", "modified_ms"))).alias("chunks"),
    )
    start = F.timestamp_millis("start_ms")
    day = Window.partitionBy("platform", "user_name", F.to_date(start)).orderBy("start_ms", "session_no")
    rows = rows.withColumn("ordinal", F.row_number().over(day).cast("bigint"))
    return rows.withColumn("label", ordinal_label(start, F.col("ordinal"), F.col("title"))).drop("session_no")
