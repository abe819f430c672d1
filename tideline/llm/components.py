"""Connected components of a graph given as links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import discard, ship, shuffle_width, written

MOST_ROUNDS = 60


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the same components as the links (a, b): each node but the least of its component, and that."""
    nodes, ids = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ids[: len(a)], ids[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        new = np.minimum(new, new[new])
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _contracted(links: DataFrame) -> DataFrame:
    """Each partition's links as a star forest: at most one row for each of its nodes, in bounded blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, held_b, n = [], [], 0
        for batch in batches:
            held_a.append(batch.column(0).to_numpy(zero_copy_only=False))
            held_b.append(batch.column(1).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= 4_000_000:
                a, b = forest(np.concatenate(held_a), np.concatenate(held_b))
                if len(a) > 2_000_000:  # many nodes: pass them on
                    yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])
                    held_a, held_b, n = [], [], 0
                else:
                    held_a, held_b, n = [a], [b], len(a)
        if n:
            a, b = forest(np.concatenate(held_a), np.concatenate(held_b))
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    ship(links.sparkSession)
    return links.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """node and component (the least node that it reaches) of each node that links name, but the least ones themselves.

    links: a and b, bigint, without nulls; both directions, repeats and loops are allowed. A round is a large-star
    and a small-star step, each an aggregate that combines before its shuffle and a join whose hot keys Spark can
    split; every step is written to the shared folder. Rounds end when each node has one link, to the least node.
    Returns the table and its path.
    """
    spark = links.sparkSession
    width = -(-shuffle_width(spark) // 4)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, path = written(_contracted(edges.repartition(width, F.col("a"))), "links")
    for _ in range(MOST_ROUNDS):
        ends = edges.groupBy("a").agg(F.count("*").alias("n"))
        roots = edges.groupBy("b").agg(F.lit(1).alias("one")).select("b")  # combined before the shuffle: a root may have most of the links
        open_ = ends.where("n > 1").select("a").unionByName(ends.join(roots, F.col("a") == F.col("b"), "left_semi").select("a"))
        if open_.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")), path
        # large star: every greater neighbour of a node goes to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, least_path = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least", narrow=True)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large, large_path = written(_contracted(large.repartition(width, F.col("a"))), "links")
        discard(spark, least_path, path)
        # small star: a node's smaller neighbours go to the least of them
        least, least_path = written(large.groupBy("a").agg(F.min("b").alias("m")), "least", narrow=True)
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")
        edges, path = written(_contracted(small.repartition(width, F.col("a"))), "links")
        discard(spark, least_path, large_path)
    raise RuntimeError("components did not settle")
