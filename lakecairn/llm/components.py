"""Connected components of an edge list by alternating stars, without any node or edge on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours hang on its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = C.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours hang on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    least = C.written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a")
    return moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b: long); root is the component's smallest node.

    Each round is written to the shared folder, so the lineage stays short and a
    lost executor costs one round. A round sends a minimum for each node, taken
    before the shuffle and written: so the join with it, whose key may be the centre
    of a large star, is a broadcast where the minima are few and otherwise a plain join
    of two shuffles, whose skewed partitions are split at run time. The count of rounds is
    logarithmic in the longest chain.
    """
    now = C.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    print_of = F.struct(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h"))
    mark = now.agg(print_of.alias("x")).first()["x"]
    while True:
        with C.only_result() as keep:
            new = keep(C.written(_small_star(C.written(_large_star(now), "edges")).distinct(), "edges"))
        C.drop_written(now)
        now, before = new, mark
        mark = now.agg(print_of.alias("x")).first()["x"]
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
