"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of an edge (u, v) of longs; component: the smallest node reachable.

    Each round hangs larger neighbours on the smallest one (large star), then smaller ones likewise (small star), until
    nothing changes; rounds grow with the logarithm of the longest path. Minima are combined before the shuffle, edges
    are 16 bytes each, and every round is written to the shared folder. Loops and repeated edges change nothing; an
    empty input gives no rows.
    """
    now = cut(
        edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    before, state = None, _state(now)
    for _ in range(most_rounds):
        if state == before or not state[0]:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where(F.col("u") != F.col("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least, F.col("u") == F.col("w")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, cut(small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "small-star")
        forget(last, large)
        before, state = state, _state(now)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
