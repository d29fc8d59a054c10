"""Connected components of an edge table by alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): the
number of rounds grows with the square of the logarithm of the largest
component at most, a round moves each edge twice, and no group of neighbours
is ever gathered: a hub is only a hot join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, release


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node reachable.

    Nodes without an edge have no row. Self loops and repeated edges are
    ignored. An empty edge table gives an empty result.
    """
    pairs = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where("a <> b").distinct()
    now = materialize(pairs, "cc")
    stamp = _stamp(now)
    while stamp[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(root, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        then = materialize(small, "cc")
        release(now)
        now, before, stamp = then, stamp, _stamp(then)
        if stamp == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
