"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns ``a``, ``b``, any order).

    ``root`` is the smallest node that can be reached.  Each step regroups
    the edges around the smallest neighbour seen so far, with minima
    aggregated before the shuffle, so no neighbourhood is ever gathered in
    one place.  The edge table is written after each round (short lineage);
    the loop ends when a round leaves it unchanged.  An empty table gives an
    empty result; self loops are ignored.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                  "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        now = written(small.distinct(), "edges")
    return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
