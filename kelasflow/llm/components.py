"""Connected components by alternating stars, on frames of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelasflow.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in an edge; the component is its smallest id.

    Each pass hangs every node's larger neighbours on its smallest neighbour,
    then its smaller ones likewise, until nothing moves; the trees shrink to
    stars in a number of passes that grows with the logarithm of the longest
    path.  Minima are folded before the shuffle, and a node with very many
    neighbours is only ever joined, never gathered.  Every pass is written to
    the shared folder.
    """
    cur = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                      .where("u > v").distinct(), "edges")
    seen = None
    while True:
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v"))
        cur = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                          "small-star")
    members = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
