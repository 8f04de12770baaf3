"""Connected components of a link table by alternating stars, in rounds kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveylab.llm.common import stored

#: Shares into which the neighbours of one node are cut for the join with its least neighbour.
SHARES = 16


def _least(edges: DataFrame) -> DataFrame:
    """Add to (u, v) the least v of each u, as ``m``; the rows of a hot u are spread over SHARES keys."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    spread = least.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    dealt = edges.withColumn("share", F.pmod(F.xxhash64("v"), F.lit(SHARES)).cast("int"))
    return dealt.join(spread, ["u", "share"]).drop("share")


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the links; root is the least node that can be reached.

    Every round hangs the greater neighbours of each node, then the lesser ones,
    on its least neighbour; rounds end when the link table stays the same. Null
    ends and links of a node with itself are no links; repeated links count once.
    """
    def distinct(e: DataFrame) -> DataFrame:
        return e.where("u > v").distinct()

    edges = stored(distinct(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                            .where(F.col(a).isNotNull() & F.col(b).isNotNull())), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        held = _least(distinct(large))
        small = held.select("u", F.col("m").alias("v")).unionByName(
            held.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = stored(distinct(small), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            break
        before = now
    root = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
