"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a few joins and grouped minima on the edges; nothing is collected. Each round's edges are written to the
shared folder, so lineage stays short. A node of very high degree is no bottleneck: minima are combined before they are
shuffled, and the joins carry a salt so that both of their sides are plain exchanges, which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import discard, tasks_of, written

def _salts(edges: int) -> int:
    """Parts of a node's edges: more where there are more edges, as one node may have a third of them."""
    return max(4, min(256, edges // 500_000))


def _with_least(pairs: DataFrame, salts: int) -> DataFrame:
    """Rows (u, v) with ``m``, the least v of the u. A node with few edges sends its least to few parts."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    # A node's parts: 4, or all where it has many edges.
    parts = F.when(F.col("n") > 100_000, salts).otherwise(4)
    spread = least.select("u", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), parts.alias("parts"))
    if salts == 4:
        salted = pairs.withColumn("salt", F.pmod(F.hash("v"), F.lit(4)))
    else:
        # Which nodes have many edges is few rows: at most one in 100,000 edges.
        wide = F.broadcast(least.where("n > 100000").select("u", F.lit(salts).alias("parts")))
        salted = pairs.join(wide, "u", "left").withColumn("salt", F.pmod(F.hash("v"), F.coalesce("parts", F.lit(4)))).drop("parts")
    return salted.join(spread.drop("parts").hint("merge"), ["u", "salt"]).drop("salt")


def _large_star(edges: DataFrame, salts: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_least(both, salts).where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()


def _small_star(edges: DataFrame, salts: int) -> DataFrame:
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    joined = _with_least(down, salts)
    moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(joined.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame, name: str = "links") -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b of one orderable type) but the roots themselves.

    The root is the least node that can be reached. Loops and repeated edges do no harm; nulls are left out.
    """
    plain = edges.where(F.col("a") != F.col("b"))
    now = written(plain.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if mark == state or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = mark
        # Each half reads its edges twice, so both are written: a plan of the two together would run the first half four times.
        # A half-step makes at most one edge of an edge.
        half = written(_large_star(now, _salts(mark[0])), name, tasks_of(mark[0]))
        discard(now)
        now = written(_small_star(half, _salts(mark[0])), name, tasks_of(mark[0]))
        discard(half)
