"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round moves a node's links to its smallest neighbour by a grouped minimum
and a join: a node with very many links is pre-aggregated in the minimum and
its join partition can be split, and no neighbour list is ever gathered.  Rounds
grow with the logarithm of the longest chain.  Each round is checkpointed to the
shared folder, so a lost executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import shared_dir

MAX_ROUNDS = 60  # far beyond log2 of any table; reaching it is an error, not a cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b of one integer type):
    the component is its smallest node.  Nodes without a link are not listed;
    loops and repeated edges do no harm; no edges give an empty table."""
    shared_dir(edges.sparkSession)
    e = edges.select("a", "b").where("a <> b").distinct().checkpoint()
    state = _state(e)
    for _ in range(MAX_ROUNDS):
        e = _small_star(_large_star(e)).checkpoint()
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return (e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
