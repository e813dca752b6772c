"""Connected groups of duplicate links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.operators.windows import split_join
from jobloom.session import ensure_checkpoint_dir


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node it can see."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return split_join(both, least, ["a"], "inner").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = split_join(down, least, ["a"], "inner").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every group is a star already: each larger node has one link, to a node that is no larger one itself."""
    larger, smaller = F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"))
    ends = edges.select(F.explode(F.array(larger, smaller)).alias("e"))
    seen = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
    return seen.filter((F.col("up") > 1) | (F.col("up") > F.col("least"))).count() == 0


def connected_groups(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, group): every linked node with the least node of its group.

    Alternates the two star steps, so the number of rounds grows with the logarithm
    of a group's size, and checkpoints every round to the shared folder: no lineage
    builds up and a lost executor costs no recomputed rounds. It ends as soon as all groups are
    stars, so links that are stars cost no round. A hub with a third of all links is split:
    its minimum combines on the map side, and the join that brings it back to the links deals
    them anew, so that adaptive execution cuts the hub's share into parts.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    current = _tidy(edges.select(F.col(edges.columns[0]).alias("a"), F.col(edges.columns[1]).alias("b"))).checkpoint()
    rounds = 0
    while not _settled(current):
        if rounds == max_rounds:
            raise RuntimeError(f"duplicate groups did not settle in {max_rounds} rounds")
        # the large step makes as many links as it is given, so only the round's end sorts out equal ones
        current = _tidy(_small_star(_large_star(current))).checkpoint()
        rounds += 1
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("group"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("group")).unionByName(roots).distinct()
