"""Connected components with DataFrame operations: alternating large and small stars.

Each round links, at every node, the neighbours to the smallest one near by:
first those larger than the node, then those not larger. Both are a grouped
minimum, combined before the shuffle, and a join of the edges to one row per
node, and give as many edges as they take, so none needs a shuffle for repeated
ones. Rounds are written to the shared folder, so a lost executor costs one
round at most. Their number grows with the logarithm of the longest path; they
end as soon as every node has one role and one neighbour to be linked to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import stored


def _both_ends(links: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Two rows (node, to) for each link."""
    ends = [F.struct(F.col(a).alias("node"), F.col(b).alias("to")) for a, b in (first, second)]
    return links.select(F.explode(F.array(*ends)).alias("end")).select("end.*")


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """A link (u, v) with u > v for each of ``links``."""
    near = _both_ends(links, ("u", "v"), ("v", "u")) if larger else links.select(F.col("u").alias("node"), F.col("v").alias("to"))
    least = near.groupBy("node").agg(F.min("to").alias("m")).withColumn("m", F.least("node", "m"))
    met = near.join(least, "node")
    if larger:
        return met.where("to > node").select(F.col("to").alias("u"), F.col("m").alias("v"))
    # The link to the smallest neighbour stays; each other neighbour is linked to that one.
    return met.select(F.when(F.col("to") > F.col("m"), F.col("to")).otherwise(F.col("node")).alias("u"), F.col("m").alias("v"))


def _are_stars(links: DataFrame) -> bool:
    """Whether every node is linked to one smaller node, or only larger ones are linked to it."""
    ends = _both_ends(links, ("u", "v"), ("v", "v"))
    mixed = ends.groupBy("node").agg(F.min("to").alias("a"), F.max("to").alias("b")).where("a <> b")
    return not mixed.agg(F.count(F.lit(1))).first()[0]


def stars(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v), stored: every node but the smallest of its component, once, with that one.

    ``links`` (u, v) have u > v, may repeat, and are read several times.
    """
    for _ in range(max_rounds):
        if _are_stars(links):
            return stored(links.distinct(), "links")
        # Each star reads its input twice, so each is stored.
        links = stored(_star(stored(_star(links, True), "links"), False), "links")
    raise RuntimeError(f"no components after {max_rounds} rounds")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the smallest node.

    Edges may repeat, run either way or be loops; a null end makes no edge.
    """
    edges = edges.select("u", "v").dropna()
    nodes_alone = edges.where("u = v").select(F.col("u").alias("node"))
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stars(stored(links, "links"), max_rounds)
    roots = links.select(F.col("v").alias("node")).unionByName(nodes_alone).distinct()
    roots = roots.join(links.select(F.col("u").alias("node")), "node", "left_anti")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
