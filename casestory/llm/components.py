"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is one aggregate and one join; a hub's edges are spread by ``join_groups`` and rounds
are written to the shared folder, so no component is ever held in one task or in the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casestory.llm.common import join_groups, stash


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Large star: every larger neighbour of u links to the least of u and its neighbours.
    Small star: u and its smaller neighbours link to the least of them."""
    if small:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        sides = edges.select("u", "v").union(edges.select("v", "u"))
    sides = stash(sides.distinct(), "sides")
    least = stash(sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
    met = join_groups(sides, least, ["u"], "n")
    if small:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stash(out.where("u <> v").distinct(), "star")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with an edge; the root is the least node of its component.

    ``edges`` has two columns of one orderable type; loops and repeats are allowed, no edges give
    no rows.
    """
    a, b = edges.columns
    now = stash(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        now = _star(_star(now, small=False), small=True)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
