"""Connected components by parallel hooking and shortcutting over a parent table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b bigint); root is the smallest node of its component.

    Each round hooks the root of every edge's far end onto the smallest root it meets, then shortcuts
    parent = parent[parent]. Both are a join on the node and an aggregation with map-side combine, so a node
    with a third of all edges costs one partial row per task; the join's hot key is split by AQE.
    Rounds grow with the logarithm of the diameter. Null ends are ignored; no edges give no rows.
    """
    links = scratch.table(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    # the first hook needs no parent table: the smallest neighbour, or the node itself
    parent = scratch.table(
        links.select(F.col("b").alias("node"), F.col("a").alias("p"))
        .union(nodes.select("node", F.col("node").alias("p")))
        .groupBy("node")
        .agg(F.min("p").alias("root"))
    )
    for _ in range(max_rounds):
        pa, pb = parent.toDF("a", "ra"), parent.toDF("b", "rb")
        rooted = links.join(pa, "a").join(pb, "b").where("ra <> rb").select("ra", "rb").distinct()
        hooks = rooted.select(F.greatest("ra", "rb").alias("node"), F.least("ra", "rb").alias("h")).groupBy("node").agg(F.min("h").alias("h"))
        hooked = parent.join(hooks, "node", "left").select("node", F.least("root", F.coalesce("h", "root")).alias("root"))
        short = hooked.join(hooked.toDF("root", "up"), "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root"))
        new = scratch.table(short)
        changed = new.join(parent.toDF("node", "old"), "node").where("root <> old").limit(1).count()
        scratch.drop(parent)
        parent = new
        if not changed:
            return parent
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
