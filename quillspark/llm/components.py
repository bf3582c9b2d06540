"""Connected components of a graph of links, by distributed union-find (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node and root (the smallest node of its component) for every node of links(a, b), two long columns.

    Each round hooks every root to the smallest root that a link of its tree
    leads to, then halves the paths until the trees are stars; links within a
    tree are dropped. Hooks lead to smaller nodes only, so that no cycle
    arises. The number of rounds grows with the logarithm of a component's
    diameter. Only one count per round reaches the driver; each round's tables
    are written to the shared folder, and the last round's are dropped.
    Self-links and repeated links are allowed; without links there are no rows.
    """
    plain = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    plain = plain.filter("a IS NOT NULL AND b IS NOT NULL")
    left = scratch.table(plain.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links-0")
    nodes = plain.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    tree, round_ = scratch.table(nodes.withColumn("root", F.col("node")), f"{name}-tree-0"), 0
    while not left.isEmpty():
        round_ += 1
        # left holds links between roots: the larger end hooks to its smallest partner
        hooks = scratch.table(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), f"{name}-hooks-{round_}")
        step = 0
        while True:  # pointer jumping among the hooked roots
            over = hooks.toDF("up", "over")
            jumped = hooks.join(over, "up", "left").select("node", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved"))
            step += 1
            jumped = scratch.table(jumped, f"{name}-hooks-{round_}-{step}")
            moved = not jumped.filter("moved").isEmpty()
            hooks = jumped.drop("moved")
            if not moved:
                break
        to = hooks.toDF("root", "up")
        tree = scratch.table(tree.join(to, "root", "left").select("node", F.coalesce("up", "root").alias("root")), f"{name}-tree-{round_}")
        a, b = hooks.toDF("a", "to_a"), hooks.toDF("b", "to_b")
        moved = left.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        left = scratch.table(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links-{round_}")
        scratch.drop(f"{name}-tree-{round_ - 1}", f"{name}-links-{round_ - 1}", *[f"{name}-hooks-{round_}-{i}" for i in range(1, step)], f"{name}-hooks-{round_}")
    return tree
