"""Connected components by parallel hooking and shortcutting over parent arrays held in tables.

Each round hooks every node that has a smaller neighbour onto its smallest neighbour, shortcuts
the parent table until all trees have depth one, relabels the edges by their roots and drops the
ones that became loops. Every node with an edge hooks or is hooked on, so the number of live nodes
at least halves a round: the rounds are logarithmic in the length of the longest path, whatever the
degree of a hub. Hubs cost no skew: hooking is a partial aggregation, and edges are deduplicated
before each join, which adaptive execution splits where one side is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.session import cut


def _shortcut(parents: DataFrame) -> DataFrame:
    """parents(node, parent) -> the same with every parent a root. A node without a row is a root."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        parents = cut(
            parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")),
            "shortcut",
        )
        moved = parents.filter("moved").limit(1).count()
        parents = parents.select("node", "parent")
        if not moved:
            return parents


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """edges(a, b) of any orderable type -> (node, component): the component is its least node.

    Nulls in either end, loops and repeated edges are ignored; nodes without an edge do not appear
    (they are their own component). An empty input gives an empty result.
    """
    live = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    live = cut(live, "edges")
    labels = None
    for _ in range(max_rounds):
        if not live.limit(1).count():
            break
        hooks = cut(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "hooks")
        parents = _shortcut(hooks)
        ends = live.select(F.explode(F.array("a", "b")).alias("node")).distinct() if labels is None else None
        if labels is None:
            labels = ends.join(parents, "node", "left").select("node", F.coalesce("parent", "node").alias("component"))
        else:
            up = parents.select(F.col("node").alias("component"), "parent")
            labels = labels.join(up, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        labels = cut(labels, "labels")
        pa = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        live = (
            live.join(pa, "a", "left")
            .join(pb, "b", "left")
            .select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        live = cut(live, "edges")
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return labels
