"""Connected components of an edge table by randomised contraction.

Each round every node hooks to the neighbour (or itself) with the least hash under that round's seed; edges are
redrawn between the hooked-to nodes and those that fall on themselves drop out. A constant share of the nodes
goes in each round whatever the shape, so chains take a logarithmic number of rounds. Hot nodes are reduced by
partial aggregation and joined by keys that adaptive execution may split. Every round is written out, so nothing
is recomputed after a loss and no plan grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of edges(a, b), with one root for each component.

    Loops and edges with a null end are no links: they give no node. Repeated edges count once. No edges give no rows.
    """
    left = materialize(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges")
    hooks: list[DataFrame] = []
    while left.limit(1).count():
        seed = F.lit(len(hooks) + 1)
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b")))
        own = F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("b"))
        hook = materialize(both.groupBy("a").agg(best.alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), own)["b"].alias("to")), f"{name}-hooks")
        hooks.append(hook)
        on_a = left.join(hook.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        on_b = on_a.join(hook.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        redrawn = materialize(on_b.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-edges")
        discard(left)
        left = redrawn
    if not hooks:
        return materialize(left.select(F.col("a").alias("node"), F.col("a").alias("root")), f"{name}-roots")  # no rows
    roots = hooks[-1].select("node", F.col("to").alias("root"))
    for hook in reversed(hooks[:-1]):
        # a node that a later round doesn't know has lost all its edges: what it hooked to is its root
        later = roots.select(F.col("node").alias("to"), "root")
        roots = hook.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    roots = materialize(roots, f"{name}-roots")
    discard(left, *hooks)
    return roots
