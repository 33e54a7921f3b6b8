"""Connected components of a link table, by hooking and path compression as in union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyspark.sources import store


def connected_components(links: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node that occurs in `links` (a, b); root is the least node it can reach.

    Each round hooks every root onto its least neighbouring root, compresses the paths that this makes by
    doubling, and renames the ends of the links; links inside a component disappear. The number of roots
    with links at least halves, so the rounds are logarithmic. All state is in written tables.
    """
    links = store.staged(links.filter("a <> b").select("a", "b").distinct(), folder, "links")
    roots = store.staged(
        links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")),
        folder, "roots",
    )
    while not links.isEmpty():
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).filter("root < node")
        hooks = _compressed(store.staged(hooks, folder, "hooks"), folder)
        roots = store.staged(_renamed(roots, hooks, "root"), folder, "roots")
        links = store.staged(
            _renamed(_renamed(links, hooks, "a"), hooks, "b").filter("a <> b").distinct(), folder, "links"
        )
    return roots


def _renamed(df: DataFrame, hooks: DataFrame, name: str) -> DataFrame:
    to = hooks.select(F.col("node").alias(name), F.col("root").alias("_to"))
    return df.join(to, name, "left").withColumn(name, F.coalesce("_to", name)).drop("_to").select(*df.columns)


def _compressed(hooks: DataFrame, folder: str) -> DataFrame:
    """Follow hooks of hooks until each leads to a node that is hooked no more; the length doubles each time."""
    while True:
        onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        doubled = hooks.join(onward, "root", "left")
        moved = store.staged(
            doubled.select("node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")),
            folder, "paths",
        )
        hooks = moved.select("node", "root")
        if moved.filter("_moved").isEmpty():
            return hooks
