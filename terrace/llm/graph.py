"""Connected components of a link table, in rounds of joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import counted, materialise


def _compressed(parents: DataFrame) -> DataFrame:
    """Every node's parent replaced by its root, halving the paths in each turn."""
    while True:
        above = parents.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
        parents, moved = counted(
            parents.join(above, F.col("parent") == F.col("_node"), "left")
            .select("node", F.coalesce("_parent", "parent").alias("parent"), (F.coalesce("_parent", "parent") != F.col("parent")).alias("moved")),
            "parents", F.col("moved"),
        )
        parents = parents.drop("moved")
        if not moved:
            return parents


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``links`` (columns ``a, b`` of one comparable type); the component is its smallest node.

    In each round every node hangs below its smallest neighbour if that is smaller;
    the trees are flattened and links relabelled with the roots.  Each root that
    still has a link meets another, so rounds are few.  Null ends and links to
    oneself are ignored.
    """
    links, left = counted(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    found: DataFrame | None = None
    while found is None or left:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = _compressed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("parent")))
        if found is None:
            found = parents.withColumnRenamed("parent", "component")
        else:
            found = materialise(
                found.join(parents.withColumnsRenamed({"node": "_node"}), F.col("component") == F.col("_node"), "left").select("node", F.coalesce("parent", "component").alias("component")),
                "components",
            )
        up, down = parents.select(F.col("node").alias("_a"), F.col("parent").alias("_pa")), parents.select(F.col("node").alias("_b"), F.col("parent").alias("_pb"))
        moved = links.join(up, F.col("a") == F.col("_a")).join(down, F.col("b") == F.col("_b")).where("_pa <> _pb")
        links, left = counted(moved.select(F.greatest("_pa", "_pb").alias("a"), F.least("_pa", "_pb").alias("b")).distinct(), "links")
    return found
