"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (columns ``a``, ``b``); component = smallest node.

    Every round hooks each node to its smallest neighbour, follows one pointer more
    and replaces the links by those between what is left.  Half of the
    connected nodes at least disappear per round, so the number of rounds is
    logarithmic.  All work is joins and minima; a hub is only ever pre-aggregated.
    Empty links give an empty frame; self links give a component of one.
    """
    links = staged(links.select("a", "b").where("a is not null and b is not null").distinct(), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    assigned = nodes.select("node", F.col("node").alias("component"))
    left = links.where("a <> b")
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = staged(both.groupBy(F.col("a").alias("v"))
                        .agg(F.least(F.col("a"), F.min("b")).alias("p")), "hooks")
        second = hooked.select(F.col("v").alias("p"), F.col("p").alias("root"))
        parent = staged(hooked.join(second, "p", "left")
                        .select("v", F.coalesce("root", "p").alias("root")), "parents")
        assigned = staged(assigned.join(parent, F.col("component") == F.col("v"), "left")
                          .select("node", F.coalesce("root", "component").alias("component")), "assigned")
        of_a = parent.select(F.col("v").alias("a"), F.col("root").alias("ra"))
        of_b = parent.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        left = staged(left.join(of_a, "a").join(of_b, "b").where("ra <> rb")
                      .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    smallest = assigned.groupBy("component").agg(F.min("node").alias("smallest"))
    return assigned.join(smallest, "component").select("node", F.col("smallest").alias("component"))
