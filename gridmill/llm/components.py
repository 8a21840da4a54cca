"""Connected components of a stored list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); a component is named by its smallest node.

    Each round sends every node to the smallest node beside it, found by an aggregate that combines before
    the shuffle, and rewrites the links to what their ends were sent to; links inside one node vanish. The
    rounds end when none is left, and the steps are then put together. Every round is a stored table.
    """
    links = scratch.store(links.where("u <> v").select("u", "v").distinct(), f"{name}-links0")
    result = None
    step = 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        sent = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to"))
        sent = scratch.store(sent, f"{name}-sent{step}")
        if result is None:
            result = sent.select(F.col("u").alias("node"), F.col("to").alias("component"))
        else:
            result = result.join(sent, result.component == sent.u, "left").select(
                "node", F.coalesce("to", "component").alias("component")
            )
        result = scratch.store(result, f"{name}-nodes{step}")
        to_u = sent.select("u", F.col("to").alias("new_u"))
        to_v = sent.select(F.col("u").alias("v"), F.col("to").alias("new_v"))
        fewer = links.join(to_u, "u").join(to_v, "v").where("new_u <> new_v")
        step += 1
        links = scratch.store(
            fewer.select(F.greatest("new_u", "new_v").alias("u"), F.least("new_u", "new_v").alias("v")).distinct(),
            f"{name}-links{step}",
        )
    if result is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return result
