"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.session import cut_lineage


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Label every vertex (``id``) with the smallest id of its component.

    Alternating star contraction: each round hangs neighbours under the smallest known
    one, so the number of rounds grows with the logarithm of the size, hubs included, and
    no neighbour list is ever collected. Each round is checkpointed.
    """
    links = cut_lineage(
        edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    )
    seen = None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
        both = links.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(
            links.select(F.col("dst").alias("u"), F.col("src").alias("v"))
        )
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter(F.col("v") > F.col("u"))
            .join(lowest, "u")
            .select(F.col("v").alias("src"), F.col("m").alias("dst"))
            .filter("src <> dst")
            .distinct()
        )
        large = cut_lineage(large)
        floor = large.groupBy("src").agg(F.min("dst").alias("m"))
        moved = large.join(floor, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        links = cut_lineage(
            moved.unionByName(floor.select("src", F.col("m").alias("dst"))).filter("src <> dst").distinct()
        )
    return vertices.join(links.select(F.col("src").alias("id"), F.col("dst").alias("root")), "id", "left").select(
        "id", F.coalesce("root", "id").alias("component")
    )
