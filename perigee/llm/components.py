"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm.shared import stored


def connected(links: DataFrame, folder: str) -> DataFrame:
    """Map every linked node to the smallest node of its component.

    `links` has columns `a`, `b` of one ordered type. Returns (node, root) for all nodes but the roots
    themselves. Each round first hangs the larger neighbours of a node on its smallest
    neighbour, then the smaller ones; the graph ends as one star per component. Rounds
    grow with the logarithm of the longest path. Every round is a written table.

    Neighbour minima are pre-aggregated; their joins carry one row per node on one side,
    so a hub is split by the skew join. Nulls and loops are no links; repeated links
    count once; an empty table gives an empty map.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stored(links.where("a <> b").distinct(), f"{folder}/links-0")
    seen, step = _signature(links), 0
    while seen[0]:
        step += 1
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, f"{folder}/links-{step}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), f"{folder}/links-{step}")
        now = _signature(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _signature(links: DataFrame) -> tuple[int, int | None]:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
