"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


#: Links that one task handles: a small table of links isn't cut into as many tasks, and files, as the session's shuffles.
TASK_LINKS = 100_000


def _star(links: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One round over links (u, v) with u > v, each node's smallest neighbour found by a pre-aggregated minimum.

    Large star: every larger neighbour of a node moves to the smallest of its neighbourhood.
    Small star: every smaller neighbour of a node, and the node itself, move there.
    """
    if large:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return moved.where("u != v").coalesce(tasks).distinct().coalesce(tasks)


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("u", "v"))).first()
    return tuple(row)


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): each linked node and the smallest node of its component.

    Takes non-null longs; self links are ignored, repeated links do no harm, no link gives an empty table.
    Every round is written to the shared checkpoint folder, so a lost executor costs one round at most.
    """
    a, b = F.col(left), F.col(right)
    links = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = materialise(links)
    before = _state(links)
    while before[0]:
        tasks = -(-before[0] // TASK_LINKS)
        links = materialise(_star(_star(links.coalesce(tasks), True, tasks), False, tasks))
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
