"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join; the edges never leave the
executors, and only a row count and a checksum reach the driver. The number of
steps grows with the logarithm of a component's size, not with its diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
    if not large:
        both = both.where(F.col("_v") < F.col("_u"))
    least = both.groupBy("_u").agg(F.min("_v").alias("_m")).select("_u", F.least("_u", "_m").alias("_m"))
    moved = both.where(F.col("_v") > F.col("_u")) if large else both
    out = moved.join(least, "_u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
    if not large:
        out = out.unionByName(least.select("_u", F.col("_m").alias("_v")))
    return out.where(F.col("_u") != F.col("_v")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)")), F.lit(0))).first()
    return int(r[0]), int(r[1])


def connected_components(edges: DataFrame, u: str, v: str, max_steps: int = 100) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Edges need no order and may repeat or be loops; rows with a null end are
    left out. Nodes without an edge are not in the result. No edges: no rows.
    """
    named = edges.select(edges[f"`{u}`"].alias("_u"), edges[f"`{v}`"].alias("_v"))
    now = checkpointed(named.where(F.col("_u") != F.col("_v")).distinct())
    state = _state(now)
    if not state[0]:
        return now.toDF("node", "component")
    for _ in range(max_steps):
        now = checkpointed(_star(_star(now, True), False))
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    roots = now.select(F.col("_v").alias("node"), F.col("_v").alias("component")).distinct()
    return now.select(F.col("_u").alias("node"), F.col("_v").alias("component")).unionByName(roots)


def extended(found: DataFrame, links: DataFrame, u: str, v: str) -> DataFrame:
    """The components found (node, component) with further links between nodes; found itself if there are none."""
    if links.isEmpty():
        return found
    return connected_components(found.select(F.col("node").alias(u), F.col("component").alias(v)).unionByName(links.select(u, v)), u, v)
