"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, save


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """``pairs(u, v)`` with ``m``, the smallest of u and all its v.

    The minimum is combined before the shuffle, and the join back can be split,
    so a node with very many neighbours is no single task's work.
    """
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    large = _to_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    small = _to_minimum(large.distinct())
    kept = small.select(F.col("u").alias("hi"), F.col("m").alias("lo"))
    moved = small.where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return kept.unionByName(moved).where("hi <> lo").distinct()


def _state(edges: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), mark).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the component's smallest node.

    u and v are of one orderable type.  Self-loops and repeated edges change
    nothing; rows with a null end are no edges.  No edges: an empty table.
    Each round is written to the shared folder, so a lost executor costs at most
    one round.  Only a count and a checksum reach the driver.
    """
    current = save(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo"))
        .distinct(),
        "edges",
    )
    before = _state(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        following = save(_round(current), "edges")
        discard(current)
        current, after = following, _state(following)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
