"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``(id, component)`` for every end of ``links`` (``a, b``): the smallest id that it reaches.

    Alternates two steps until nothing changes, which takes about as many turns
    as the logarithm of the largest component's size. In the first each node
    links its larger neighbours to the smallest node it knows, in the second
    its smaller ones and itself. Links stay as many at most, all work is
    grouping and joining by node, and each turn's links are a written table.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = scratch.keep(ordered, f"{name}-0")
    state, turn = _state(now), 0
    while True:
        turn += 1
        larger = scratch.keep(_large_star(now, scratch, f"{name}-{turn}-large"), f"{name}-{turn}-links")
        following = scratch.keep(_small_star(larger, scratch, f"{name}-{turn}-small"), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}", f"{name}-{turn}-links", f"{name}-{turn}-large", f"{name}-{turn}-small")
        now, before = following, state
        state = _state(now)
        if state == before:
            break
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _state(links: DataFrame) -> tuple:
    """Count and checksum; the links are a set."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _large_star(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")), name)
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a > b").distinct()


def _small_star(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    least = scratch.keep(links.groupBy("a").agg(F.min("b").alias("least")), name)
    below = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.select("a", F.col("least").alias("b"))
    return below.unionByName(own).where("a > b").distinct()
