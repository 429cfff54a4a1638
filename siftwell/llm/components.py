"""Distributed union-find: connected components by hooking to the smallest neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a long, b long)`` -> ``(id long, component long)``, component the smallest id that is reachable; one row per id that
    has an edge to another id. Self loops, repeats and either direction are fine; no edges give no rows.

    Each round every vertex points to its smallest neighbour (pointers only go down, so they form trees), two jumps shorten the
    trees, and edges are renamed to what their ends point at. A tree's root is its least vertex. Rounds grow with the logarithm of
    the longest path. The minimum is pre-aggregated before its shuffle, so a hub's neighbours do not meet in one task, and joins on
    a hub are plain equi-joins that adaptive execution splits. Nothing is collected; each round's tables are written to the shared
    folder, and its edges dropped when the next are there.
    """
    edges = scratch.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("p"))
        up = scratch.save(up)
        far = up.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        jumped = up.join(far, "p").select("id", F.col("pp").alias("p"))
        here = scratch.save(jumped)
        to_a = here.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        to_b = here.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        renamed = edges.join(to_a, "a").join(to_b, "b").filter("pa <> pb")
        rest = scratch.save(renamed.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct())
        scratch.drop(edges, up)
        edges = rest
        maps.append(here)
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = maps[0].select("id", F.col("p").alias("component"))
    for step in maps[1:]:
        nxt = step.select(F.col("id").alias("component"), F.col("p").alias("_next"))
        out = out.join(nxt, "component", "left").select("id", F.coalesce("_next", "component").alias("component"))
    return scratch.save(out)


def extended(found: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """The components ``found(id, component)`` after the edges ``more(a, b)`` are added to theirs: the edges are taken between components, so
    what was united before is not gone over again."""
    ends = scratch.save(more.select("a", "b"))
    to_a = found.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    to_b = found.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    edges = ends.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    step = components(edges, scratch).select(F.col("id").alias("component"), F.col("component").alias("_to"))
    alone = ends.select(F.col("a").alias("id")).unionByName(ends.select(F.col("b").alias("id"))).distinct().join(found, "id", "left_anti")
    every = found.unionByName(alone.select("id", F.col("id").alias("component")))
    return scratch.save(every.join(step, "component", "left").select("id", F.coalesce("_to", "component").alias("component")))
