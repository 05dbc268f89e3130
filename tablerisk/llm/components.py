"""Connected components of links, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerisk.llm.store import growing, stored


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable.

    Alternates two steps that keep components and shrink paths: each node's larger neighbours move to
    its smallest neighbour, then its smaller ones do, until nothing changes. Every round's links are
    stored, which cuts the lineage; rounds grow with the logarithm of the longest path.
    """
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = stored(edges.distinct(), f"{folder}/links-0")
    round_, before = 0, None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(growing(least), "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        large = large.where("x <> y").distinct()
        down = large.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(growing(least), "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        small = small.union(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
        round_ += 1
        edges = stored(
            small.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(),
            f"{folder}/links-{round_}",
        )
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            break
        before = now
    stars = edges.groupBy("a").agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), "component").union(roots)
