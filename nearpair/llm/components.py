"""Connected components of a graph that no machine holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpair.llm.tables import written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above u is linked to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u").filter("v > u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and each neighbour below it are linked to the least neighbour. Here u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").filter("v <> m")
    rest = rest.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(rest).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """`u, root` for each vertex u of `edges` (`u, v`) that is not the least of its component.

    Alternates large-star and small-star steps; each step's edges are written to the shared
    folder. A hub costs one aggregation with map-side combine and one one-sided join. Loops,
    repeated edges and null ends are left out.
    """
    edges = edges.filter("u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = written(_small_star(_large_star(edges)), "edges")
        mark, last = _mark(edges), mark
        if mark == last:
            break
    return edges.select("u", F.col("v").alias("root"))
