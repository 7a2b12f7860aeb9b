"""Connected components of a graph in a table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, scratch, written


def _to_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours as m. The least is aggregated before it is dealt out, and nodes of very many edges are joined where these are."""
    least = written(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c")))
    return join_counted(edges, least, "u", total, "v").select("u", "v", "m")


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


@scratch
def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges (u long, v long); component is the least id that can be reached, the node's own included.

    Repeated edges, loops, and edges with a null end do no harm; a node that has only loops or null partners isn't listed. An empty table gives an empty one.
    Each round is a written table; only counts and a check sum come to the driver, and the rounds grow as the logarithm of the longest path.
    """
    now, mark = written(_tidy(edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL"))), None
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not found.n or found == mark:
            break
        mark = found
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, 2 * found.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        near = _to_least(written(_tidy(large)), found.n)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        now = written(_tidy(small))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
