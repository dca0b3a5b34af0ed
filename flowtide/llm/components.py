"""Connected components by alternating large-star and small-star steps, all in joins and aggregates.

Each round is written to the shared folder, so lineage stays short and a lost executor costs one round.
Minima come from aggregates (combined before the shuffle) and are joined back, so that AQE can split a
star with very many members; nothing is collected per node.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def _to_minimum(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of u and all its v."""
    least = edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    return edges.join(least, edges["u"] == least["k"]).select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _to_minimum(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    ends = F.explode(F.array("u", "v"))
    return down.select(ends.alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v: long) but the roots; a root is its component's least node."""
    edges, before = materialize(edges.filter("u <> v"), "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges, before = materialize(_small_star(_large_star(edges)), "edges"), state
