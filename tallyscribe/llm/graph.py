"""Connected components of a table of links, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscribe.llm.frames import beside
from tallyscribe.sources.storage import cut_lineage


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)`` that is not its component's smallest.

    Alternates two steps until nothing changes: every node sends its larger neighbours to its smallest one, then its
    smaller neighbours and itself to the smallest of them. Only minima are gathered per node, never a list of neighbours,
    and the number of links does not grow. No links, no rows.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # (a, b): b < a, and b is as near to the smallest as a's neighbours know
        edges = both.join(beside(low, 2 * state[0]), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        near = edges.join(beside(low, 2 * state[0]), "a")
        edges = (
            near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        )
        edges = cut_lineage(edges, "links")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
