"""Connected components of links that are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the smallest node that can be reached, for all nodes with a link.

    ``links`` has two long columns ``a`` and ``b``.  Alternates between hanging
    larger neighbours and smaller neighbours under the smallest neighbour of a
    node until only stars are left; the number of rounds grows with the logarithm
    of the longest path.  Rounds are stored, so the plan stays short.  A node
    with very many links is met by its own row per link only; minima combine
    before the shuffle.
    """
    edges = store(_ordered(links), "links")
    while not _only_stars(edges):
        larger = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = larger.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hung = larger.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = store(hung.filter("a <> b"), "links")
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        hung = edges.join(least, "a")
        hung = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        edges = store(_ordered(hung), "links")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


def _only_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one link and is no smaller end."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 OR up > 0 AND down > 0").isEmpty()


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links, the larger node first."""
    return (
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
