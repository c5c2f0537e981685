"""Connected components of a link table, by alternating star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import discard, materialise


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``links``, component being its smallest node.

    Each round hangs every neighbour of a node below the smallest one, first the larger neighbours, then the rest, until
    nothing moves; the number of rounds grows with the logarithm of the longest path. Links are only joined and
    aggregated by node (a node with very many links is split by the adaptive join), never gathered. Links with a null
    end and links of a node with itself add nothing. Node ids may be any longs. Nothing moved when the number of links and two sums
    of independent hashes of them stay the same; the tables of a round are removed when the next is written.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))
    )
    edges = materialise(edges.distinct(), "links")
    before = None
    while True:
        sums = [F.sum(F.pmod(F.xxhash64(*pair), F.lit((1 << 31) - 1))) for pair in (("u", "v"), ("v", "u"))]
        state = edges.agg(F.count("*"), *sums).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        written = materialise(small.distinct(), "links")
        discard(edges)
        edges = written
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
