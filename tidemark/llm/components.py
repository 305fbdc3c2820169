"""Connected components of a graph given as a table of edges, by alternating large and small stars.

Each round is two aggregations and joins over the edges; no vertex's neighbours are gathered in one place, and a vertex with
very many neighbours is split by the adaptive skew join because both sides of every join come from written tables.

Edge cases: edges with a null end and edges of a vertex with itself say nothing and are left out; repeated edges and edges in both
directions count once; no edges give an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import discard, settle


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every vertex that an edge touches; a component is named by its smallest vertex."""
    spark = edges.sparkSession
    kept: list[str] = []
    edges = settle(edges.where(f"{a} is not null and {b} is not null").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges", kept)
    before = None
    while True:
        spent, kept = kept, []
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large", spent)
        large = settle(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "star", spent)
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")), "small", spent)
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = settle(small.distinct(), "edges", kept)
        discard(spark, spent)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
