"""Connected components of links, as Spark joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import materialized


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Large-star and small-star rounds: each node's neighbours are linked to the smallest one near it,
    until every component is a star. Smallest neighbours and links are written each time, so that a node
    with very many links is added up early, and its links are split in a join of two shuffled tables.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, seen = materialized(edges), None
    while True:
        found = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(found) == seen or not found["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = tuple(found)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialized(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = materialized(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = materialized(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("m"), F.explode(F.array("u", "v")).alias("u")).where("u <> m")
        edges = materialized(small.select("u", F.col("m").alias("v")).distinct())
