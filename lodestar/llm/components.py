"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, new_path


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node of edges(a long, b long).

    Each step only takes minima over a node's neighbours and hangs neighbours on them, so hubs cost no pairs; the steps'
    results go through the shared folder. Nodes without an edge to another node are not listed.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = new_path(spark, "star")
        df.write.parquet(path)
        own = spark.read.schema("a long, b long").parquet(path)
        mark = own.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(b as decimal(38, 0)))")).first()
        return own, path, tuple(mark)

    # Edges point from the larger node to the smaller.
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path, mark = written(down)
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the smaller neighbours of a node, and itself, hang on the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        then, new, seen = written(small.distinct())
        delete(spark, path)
        now, path = then, new
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

