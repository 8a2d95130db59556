"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.sources.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of the pairs ``a``, ``b``.

    Alternates two steps until nothing changes: every node ties its larger neighbours to the smallest node around it,
    then its smaller ones. Each step is a shuffle of the edges whose minimum is combined before the shuffle; a hub
    with millions of neighbours is never gathered, as only its minimum is. The number of rounds grows with the
    logarithm of the longest path. Edges of each round are stored in the shared folder, which cuts the lineage.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        # Large star: around every node, tie the larger neighbours to the smallest node of all.
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: tie every node and its smaller neighbours to the smallest of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = (
            joined.select(F.col("m").alias("a"), F.col("a").alias("b"))
            .union(joined.select(F.col("m").alias("a"), "b"))
            .where("a <> b")
            .distinct()
        )
        after = materialize(small)
        same = after.count() == edges.count() and after.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
