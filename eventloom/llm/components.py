"""Connected components of a table of links, by alternating large and small stars.

Each step rewrites the links with two grouped joins; their number is logarithmic in the size of
the largest component in practice. Every step is written to the shared folder, so the lineage
stays short and lost executors cost a re-read. No component is gathered in one task: a step uses
sums and minima per node, which combine before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import materialize


def _neighbours(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    return both


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each pair with the least of its node's others and the node itself.

    The minima are stored, so that the join has two plain shuffles, whose hot nodes Spark splits.
    """
    least = pairs.groupBy("node").agg(F.min("other").alias("m")).withColumn("m", F.least("node", "m"))
    return pairs.join(materialize(least, "least"), "node")


def _step(links: DataFrame) -> DataFrame:
    large = _with_least(_neighbours(links)).filter(F.col("other") > F.col("node")).select(F.col("other").alias("a"), F.col("m").alias("b"))
    large = large.filter("a != b").distinct()
    down = large.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    small = _with_least(down)
    moved = small.select(F.col("other").alias("a"), F.col("m").alias("b")).union(small.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return moved.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of a link can reach; links are (a, b)."""
    current = materialize(links.select("a", "b").filter("a != b").distinct(), "links")
    state = None
    while True:
        new = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if new == state or new.n == 0:
            break
        state = new
        current = materialize(_step(current), "links")
    labels = current.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("component"))
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    return labels.union(roots).distinct()
