"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, root): the smallest node reachable over ``links`` (columns a, b), for all nodes in links.

    Large-star and small-star steps alternate until the links are stars.  Every step is
    written below ``folder``, so lineage stays short; a node's links are only ever
    aggregated to their smallest, never gathered.
    """
    now = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, f"{folder}/links-{uuid.uuid4().hex}")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), f"{folder}/large-{uuid.uuid4().hex}")
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l")).select("l.a", "l.b")
        small = written(small.filter(F.col("a") != F.col("b")).distinct(), f"{folder}/small-{uuid.uuid4().hex}")
        changed = small.select("a").intersect(small.select(F.col("b").alias("a"))).limit(1).count() or small.count() != small.select("a").distinct().count()
        now = small
        if not changed:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
