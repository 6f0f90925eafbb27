"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import Scratch


#: Edges of one file of a step, so that small steps are few tasks.
FILE_ROWS = 250_000


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long, not null); the
    component is the least node in it. Each step is written to the shared folder;
    it ends when the edges are stars. No edges give no rows."""
    now = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before, files = None, max(4, now.count() // FILE_ROWS)
    while True:
        count, mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not count or before == (count, mark):
            break
        before = (count, mark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(files), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        turned = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.keep(turned.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(files), "small")
        scratch.drop(now, large)
        now = small
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return scratch.keep(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
