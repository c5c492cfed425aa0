"""Connected components of links between 64-bit keys, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import cut, drop_cut, looked_up


def _starred(links: DataFrame, large: bool, n: int) -> DataFrame:
    """One round over n links.  Minima are summed before the shuffle; those of hubs are sent to all tasks, so no task gets a hub."""
    if large:
        links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"), "degree")
    both = looked_up(links, low, [("u", "c")], "degree", 2 * n)
    if large:  # neighbours above u hang on the least of all
        out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its neighbours below hang on the least of these
        out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _state(links: DataFrame) -> tuple[int, bool]:
    """The number of links, and whether every key hangs on one root alone and no root hangs on another: one job."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))).alias("e"))
    by = ends.groupBy("e.x").agg(F.sum("e.below").alias("below"), F.max("e.above").alias("above"))
    n, most = by.agg(F.coalesce(F.sum("below"), F.lit(0)), F.coalesce(F.max(F.col("below") + F.when(F.col("below") > 0, F.col("above")).otherwise(0)), F.lit(0))).first()
    return n, most <= 1


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every key that has a link, the root being the least key of its component, roots left out.

    ``links`` has two long columns u and v.  Each round is written to the shared folder, and the one before is deleted; what
    ``links`` was made of is no longer read when this returns.
    """
    links = cut(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        n, done = _state(links)
        if done:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        wide = cut(_starred(links, True, n), "links")
        drop_cut(links)
        links = cut(_starred(wide, False, n), "links")
        drop_cut(wide)
