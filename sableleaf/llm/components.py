"""Connected components as relational rounds, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, staged


def _print(edges: DataFrame):
    """Count and two order-free sums over a set of edges: alike only if nothing changed."""
    h = F.xxhash64("u", "v")
    return edges.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node that has an edge: (node, component).

    Alternates large-star and small-star rounds until no edge changes. Each round
    is written to the shared folder, the one before it deleted. A node's edges are
    met by the minimum over its neighbours, which is pre-aggregated, and by a join
    that Spark can split, so a hub is never gathered in one task. Self links and
    null ends are left out; repeated and reversed edges count once; without edges
    the result is empty.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    with Scratch(edges.sparkSession) as tmp:
        e = tmp.staged(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        before = _print(e)
        while True:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
            large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            # a node that is itself the minimum keeps its larger neighbours: v -> m = u
            large = tmp.staged(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large")
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
            after = tmp.staged(small.distinct(), "small")
            tmp.drop(e, large)
            e, last, before = after, before, _print(after)
            if before == last:
                break
        out = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
        return staged(out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
