"""Connected components of links, in rounds of large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link; root is the component's least node.

    Each round is written to the shared folder, so that lineage stays short and lost executors cost one round.
    Rounds grow with the logarithm of the longest chain. Links with a null end are ignored.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    pairs = keep(pairs, "links")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that it is a plain scan: a hub's rows may then be split among tasks where they are joined to it.
        low = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "links-least")
        large = both.join(low, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large, "links-large")
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "links-least")
        near = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = keep(near.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        # Both are distinct, so of equal size they are equal if one lacks nothing of the other.
        same = after.count() == pairs.count() and after.join(pairs, ["u", "v"], "left_anti").isEmpty()
        discard(pairs, low, large, least)
        pairs = after
        if same:
            roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each index's component, for links a-b among indices below n."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            return label
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
