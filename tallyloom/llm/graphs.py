"""Connected components over edge tables, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, shared_table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node reachable) of every node of an undirected edge table.

    Each round takes the least label among a node's own and its neighbours', then the label of
    that label (pointer jumping); it ends when nothing changes. Rounds are written to the shared
    folder. Hubs are safe: labels are minima with map-side combining, joins can be split.
    Nulls, loops and repeated edges are ignored; an empty table gives no rows.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = shared_table(both.union(both.select("other", "node")).distinct(), "cc-edges")
    labels = shared_table(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("r")), "other").groupBy("node").agg(F.min("r").alias("r"))
        new = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        step = shared_table(new.join(jump, "mid", "left").select("node", "old", F.least("mid", "far").alias("root")), "cc-labels")
        done = step.where("root <> old").isEmpty()
        discard(labels)
        labels = step
        if done:
            discard(both)
            return labels
