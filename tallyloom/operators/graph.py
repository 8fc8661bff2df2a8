"""Dependency graphs: levels, exact first-in-first-out orders, free names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topological_order(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """Kahn's order of each group's nodes (node, ord), ready ones first in, first out; members of cycles follow in their own order.

    A group is one script, so it is ordered as a whole; edges to itself or repeated count once or not at all.
    """
    import pandas as pd

    both = nodes.select(group, "node", "ord", F.lit(None).cast("string").alias("needs")).unionByName(edges.select(group, "node", F.lit(None).cast("long").alias("ord"), "needs"))

    def order(g: pd.DataFrame) -> pd.DataFrame:
        from collections import deque

        names = list(g[g["ord"].notna()].sort_values("ord")["node"])
        known = set(names)
        needs = {n: set() for n in names}
        for n, d in g[g["needs"].notna()][["node", "needs"]].itertuples(index=False):
            if n in known and d in known and n != d:
                needs[n].add(d)
        users: dict[str, list[str]] = {n: [] for n in names}
        for n in names:
            for d in needs[n]:
                users[d].append(n)
        waiting = {n: len(d) for n, d in needs.items()}
        ready, out = deque(n for n in names if not waiting[n]), []
        while ready:
            out.append(n := ready.popleft())
            for u in users[n]:
                waiting[u] -= 1
                if not waiting[u]:
                    ready.append(u)
        done = set(out)
        out += [n for n in names if n not in done]
        return pd.DataFrame({group: g[group].iloc[0], "node": out, "place": range(len(out))})

    schema = nodes.select(group, "node", F.lit(0).cast("long").alias("place")).schema
    return both.groupBy(group).applyInPandas(order, schema)


def stored(df: DataFrame) -> DataFrame:
    """Computed once, in the folder of spark.checkpoint.dir; a local master without one (tests) gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='tallyloom-cp-')}")
    return df.checkpoint()


def levels(edges: DataFrame) -> DataFrame:
    """Longest distance of each node from the nodes without edges in (parent, child), to any depth.

    Nodes that no such node leads to are left out, as are edges with a null end; a cycle that one leads to is a ValueError.
    A node is done in the round after the last of its parents.
    """
    edges = edges.where("parent is not null and child is not null").select("parent", "child").distinct().transform(stored)
    children = lambda e: e.select(F.col("child").alias("node")).distinct()
    of = lambda nodes: nodes.withColumnRenamed("node", "parent")
    roots = edges.select(F.col("parent").alias("node")).distinct().join(children(edges), "node", "left_anti").transform(stored)
    seen = front = roots
    while not front.isEmpty():
        front = children(edges.join(of(front), "parent", "left_semi")).join(seen, "node", "left_anti").transform(stored)
        seen = seen.union(front).transform(stored)
    left, front, level = edges.join(of(seen), "parent", "left_semi").transform(stored), roots, 0
    out = roots.withColumn("level", F.lit(0))
    while not front.isEmpty():
        rest = left.join(of(front), "parent", "left_anti").transform(stored)
        front = children(left.join(of(front), "parent", "left_semi")).join(children(rest), "node", "left_anti").transform(stored)
        left, level = rest, level + 1
        out = out.union(front.withColumn("level", F.lit(level)))
    if not left.isEmpty():
        raise ValueError("levels: a node without edges in leads to a cycle")
    return out


def free_names(uses: DataFrame, definitions: DataFrame, group: str) -> DataFrame:
    """Uses of names that nothing before them in their group defines."""
    first = definitions.groupBy(group, "name").agg(F.min("at").alias("defined_at"))
    return uses.join(first, [group, "name"], "left").where(F.col("defined_at").isNull() | (F.col("defined_at") >= F.col("at"))).select(group, "name", "at")


def preorder(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes of trees (parent, child, ord) below ``roots`` (node, ord), with depth and path; paths sort as a walk from the top does.

    One round a depth. A node that is its own ancestor is a ValueError.
    """
    step = lambda o: F.lpad(F.col(o).cast("string"), 12, "0")
    front = roots.select("node", F.lit(0).alias("depth"), step("ord").alias("path"), F.array("node").alias("above")).transform(stored)
    out = front
    while not front.isEmpty():
        below = front.join(edges.withColumnRenamed("parent", "node"), "node")
        below = below.select(F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", step("ord")).alias("path"), "above")
        front = below.withColumn("cycle", F.array_contains("above", F.col("node"))).withColumn("above", F.concat("above", F.array("node"))).transform(stored)
        if not front.where("cycle").isEmpty():
            raise ValueError("preorder: a node is below itself")
        front = front.drop("cycle")
        out = out.unionByName(front)
    return out.select("node", "depth", "path")


def budgeted(items: DataFrame, group: str, order: list[str], cost: str, budget: int, most: int) -> DataFrame:
    """Items of each group in order as long as the budget holds, each costing ``most`` at most; the one that goes over is the last."""
    own = F.least(F.col(cost), F.lit(most))
    w = Window.partitionBy(group).orderBy(*order)
    return items.withColumn("spent", F.sum(own).over(w)).where(F.col("spent") - own < budget)
