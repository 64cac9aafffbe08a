"""Connected components: of an edge table by contraction, of a task's rows by union-find."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, passing_tables


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root of every node in edges (a, b): root is one of the nodes that it reaches, the same for all of them.

    Each round every node hooks to its least neighbour in the order of their hashes, hooks are followed once, and edges
    move to the nodes hooked to; those inside one node go. A hashed order has no long ascending paths, so about a third of
    the nodes is left after a round, whatever the ids are: a path of n nodes takes about log3(n) rounds.

    All steps are joins and aggregations on node keys. What a round aggregates is written before it is joined, so lineage
    stays short and a node that many others hook to is a skewed join, which adaptive execution splits. Nodes may be of any
    ordered type. Null nodes and loops are ignored; edges that repeat count once; no edges give no rows.
    """
    with passing_tables(edges.sparkSession) as keep:
        keep.append(_contracted(edges))
    return keep[0]


def _contracted(edges: DataFrame) -> DataFrame:
    place = lambda c: F.struct(F.xxhash64(c), F.col(c).alias("id"))
    edges = materialize(edges.filter("a <> b").select(place("a").alias("a"), place("b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up")), "hooks")
        further = hooks.select(F.col("node").alias("up"), F.col("up").alias("to"))
        hooks = materialize(hooks.join(further, "up").select("node", F.col("to").alias("up")), "hooks")
        a, b = (hooks.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in "ab")
        moved = edges.join(a, "a").join(b, "b").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
        edges = materialize(moved.filter("a <> b").distinct(), "edges")
        steps.append(hooks)
    if not steps:
        return materialize(edges.select(F.col("a.id").alias("node"), F.col("b.id").alias("root")), "roots")
    roots = steps[0].select("node", F.col("up").alias("root"))
    for hooks in steps[1:]:
        step = hooks.select(F.col("node").alias("root"), "up")
        roots = roots.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return materialize(roots.select(F.col("node.id").alias("node"), F.col("root.id").alias("root")), "roots")


def components_of(nodes: DataFrame, key: str, roots: DataFrame, out: str | None = None) -> DataFrame:
    """out (key itself by default), component_id: the least `first` among the nodes with one root; nodes without a root stand alone. Written.

    What is least of each root is written before it is joined, so a root of many nodes is a skewed join and no hot task.
    Nulls in first are passed over, no nodes give no rows.
    """
    rooted = materialize(nodes.join(roots.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key)), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    return materialize(rooted.join(least, "root").select(out or key, "component_id"), "components")


class Forest:
    """Union-find over arrays; a root is the least index of its tree. Of the pairs joined, edges are those that span the trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges = [(self.root[:0], self.root[:0])]

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.root, high, low)
            hooked = np.flatnonzero(self.root[high] == low)
            hooked = hooked[np.unique(high[hooked], return_index=True)[1]]
            self.edges.append((i[hooked], j[hooked]))
            while not np.array_equal(jumped := self.root[self.root], self.root):
                self.root = jumped
