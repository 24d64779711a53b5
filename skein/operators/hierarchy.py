"""Full hierarchies from parent-child rows.

Leaf peeling from the bottom: every round removes the nodes without children (rake) and splices out
an independent set of the nodes with one child (compress), so a chain of length n is gone after
O(log n) rounds instead of n. Each removed node remembers the parent it hung from when it left and
the segment of nodes between. Read back in reverse peel order, a node's path is its parent's path
plus its segment. What the peeling cannot remove shrinks to loops of one node: the cycles.

Hot parents: children are counted with a map-side combine, and joins run from child to parent, where
the parent side has one row per key; AQE splits a skewed child side. No group is collected: lists of
descendants are rows, never arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.runtime import Workspace, tidy_key


def _hash(c, r: int):
    return F.xxhash64(c, F.lit(r))


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """One row per node: id, parent_id, root_id, depth, path, in_cycle.

    Keys match ignoring case and outer white space; rows with a blank id are ignored; repeated rows
    count once, and an id with several parents keeps the smallest. A parent that is absent makes its
    child a root of depth 0. On a cycle or below one root_id and path are '' and depth is -1;
    in_cycle is 1 on the cycle itself. An empty table gives an empty result. Other columns, whatever
    their names, are not read.
    """
    spark = df.sparkSession
    ws = Workspace(spark)
    nodes = (
        df.select(tidy_key(F.col(id_col)).alias("k"), F.col(id_col).alias("id"), tidy_key(F.col(parent_col)).alias("p"), F.col(parent_col).alias("parent_id"))
        .where("k is not null")
        .groupBy("k")
        .agg(F.min("id").alias("id"), F.min("p").alias("p"), F.min_by("parent_id", "p").alias("parent_id"))
    )
    nodes, _ = ws.write(nodes, "nodes")
    known = nodes.select(F.col("k").alias("p"))
    edges = nodes.where("p is not null").join(known, "p", "left_semi").select(F.col("k").alias("v"), "p", F.array("id").alias("seg"))

    # status: 0 stays, 1 leaf, 2 spliced out, 3 loop
    rounds, r = [], 0
    while True:
        loops = F.col("v") == F.col("p")
        kids = edges.where(~loops).groupBy(F.col("p").alias("kp")).agg(F.count("*").alias("n"), F.min("v").alias("c"))
        hv, hp, hc = _hash(F.col("v"), r), _hash(F.col("p"), r), _hash(F.col("c"), r)
        marked = edges.join(kids, F.col("v") == F.col("kp"), "left").select(
            "v", "p", "seg", F.when(loops, 3).when(F.col("n").isNull(), 1).when((F.col("n") == 1) & (hv > hp) & (hv > hc), 2).otherwise(0).alias("status")
        )
        marked, seen = ws.write(marked, f"round{r}", left=F.sum(F.when(F.col("status") == 0, 1).otherwise(0)))
        rounds.append(marked)
        if not seen["left"]:
            break
        spliced = marked.where("status = 2").select(F.col("v").alias("sv"), F.col("p").alias("sp"), F.col("seg").alias("sseg"))
        edges = (
            marked.where("status = 0")
            .join(spliced, F.col("p") == F.col("sv"), "left")
            .select("v", F.coalesce("sp", "p").alias("p"), F.when(F.col("sseg").isNotNull(), F.concat("sseg", "seg")).otherwise(F.col("seg")).alias("seg"))
        )
        r += 1

    loops = None
    for t in rounds:
        x = t.where("status = 3").select("v", "seg")
        loops = x if loops is None else loops.unionByName(x)
    on_cycle = loops.select(F.explode("seg").alias("id")).select(tidy_key(F.col("id")).alias("k")).distinct().withColumn("on_cycle", F.lit(1))
    tops = (
        nodes.join(rounds[0].select(F.col("v").alias("k")), "k", "left_anti")
        .select("k", F.array("id").alias("trail"), F.lit(False).alias("cyclic"))
        .unionByName(loops.select(F.col("v").alias("k"), F.array().cast("array<string>").alias("trail"), F.lit(True).alias("cyclic")))
    )
    done, _ = ws.write(tops, "done", mode="append")
    schema = done.schema
    for t in reversed(rounds):
        for status in (2, 1):
            above = ws.read("done", schema).select(F.col("k").alias("p"), F.col("trail").alias("above"), "cyclic")
            got = t.where(F.col("status") == status).join(above, "p").select(F.col("v").alias("k"), F.when(F.col("cyclic"), F.col("above")).otherwise(F.concat("above", "seg")).alias("trail"), "cyclic")
            ws.write(got, "done", mode="append")
    return (
        nodes.join(ws.read("done", schema), "k")
        .join(on_cycle, "k", "left")
        .select(
            "id",
            "parent_id",
            F.when(F.col("cyclic"), "").otherwise(F.element_at("trail", 1)).alias("root_id"),
            F.when(F.col("cyclic"), F.lit(-1)).otherwise(F.size("trail") - 1).cast("long").alias("depth"),
            F.when(F.col("cyclic"), "").otherwise(F.array_join("trail", "/")).alias("path"),
            F.coalesce("on_cycle", F.lit(0)).cast("long").alias("in_cycle"),
            "trail",
        )
    )


def descendants(tree: DataFrame) -> DataFrame:
    """Every (ancestor, descendant, distance) row of a hierarchy() result; nodes at or below cycles have none."""
    return tree.select(F.col("id").alias("descendant_id"), "depth", F.posexplode("trail")).where("pos < depth").select(
        F.col("col").alias("ancestor_id"), "descendant_id", (F.col("depth") - F.col("pos")).cast("int").alias("distance")
    )


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """Number of descendants per node that has any, pre-aggregated before the shuffle."""
    return descendants(tree).groupBy(F.col("ancestor_id").alias("id")).agg(F.count("*").alias("descendants"), F.max("distance").alias("height"))
