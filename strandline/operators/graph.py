"""Reachability over edges (src, dst): frontier loops whose lineage is cut by reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the cluster's shared folder (spark.checkpoint.dir); where that is unset and the master is local, in
    one of our own. On a cluster without the setting there is no folder that executors share, which is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandline-"))
    return df.checkpoint()


def _none(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def reach(edges: DataFrame, seeds: DataFrame, most: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(node, label, dist): every node from which an edge path leads to a seed (node, label), with the fewest steps.

    Label by label the least distance; seeds have 0. ``most`` bounds the steps; with ``allowed`` (node) only those nodes
    are entered after the seeds. Semi-naive: a round joins only what the last one found, and a pair is never found twice,
    so cycles end.
    """
    into = cut(edges.select("src", "dst").distinct())
    if allowed is not None:
        into = into.join(allowed.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    found = cut(seeds.select("node", "label").distinct().withColumn("dist", F.lit(0)))
    frontier, step = found, 0
    while most is None or step < most:
        step += 1
        new = into.join(frontier.select(F.col("node").alias("dst"), "label"), "dst").select(F.col("src").alias("node"), "label").distinct()
        new = cut(new.join(found, ["node", "label"], "left_anti").withColumn("dist", F.lit(step)))
        if new.isEmpty():
            break
        found, frontier = found.unionByName(new), new
    return found


def with_unreached(nodes: DataFrame, found: DataFrame, far: int) -> DataFrame:
    """Every node with its least distance over labels, or ``far``."""
    near = found.groupBy("node").agg(F.min("dist").alias("dist"))
    return nodes.join(near, "node", "left").select("node", F.coalesce("dist", F.lit(far)).alias("dist"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in) over distinct edges, in one aggregation."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select(F.col("dst"), F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def regions(edges: DataFrame, seeds: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """(region, node): what grows from each seed (region, node) along edges into nodes of at most one predecessor, or, if
    ``closed`` (node) is given, into nodes that are not in it; the seed itself is exempt."""
    e = cut(edges.select("src", "dst").distinct())
    if closed is None:
        closed = e.groupBy("dst").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("dst").alias("node"))
    steps = cut(e.join(closed.select(F.col("node").alias("dst")), "dst", "left_anti"))
    found = frontier = cut(seeds.select("region", "node").distinct())
    while True:
        new = frontier.select("region", F.col("node").alias("src")).join(steps, "src").select("region", F.col("dst").alias("node")).distinct()
        new = cut(new.join(found, ["region", "node"], "left_anti"))
        if new.isEmpty():
            return found
        found, frontier = found.unionByName(new), new


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges that are left when those from nodes without a predecessor, or to nodes without a successor, are taken
    away until none is: all cycles, and the paths between them."""
    left = cut(edges.select("src", "dst").distinct())
    n = left.count()
    while n:
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = cut(kept.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, n, left = n, kept.count(), kept
        if n == before:
            break
    return left


def on_cycle(edges: DataFrame) -> DataFrame:
    """(node): nodes that reach themselves by at least one step.

    Edges are trimmed first. Then colours spread until none changes, each node taking the largest node that reaches it;
    a colour's own node is on a cycle if a node of its colour leads back to it, and then so are all nodes of that colour
    that reach it. Those components leave, and the rest is trimmed and coloured again. So work follows edges and rounds,
    never pairs of nodes.
    """
    found = None
    left = trimmed(edges)
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colour = cut(nodes.withColumn("colour", F.col("node")))
        while True:
            seen = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("from")), "src").groupBy(F.col("dst").alias("node")).agg(F.max("from").alias("best"))
            after = cut(colour.join(seen, "node", "left").select("node", F.greatest("colour", "best").alias("colour"), (F.col("best") > F.col("colour")).alias("moved")))
            colour = after.select("node", "colour")
            if after.filter("moved").isEmpty():
                break
        same = left.join(colour.withColumnRenamed("node", "src"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c")), "dst").filter("colour = c").select("src", "dst", "colour")
        # backwards from each colour's own node, within the colour: its strong component
        back = reach(same, same.filter("dst = colour").select(F.col("colour").alias("node"), F.lit(0).alias("label")).distinct())
        on = cut(back.select("node").distinct())
        found = on if found is None else found.unionByName(on)
        gone = on.unionByName(colour.filter("node = colour").select("node")).distinct()
        left = trimmed(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    return found if found is not None else edges.select(F.col("src").alias("node")).limit(0)


def read_wrappers(edges: DataFrame, origins: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Wrappers (node) that read: any of their origins (node, reads) reads, a wrapper that they call reads, or they are on
    a cycle of wrappers. The least fixpoint, by definition independent of the order of visits."""
    own = wrappers.select("node").distinct()
    among = edges.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi")
    looped = on_cycle(among)
    seeds = origins.filter("reads").select("node").unionByName(looped).distinct().join(own, "node", "left_semi").withColumn("label", F.lit("read"))
    return reach(among, seeds).select("node").distinct()


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with the place, from 1, of each row in the order of ``key``: rows are dealt out by range and numbered there,
    starting from the sizes of the ranges before."""
    ranged = cut(df.repartitionByRange(key).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__m"))  # a row for each range
    before = F.coalesce(F.sum("__m").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(key))
    return ranged.withColumn("__own", own).join(sizes.select("__p", before.alias("__before")), "__p").select(*df.columns, (F.col("__before") + F.col("__own")).alias(name))
