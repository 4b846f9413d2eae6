"""Queries over the call graph: reachability, distances, guarded closures, regions, degrees."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import dimensions as D
from strandline.operators import graph as G
from strandline.plans.carriers import EDGE_SQL, edges
from strandline.plans.registry import query
from strandline.session import table

SEED_SQL = "seed as (select s_suppkey as node, n_regionkey as label from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 9000)"
ONE_SQL = "seed as (select s_suppkey as node from supplier where s_acctbal > 9700)"
#: Reverse reach with distances: each round joins the edges into what is known; the least depth counts.
BFS_SQL = "bfs(node, dist) as (select node, 0 from seed union select edge.src, bfs.dist + 1 from bfs join edge on edge.dst = bfs.node where bfs.dist < {most})"


def _seeds(spark, sf_dir, least):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("label"))
    return table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") > least).join(nation, "s_nationkey").select(F.col("s_suppkey").alias("node"), "label")


def _one(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter("s_acctbal > 9700").select(F.col("s_suppkey").alias("node"), F.lit(1).alias("label"))


@query("degree_counts", f"with {EDGE_SQL} select node, cast(sum(o) as bigint) as n_out, cast(sum(i) as bigint) as n_in from (select src as node, 1 as o, 0 as i from edge union all select dst, 0, 1 from edge) group by node")
def degree_counts(spark, sf_dir):
    """Out- and in-degree of each node."""
    return G.degrees(edges(spark, sf_dir))


@query(
    "reach_labels_fixpoint",
    f"""with recursive {EDGE_SQL}, {SEED_SQL}, r(node, label) as (select node, label from seed union select edge.src, r.label from r join edge on edge.dst = r.node),
    callee as (select src, count(distinct dst) as n from edge where dst in (select node from r) group by src)
    select r.node, cast(count(distinct label) as bigint) as n_labels, list_sort(list(distinct label)) as labels, cast(coalesce(max(callee.n), 0) as bigint) as n_callees from r left join callee on callee.src = r.node group by r.node""",
)
def reach_labels_fixpoint(spark, sf_dir):
    """The labels that reach each node, and how many of its callees have any."""
    e = edges(spark, sf_dir)
    found = G.reach(e, _seeds(spark, sf_dir, 9000))
    callees = e.join(found.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    sets = found.groupBy("node").agg(F.countDistinct("label").alias("n_labels"), F.array_sort(F.collect_set("label")).alias("labels"))
    return sets.join(callees, "node", "left").select("node", "n_labels", "labels", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_callees"))


@query("reach_distance", f"with recursive {EDGE_SQL}, {ONE_SQL}, {BFS_SQL.format(most=98)}, d as (select node, min(dist) as dist from bfs group by node) select s_suppkey as node, cast(coalesce(dist, 99) as integer) as dist from supplier left join d on node = s_suppkey".replace("select edge.src, bfs.dist + 1 from bfs join edge on edge.dst = bfs.node where bfs.dist < 98", "select edge.src, bfs.dist + 1 from bfs join edge on edge.dst = bfs.node where bfs.dist < 40"))
def reach_distance(spark, sf_dir):
    """Steps to the nearest seed for every node; 99 if none is reached."""
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    return G.with_unreached(nodes, G.reach(edges(spark, sf_dir), _one(spark, sf_dir)), D.UNREACHABLE)


@query("reach_k3", f"with recursive {EDGE_SQL}, {ONE_SQL}, {BFS_SQL.format(most=3)} select node, cast(min(dist) as integer) as dist from bfs group by node")
def reach_k3(spark, sf_dir):
    """Nodes within three steps of a seed."""
    return G.reach(edges(spark, sf_dir), _one(spark, sf_dir), most=D.RECALL_HOPS).groupBy("node").agg(F.min("dist").alias("dist"))


@query("up_k2", f"with recursive {EDGE_SQL}, seed as (select s_suppkey as node from supplier where s_nationkey = 3), {BFS_SQL.format(most=2)} select distinct node from bfs")
def up_k2(spark, sf_dir):
    """Two steps up from an arbitrary set."""
    seeds = table(spark, sf_dir, "supplier").filter("s_nationkey = 3").select(F.col("s_suppkey").alias("node"), F.lit(1).alias("label"))
    return G.reach(edges(spark, sf_dir), seeds, most=D.QUEUE_HOPS).select("node").distinct()


@query("reach_any", f"with recursive {EDGE_SQL}, {ONE_SQL}, r(node) as (select node from seed union select edge.src from r join edge on edge.dst = r.node) select s_suppkey as node, cast(s_suppkey in (select node from r) as integer) as reaches from supplier")
def reach_any(spark, sf_dir):
    """Whether each node reaches a seed at all."""
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    found = G.reach(edges(spark, sf_dir), _one(spark, sf_dir)).select("node", F.lit(1).alias("hit")).distinct()
    return nodes.join(found, "node", "left").select("node", F.coalesce("hit", F.lit(0)).alias("reaches"))


@query("guarded_closure", f"with recursive {EDGE_SQL}, {ONE_SQL}, r(node) as (select node from seed union select edge.src from r join edge on edge.dst = r.node join supplier on s_suppkey = edge.src where s_acctbal <= 6000) select node from r")
def guarded_closure(spark, sf_dir):
    """A closure that enters only nodes under a size bound."""
    allowed = table(spark, sf_dir, "supplier").filter("s_acctbal <= 6000").select(F.col("s_suppkey").alias("node"))
    return G.reach(edges(spark, sf_dir), _one(spark, sf_dir), allowed=allowed).select("node").distinct()


@query(
    "region_growth",
    f"""with recursive {EDGE_SQL}, single as (select dst from edge group by dst having count(*) <= 1), seed as (select distinct dst as region from edge where src % 3 = 0),
    r(region, node) as (select region, region from seed union select r.region, edge.dst from r join edge on edge.src = r.node join single on single.dst = edge.dst)
    select region, cast(count(*) as bigint) as size, cast(min(node) as bigint) as least from r group by region""",
)
def region_growth(spark, sf_dir):
    """Regions grown from branch targets through nodes of a single predecessor."""
    e = edges(spark, sf_dir)
    seeds = e.filter("src % 3 = 0").select(F.col("dst").alias("region"), F.col("dst").alias("node")).distinct()
    return G.regions(e, seeds).groupBy("region").agg(F.count("*").alias("size"), F.min("node").alias("least"))


@query(
    "back_edge_regions",
    f"""with {EDGE_SQL}, n as (select distinct node from (select src as node from edge union all select dst from edge)), o as (select node, row_number() over (order by node) as k from n)
    select e.src, e.dst, cast(a.k as bigint) as hi, cast(b.k as bigint) as lo, cast(a.k - b.k + 1 as bigint) as n_nodes from edge e join o a on a.node = e.src join o b on b.node = e.dst where b.k <= a.k""",
)
def back_edge_regions(spark, sf_dir):
    """Back edges by layout order and the size of the contiguous region that they close."""
    e = edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    order = G.numbered(nodes, "node", "k")
    met = e.join(order.select(F.col("node").alias("src"), F.col("k").alias("hi")), "src").join(order.select(F.col("node").alias("dst"), F.col("k").alias("lo")), "dst")
    return met.filter("lo <= hi").select("src", "dst", "hi", "lo", (F.col("hi") - F.col("lo") + 1).alias("n_nodes"))


@query(
    "wrapper_one_hop",
    f"""with {EDGE_SQL}, w as (select s_suppkey as node, min(n_regionkey) as cat from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 8000 group by 1)
    select e.src as node, cast(min(w.cat) as integer) as cat from edge e join w on w.node = e.dst where e.src not in (select node from w) group by 1 union all select node, cat from w""",
)
def wrapper_one_hop(spark, sf_dir):
    """A caller of a wrapper takes its first category, unless it is a wrapper itself."""
    w = _seeds(spark, sf_dir, 8000).groupBy("node").agg(F.min("label").alias("cat"))
    e = edges(spark, sf_dir)
    up = e.join(w.withColumnRenamed("node", "dst"), "dst").join(w.select(F.col("node").alias("src")), "src", "left_anti").groupBy(F.col("src").alias("node")).agg(F.min("cat").alias("cat"))
    return up.unionByName(w)


@query(
    "wrapper_direction",
    f"""with recursive {EDGE_SQL}, w as (select s_suppkey as node, s_acctbal > 8500 as reads from supplier where s_acctbal > 0),
    e as (select src, dst from edge where src in (select node from w) and dst in (select node from w)),
    walk(a, b) as (select src, dst from e union select walk.a, e.dst from walk join e on e.src = walk.b),
    s as (select node from w where reads union select a from walk where a = b),
    r(node) as (select node from s union select e.src from r join e on e.dst = r.node) select node from r""",
)
def wrapper_direction(spark, sf_dir):
    """Wrappers that read: by an origin of their own, through another wrapper, or by being on a cycle."""
    held = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("node"), (F.col("s_acctbal") > 8500).alias("reads"))
    return G.read_wrappers(edges(spark, sf_dir), held, held)
