import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import graph as G
from strandline.operators import positional as P
from strandline.operators import relational as R


def brute(edges, seeds):
    dist = {(n, x): 0 for n, x in seeds}
    front = set(dist)
    step = 0
    while front:
        step += 1
        front = {(s, x) for s, d in edges for n, x in front if n == d} - set(dist)
        dist |= dict.fromkeys(front, step)
    return dist


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_is_closure(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(18)]
    seeds = [(rng.randrange(12), x) for x in "ab"]
    found = G.reach(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame(seeds, "node int, label string"))
    assert {(r.node, r.label): r.dist for r in found.collect()} == brute(edges, seeds)


def test_reach_empty_and_cycle(spark):
    none = spark.createDataFrame([], "src int, dst int")
    seeds = spark.createDataFrame([(1, "a")], "node int, label string")
    assert [tuple(r) for r in G.reach(none, seeds).collect()] == [(1, "a", 0)]
    loop = spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int")
    assert G.reach(loop, seeds).count() == 2
    chain = spark.createDataFrame([(k + 1, k) for k in range(1, 6)], "src int, dst int")
    assert G.reach(chain, seeds, most=3).count() == 4


def test_read_wrappers_cycle_reads(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 5)], "src int, dst int")
    nodes = spark.createDataFrame([(1, False), (2, False), (3, False), (4, False), (5, False)], "node int, reads boolean")
    assert sorted(r.node for r in G.read_wrappers(edges, nodes, nodes).collect()) == [1, 2, 3]


def test_range_lookup_bounds(spark):
    points = spark.createDataFrame([(0.0,), (9.999,), (10.0,), (35.0,)], "x double")
    spans = spark.createDataFrame([(0, 0.0, 10.0), (1, 5.0, 30.0), (2, 50.0, 50.0)], "ord int, lo double, hi double")
    got = {r.x: r.ord for r in R.range_lookup(points, spans, "x", "lo", "hi", "ord", 7).collect()}
    assert got == {0.0: 0, 9.999: 0, 10.0: 1}


def test_staged_union_identity(spark):
    f = lambda xs: spark.createDataFrame([(x,) for x in xs], "k int")
    out = {r.k: r.recovered for r in R.staged_union(f([1, 2]), f([2, 3, 4]), f([3, 2]), ["k"]).collect()}
    assert out == {1: 0, 2: 0, 3: 1}


@pytest.mark.parametrize("n,want", [(1, {"train": 1}), (2, {"train": 1, "test": 1}), (3, {"train": 1, "validation": 1, "test": 1}), (10, {"train": 6, "validation": 2, "test": 2})])
def test_split_sizes(spark, n, want):
    df = P.proportional_split(spark.range(n).withColumn("s", F.lit(0)), ["s"], F.col("id"))
    got = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert got == want


def test_partition_invariance(spark):
    from strandline.plans.streams import mode_first_seen

    results = []
    for n in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, mode_first_seen(spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert results[0] == results[1]
